"""Attribute values as JSON text: reading, comparing and matching them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(value: Any) -> str:
    """A Python value as the canonical JSON text used in attribute maps."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def plain_text(value: Any) -> str:
    """A Python value without the quotes a JSON string would have."""
    return value if isinstance(value, str) else json_text(value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: keeps deep expressions small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_string(value: Column) -> Column:
    return value.startswith('"')


def string_value(text: Column) -> Column:
    """A string column as JSON text."""
    return F.when(~text.rlike(r'["\\\\\x00-\x1f\x7f-\uffff]'), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
        F.to_json(text.cast("variant")))


def plain(value: Column) -> Column:
    """JSON text without string quotes; other values keep their text."""
    return (
        F.when(~value.startswith('"'), value)
        .when(~value.contains("\\"), F.substring(value, F.lit(2), F.length(value) - 2))
        .otherwise(F.get_json_object(F.concat(F.lit("["), value, F.lit("]")), "$[0]"))
    )


def text_or_number(value: Column) -> Column:
    """A non-empty string or a number as text, else null."""
    return let(value, lambda v: F.when(v.startswith('"') & (v != '""'), plain(v)).when(v.rlike(r"^-?[0-9]"), v))


def attribute(key: str, attributes: str = "attributes", resource: str = "resource") -> Column:
    """A span attribute, else the resource attribute of that name."""
    return F.coalesce(
        F.try_element_at(F.col(attributes), F.lit(key)),
        F.try_element_at(F.col(resource), F.lit(key)),
    )


# ------------------------------------------------------------ patterns

def regex(pattern: str) -> str:
    """A pattern with Unicode classes, ``\\n`` as the only line end and ``$``
    as the very end of the text, written in the dialect Spark uses."""
    if re.search(r"\(\?[a-z]*m", pattern):
        return "(?Ud)" + pattern
    out, in_class, escaped = [], False, False
    for char in pattern:
        if escaped:
            escaped = False
        elif char == "\\":
            escaped = True
        elif char == "[":
            in_class = True
        elif char == "]":
            in_class = False
        elif char == "$" and not in_class:
            char = r"\z"
        out.append(char)
    return "(?Ud)" + "".join(out)


def glob_regex(pattern: str) -> str:
    """``*`` any run, ``?`` one character, the rest literal, whole text."""
    body = re.sub(r"[^*?]+|[*?]", lambda m: {"*": ".*", "?": "."}.get(m[0]) or _quote(m[0]), pattern)
    return rf"(?s)\A{body}\z"


def _quote(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def is_glob(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def glob(pattern: str, text: Column) -> Column:
    """Whether the text matches the glob; the cheapest form that is exact."""
    if not is_glob(pattern):
        return text == F.lit(pattern)
    if "?" not in pattern:
        parts = pattern.split("*")
        if not any(parts):
            return text.isNotNull()
        if len(parts) == 2 and not parts[1]:
            return text.startswith(parts[0])
        if len(parts) == 2 and not parts[0]:
            return text.endswith(parts[1])
        if len(parts) == 3 and not parts[0] and not parts[2]:
            return text.contains(parts[1])
    return text.rlike(glob_regex(pattern))


def value_matches(expected: Any, actual: Column) -> Column:
    """Whether an attribute meets an expectation: ``"!"`` absent, ``"*"``
    present, ``"re:..."`` a pattern, anything else equal (``3`` equals ``"3"``)."""
    missing = actual.isNull() | (actual == "null")
    if expected == "!":
        return missing
    if isinstance(expected, str) and expected == "*":
        return ~missing
    if isinstance(expected, str) and expected.startswith("re:"):
        met = plain(actual).rlike(regex(expected[3:]))
    else:
        met = plain(actual) == F.lit(plain_text(expected))
    return ~missing & F.coalesce(met, F.lit(False))
