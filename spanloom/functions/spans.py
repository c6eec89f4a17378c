"""Columns computed from one span."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.values import attribute, let, plain, text_or_number

#: Kinds by their OTLP number (0 and 1 are internal).
KIND_BY_NUMBER = {2: "server", 3: "client", 4: "producer", 5: "consumer"}
NUMBER_BY_KIND = {"internal": 1, "server": 2, "client": 3, "producer": 4, "consumer": 5}
#: Spellings of kinds other systems use.
KIND_BY_NAME = {
    "internal": "internal", "unspecified": "internal", "": "internal",
    "server": "server", "rpc_server": "server",
    "client": "client", "rpc_client": "client",
    "producer": "producer", "consumer": "consumer",
}
KINDS = ("internal", "server", "client", "producer", "consumer")


#: The spellings as they mostly come, so that few names have to be cleaned.
_PLAIN_KINDS = KIND_BY_NAME | {name.upper(): kind for name, kind in KIND_BY_NAME.items()} | {
    f"SPAN_KIND_{name.upper()}": kind for name, kind in KIND_BY_NAME.items() if name}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def kind_from_name(text: Column) -> Column:
    """A kind by name in any case, with or without the OTLP prefix."""
    name = F.regexp_replace(F.lower(text), r"\A(span_kind_)+", "")
    return F.coalesce(_lookup(_PLAIN_KINDS, text), _lookup(KIND_BY_NAME, name), F.lit("internal"))


def kind_from_number(number: Column) -> Column:
    return F.coalesce(_lookup(KIND_BY_NUMBER, number.cast("int")), F.lit("internal"))


def duration_ns(start: str = "start_ns", end: str = "end_ns") -> Column:
    return F.greatest(F.col(end) - F.col(start), F.lit(0).cast("long"))


def duration_ms(start: str = "start_ns", end: str = "end_ns") -> Column:
    return duration_ns(start, end).cast("double") / F.lit(1e6)


def is_error(status: str = "status") -> Column:
    return F.col(status) == "error"


def host_of(url: Column) -> Column:
    """The host of a URL, port kept and user information dropped."""
    authority = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.nullif(F.regexp_replace(authority, r"(?s)\A.*@", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The path of a URL without query or fragment, ``/`` when there is none."""
    rest = F.regexp_replace(url, r"(?s)\A.*?://", "")
    return F.coalesce(
        F.regexp_extract(F.when(rest.contains("/"), F.regexp_replace(rest, r"(?s)\A[^/]*", "")), r"(?s)\A([^?#]*)", 1),
        F.lit("/"),
    )


# Attribute names of the semantic conventions, best first.
_DB_SYSTEM = ("db.system", "db.system.name")
_DB_NAME = ("db.namespace", "db.name")
_DESTINATION = ("messaging.destination.name", "messaging.destination")
_ADDRESS = ("server.address", "net.peer.name", "http.host")
_URLS = ("url.full", "http.url")


_PEER_KEYS = ("peer.service", *_DB_SYSTEM, *_DB_NAME, *_DESTINATION, "messaging.system", "rpc.service", *_ADDRESS, *_URLS)


def peer(attributes: str = "attributes", resource: str = "resource") -> Column:
    """What a client or producer span talks to, by the semantic conventions."""
    # Bound outside the loop over the keys: derived maps would be built once a key.
    raw = let(F.struct(F.col(attributes).alias("a"), F.col(resource).alias("r")), lambda m: F.transform(
        F.array(*[F.lit(k) for k in _PEER_KEYS]), lambda k: F.coalesce(F.try_element_at(m["a"], k), F.try_element_at(m["r"], k))))

    def choose(texts: Column) -> Column:
        def first(keys) -> Column:
            return F.coalesce(*[F.get(texts, F.lit(_PEER_KEYS.index(k))) for k in keys])

        # concat_ws drops a missing database name.
        database = F.when(first(_DB_SYSTEM).isNotNull(), F.concat_ws(":", first(_DB_SYSTEM), first(_DB_NAME)))
        return F.coalesce(
            first(["peer.service"]), database, first([*_DESTINATION, "messaging.system", "rpc.service", *_ADDRESS]),
            *[host_of(first([k])) for k in _URLS])

    # A one-element array stands in for a local variable, so each key is read once.
    return F.get(F.transform(F.array(F.transform(raw, text_or_number)), choose), F.lit(0))


# ------------------------------------------------------------- code places

CODE_TYPE = "struct<file:string,line:bigint,function:string>"


def parse_code(text: Column) -> Column:
    """``path/file.ext[:line][:function]`` as a struct; null when the path has
    no extension. A trailing ``(note)`` is dropped, a drive letter kept."""
    def located(path: Column, parts: Column) -> Column:
        name = F.regexp_extract(path, r"(?s)([^/\\]*)\z", 1)
        rest = F.filter(F.transform(F.slice(parts, 2, 1 << 20), F.trim), lambda p: p != "")
        numbers = lambda r: F.filter(r, lambda p: p.rlike(r"\A\+?[0-9]+\z") & (p.try_cast("long") <= 4294967295))
        # The first number is the line; of everything else the last is the function.
        others = lambda r, line: F.filter(r, lambda p, i: line.isNull() | (i + 1 != F.array_position(r, line)))
        found = let(rest, lambda r: let(F.get(numbers(r), F.lit(0)), lambda line: F.struct(
            path.alias("file"), line.cast("long").alias("line"),
            F.element_at(F.concat(F.array(F.lit(None).cast("string")), others(r, line)), -1).alias("function"))))
        return let(name, lambda n: F.when(n.contains(".") & ~n.endswith("."), found))

    def split(trimmed: Column) -> Column:
        drive = F.regexp_extract(trimmed, r"\A([A-Za-z]:)(?=.)", 1)
        return let(drive, lambda d: let(F.split(F.substring(trimmed, F.length(d) + 1, F.lit(1 << 30)), ":"), lambda parts: let(
            F.concat(d, F.get(parts, F.lit(0))), lambda path: located(path, parts))))

    return let(F.trim(F.substring_index(F.trim(text), " (", 1)), split).cast(CODE_TYPE)


def code_from_attributes() -> Column:
    """A span's code location from its ``code.*`` attributes."""
    def first(*keys: str) -> Column:
        return F.coalesce(*[text_or_number(attribute(k)) for k in keys])

    file = first("code.file.path", "code.filepath")
    line = first("code.line.number", "code.lineno")
    return F.when(file.isNotNull(), F.struct(
        file.alias("file"),
        let(line, lambda t: F.when(t.rlike(r"\A\+?[0-9]+\z") & (t.try_cast("long") <= 4294967295), t.try_cast("long"))).alias("line"),
        first("code.function.name", "code.function").alias("function"),
    )).cast(CODE_TYPE)


def visible_attributes(attributes: Column) -> Column:
    """Attributes worth showing in text: tooling noise is hidden."""
    # The prefixes and keys left out.
    prefixes, keys = ("otel.", "telemetry.", "thread.", "code."), ("span.kind", "peer.service")

    def shown(key: Column) -> Column:
        hidden = key.isin(*keys)
        for prefix in prefixes:
            hidden = hidden | key.startswith(prefix)
        return ~hidden

    return F.map_filter(attributes, lambda k, _: shown(k))

