"""What users declare: expected flows and the catalog of planned spans.

Strict JSON: unknown fields are refused with a reason.
"""

from __future__ import annotations

import dataclasses
import json
import re
from dataclasses import dataclass, field
from typing import Any

from spanloom.functions.spans import KIND_BY_NAME, KINDS

ORDERS = ("sequence", "any")
DEFAULT_SETTLE_SECS = 10


def _strict(cls: type, data: Any, where: str) -> dict[str, Any]:
    if not isinstance(data, dict):
        raise ValueError(f"{where}: expected an object")
    known = {f.metadata.get("json", f.name) for f in dataclasses.fields(cls)}
    for key in data:
        if key not in known:
            raise ValueError(f"{where}: unknown field {key!r}")
    for f in dataclasses.fields(cls):
        name = f.metadata.get("json", f.name)
        required = f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING
        if required and name not in data:
            raise ValueError(f"{where}: missing field {name!r}")
    return {f.name: data[f.metadata.get("json", f.name)] for f in dataclasses.fields(cls)
            if data.get(f.metadata.get("json", f.name)) is not None}


def _checked(values: dict, where: str, **types) -> dict:
    for name, kind in types.items():
        value = values.get(name)
        if value is None:
            continue
        if not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool):
            raise ValueError(f"{where}: {name} has the wrong type")
    return values


@dataclass
class Count:
    min: int | None = None
    max: int | None = None

    def text(self) -> str:
        if self.min is not None and self.min == self.max:
            return f"exactly {self.min}"
        if self.min is not None and self.max is not None:
            return f"{self.min} to {self.max}"
        if self.min is not None:
            return f"at least {self.min}"
        return f"at most {self.max}" if self.max is not None else "any"


@dataclass
class Step:
    """One expected span: service and name globs, and what must hold."""

    service: str
    span: str
    id: str = ""
    kind: str | None = None
    attributes: dict[str, Any] = field(default_factory=dict)
    error: bool = False
    max_ms: float | None = None
    optional: bool = False
    count: Count | None = None
    code: str | None = None
    why: str | None = None

    @classmethod
    def of(cls, data: Any, where: str) -> Step:
        values = _checked(_strict(cls, data, where), where, service=str, span=str, id=str, kind=str, attributes=dict,
                          error=bool, max_ms=(int, float), optional=bool, code=str, why=str)
        if "count" in values:
            values["count"] = Count(**_checked(_strict(Count, values["count"], f"{where} count"), where, min=int, max=int))
        if values.get("kind") is not None and values["kind"] not in KINDS:
            raise ValueError(f"{where}: unknown kind {values['kind']!r}")
        # Attributes are kept by key, as they are compared and reported.
        values["attributes"] = dict(sorted(values.get("attributes", {}).items()))
        return cls(**values)


@dataclass
class Forbid:
    """Spans that must not appear."""

    service: str = "*"
    span: str = "*"


@dataclass
class Selector:
    """Which traces a flow is about."""

    attributes: dict[str, Any] = field(default_factory=dict)
    root: str | None = None


@dataclass
class Flow:
    """The trace a feature is expected to produce."""

    name: str
    steps: list[Step]
    description: str | None = None
    selector: Selector | None = field(default=None, metadata={"json": "match"})
    order: str = "sequence"
    forbid: list[Forbid] = field(default_factory=list)
    no_errors: bool = True
    max_ms: float | None = None
    settle_secs: int = DEFAULT_SETTLE_SECS

    @classmethod
    def parse(cls, text: str) -> Flow:
        try:
            data = json.loads(text)
        except ValueError as error:
            raise ValueError(f"invalid flow: {error}") from error
        values = _checked(_strict(cls, data, "invalid flow"), "invalid flow", name=str, steps=list, description=str,
                          order=str, forbid=list, no_errors=bool, max_ms=(int, float), settle_secs=int)
        values["steps"] = [Step.of(s, "invalid flow: step") for s in values["steps"]]
        values["forbid"] = [Forbid(**_strict(Forbid, f, "invalid flow: forbid")) for f in values.get("forbid", [])]
        if "selector" in values:
            values["selector"] = Selector(**_strict(Selector, values["selector"], "invalid flow: match"))
        flow = cls(**values)
        flow.validate()
        return flow

    def validate(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9._-]{1,64}", self.name.strip()) or self.name != self.name.strip():
            raise ValueError("flow name: 1-64 letters, digits, '-', '_' or '.'")
        if self.order not in ORDERS:
            raise ValueError(f"order is one of {', '.join(ORDERS)}")
        if not self.steps:
            raise ValueError("a flow needs at least one step")
        seen = set()
        for number, step in enumerate(self.steps, 1):
            if not step.id.strip():
                step.id = str(number)
            if step.id in seen:
                raise ValueError(f"step id {step.id!r} is used twice")
            seen.add(step.id)
            if not step.service or not step.span:
                raise ValueError(f"step {step.id}: service and span are required (globs allowed)")
            _check_patterns(step.attributes, f"step {step.id}")
            if step.count and step.count.min is not None and step.count.max is not None and step.count.min > step.count.max:
                raise ValueError(f"step {step.id}: count.min is above count.max")
        if self.selector:
            _check_patterns(self.selector.attributes, "match")

    def fingerprint(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)


def _check_patterns(attributes: dict[str, Any], where: str) -> None:
    for key, expected in attributes.items():
        if isinstance(expected, str) and expected.startswith("re:"):
            pattern = expected[3:]
            try:
                re.compile(pattern)
            except re.error as error:
                raise ValueError(f"{where}: attribute {key}: bad regex: {error}") from error
            if re.search(r"\(\?<?[=!]|(?<!\\)\\[1-9]", pattern):
                raise ValueError(f"{where}: attribute {key}: bad regex: look-around and back-references are not supported")


@dataclass
class CatalogEntry:
    """One span the code is said to make."""

    service: str
    span: str
    kind: str | None = None
    file: str | None = None
    line: int | None = None
    function: str | None = None
    why: str | None = None
    attributes: list[str] = field(default_factory=list)


@dataclass
class SpanCatalog:
    spans: list[CatalogEntry]
    root: str | None = None

    @classmethod
    def parse(cls, text: str) -> SpanCatalog:
        try:
            values = _strict(cls, json.loads(text), "invalid span catalog")
        except json.JSONDecodeError as error:
            raise ValueError(f"invalid span catalog: {error}") from error
        entries = []
        for item in values["spans"]:
            entry = CatalogEntry(**_checked(_strict(CatalogEntry, item, "invalid span catalog"), "invalid span catalog",
                                            service=str, span=str, kind=str, file=str, line=int, function=str, why=str,
                                            attributes=list))
            if not entry.service.strip() or not entry.span.strip():
                raise ValueError("every catalog entry needs a service and a span")
            if entry.kind is not None and entry.kind not in KINDS:
                raise ValueError(f"invalid span catalog: unknown kind {entry.kind!r}")
            entries.append(entry)
        return cls(spans=entries, root=values.get("root"))
