"""The request: a start set, hops along links, and what to return. Read from JSON and checked against the ontology."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from moorline.functions.transforms import ascii_lower
from moorline.schema.ontology import Ontology, Property

OPERATORS = {"eq": "eq", "=": "eq", "ne": "ne", "!=": "ne", "lt": "lt", "<": "lt", "lte": "lte", "<=": "lte", "gt": "gt", ">": "gt", "gte": "gte", ">=": "gte", "contains": "contains", "starts_with": "starts_with", "prefix": "starts_with"}
MAX_LIMIT, DEFAULT_LIMIT, DEFAULT_EXPAND = 10_000, 200, 100_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_UPPER = {v: k for k, v in _LOWER.items()}


class RequestError(ValueError):
    """A request that names something unknown or is malformed."""


@dataclass(frozen=True)
class Predicate:
    prop: str
    op: str
    value: Any

    def column(self, of: Property) -> Column:
        """True where the property meets it; a missing value meets nothing, and kinds that can't be compared never do."""
        if of.kind == "string[]":
            return F.coalesce(F.exists(F.col(of.name), lambda x: self._test(x, "string")), F.lit(False))
        return F.coalesce(self._test(F.col(of.name), "string" if of.kind == "enum" else of.kind), F.lit(False))

    def _test(self, x: Column, kind: str) -> Column:
        value = self.value
        numeric = isinstance(value, (int, float)) and not isinstance(value, bool)
        if kind == "timestamp" and isinstance(value, str):
            value = parse_time(value)
            if value is None:
                return F.lit(False)
        elif kind == "timestamp" and numeric:
            x, value = F.unix_millis(x).cast("double"), float(value)
        elif kind in ("int", "double") and not numeric or kind == "string" and not isinstance(value, str) or kind == "bool" and not isinstance(value, bool):
            return F.lit(False)
        if self.op in ("contains", "starts_with"):
            if kind != "string":
                return F.lit(False)
            low = F.lit(value.translate(_LOWER))
            return ascii_lower(x).contains(low) if self.op == "contains" else _spelt(x, value) & ascii_lower(x).startswith(low)
        if kind == "int" and isinstance(value, float):
            x = x.cast("double")
        y = instant(value) if isinstance(value, datetime) else F.lit(value)
        return {"eq": x == y, "ne": x != y, "lt": x < y, "lte": x <= y, "gt": x > y, "gte": x >= y}[self.op]


def _spelt(x: Column, prefix: str) -> Column:
    """Whether x begins as the first two characters of prefix in some case, written out so that a scan can be pruned by it."""
    forms = {""}
    for c in prefix[:2]:
        forms = {f + k for f in forms for k in {c.translate(_LOWER), c.translate(_UPPER)}}
    return reduce(lambda a, b: a | b, [x.startswith(f) for f in sorted(forms)])


def parse_time(text: str) -> datetime | None:
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00").replace("z", "+00:00"))
    except ValueError:
        return None
    return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at


def instant(at: datetime) -> Column:
    """A moment as a literal without a zone, so that the session's time zone doesn't move it."""
    return F.to_timestamp_ntz(F.lit(at.isoformat(sep=" ")))


@dataclass(frozen=True)
class Window:
    """A half-open stretch of time; an end that isn't given is open."""

    low: datetime | None = None
    high: datetime | None = None

    def column(self, ts: Column) -> Column:
        out = ts.isNotNull()
        if self.low is not None:
            out = out & (ts >= instant(self.low))
        return out & (ts < instant(self.high)) if self.high is not None else out


@dataclass(frozen=True)
class Hop:
    link: str
    reverse: bool | None = None
    max_expand: int = DEFAULT_EXPAND
    where: tuple[Predicate, ...] = ()


@dataclass(frozen=True)
class Query:
    type: str
    ids: tuple[str, ...] | None = None
    filters: tuple[Predicate, ...] = ()
    hops: tuple[Hop, ...] = ()
    select: tuple[str, ...] = ()
    limit: int = DEFAULT_LIMIT
    include_path: bool = False

    @classmethod
    def from_json(cls, source: str | dict) -> Query:
        try:
            raw = json.loads(source) if isinstance(source, str) else source
        except json.JSONDecodeError as e:
            raise RequestError(f"the request isn't JSON: {e}") from e
        start = raw.get("start")
        if not isinstance(start, dict) or not isinstance(start.get("type"), str):
            raise RequestError("start.type is missing")
        limit = raw.get("limit", DEFAULT_LIMIT)
        if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= MAX_LIMIT:
            raise RequestError(f"limit must be from 1 to {MAX_LIMIT}")
        hops = []
        for h in raw.get("hops") or []:
            if not isinstance(h.get("link"), str):
                raise RequestError("a hop has no link")
            expand = h.get("max_expand", DEFAULT_EXPAND)
            if not isinstance(expand, int) or expand < 1:
                raise RequestError("max_expand must be at least 1")
            hops.append(Hop(h["link"], h.get("reverse"), expand, _predicates(h.get("where"))))
        ids = start.get("ids")
        return cls(start["type"], None if ids is None else tuple(map(str, ids)), _predicates(start.get("filter") or start.get("where")), tuple(hops), tuple(raw.get("select") or ()), limit, bool(raw.get("include_path")))


def _predicates(raw: dict | None) -> tuple[Predicate, ...]:
    out = []
    for prop, told in (raw or {}).items():
        for op, value in told.items() if isinstance(told, dict) else [("eq", told)]:
            if op not in OPERATORS:
                raise RequestError(f"unknown operator {op!r}")
            out.append(Predicate(prop, OPERATORS[op], value))
    return tuple(out)


@dataclass
class Step:
    """One step of a plan: the access path, what it is given, and what is tested after."""

    kind: str
    target: str
    access: str
    link: str | None = None
    reverse: bool = False
    indexed: Predicate | None = None
    residual: tuple[Predicate, ...] = ()
    window: Window | None = None
    max_expand: int = DEFAULT_EXPAND
    note: str = ""


@dataclass
class Plan:
    query: Query
    steps: list[Step] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def headline(self) -> str:
        """The most telling access path of all steps."""
        rank = ("TIDX", "IDX", "IDX_RANGE", "IDX_PREFIX", "POINT", "LINKOUT", "LINKIN", "SCAN")
        return min((s.access for s in self.steps), key=rank.index)

    def render(self) -> str:
        lines = [f"{i}. {s.kind:5} {s.access:10} {s.target}" + (f" by {s.link}{' backwards' if s.reverse else ''}" if s.link else "") + (f" on {s.indexed.prop} {s.indexed.op} {s.indexed.value!r}" if s.indexed else "") + (f" in [{s.window.low}, {s.window.high})" if s.window else "") + (f", then {len(s.residual)} more" if s.residual else "") for i, s in enumerate(self.steps)]
        return "\n".join([*lines, *(f"warning: {w}" for w in self.warnings)])


def known(ontology: Ontology, type_name: str, predicates: tuple[Predicate, ...]) -> None:
    for p in predicates:
        if p.prop not in ontology.type(type_name).properties:
            raise RequestError(f"unknown property {type_name}.{p.prop}")
