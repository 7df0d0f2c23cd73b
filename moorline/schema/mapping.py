"""Source mappings: which columns of a source make which properties and links, by which transforms."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from moorline.functions.transforms import chain_fingerprint, resolve_chain

from .ontology import Ontology, SchemaError, load

CONNECTORS = ("csv", "http", "postgres", "memory")


@dataclass(frozen=True)
class PropertyMapping:
    name: str
    columns: tuple[str, ...]
    chain: tuple[str, ...]

    @property
    def fingerprint(self) -> int:
        return chain_fingerprint(self.chain)


@dataclass(frozen=True)
class LinkMapping:
    link: str
    target: str
    column: str
    match_property: str


@dataclass(frozen=True)
class TypeMapping:
    target: str
    natural_key: tuple[str, ...]
    properties: tuple[PropertyMapping, ...]
    links: tuple[LinkMapping, ...] = ()
    endpoint: str | None = None


@dataclass(frozen=True)
class Source:
    id: str
    source_id: int
    connector: str
    trust: float = 0.5
    uri: str | None = None
    snapshot_dir: str | None = None
    dsn: str | None = None
    query: str | None = None
    params: tuple[str, ...] = ()
    fetch_size: int = 10_000
    filters: tuple[tuple[str, str], ...] = ()
    endpoints: dict[str, str | None] = field(default_factory=dict)
    mappings: tuple[TypeMapping, ...] = ()

    def columns(self) -> list[str]:
        """Every column or path that filters, keys, properties and links read."""
        names = [c for c, _ in self.filters]
        for m in self.mappings:
            names += [*m.natural_key, *(c for p in m.properties for c in p.columns), *(x.column for x in m.links)]
        return list(dict.fromkeys(names))


def _list(x) -> tuple:
    return () if x is None else tuple(x) if isinstance(x, (list, tuple)) else (x,)


def read_source(raw: str | Path | dict, ontology: Ontology) -> Source:
    """One source's mapping file; anything wrong with it is an error here, not in a run."""
    body = load(raw)
    head = body.get("source") or {}
    name = head.get("id")
    if not name:
        raise SchemaError("source.id is missing")
    number = head.get("source_id")
    if not isinstance(number, int) or isinstance(number, bool) or not 0 < number < 1 << 32:
        raise SchemaError(f"{name}: source_id must be a positive 32-bit number")
    if head.get("connector") not in CONNECTORS:
        raise SchemaError(f"{name}: unknown connector {head.get('connector')!r}")
    trust = head.get("trust", 0.5)
    if not isinstance(trust, (int, float)) or not 0 <= trust <= 1:
        raise SchemaError(f"{name}: trust must be from 0 to 1")
    filters = []
    for f in _list(head.get("filter") or head.get("filters")):
        if "column" not in f or not (f.get("matches") or f.get("regex")):
            raise SchemaError(f"{name}: a filter needs column and matches")
        pattern = f.get("matches") or f.get("regex")
        try:
            re.compile(pattern)
        except re.error as e:
            raise SchemaError(f"{name}: {pattern!r} isn't a regular expression") from e
        filters.append((f["column"], pattern))
    endpoints = {}
    for e in _list(head.get("endpoints")) if not isinstance(head.get("endpoints"), dict) else [{"id": k, **(v or {})} for k, v in head["endpoints"].items()]:
        endpoints[e["id"]] = e.get("records_at")
    mappings = tuple(_type(name, m, head, ontology, endpoints) for m in body.get("mappings") or [])
    return Source(name, number, head["connector"], float(trust), head.get("uri"), head.get("snapshot_dir"), head.get("dsn"), head.get("query"), _list(head.get("params")), head.get("cursor_size", 10_000), tuple(filters), endpoints, mappings)


def _type(name: str, m: dict, head: dict, ontology: Ontology, endpoints: dict) -> TypeMapping:
    target = m.get("target_type")
    of = ontology.type(target)
    endpoint = m.get("from_endpoint")
    if endpoint is not None and endpoint not in endpoints:
        raise SchemaError(f"{name}: endpoint {endpoint} isn't declared")
    key = _list(m.get("natural_key") or head.get("natural_key"))
    if not key:
        raise SchemaError(f"{name}: {target} has no natural_key")
    properties = []
    for p, spec in (m.get("properties") or {}).items():
        if p not in of.properties:
            raise SchemaError(f"{name}: unknown property {target}.{p}")
        chain = _list(spec.get("transform"))
        try:
            resolve_chain(chain)
        except ValueError as e:
            raise SchemaError(f"{name}: {target}.{p}: {e}") from e
        if not _list(spec.get("from")):
            raise SchemaError(f"{name}: {target}.{p} has no column")
        properties.append(PropertyMapping(p, _list(spec["from"]), chain))
    links = []
    for x in m.get("links") or []:
        link = ontology.links.get(x.get("type"))
        if link is None or link.source != target:
            raise SchemaError(f"{name}: link {x.get('type')} doesn't start at {target}")
        to, via = x.get("to_type", link.target), x.get("via") or {}
        match = via.get("match_property")
        if to not in ontology.types or match not in ontology.types[to].properties:
            raise SchemaError(f"{name}: unknown property {to}.{match}")
        if not ontology.types[to].properties[match].indexed:
            raise SchemaError(f"{name}: {to}.{match} isn't indexed")
        links.append(LinkMapping(link.name, to, via["from"], match))
    return TypeMapping(target, key, tuple(properties), tuple(links), endpoint)


@dataclass
class Bundle:
    """An ontology and all its sources."""

    ontology: Ontology
    sources: dict[str, Source]

    @classmethod
    def read(cls, ontology: str | Path | dict | Ontology, sources: str | Path | list) -> Bundle:
        """sources: a folder of mapping files, read in the order of their names, or a list of declarations."""
        of = ontology if isinstance(ontology, Ontology) else Ontology.read(ontology)
        listed = sorted(Path(sources).glob("*.y*ml")) if isinstance(sources, (str, Path)) else sources
        found: dict[str, Source] = {}
        for raw in listed:
            source = raw if isinstance(raw, Source) else read_source(raw, of)
            if source.id in found or source.source_id in {s.source_id for s in found.values()}:
                raise SchemaError(f"{source.id}: a source with this id is there already")
            found[source.id] = source
        return cls(of, found)

    def by_number(self, number: int) -> Source:
        return next(s for s in self.sources.values() if s.source_id == number)
