"""Entity types, properties and links, declared in YAML (or JSON) and checked as a whole when loaded."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moorline.functions import transforms

KINDS: dict[str, T.DataType] = {"string": T.StringType(), "int": T.LongType(), "double": T.DoubleType(), "bool": T.BooleanType(), "timestamp": T.TimestampType(), "string[]": T.ArrayType(T.StringType(), False), "enum": T.StringType()}
FUSIONS = ("most_trusted", "most_recent", "most_frequent", "numeric_median", "longest", "union")
CARDINALITIES = ("many_to_one", "one_to_many", "many_to_many", "one_to_one")


class SchemaError(ValueError):
    """What is wrong with a declaration; raised when it is loaded."""


def load(source: str | Path | dict) -> dict:
    """A declaration from a dict, from YAML or JSON text, or from a file."""
    if isinstance(source, dict):
        return source
    text = Path(source).read_text() if isinstance(source, Path) or "\n" not in source else source
    try:
        import yaml
    except ImportError:
        found = json.loads(text)
    else:
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise SchemaError("a declaration must be a map")
    return found


@dataclass(frozen=True)
class Property:
    id: int
    name: str
    kind: str
    title: bool = False
    indexed: bool = False
    unique_hint: bool = False
    fuse: str = "most_trusted"
    values: tuple[str, ...] = ()

    @property
    def data_type(self) -> T.DataType:
        return KINDS[self.kind]

    def field(self) -> T.StructField:
        return T.StructField(self.name, self.data_type, True, {"id": self.id, "indexed": self.indexed, "title": self.title, "fuse": self.fuse})


@dataclass(frozen=True)
class EntityType:
    id: int
    name: str
    properties: dict[str, Property]
    description: str = ""
    display: str = ""

    @property
    def title(self) -> Property | None:
        return next((p for p in self.properties.values() if p.title), None)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField("entity_id", T.StringType()), *[p.field() for p in self.properties.values()]])

    def display_column(self) -> Column:
        """The display template filled in; what is missing is empty."""
        out: list[Column] = []
        for text, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", self.display or ("{%s}" % self.title.name if self.title else "")):
            if text:
                out.append(F.lit(text))
            if name:
                kind = self.properties[name].kind
                out.append(transforms.display("string" if kind == "enum" else kind, F.col(name)))
        return F.concat(*out) if out else F.lit("")


@dataclass(frozen=True)
class LinkType:
    id: int
    name: str
    source: str
    target: str
    cardinality: str
    inverse: str | None = None
    time_index: str | None = None


@dataclass
class Ontology:
    version: int
    types: dict[str, EntityType]
    links: dict[str, LinkType] = field(default_factory=dict)

    def type(self, name: str) -> EntityType:
        if name not in self.types:
            raise SchemaError(f"unknown entity type: {name}")
        return self.types[name]

    def property(self, type_name: str, name: str) -> Property:
        own = self.type(type_name).properties
        if name not in own:
            raise SchemaError(f"unknown property: {type_name}.{name}")
        return own[name]

    def link(self, name: str) -> tuple[LinkType, bool]:
        """A link by its name, or by its inverse's, which is walked backwards."""
        if name in self.links:
            return self.links[name], False
        for link in self.links.values():
            if link.inverse == name:
                return link, True
        raise SchemaError(f"unknown link: {name}")

    @classmethod
    def read(cls, source: str | Path | dict) -> Ontology:
        raw = load(source)
        if "version" not in raw:
            raise SchemaError("version is missing")
        if not isinstance(raw.get("entity_types"), dict) or not raw["entity_types"]:
            raise SchemaError("entity_types must be a map with at least one type")
        types, ids, property_ids = {}, set(), set()
        for name, body in raw["entity_types"].items():
            types[name] = _entity(name, body or {}, ids, property_ids)
        links, link_ids, names = {}, set(), set()
        for name, body in (raw.get("link_types") or {}).items():
            links[name] = _link(name, body or {}, types, link_ids)
            for n in filter(None, (name, links[name].inverse)):
                if n in names:
                    raise SchemaError(f"{n}: two links have this name")
                names.add(n)
        return cls(raw["version"], types, links)


def _id(what: str, body: dict, taken: set[int]) -> int:
    number = body.get("id")
    if not isinstance(number, int) or isinstance(number, bool) or not 1 <= number <= 65535:
        raise SchemaError(f"{what}: id must be from 1 to 65535")
    if number in taken:
        raise SchemaError(f"{what}: id {number} is taken")
    taken.add(number)
    return number


def _entity(name: str, body: dict, ids: set[int], property_ids: set[int]) -> EntityType:
    number = _id(name, body, ids)
    properties: dict[str, Property] = {}
    for p, spec in (body.get("properties") or {}).items():
        what, spec = f"{name}.{p}", spec or {}
        kind = spec.get("type")
        if kind not in KINDS:
            raise SchemaError(f"{what}: unknown type {kind!r}")
        values = tuple(spec.get("values") or ())
        if kind == "enum" and not values:
            raise SchemaError(f"{what}: an enum needs values")
        fuse = spec.get("fuse", "union" if kind == "string[]" else "most_trusted")
        if fuse not in FUSIONS:
            raise SchemaError(f"{what}: unknown fusion rule {fuse!r}")
        if (kind == "string[]") != (fuse == "union"):
            raise SchemaError(f"{what}: string[] fuses by union, and nothing else does")
        properties[p] = Property(_id(what, spec, property_ids), p, kind, bool(spec.get("title")), bool(spec.get("indexed")), bool(spec.get("unique_hint")), fuse, values)
    if sum(p.title for p in properties.values()) > 1:
        raise SchemaError(f"{name}: more than one title")
    display = body.get("display", "")
    if re.sub(r"\{\w+\}", "", display).count("{") or re.sub(r"\{\w+\}", "", display).count("}"):
        raise SchemaError(f"{name}: a brace of display isn't closed")
    for p in re.findall(r"\{(\w+)\}", display):
        if p not in properties:
            raise SchemaError(f"{name}: display names {p}, which isn't a property")
    return EntityType(number, name, properties, body.get("description", ""), display)


def _link(name: str, body: dict, types: dict[str, EntityType], ids: set[int]) -> LinkType:
    number = _id(name, body, ids)
    source, target = body.get("from"), body.get("to")
    for end in (source, target):
        if end not in types:
            raise SchemaError(f"{name}: unknown entity type {end!r}")
    if body.get("cardinality") not in CARDINALITIES:
        raise SchemaError(f"{name}: unknown cardinality {body.get('cardinality')!r}")
    time_index = body.get("time_index")
    if time_index is not None:
        of = types[source].properties.get(time_index)
        if of is None or of.kind != "timestamp":
            raise SchemaError(f"{name}: time_index must be a timestamp of {source}")
    return LinkType(number, name, source, target, body["cardinality"], body.get("inverse"), time_index)
