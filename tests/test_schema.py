import copy

import pytest

from moorline.schema.mapping import Bundle, read_source
from moorline.schema.ontology import Ontology, SchemaError

GOOD = {
    "version": 1,
    "entity_types": {
        "Port": {"id": 1, "properties": {"name": {"id": 1, "type": "string", "title": True}, "code": {"id": 2, "type": "string", "indexed": True}, "alt": {"id": 3, "type": "string[]"}, "size": {"id": 4, "type": "enum", "values": ["S", "L"]}}, "display": "{name} ({code})"},
        "Call": {"id": 2, "properties": {"at": {"id": 5, "type": "timestamp"}}},
    },
    "link_types": {"calls_at": {"id": 1, "from": "Call", "to": "Port", "cardinality": "many_to_one", "inverse": "calls", "time_index": "at"}},
}
SOURCE = {"source": {"id": "a", "source_id": 1, "connector": "memory", "natural_key": ["k"]}, "mappings": [{"target_type": "Port", "properties": {"name": {"from": "n", "transform": ["trim"]}}}]}


def changed(base, path, value):
    out = copy.deepcopy(base)
    at = out
    for p in path[:-1]:
        at = at[p]
    if value is None:
        at.pop(path[-1])
    else:
        at[path[-1]] = value
    return out


def test_good():
    of = Ontology.read(GOOD)
    assert of.link("calls") == (of.links["calls_at"], True) and of.types["Port"].title.name == "name"
    assert of.types["Port"].properties["alt"].fuse == "union"


@pytest.mark.parametrize(
    ("path", "value"),
    [
        (["version"], None), (["entity_types"], {}), (["entity_types", "Port", "id"], 0), (["entity_types", "Port", "id"], 2), (["entity_types", "Port", "properties", "name", "type"], "decimal"),
        (["entity_types", "Port", "properties", "size", "values"], None), (["entity_types", "Port", "properties", "name", "fuse"], "best"), (["entity_types", "Port", "properties", "alt", "fuse"], "longest"),
        (["entity_types", "Port", "properties", "code", "title"], True), (["entity_types", "Port", "properties", "code", "id"], 5), (["entity_types", "Port", "display"], "{nome}"), (["entity_types", "Port", "display"], "{name"),
        (["link_types", "calls_at", "to"], "Pier"), (["link_types", "calls_at", "cardinality"], "few"), (["link_types", "calls_at", "time_index"], "name"), (["link_types", "calls_at", "id"], 70000),
    ],
)
def test_rejections(path, value):
    with pytest.raises(SchemaError):
        Ontology.read(changed(GOOD, path, value))


def test_yaml():
    pytest.importorskip("yaml")
    of = Ontology.read("version: 1\nentity_types:\n  A:\n    id: 1\n    properties:\n      n: {id: 1, type: int}\n")
    assert of.types["A"].properties["n"].kind == "int"


@pytest.mark.parametrize(
    ("path", "value"),
    [
        (["source", "source_id"], None), (["source", "connector"], "ftp"), (["source", "trust"], 1.5), (["source", "filter"], [{"column": "x"}]), (["source", "filter"], [{"column": "x", "matches": "("}]),
        (["source", "natural_key"], None), (["mappings", 0, "target_type"], "Pier"), (["mappings", 0, "from_endpoint"], "e"), (["mappings", 0, "properties", "name", "transform"], ["shout"]), (["mappings", 0, "properties"], {"nome": {"from": "n"}}),
        (["mappings", 0, "links"], [{"type": "calls_at", "via": {"from": "x", "match_property": "code"}}]),
    ],
)
def test_mapping_rejections(path, value):
    with pytest.raises(SchemaError):
        read_source(changed(SOURCE, path, value), Ontology.read(GOOD))


def test_link_match_must_be_indexed():
    link = lambda prop: {"source": SOURCE["source"], "mappings": [{"target_type": "Call", "properties": {}, "links": [{"type": "calls_at", "via": {"from": "x", "match_property": prop}}]}]}
    assert read_source(link("code"), Ontology.read(GOOD)).mappings[0].links[0].target == "Port"
    with pytest.raises(SchemaError):
        read_source(link("name"), Ontology.read(GOOD))


def test_duplicate_sources():
    with pytest.raises(SchemaError):
        Bundle.read(GOOD, [SOURCE, SOURCE])
