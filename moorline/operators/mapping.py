"""Rows to records: natural keys, properties by transform chains, link references, and the reasons of what is dropped."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.functions.transforms import Typed, apply_chain, chain_fingerprint, resolve_chain
from moorline.schema.mapping import PropertyMapping, Source, TypeMapping
from moorline.schema.ontology import KINDS, Ontology

SEPARATOR = "\x1f"
#: Where a cell's value lies, by kind.
SLOTS = {"string": "s", "enum": "s", "int": "i", "double": "d", "bool": "b", "timestamp": "ts", "string[]": "l"}
SLOT_TYPES = {"s": "string", "i": "bigint", "d": "double", "b": "boolean", "ts": "timestamp", "l": "array<string>"}


@dataclass
class Mapped:
    """cells: a row for each property of each record; refs: link references; kept: the rows that give any record;
    records: how many a row gives, null if it is filtered."""

    cells: DataFrame
    refs: DataFrame
    kept: DataFrame
    records: Column


def field(name: str) -> Column:
    return F.try_element_at(F.col("fields"), F.lit(name))


def accepts(source: Source) -> Column:
    """Whether every filter's column is there and its pattern is found in it."""
    tests = [F.coalesce(field(c).rlike(p), F.lit(False)) for c, p in source.filters]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def natural_key(mapping: TypeMapping) -> Column:
    """The key's parts joined; null if no part has text."""
    parts = [F.coalesce(field(c), F.lit("")) for c in mapping.natural_key]
    any_ = reduce(lambda a, b: a | b, [p != "" for p in parts])
    return F.when(any_, F.concat_ws(SEPARATOR, *parts))


def cell_of(p: PropertyMapping) -> tuple[Column, str, Column, Column]:
    """A property's input, its kind, its raw text, and whether any of its columns is in the row."""
    there = reduce(lambda a, b: a | b, [field(c).isNotNull() for c in p.columns])
    texts = [F.coalesce(field(c), F.lit("")) for c in p.columns]
    if len(texts) == 1:
        return field(p.columns[0]), "string", field(p.columns[0]), there
    return F.when(there, F.array(*texts)), "string[]", F.when(there, F.concat_ws(SEPARATOR, *texts)), there


def declared(t: Typed, kind: str, values: tuple[str, ...] = ()) -> Typed:
    """A chain's result as the property's kind: a text becomes a list of one, a list its first item; enums are checked."""
    value, error, own = t.value, t.error, t.kind
    want = "string" if kind == "enum" else kind
    if want == "string[]" and own == "string":
        value, own = F.when(value.isNotNull(), F.array(value)), want
    elif want != "string[]" and own == "string[]":
        value, own = F.get(value, F.lit(0)), "string"
    if kind == "enum":
        bad = value.isNotNull() & ~value.isin(*values)
        error = F.coalesce(error, F.when(bad, F.concat(F.lit("enum: not one of the values: "), value)))
        value = F.when(~bad, value)
    elif own != want:
        made = value.try_cast(KINDS[want]) if want != "string" else value.cast("string")
        error = F.coalesce(error, F.when(value.isNotNull() & made.isNull(), F.lit(f"declared as {want}, but the chain gives {own}")))
        value = made
    return Typed(kind, value, error)


def compiled(p: PropertyMapping, ontology: Ontology, type_name: str) -> tuple[Typed, Column, Column]:
    """A mapping as Columns: the typed value with its error, the raw text, and whether the property is there."""
    of = ontology.property(type_name, p.name)
    cell, kind, raw, there = cell_of(p)
    return declared(apply_chain(p.chain, cell, kind), of.kind, of.values), raw, there


def map_rows(rows: DataFrame, source: Source, batch_id: int, ontology: Ontology, endpoint: str | None = None) -> Mapped:
    """All records of a source's rows. Rows that a filter rejects, and records without a key, are left out."""
    kept = rows.where(accepts(source))
    cells, refs = [], []
    used = [m for m in source.mappings if m.endpoint in (endpoint, None)]
    for m in used:
        keyed = kept.withColumn("natural_key", natural_key(m)).where("natural_key is not null")
        head = [F.lit(source.source_id).alias("source_id"), F.lit(batch_id).cast("bigint").alias("batch_id"), "row_seq", F.lit(m.target).alias("type"), F.xxhash64("natural_key").alias("key_hash"), "natural_key"]
        structs = []
        for p in m.properties:
            typed, raw, there = compiled(p, ontology, m.target)
            slot = SLOTS[typed.kind]
            slots = [(typed.value if s == slot else F.lit(None)).cast(t).alias(s) for s, t in SLOT_TYPES.items()]
            structs.append(F.when(there, F.struct(F.lit(p.name).alias("prop"), *slots, raw.alias("raw"), F.lit("+".join(p.columns)).alias("column"), F.array(*[F.lit(i) for i in resolve_chain(p.chain)]).cast("array<int>").alias("chain"), F.lit(chain_fingerprint(p.chain)).alias("chain_fp"), typed.error.alias("error"))))
        cells.append(keyed.select(*head, F.explode(F.array_compact(F.array(*structs))).alias("cell")).select("source_id", "batch_id", "row_seq", "type", "key_hash", "natural_key", "cell.*"))
        for x in m.links:
            value = field(x.column)
            refs.append(keyed.where(value != "").select(*head, F.lit(x.link).alias("link"), F.lit(x.target).alias("target_type"), F.lit(x.match_property).alias("match_property"), value.alias("match_value"), F.lit(x.column).alias("column")))
    spark = rows.sparkSession
    none = spark.createDataFrame([], "source_id int, batch_id bigint, row_seq bigint, type string, key_hash bigint, natural_key string, link string, target_type string, match_property string, match_value string, column string")
    given = reduce(lambda a, b: a + b, [natural_key(m).isNotNull().cast("int") for m in used])
    return Mapped(reduce(DataFrame.unionByName, cells), reduce(DataFrame.unionByName, refs, none), kept.where(given > 0), F.when(accepts(source) & (given > 0), given))


def latest(cells: DataFrame) -> DataFrame:
    """Of each record the newest batch's cells, and in a batch the latest row's."""
    newest = cells.groupBy("source_id", "type", "key_hash").agg(F.max(F.struct("batch_id", "row_seq")).alias("new"))
    joined = cells.join(newest, ["source_id", "type", "key_hash"])
    return joined.where((F.col("batch_id") == F.col("new.batch_id")) & (F.col("row_seq") == F.col("new.row_seq"))).drop("new")


def of_source(cells: DataFrame, source_id: int, type_name: str | None = None) -> DataFrame:
    """One source's cells, of one type or all: scans are pruned by the source."""
    own = cells.where(F.col("source_id") == source_id)
    return own if type_name is None else own.where(F.col("type") == type_name)


def records(cells: DataFrame, ontology: Ontology, type_name: str) -> DataFrame:
    """A row for each record of a type, with a typed column for each property."""
    aggregates = []
    for p in ontology.type(type_name).properties.values():
        aggregates.append(F.first(F.when(F.col("prop") == p.name, F.col(SLOTS[p.kind])), ignorenulls=True).alias(p.name))
    own = cells.where(F.col("type") == type_name)
    return own.groupBy("source_id", "key_hash").agg(F.first("natural_key").alias("natural_key"), F.first("batch_id").alias("batch_id"), F.first("row_seq").alias("row_seq"), *aggregates)

