"""Fusion: of a cluster's cells for a property, one value, with where it came from and what was rejected.

Cells are taken in cluster order: by source, then record key. Trust comes from the sources; a property without any
value is left out. Equal values of a property meet first and keep their best cell, then a property's values: both are
aggregations that combine before they shuffle, and what isn't asked for, as the rejected cells, isn't gathered.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.functions import transforms
from moorline.schema.ontology import Ontology

from .mapping import SLOTS

ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def entity_id(cluster: Column, type_name: Column) -> Column:
    """26 characters that are the same for the same smallest member, so resolving again keeps ids."""
    hashed = F.sha2(F.concat_ws("|", type_name, cluster), 256)
    digits = [F.lpad(F.conv(F.substring(hashed, at, n), 16, 32), width, "0") for at, n, width in ((1, 15, 12), (16, 15, 12), (31, 2, 2))]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)


def shown() -> Column:
    """A cell's value as text, by the slot that is filled."""
    return F.coalesce("s", F.col("i").cast("string"), F.col("d").cast("string"), F.col("b").cast("string"), transforms.format_iso8601(F.col("ts")), F.array_join("l", "; "))


def named(clusters: DataFrame) -> DataFrame:
    """type, source_id, key_hash, entity_id, size: the records with their entity, whose id and size are worked out once for a cluster."""
    of = clusters.groupBy("type", "cluster").agg(F.count("*").alias("size")).withColumn("entity_id", entity_id(F.col("cluster"), F.col("type")))
    return clusters.join(of, ["type", "cluster"]).select("type", F.col("ref.source_id").alias("source_id"), F.col("ref.key_hash").alias("key_hash"), "entity_id", "size")


def candidates(cells: DataFrame, clusters: DataFrame, trust: Mapping[int, float]) -> DataFrame:
    """The cells that hold a value, with entity_id, size, trust and the value as text."""
    lookup = F.create_map(*[F.lit(y) for k, v in trust.items() for y in (k, float(v))]) if trust else F.create_map().cast("map<int,double>")
    joined = cells.where("error is null").withColumn("shown", shown()).where("shown is not null").join(named(clusters), ["type", "source_id", "key_hash"])
    return joined.withColumn("trust", F.coalesce(F.try_element_at(lookup, F.col("source_id")), F.lit(0.5)))


def _rank() -> Column:
    """What a cell is ranked by under its rule, the first being best; ties go by cluster order."""
    rule = F.col("rule")
    number = F.when(rule == "most_trusted", -F.col("trust")).when(rule == "numeric_median", F.col("number")).otherwise(F.lit(0.0))
    whole = F.when(rule == "most_recent", -F.col("batch_id")).when(rule == "longest", -F.octet_length("shown").cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    row = F.when(rule == "most_recent", -F.col("row_seq")).otherwise(F.lit(0).cast("bigint"))
    return F.struct(number.alias("number"), whole.alias("whole"), row.alias("row"), "source_id", "key_hash")


def _reason(x: Column, won: Column) -> Column:
    """Why a cell was rejected. The texts are fixed values."""
    two = lambda c: F.format_string("%.2f", c)
    rule = F.col("rule")
    return (
        F.when(rule == "most_trusted", F.concat(F.lit("lower source trust ("), two(x["trust"]), F.lit(" < "), two(won["trust"]), F.lit(")")))
        .when(rule == "numeric_median", "not the median")
        .when(rule == "most_recent", "an earlier observation")
        .when(rule == "most_frequent", "a minority value")
        .when(rule == "longest", "shorter than the chosen value")
    )


_REJECTED = "array<struct<source_id:int,batch_id:bigint,row_seq:bigint,column:string,value:string,reason:string>>"


def fuse(cells: DataFrame, clusters: DataFrame, ontology: Ontology, trust: Mapping[int, float]) -> DataFrame:
    """The table provenance: a row for each entity and property, with the emitted value in its kind's slot.

    The median is that of a property's distinct values, by their counts; of cells with one value the first in cluster
    order stands for it. Under union nothing is rejected, and all cells are contributors."""
    rules = {(t.name, p.name): p.fuse for t in ontology.types.values() for p in t.properties.values()}
    rule = F.create_map(*[F.lit(y) for (t, p), r in rules.items() for y in (f"{t}.{p}", r)])
    key = ["type", "entity_id", "prop", "rule"]
    own = candidates(cells, clusters, trust).withColumn("rule", F.try_element_at(rule, F.concat_ws(".", "type", "prop")))
    own = own.where("rule is not null").withColumn("number", F.coalesce(F.col("d"), F.col("i").cast("double")))
    # A property with the median rule whose cells aren't numbers is left out.
    own = own.where("rule <> 'numeric_median' or number is not null").withColumn("rank", _rank())
    cell = F.struct(F.struct("source_id", "batch_id", "row_seq", "column").alias("origin"), "chain", "chain_fp", "raw", "s", "i", "d", "b", "ts", "trust", "shown")
    told = F.struct("source_id", "batch_id", "row_seq", "column", F.col("shown").alias("value"), "trust", "chain", "raw")
    values = own.groupBy(*key, "shown").agg(F.count("*").alias("times"), F.max("size").alias("size"), F.min("rank").alias("rank"), F.min_by(cell, F.col("rank")).alias("best"), F.collect_set("l").alias("lists"), F.collect_list(told).alias("all"))
    often = F.col("rule") == "most_frequent"
    place = F.struct(F.when(often, -F.col("times").cast("double")).otherwise(F.col("rank.number")).alias("number"), F.col("rank.whole"), F.col("rank.row"), F.when(often, F.col("shown")).otherwise("").alias("text"), F.col("rank.source_id"), F.col("rank.key_hash"))
    in_order = F.array_sort(F.collect_list(F.when(F.col("rule") == "numeric_median", F.struct(F.col("rank.number").alias("number"), F.col("rank.source_id"), F.col("rank.key_hash"), "times", "best"))))
    grouped = values.groupBy(*key).agg(F.sum("times").alias("candidates"), F.max("size").alias("cluster_size"), F.min_by("best", place).alias("first"), in_order.alias("numbers"), F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list("lists"))))).alias("items"), F.array_sort(F.flatten(F.collect_list("all"))).alias("all"))
    # The upper median: the value at which the counts pass the half.
    start = F.struct(F.floor(F.col("candidates") / 2).alias("left"), F.lit(None).cast(values.schema["best"].dataType).alias("best"))
    median = F.aggregate("numbers", start, lambda a, x: F.struct((a["left"] - x["times"]).alias("left"), F.when(a["best"].isNull() & (a["left"] < x["times"]), x["best"]).otherwise(a["best"]).alias("best")), lambda a: a["best"])
    won = grouped.withColumn("w", F.when(F.col("rule") == "numeric_median", median).otherwise(F.col("first")))
    union = F.col("rule") == "union"
    lost = F.transform(F.filter("all", lambda x: x["value"] != F.col("w.shown")), lambda x: F.struct(x["source_id"].alias("source_id"), x["batch_id"].alias("batch_id"), x["row_seq"].alias("row_seq"), x["column"].alias("column"), x["value"].alias("value"), _reason(x, F.col("w")).alias("reason")))
    return won.select(
        "type", "entity_id", "prop", F.col("w.origin").alias("origin"), F.col("w.chain").alias("chain"), F.col("w.chain_fp").alias("chain_fp"), F.col("w.raw").alias("raw_value"),
        F.col("w.s").alias("s"), F.col("w.i").alias("i"), F.col("w.d").alias("d"), F.col("w.b").alias("b"), F.col("w.ts").alias("ts"), F.when(union, F.col("items")).alias("l"), "rule",
        F.when(F.col("candidates") > 1, F.col("w.trust")).otherwise(1.0).alias("confidence"), F.when(union, F.array().cast(_REJECTED)).otherwise(lost.cast(_REJECTED)).alias("rejected"),
        F.when(union, F.col("all")).alias("contributors"), "cluster_size",
        F.array(F.concat(F.lit("merged from "), F.col("cluster_size").cast("string"), F.lit(" source records"))).alias("merge_evidence"),
    )


def entities(provenance: DataFrame, clusters: DataFrame, ontology: Ontology, type_name: str) -> DataFrame:
    """entity_id, members and a typed column for each property of a type's entities; those without values are there too."""
    own = clusters.where(F.col("type") == type_name).groupBy("type", "cluster").agg(F.array_sort(F.collect_list("ref")).alias("members")).select(entity_id(F.col("cluster"), F.col("type")).alias("entity_id"), "members")
    aggregates = [F.first(F.when(F.col("prop") == p.name, F.col(SLOTS[p.kind])), ignorenulls=True).alias(p.name) for p in ontology.type(type_name).properties.values()]
    values = provenance.where(F.col("type") == type_name).groupBy("entity_id").agg(*aggregates)
    return own.join(values, "entity_id", "left")


def xref(clusters: DataFrame) -> DataFrame:
    return named(clusters).drop("size")
