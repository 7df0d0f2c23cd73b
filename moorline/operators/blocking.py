"""Blocking: records that share a key are compared, others never are. A record is ref struct(source_id, key_hash)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.functions import geo, text
from moorline.schema.ontology import Ontology, SchemaError

PREFIX, GEO_PRECISION, MAX_BLOCK = 4, 4, 200
PORT_PROPERTIES = ("name", "locode", "alt_names", "country", "lat", "lon")
VESSEL_PROPERTIES = ("name", "imo", "mmsi", "call_sign", "flag")


def bind(ontology: Ontology) -> None:
    """Checks that the properties that keys and features read are declared."""
    for type_name, names in (("Port", PORT_PROPERTIES), ("Vessel", VESSEL_PROPERTIES)):
        if type_name in ontology.types:
            missing = [n for n in names if n not in ontology.types[type_name].properties]
            if missing:
                raise SchemaError(f"{type_name} lacks {', '.join(missing)}, which resolution needs")


def _key(generator: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.struct(F.lit(generator).alias("generator"), value.alias("value")))


def _name_keys(words: Column) -> list[Column]:
    name = text.canonical(words)
    return [_key("name_soundex", text.soundex_phrase(name)), _key("name_prefix", F.substring(name, 1, PREFIX))]


def port_keys() -> Column:
    """Code, sound and beginning of the name, country with name, and the geohash cell with those around it."""
    words = text.port_tokens(F.col("name"))
    cells = F.coalesce(geo.geohash_with_neighbours(F.col("lat"), F.col("lon"), GEO_PRECISION), F.array().cast("array<string>"))
    named = F.when(F.col("name").isNotNull() & (F.size(words) > 0), F.array(*_name_keys(words), _key("country_name", F.concat(F.col("country"), F.lit("|"), text.canonical(words)))))
    return F.array_compact(F.concat(F.array(_key("locode_exact", F.col("locode"))), F.coalesce(named, F.array().cast("array<struct<generator:string,value:string>>")), F.transform(cells, lambda c: _key("geo_cell", c))))


def vessel_keys() -> Column:
    words = text.vessel_tokens(F.col("name"))
    named = F.when(F.col("name").isNotNull() & (F.size(words) > 0), F.array(*_name_keys(words)))
    exact = [_key("imo_exact", F.col("imo")), _key("mmsi_exact", F.col("mmsi")), _key("callsign_exact", F.col("call_sign"))]
    return F.array_compact(F.concat(F.array(*exact), F.coalesce(named, F.array().cast("array<struct<generator:string,value:string>>"))))


def blocking_keys(records: DataFrame, type_name: str) -> DataFrame:
    """type, ref, generator, value; types other than ports and vessels have no keys."""
    keys = {"Port": port_keys, "Vessel": vessel_keys}.get(type_name)
    made = F.explode(keys()) if keys else F.explode(F.array().cast("array<struct<generator:string,value:string>>"))
    rows = records.select(F.lit(type_name).alias("type"), F.struct("source_id", "key_hash").alias("ref"), made.alias("key"))
    return rows.select("type", "ref", "key.generator", "key.value").distinct()


def block_sizes(keys: DataFrame) -> DataFrame:
    return keys.groupBy("type", "generator", "value").agg(F.count("*").alias("n"))


def block(keys: DataFrame, generator: str, value: str) -> DataFrame:
    """The records (type, ref) of one block."""
    return keys.where((F.col("generator") == generator) & (F.col("value") == value)).select("type", "ref")


def block_stats(keys: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """blocking_keys, blocks, largest_block, purged_blocks."""
    n = F.col("n")
    return block_sizes(keys).agg(F.coalesce(F.sum(n), F.lit(0)).alias("blocking_keys"), F.count("*").alias("blocks"), F.coalesce(F.max(n), F.lit(0)).alias("largest_block"), F.count_if(n > max_block).alias("purged_blocks"))


def candidate_pairs(keys: DataFrame, max_block: int = MAX_BLOCK, cross_source_only: bool = False) -> DataFrame:
    """type, a, b (a before b) and via, the generators of the blocks that they share.

    Larger blocks are dropped whole before the join, so a common value costs its count, not its pairs.
    """
    block = ["type", "generator", "value"]
    kept = keys.join(block_sizes(keys).where(F.col("n").between(2, max_block)).drop("n"), block)
    x, y = kept.withColumnRenamed("ref", "a"), kept.withColumnRenamed("ref", "b")
    pairs = x.join(y, block).where(F.col("a") < F.col("b"))
    if cross_source_only:
        pairs = pairs.where(F.col("a.source_id") != F.col("b.source_id"))
    return pairs.groupBy("type", "a", "b").agg(F.sort_array(F.collect_set("generator")).alias("via"))


def pairs_by_generator(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode("via").alias("generator")).groupBy("generator").agg(F.count("*").alias("pairs"))


def reduction(pairs: DataFrame, records_per_type: DataFrame) -> DataFrame:
    """candidate_pairs, possible_pairs (within types), reduction_ratio. records_per_type: type, n."""
    possible = records_per_type.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("possible_pairs"))
    ratio = F.when(F.col("possible_pairs") == 0, 0.0).otherwise(1 - F.col("candidate_pairs") / F.col("possible_pairs"))
    return pairs.agg(F.count("*").alias("candidate_pairs")).crossJoin(possible).withColumn("reduction_ratio", ratio)


def coverage(pairs: DataFrame, golden: DataFrame) -> DataFrame:
    """Of golden matches (a, b, label): matches, found, completeness, and per generator the matches it found, alone or not."""
    met = golden.where("label = 'match'").join(pairs.select("a", "b", "via"), ["a", "b"], "left")
    totals = met.agg(F.count("*").alias("matches"), F.count("via").alias("found")).withColumn("completeness", F.when(F.col("matches") == 0, 0.0).otherwise(F.col("found") / F.col("matches")))
    by = met.where("via is not null").select(F.explode("via").alias("generator"), (F.size("via") == 1).alias("alone")).groupBy("generator").agg(F.count("*").alias("n"), F.count_if("alone").alias("alone"))
    return totals.crossJoin(by.agg(F.sort_array(F.collect_list(F.struct("generator", "n", "alone"))).alias("by_generator")))


def missed(pairs: DataFrame, golden: DataFrame, limit: int = 25) -> DataFrame:
    return golden.where("label = 'match'").join(pairs.select("a", "b"), ["a", "b"], "left_anti").orderBy("a", "b").limit(limit)
