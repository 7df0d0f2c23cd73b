"""Link resolution: references by raw value become edges between entities, with the link's time where it has one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorline.schema.ontology import Ontology


def resolve_links(refs: DataFrame, xref: DataFrame, entities: dict[str, DataFrame], ontology: Ontology) -> DataFrame:
    """Each reference with src, dst (smallest matching entity id) and ts, null where there is none."""
    values = []
    for target, prop in {(r.target_type, r.match_property) for r in refs.select("target_type", "match_property").distinct().collect()}:
        ontology.property(target, prop)
        values.append(entities[target].where(F.col(prop).isNotNull()).groupBy(F.col(prop).cast("string").alias("match_value")).agg(F.min("entity_id").alias("dst")).select(F.lit(target).alias("target_type"), F.lit(prop).alias("match_property"), "match_value", "dst"))
    joined = refs.join(xref.withColumnRenamed("entity_id", "src"), ["type", "source_id", "key_hash"], "left")
    joined = joined.join(reduce(DataFrame.unionByName, values), ["target_type", "match_property", "match_value"], "left") if values else joined.withColumn("dst", F.lit(None).cast("string"))
    times = [entities[x.source].where(F.col(x.time_index).isNotNull()).select(F.lit(x.name).alias("link"), F.col("entity_id").alias("src"), F.col(x.time_index).alias("ts")) for x in ontology.links.values() if x.time_index and x.source in entities]
    return joined.join(reduce(DataFrame.unionByName, times), ["link", "src"], "left") if times else joined.withColumn("ts", F.lit(None).cast("timestamp"))


def edges(resolved: DataFrame) -> DataFrame:
    """The table links: link, src, dst, ts; members of one entity give an edge once."""
    return resolved.where("src is not null and dst is not null").select("link", "src", "dst", "ts").distinct()


def link_report(resolved: DataFrame) -> DataFrame:
    """Per link: references seen, written, distinct edges, with a time, unresolved (no target), orphaned (no source entity)."""
    whole = F.expr("src is not null and dst is not null")
    return resolved.groupBy("link").agg(F.count("*").alias("seen"), F.count_if(whole).alias("written"), F.countDistinct(F.when(whole, F.struct("src", "dst"))).alias("edges"), F.count_if(whole & F.col("ts").isNotNull()).alias("time_indexed"), F.count_if(F.expr("src is not null and dst is null")).alias("unresolved"), F.count_if(F.col("src").isNull()).alias("orphaned"))


def laid_out(links: DataFrame) -> DataFrame:
    """links sorted so that a target's edges of a time lie together, which Parquet statistics then prune."""
    return links.repartition("link", "dst").sortWithinPartitions("link", "dst", "ts")
