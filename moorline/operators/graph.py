"""Connected components: forests of bounded pieces, then rounds of joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegralType, StringType

from moorline.stage import remove, shared_dir, ship

#: Edges that one task joins by itself, about.
EDGES = 200_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): rows (node, component), component the smallest node reachable.

    First each partition's edges, of a bounded number, become stars around their smallest nodes. If there are several
    partitions, large-star and small-star steps alternate; each round is written to the shared folder, so lineage
    stays short. Both steps only group by a node and take its smallest neighbour, which Spark pre-aggregates,
    and join that back, which AQE splits if a node is hot. Empty edges give an empty table.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, paths = _stored(now, spark, [], None)
    n = now.count()
    parts = parts_for(n)
    plain = isinstance(now.schema["a"].dataType, (IntegralType, StringType, BinaryType))
    if plain:
        ship(spark)
        now, paths = _stored(now.coalesce(parts).mapInArrow(_stars, now.schema), spark, paths, parts)
    if not plain or parts > 1:
        now = _rounds(now, spark, paths, parts, max_rounds)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _stars(batches):
    """The components of one partition's edges: each node with the smallest of its component."""
    above: dict = {}

    def top(x):
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = top(x), top(y)
            if x != y:
                above[max(x, y)] = min(x, y)
    if schema is not None:
        pairs = [(x, t) for x in above if (t := top(x)) != x]
        for k in range(0, len(pairs), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pairs[k : k + 10_000]), schema)], names=["a", "b"])


def _rounds(now: DataFrame, spark: SparkSession, paths: list[str], parts: int, max_rounds: int) -> DataFrame:
    before = None
    for _ in range(max_rounds):
        # Large star: every node's larger neighbours point to its smallest neighbour (or itself).
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a")).coalesce(parts)
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct().coalesce(parts)
        # Small star: a node and its smaller neighbours point to the smallest of them.
        small = large.groupBy("a").agg(F.min("b").alias("low"))
        linked = large.join(small, "a")
        after = linked.select(F.col("b").alias("a"), F.col("low").alias("b")).union(linked.select("a", F.col("low").alias("b")))
        after = after.where("a <> b").distinct()
        after, paths = _stored(after, spark, paths, parts)
        sign = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        now = after
        if sign == before:
            return now
        before = sign
    raise RuntimeError("components have not converged")


def parts_for(rows: int, each: int = EDGES) -> int:
    """How many partitions so many small rows are worth."""
    return max(1, -(-rows // each))


def _stored(df: DataFrame, spark: SparkSession, paths: list[str], parts: int | None) -> tuple[DataFrame, list[str]]:
    """Writes df and drops the table before the last, which nothing reads any more."""
    path = shared_dir(spark, "components")
    (df.coalesce(parts) if parts else df).write.parquet(path)
    for old in paths[:-1]:
        remove(spark, old)
    return spark.read.schema(df.schema).parquet(path), [*paths[-1:], path]
