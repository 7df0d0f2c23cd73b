"""Clusters of matching records: connected components, or greedy merging that no veto may span."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.stage import discard, materialise, ship

from .evaluate import with_rates
from .graph import components

#: Records of one connected component that the greedy step takes in one task; larger ones are settled in rounds.
LARGEST = 200_000


def ref_text(ref: str) -> Column:
    """A record as text that sorts as source and key do."""
    return F.concat(F.lpad(F.col(f"{ref}.source_id").cast("string"), 10, "0"), F.lit(":"), F.lpad((F.col(f"{ref}.key_hash").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0"))


def transitive(scored: DataFrame, records: DataFrame) -> DataFrame:
    """ref, cluster (the smallest member's text): all records (type, ref), joined by match edges."""
    edges = scored.where("decision = 'match'").select(ref_text("a").alias("a"), ref_text("b").alias("b"))
    return _with_singletons(components(edges).withColumnRenamed("component", "cluster"), records)


def _with_singletons(of: DataFrame, records: DataFrame) -> DataFrame:
    named = records.select("type", "ref", ref_text("ref").alias("node"))
    return named.join(of, "node", "left").select("type", "ref", F.coalesce("cluster", "node").alias("cluster"))


def greedy(edges: list[tuple[str, str, float]], vetoes: set[tuple[str, str]]) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Merges by falling score, equal scores by pair, refusing what a vetoed pair would span: members' clusters, refusals."""
    members: dict[str, list[str]] = {}
    of: dict[str, str] = {}
    against: dict[str, set[str]] = {}
    for a, b in vetoes:
        against.setdefault(a, set()).add(b)
        against.setdefault(b, set()).add(a)
    for a, b, _ in edges:
        for n in (a, b):
            of.setdefault(n, n)
            members.setdefault(n, [n])
    refused = []
    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        x, y = of[a], of[b]
        if x == y:
            continue
        small, large = sorted((x, y), key=lambda c: len(members[c]))
        if any(not against.get(n, set()).isdisjoint(members[large]) for n in members[small]):
            refused.append((a, b))
            continue
        members[large] += members.pop(small)
        for n in members[large]:
            of[n] = large
    return {n: min(members[c]) for n, c in of.items()}, refused


def in_rounds(edges: DataFrame, vetoes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As greedy(), for components of any size: merged labels (a, b) and refused edges (a, b) of edges (a, b, score).

    An edge that comes first among all that touch either of its two clusters is decided the same in the whole order as
    now, as no edge before it touches them. Each round decides all such edges, which share no cluster, and renames the
    clusters that merge by their smallest member. Rounds are written, so lineage stays short.
    """
    edges = edges.groupBy("a", "b").agg(F.max("score").alias("score"))
    live = materialise(edges.select("a", "b", F.struct((-F.col("score")).alias("against"), "a", "b").alias("place"), F.col("a").alias("x"), F.col("b").alias("y")).where("a <> b"), "edges")
    barred = materialise(vetoes.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct(), "vetoes")
    merged, refused = [], []
    while not live.isEmpty():
        first = live.select(F.explode(F.array("x", "y")).alias("of"), "place").groupBy("of").agg(F.min("place").alias("best"))
        now = live.join(first.toDF("x", "best_x"), "x").join(first.toDF("y", "best_y"), "y").where("place = best_x and place = best_y")
        marks = barred.withColumn("apart", F.lit(True))
        told = now.select("a", "b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).join(marks, ["x", "y"], "left")
        told = materialise(told.select("a", "b", "x", "y", F.coalesce("apart", F.lit(False)).alias("apart")), "decided")
        joins = told.where("not apart").select(F.col("y").alias("old"), F.col("x").alias("new"))
        merged.append(joins.select(F.col("old").alias("a"), F.col("new").alias("b")))
        refused.append(told.where("apart").select("a", "b"))

        def renamed(of: DataFrame, joins: DataFrame = joins) -> DataFrame:
            for c in ("x", "y"):
                of = of.join(joins.select(F.col("old").alias(c), F.col("new").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
            return of.where("x <> y")

        before = live, barred
        live = materialise(renamed(live.join(told.select("a", "b"), ["a", "b"], "left_anti")).select("a", "b", "place", "x", "y"), "edges")
        barred = materialise(renamed(barred).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "vetoes")
        discard(*before)
    none = live.select("a", "b").limit(0)
    return reduce(DataFrame.union, merged, none), reduce(DataFrame.union, refused, none)


def constrained(scored: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ref, cluster) of all records, and the refused edges (a, b).

    Merges and vetoes of one component of match edges don't touch another, so each component is settled on its own.
    Only components that hold a veto need the greedy step: in one task each, or in rounds if of more than LARGEST records.
    """
    ship(scored.sparkSession)
    matches = scored.where("decision = 'match'").select(ref_text("a").alias("a"), ref_text("b").alias("b"), "score")
    vetoes = scored.where("vetoed").select(ref_text("a").alias("a"), ref_text("b").alias("b"))
    of = components(matches.select("a", "b"))
    x, y = of.select(F.col("node").alias("a"), "component"), of.select(F.col("node").alias("b"), F.col("component").alias("other"))
    inside = vetoes.join(x, "a").join(y, "b").where("component = other").select("component", "a", "b", F.lit(None).cast("double").alias("score"))
    torn = inside.select("component").distinct()
    rows = matches.join(x, "a").select("component", "a", "b", "score").join(torn, "component", "left_semi").unionByName(inside)
    large = materialise(of.join(torn, "component", "left_semi").groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > LARGEST).select("component"), "large")

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        edges = [(a, b, s) for a, b, s in zip(part["a"], part["b"], part["score"]) if s == s and s is not None]
        barred = {(a, b) for a, b, s in zip(part["a"], part["b"], part["score"]) if s != s or s is None}
        clusters, refused = greedy(edges, barred)
        return pd.DataFrame([(n, c, None) for n, c in clusters.items()] + [(a, None, b) for a, b in refused], columns=["node", "cluster", "refused"])

    settled = rows.join(large, "component", "left_anti").groupBy("component").applyInPandas(settle, "node string, cluster string, refused string")
    whole = of.join(torn, "component", "left_anti").select("node", F.col("component").alias("cluster"))
    clusters = whole.unionByName(settled.where("cluster is not null").select("node", "cluster"))
    refused = settled.where("refused is not null").select(F.col("node").alias("a"), F.col("refused").alias("b"))
    if not large.isEmpty():
        own = rows.join(large, "component", "left_semi")
        merged, more = in_rounds(own.where("score is not null").select("a", "b", "score"), own.where("score is null").select("a", "b"))
        clusters, refused = clusters.unionByName(components(merged).withColumnRenamed("component", "cluster")), refused.unionByName(more)
    return _with_singletons(clusters, records), refused


def cluster_stats(clusters: DataFrame) -> DataFrame:
    """clusters, largest, singletons, implied_pairs."""
    n = F.col("n")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.coalesce(F.max(n), F.lit(0)).alias("largest"), F.count_if(n == 1).alias("singletons"), F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("implied_pairs"))


def against_golden(clusters: DataFrame, golden: DataFrame) -> DataFrame:
    """Counts of golden pairs (a, b, label) by whether they share a cluster: tp, fp, tn, fn."""
    x, y = clusters.select(F.col("ref").alias("a"), F.col("cluster").alias("p")), clusters.select(F.col("ref").alias("b"), F.col("cluster").alias("q"))
    met = golden.join(x, "a", "left").join(y, "b", "left")
    one, together = F.col("label") == "match", F.coalesce(F.col("p") == F.col("q"), F.lit(False))
    return met.agg(F.count_if(one & together).alias("tp"), F.count_if(~one & together).alias("fp"), F.count_if(~one & ~together).alias("tn"), F.count_if(one & ~together).alias("fn"))



def metrics(clusters: DataFrame, golden: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """One row: cluster_stats, refused_merges, and counts and rates of the golden pairs by whether they share a cluster."""
    merges = F.lit(0).cast("bigint") if refused is None else F.col("refused_merges")
    out = cluster_stats(clusters).crossJoin(with_rates(against_golden(clusters, golden)))
    if refused is not None:
        out = out.crossJoin(refused.agg(F.count("*").alias("refused_merges")))
    return out.select("clusters", "largest", "singletons", "implied_pairs", merges.alias("refused_merges"), "tp", "fp", "fn", "precision", "recall", "f1")
