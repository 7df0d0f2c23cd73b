"""Quality against golden pairs: splits, confusion matrices, worst examples, and the tuner of weights."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.functions import hashing
from moorline.schema.mapping import Bundle
from moorline.sources.rows import split_csv

from .mapping import SEPARATOR
from .scoring import Config, Weights


def golden_pairs(bundle: Bundle, source: str | Path, spark) -> DataFrame:
    """a, b, label, truth_id, split of a golden file (record_a, record_b, label, truth_id); an unknown source is an error.

    A golden file is small and read on the driver; its pairs' split is by the portable hash of their keys' parts."""
    text = Path(source).read_text() if isinstance(source, Path) else source
    header, *lines = [cells for _, cells in split_csv(text)]

    def ref(told: str) -> tuple[int, str]:
        name, _, key = told.partition(":")
        if name not in bundle.sources or not key:
            raise ValueError(f"golden pair names an unknown record: {told!r}")
        return bundle.sources[name].source_id, key.replace("|", SEPARATOR)

    rows = []
    for cells in lines:
        row = dict(zip(header, cells))
        if row["label"] not in ("match", "non_match"):
            raise ValueError(f"unknown label {row['label']!r}")
        both = ref(row["record_a"]), ref(row["record_b"])
        held = hashing.holdout(tuple((s, hashing.hash64_fields(k.split(SEPARATOR))) for s, k in both))
        rows.append((*both[0], *both[1], row["label"], row.get("truth_id", ""), "holdout" if held else "train"))
    table = spark.createDataFrame(rows, "sa int, ka string, sb int, kb string, label string, truth_id string, split string")
    side = lambda s, k: F.struct(F.col(s).alias("source_id"), F.xxhash64(k).alias("key_hash"))
    return table.select(F.least(side("sa", "ka"), side("sb", "kb")).alias("a"), F.greatest(side("sa", "ka"), side("sb", "kb")).alias("b"), "label", "truth_id", "split")


def split(percent: int = 20) -> Column:
    """holdout or train, by a hash of the ordered pair, for labels that weren't read from a golden file."""
    told = F.concat_ws("|", *[F.col(c).cast("string") for c in ("a.source_id", "a.key_hash", "b.source_id", "b.key_hash")])
    return F.when(F.pmod(F.xxhash64(told), F.lit(100)) < percent, "holdout").otherwise("train")


def confusion(pairs: DataFrame, *by: str) -> DataFrame:
    """tp, fp, tn, fn and missed_to_review of pairs with label and decision; a pair that was never compared is no match."""
    true, said = F.col("label") == "match", F.coalesce(F.col("decision") == "match", F.lit(False))
    return pairs.groupBy(*by).agg(F.count_if(true & said).alias("tp"), F.count_if(~true & said).alias("fp"), F.count_if(~true & ~said).alias("tn"), F.count_if(true & ~said).alias("fn"), F.count_if(true & (F.col("decision") == "review")).alias("missed_to_review"))


def with_rates(matrix: DataFrame) -> DataFrame:
    """precision, recall, f1, accuracy; 0 where nothing is divided by."""
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return matrix.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + tn + fn)})


def _split_of(golden: DataFrame) -> Column:
    return F.col("split") if "split" in golden.columns else split()


def evaluate(scored: DataFrame, golden: DataFrame) -> DataFrame:
    """Rates for holdout, train and overall."""
    met = golden.join(scored.select("a", "b", "score", "decision"), ["a", "b"], "left").withColumn("split", _split_of(golden))
    parts = confusion(met, "split").unionByName(confusion(met.withColumn("split", F.lit("overall")), "split"))
    return with_rates(parts)


def worst(scored: DataFrame, golden: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """False positives by falling score, false negatives by rising score."""
    met = golden.join(scored, ["a", "b"])
    return met.where("label = 'non_match' and decision = 'match'").orderBy(F.desc("score"), "a", "b").limit(n), met.where("label = 'match' and decision <> 'match'").orderBy("score", "a", "b").limit(n)


def tune(features: list[dict[str, float]], labels: list[bool], vetoed: list[bool], start: Weights, max_passes: int = 12, least: float = 0.0005) -> tuple[Weights, float]:
    """Coordinate ascent on F1 over golden pairs, which are few and on the driver: steps of each weight, then of the threshold."""
    names = sorted({k for f in features for k in f} | set(start.weights))
    x = np.array([[f.get(k, 0.0) for k in names] for f in features]).reshape(len(features), len(names))
    y, barred = np.array(labels, dtype=bool), np.array(vetoed, dtype=bool)

    def f1(w: np.ndarray, threshold: float) -> float:
        said = (x @ w >= threshold) & ~barred
        wrong = (said != y).sum()
        return 0.0 if not (said & y).any() else 2 * (said & y).sum() / (2 * (said & y).sum() + wrong)

    w, threshold = np.array([start.weight(k) for k in names]), start.match
    best = f1(w, threshold)
    for _ in range(max_passes):
        before = best
        for j in range(len(names)):
            for step in (2.0, 1.0, 0.5, 0.25):
                for sign in (1, -1):
                    trial = w.copy()
                    trial[j] = max(0.0, w[j] + sign * step)
                    if (now := f1(trial, threshold)) > best:
                        best, w = now, trial
        for step in (1.0, 0.5, 0.25):
            for sign in (1, -1):
                if (now := f1(w, threshold + sign * step)) > best:
                    best, threshold = now, threshold + sign * step
        if best - before < least:
            break
    return replace(start, weights=dict(zip(names, map(float, w))), match=threshold, review=min(start.review, threshold)), best


def tune_pairs(scored: DataFrame, golden: DataFrame, config: Config, type_name: str, **options) -> tuple[Weights, float]:
    rows = golden.join(scored.where(F.col("type") == type_name).select("a", "b", "features", "vetoed"), ["a", "b"]).where(_split_of(golden) == "train").select("label", "features", "vetoed").collect()
    return tune([{f["name"]: f["value"] for f in r.features} for r in rows], [r.label == "match" for r in rows], [r.vetoed for r in rows], config.types[type_name], **options)
