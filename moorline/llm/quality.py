"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled one and a scaled identity. A score is the
logistic of the difference of the two Mahalanobis log-densities, by Cholesky factors that are computed once.

Null and empty texts have the statistics of an empty text and are scored like others. Labels count once a row;
labels with a null id or a quality other than 0 and 1 are ignored, and so are rows of unlabelled documents. With
fewer than two labels of either class, every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, give_back, release, tune

#: Statistics of a text, in the order of features().
NAMES = ("length", "upper", "digits", "symbols", "loud", "stops", "foreign", "spaces", "breaks", "word_length", "word_spread", "short_words", "variety", "entropy", "lines", "bare")
#: Weight of the pooled covariance and of the identity in each class covariance.
POOLED, RIDGE = 0.1, 0.02
#: Divides the log-density difference: correlated statistics make raw discriminants too sure.
TEMPERATURE = 4.0
THRESHOLD = 0.3
#: Labelled rows to learn from, about; of more, those whose ids' hashes come first. Only their statistics are worked out to learn.
SAMPLE = 500_000

_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True


def features(text: str | None) -> list[float]:
    """The transformed statistics of one text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = max(len(raw), 1)
    words = text.split()
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    lines = text.split("\n")
    foreign = int(count[128:].sum())
    letters = max(int(count[_UPPER].sum() + count[_LOWER].sum()) + foreign, 1)
    p = count[count > 0] / n
    root = lambda x: float(np.sqrt(x))
    return [
        float(np.log1p(len(text))),
        root(count[_UPPER].sum() / letters),
        root(count[_DIGIT].sum() / n),
        root(count[_SYMBOL].sum() / n),
        root((count[33] + count[63]) / n),
        root((count[44] + count[46]) / n),
        root(foreign / n),
        root(count[32] / n),
        root(count[10] / n),
        float(np.log1p(sizes.mean())),
        float(np.log1p(sizes.std())),
        root((sizes <= 3).mean()),
        float(np.log1p(len(set(words))) / np.log1p(max(len(words), 1))),
        float(-(p * np.log(p)).sum()),
        float(len(set(lines)) / len(lines)),
        root(letters / n),
    ]


@dataclass
class Model:
    """Means, inverse Cholesky factors and log terms of classes 0 and 1; without them, a constant score."""

    constant: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    offsets: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        logs = [self.offsets[c] - 0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        z = np.clip((logs[1] - logs[0]) / TEMPERATURE, -60, 60)
        return np.round(1 / (1 + np.exp(-z)), 9)


def model_from(sums: dict[int, np.ndarray]) -> Model:
    """The discriminant of each class's count, sum and sum of products (one flat array of 1 + d + d*d)."""
    d = len(NAMES)
    n = [float(sums[c][0]) if c in sums else 0.0 for c in (0, 1)]
    if min(n) < 2:
        return Model(0.5 if sum(n) == 0 else n[1] / sum(n))
    means = [sums[c][1 : d + 1] / n[c] for c in (0, 1)]
    covs = [sums[c][d + 1 :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / (n[0] + n[1])
    scale = np.trace(pooled) / d or 1.0
    factors, offsets = [], []
    for c in (0, 1):
        cov = (1 - POOLED - RIDGE) * covs[c] + POOLED * pooled + RIDGE * scale * np.eye(d)
        lower = np.linalg.cholesky(cov + 1e-9 * np.eye(d))
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(n[c] / sum(n)) - np.log(np.diag(lower)).sum())
    return Model(n[1] / sum(n), np.array(means), np.array(factors), np.array(offsets))


def held_out(column: str = "doc_id"):
    """True for rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(True))


def marked(labels: DataFrame) -> DataFrame:
    """doc_id, quality (0 or 1) of the labelled rows that count, of which SAMPLE are taken by a hash of the id."""
    rows = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = rows.count()
    return rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (SAMPLE << 20) // n)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled rows that aren't held out; only each class's sums reach the driver.

    A document with several labels counts once for each; the texts of documents without any aren't looked at."""
    import pyarrow as pa

    d = len(NAMES)
    known = marked(labels)
    # About SAMPLE rows at most, so they go to the texts and not the texts to them.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("quality", "text")

    def partial(batches):
        # Features and sums in one run: two in a task would leave an executor twice as many workers as cores.
        release()
        total = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
        for batch in batches:
            if batch.num_rows:
                kinds = batch.column(0).to_numpy(zero_copy_only=False)
                x = np.array([features(t) for t in batch.column(1).to_pylist()])
                for c in (0, 1):
                    own = x[kinds == c]
                    total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
            del batch
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([total[0], total[1]], pa.list_(pa.float64()))], names=["quality", "sums"])

    parts = rows.mapInArrow(partial, "quality int, sums array<double>").select("quality", F.posexplode("sums").alias("at", "x"))
    sums: dict[int, np.ndarray] = {}
    for kind, at, x in parts.groupBy("quality", "at").agg(F.sum("x")).collect():
        sums.setdefault(kind, np.zeros(1 + d + d * d))[at] = x
    return model_from(sums)


def _scored(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    return append(docs, "text", lambda texts: model.scores(np.array([features(t) for t in texts])) if texts else [], "double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    tune(docs.sparkSession)
    table, made = _scored(docs.select("doc_id", "text"), fit(docs, labels))
    return table.select("doc_id", held_out().alias("held_out"), F.col(made).alias("score"), (F.col(made) >= THRESHOLD).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier keeps."""
    tune(docs.sparkSession)
    table, made = _scored(docs, fit(docs, labels))
    return table.where(F.col(made) >= THRESHOLD).drop(made)
