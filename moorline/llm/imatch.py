"""I-Match fingerprints: terms of a band of inverse document frequency, sorted, hashed under randomised lexicons.

The lexicon holds the terms whose share of documents lies in a band; as the share has a lower end, the lexicon's size
is bounded by a document's mean number of distinct terms over that end, however large the corpus. Randomised lexicons
keep each term with a chance of a half down to a 512th. Under each, a text's distinct terms are sorted and hashed; the
hashes in a row are the fingerprint. Which of two fingerprints' hashes are equal tells how many terms their texts share.

A text without lexicon terms, as null and empty texts, has a hash of the text itself as its fingerprint, like only to
equal texts. Equal texts have equal fingerprints. Documents are ordered by doc_id (null first), equal ids by text.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import large_batches, materialise, tune
from .decontaminate import words

#: The band: shares of all documents that hold a term, and so its inverse document frequency.
RAREST, COMMONEST = 0.002, 0.25
#: How many lexicons keep a term with which chance.
LEXICONS = [(4, 2), (8, 8), (16, 32), (24, 128), (24, 512)]
#: Distinct terms that a task counts before it emits; candidate terms that a task may hold, more are counted by a shuffle.
COUNTED, HELD = 300_000, 500_000
#: Characters of the documents of one task when neighbours meet, and tasks at most: the driver holds a bound for each,
#: and a task streams its documents, however many they are.
TASK_CHARS, TASKS = 16_000_000, 20_000


def _counts(docs: DataFrame, keep: frozenset | None, share: float) -> DataFrame:
    """term, n of each task's documents: without keep only terms of at least that share of them, else exact counts of keep's terms.

    silent is how many of the block's documents a term may be in that the block doesn't tell of."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int64()), ("silent", pa.int64()), ("docs", pa.int64()), ("chars", pa.int64())])

    def rows(batches):
        count, docs, chars = Counter(), 0, 0

        def flush():
            least = share * docs
            silent = max(0, math.ceil(least) - 1)
            yield from ((t.decode(), n, silent, 0, 0) for t, n in count.items() if keep is not None or n >= least)
            yield None, 0, silent, docs, chars

        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = set(words(text))
                count.update(own if keep is None else own & keep)
                docs += 1
                chars += len(text or "")
            if len(count) > COUNTED and keep is None:
                # A term of the whole corpus' share has it in one such block at least.
                yield from flush()
                count, docs, chars = Counter(), 0, 0
        yield from flush()

    return docs.select("text").mapInArrow(lambda batches: large_batches(rows(batches), schema), "term string, n bigint, silent bigint, docs bigint, chars bigint")


def lexicon(docs: DataFrame) -> tuple[list[bytes], int, int]:
    """The terms of the band, and how many documents and characters there are; every document is counted."""
    sums = [F.sum(c).alias(c) for c in ("n", "silent", "docs", "chars")]
    blocks = materialise(_counts(docs, None, RAREST).groupBy("term").agg(*sums), "candidates")
    n, chars, silent = (x or 0 for x in blocks.agg(F.sum("docs"), F.sum("chars"), F.sum(F.when(F.col("term").isNull(), F.col("silent")))).first())
    # A term's documents are those counted and at most what the blocks without word of it are silent about.
    likely = blocks.where(F.col("term").isNotNull() & (F.col("n") + silent - F.col("silent") >= RAREST * n)).select("term")
    # More than a task may hold: no term is left out, all blocks' counts meet by term.
    keep = frozenset(r.term.encode() for r in likely.collect()) if likely.count() <= HELD else None
    exact = _counts(docs, keep, 0.0).where("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
    return sorted(r.term.encode() for r in exact.where(F.col("n").between(RAREST * n, COMMONEST * n)).collect()), n, chars


class Printer:
    """Fingerprints under the lexicons of a term list."""

    def __init__(self, terms: list[bytes]):
        lots = [chance for number, chance in LEXICONS for _ in range(number)]
        self.member = {}
        for t in terms:
            # 16 bits for each lexicon decide whether it keeps the term.
            bits = np.frombuffer(b"".join(hashlib.blake2b(t, person=bytes([k]), digest_size=64).digest() for k in range(-(-2 * len(lots) // 64))), dtype="<u2")[: len(lots)]
            self.member[t] = tuple(k for k, c in enumerate(lots) if bits[k] < 65536 // c)
        self.terms = frozenset(terms)
        self.size = len(lots)

    def __call__(self, text: str) -> str:
        own = sorted(set(words(text)) & self.terms)
        if not own:
            return "text:" + hashlib.blake2b(text.encode(), digest_size=8).hexdigest()
        held: list[list[bytes]] = [[] for _ in range(self.size)]
        for t in own:
            for k in self.member[t]:
                held[k].append(t)
        from xxhash import xxh3_64_intdigest

        return ":".join(f"{xxh3_64_intdigest(b' '.join(h)) & 0xFFFFFFFF:08x}" if h else "-" for h in held)


_CHANCE = np.repeat([1 / c for _, c in LEXICONS], [n for n, _ in LEXICONS])
#: Numbers of terms that likeness() chooses among, and the log chance that a lexicon keeps none of so many, or any.
_SIZES = np.concatenate([[0.01], np.geomspace(1, 20_000, 140)])
_NONE = _SIZES[:, None] * np.log1p(-_CHANCE)[None, :]
_ANY = np.log(-np.expm1(np.minimum(_NONE, -1e-12)))


def likeness(a: str, b: str) -> float:
    """From 0 to 1: the estimated share of common terms among all terms of two fingerprints' texts.

    A lexicon's hashes are equal if it keeps no term that only one text has, and both are empty if it keeps no term of
    either; the likeliest numbers of such terms, by all lexicons, give the share.
    """
    if a == b:
        return 1.0
    x, y = a.split(":"), b.split(":")
    if len(x) != len(y) or x[0] == "text":
        return 0.0
    same = np.fromiter((p == q for p, q in zip(x, y)), dtype=bool, count=len(x))
    blank = np.fromiter((p == q == "-" for p, q in zip(x, y)), dtype=bool, count=len(x))
    apart, whole = (_SIZES[int(np.argmax(_NONE @ k + _ANY @ ~k))] for k in (same, blank))
    return float(min(1.0, max(0.0, 1 - apart / whole)))


def edited(text: str, follower: str) -> str:
    """text with its last half replaced by as many of the follower's first code points, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    tune(spark)
    terms, n, chars = lexicon(docs)
    shared = spark.sparkContext.broadcast(terms)
    kind = docs.schema["doc_id"].dataType
    least = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(least)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, min(n, -(-chars // TASK_CHARS), TASKS))
    cuts = (rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 100_000)).first()[0] if parts > 1 else None) or []
    bounds = np.array(sorted(set(cuts)), dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(), side="right").astype(np.int32))

    firsts = {r.part: r.first for r in rows.select("k").withColumn("part", part_of("k")).groupBy("part").agg(F.min("k").alias("first")).collect()}
    order = sorted(firsts)
    # The first documents of a part also go to the part before it, and the very first to the last: as followers.
    before = {p: order[i - 1] for i, p in enumerate(order)}
    firsts_of = np.full(len(bounds) + 1, least, dtype=np.int64)
    before_of = np.zeros(len(bounds) + 1, dtype=np.int32)
    for p in order:
        firsts_of[p], before_of[p] = firsts[p], before[p]

    @F.pandas_udf("array<int>")
    def places(k: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, k.to_numpy(), side="right")
        return pd.Series([[p, before_of[p]] if firsts_of[p] == v else [p] for p, v in zip(at.tolist(), k.tolist())])

    dealt = rows.select("doc_id", "k", "text", F.posexplode(places("k")).alias("follows", "part"))
    sorted_parts = dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "follows", "k", "text")
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def made(batches):
        printer = Printer(shared.value)

        def line(now, text, own):
            other = edited(now[1], text)
            print_ = printer(other)
            return now[0], len(now[1]), hashlib.sha256(other.encode()).hexdigest(), now[2], print_, likeness(now[2], print_), likeness(now[2], own)

        part, now = None, None
        for batch in batches:
            for doc_id, text, follows, of in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if of != part:
                    part, now = of, None
                if follows and now is None:
                    continue  # the part's last document has its follower
                own = printer(text)
                if now is not None:
                    yield line(now, text, own)
                now = None if follows else (doc_id, text, own)

    names = f"doc_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sorted_parts.mapInArrow(lambda batches: large_batches(made(batches), schema), names)
