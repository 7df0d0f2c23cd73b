"""MinHash near-duplicates with odd sketches.

A document is the set of its distinct word shingles (words end at ASCII white space, A-Z are lowered). Documents of
equal sets are one class, and classes go on. Each class has MinHash samples of two makes: bands of repeated samples
choose candidate pairs, and the least hash in each of many slots (one-permutation samples), folded into a parity
bitmap (an odd sketch), verifies a candidate: the population count of two bitmaps' XOR tells their similarity. What the
sketches cannot rule out is confirmed on the full sets.

Two rounds leave no candidate pair between components undecided, whatever a bucket's size. In the first, each bucket
tests its most central member, the one that shares the most buckets, against the others: a group of n copies costs n
tests. In the second, buckets that still hold several components compare what lies outside their largest component with
all members: a task holds a bounded block of such sketches while members stream past, and only pairs that the sketches
can't rule out become rows. Large buckets are split over many tasks.

Null, empty and blank texts have no shingles and are linked with nothing. Rows that share a doc_id are one node, also
if their texts differ. A row with a null doc_id is linked with nothing, has a null component_id and is kept. Written stages are deleted
once no later one reads them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import components, discard, materialise, release, tune

BANDS, ROWS = 30, 5
#: Slots of one-permutation samples, and bits of the odd sketch that they are folded into (both powers of two).
SLOTS = SKETCH_BITS = 4096
WORDS64 = SKETCH_BITS // 64
#: Standard deviations beyond which a sketch rules a pair out.
SURE = 4.5
#: Sketches that a task of the second round holds, about, and members that stream past them in one task.
BLOCK, STREAM = 1000, 20_000
#: Pairs compared at once, and what a row of the second round is.
CELLS = 1 << 16
#: Whole-number ids, by their count, that are sent to every executor so that texts needn't be dealt out by id.
SENT_IDS = 4_000_000
HELD, MAIN, APART = 0, 1, 2
_SEED = np.random.default_rng(20240501)
_A, _C = (_SEED.integers(0, 1 << 32, size=(BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1) for _ in range(2))
_BAND_KEY = _SEED.integers(0, 1 << 63, size=ROWS, dtype=np.uint64) | np.uint64(1)
_BAND_SALT = _SEED.integers(0, 1 << 63, size=BANDS, dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; of fewer words, the whole sequence is one."""
    from xxhash import xxh3_64_intdigest

    own = (text or "").encode().lower().split()
    if not own:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, own), dtype=np.uint64, count=len(own))
    size = min(words, len(own))
    out = np.full(len(own) - size + 1, np.uint64(size))
    for k in range(size):
        out = _mix(out * _M2 + hashes[k : len(own) - size + 1 + k])
    return np.unique(out)


def digest(of: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(of.tobytes())


def signature(of: np.ndarray) -> tuple[bytes, list[int], bytes]:
    """Of a shingle set: its digest, the band hashes and the odd sketch."""
    low, high = (of & np.uint64(0xFFFFFFFF)).astype(np.uint32), (of >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for k in range(0, len(of), 512):
        np.minimum(least, (low[None, k : k + 512] * _A + high[None, k : k + 512] * _C).min(axis=1), out=least)
    wide = least.astype(np.uint64)
    bands = _mix((_mix(wide.reshape(BANDS, ROWS) + _BAND_KEY[None, :]) * _BAND_KEY[None, :]).sum(axis=1, dtype=np.uint64) + _BAND_SALT)
    # The set is sorted, so a slot's least hash is the first with the slot's upper bits.
    slot = (of >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
    samples = of[np.flatnonzero(np.diff(slot, prepend=-1))]
    places = (_mix(samples * _M1 + _M2) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    parity = (np.bincount(places, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return digest(of), bands.view(np.int64).tolist(), np.packbits(parity).tobytes()


def distance(total: np.ndarray | float, share: float, lopsided: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the XOR population count of two sets with total shingles in all and that similarity.

    Which hashes fall into one slot, and which samples onto one bit, is chance; the sets' sizes are given, so the
    variances are those of independent (Poisson) numbers less what the given sizes explain.
    """
    union = np.asarray(total, dtype=float) / (1 + share) / SLOTS
    left = (1 - share) * union * (1.0 if lopsided else 0.5)
    rates = [share * union, left, (1 - share) * union - left]

    def apart(c, a, b):
        """Per slot, the chance of unequal samples, and that of one sample alone."""
        whole = c + a + b
        return -np.expm1(-whole) * (1 - c / whole), np.exp(-(c + a)) + np.exp(-(c + b)) - 2 * np.exp(-whole)

    differ, alone = apart(*rates)
    mean = 2 * differ - alone
    spread = 4 * differ - 3 * alone - mean**2
    for i, rate in enumerate(rates):
        step = 1e-4 * rate + 1e-12
        more, lone = apart(*[r + step * (k == i) for k, r in enumerate(rates)])
        spread = spread - rate * ((2 * more - lone - mean) / step) ** 2
    samples, spread = SLOTS * mean, SLOTS * np.maximum(spread, 0)
    fold = np.exp(-2 * samples / SKETCH_BITS)
    folding = np.maximum(SKETCH_BITS / 4 * (1 - fold**2) - samples * fold**2, 0)
    return SKETCH_BITS / 2 * (1 - fold), np.sqrt(folding + fold**2 * spread)


def estimate(count: int, total: float) -> float:
    """The similarity of two sets with total shingles in all whose sketches differ in count bits."""
    low, high = 0.0, 1.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if distance(total, middle)[0] > count else (low, middle)
    return (low + high) / 2


@lru_cache(maxsize=8)
def _furthest(share: float) -> tuple[np.ndarray, np.ndarray]:
    totals = np.geomspace(1, 1e9, 800)
    return np.log(totals), np.max([m + SURE * s + 1 for m, s in (distance(totals, share, x) for x in (False, True))], axis=0)


def furthest(total: np.ndarray | float, share: float) -> np.ndarray:
    """The largest population count that doesn't rule out a similarity of share."""
    return np.interp(np.log(total), *_furthest(share))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest, bands, sketch of every row."""

    def run(batches):
        release()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                of = shingles(text, words)
                out.append((len(of), *(signature(of) if len(of) else (None, None, None))))
            n, digests, bands, sketch = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "digest", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, digest binary, bands array<bigint>, sketch binary")


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """The rows of a column of equally long binaries."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width)


def _close(pairs: DataFrame, active: DataFrame, share: float) -> DataFrame:
    """Of pairs (a, b) those that the sketches don't rule out, with rep_a, rep_b. a may be in any number of pairs."""
    own = active.select("digest", "rep", "n_shingles", "sketch")
    of_b = pairs.join(own.toDF("b", "rep_b", "n_b", "s_b"), "b")
    both = of_b.join(own.toDF("a", "rep_a", "n_a", "s_a"), "a").select("a", "b", "rep_a", "rep_b", "n_a", "n_b", "s_a", "s_b")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (_matrix(batch.column(i), np.uint64, WORDS64) for i in (6, 7))
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            near = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= furthest(n + m, share)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(near & (np.minimum(n, m) >= share * np.maximum(n, m) - 1e-6)))

    return both.mapInArrow(run, both.select("a", "b", "rep_a", "rep_b").schema)


def _joined(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs joined with a written table of doc_ids: if its rows are few, counted before, texts stay where they are."""
    few = isinstance(ids.schema["doc_id"].dataType, IntegralType) and ids.count() <= SENT_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def _texts(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """digest, text: one text of each class of these documents."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([digest(shingles(t, words)) for t in batch.column(1).to_pylist()], pa.binary()), batch.column(1)], names=["digest", "text"])

    rows = _joined(docs.select("doc_id", "text"), ids, "left_semi").mapInArrow(run, "digest binary, text string")
    return rows.groupBy("digest").agg(F.first("text").alias("text"))


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (rep_a, rep_b) with 100 * intersection >= percent * union on the full sets.

    b's text goes to its pair first, then the pair to a's text: a hub's text is not sent with each of its pairs."""
    of_b = pairs.join(texts.toDF("b", "text_b"), "b")
    both = of_b.join(texts.toDF("a", "text_a"), "a").select("a", "rep_a", "rep_b", "text_a", "text_b")

    def run(batches):
        release()
        last, u = None, None
        for batch in batches:
            linked = []
            for a, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4).to_pylist()):
                if a != last:
                    last, u = a, shingles(text_a.as_py(), words)
                v = shingles(text_b, words)
                both = len(np.intersect1d(u, v, assume_unique=True))
                linked.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select([1, 2]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, both.select("rep_a", "rep_b").schema).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def _parts(rows: int, each: int = 200_000) -> int:
    """Partitions of so many rows, two at least: small tables needn't be dealt out like large ones."""
    return max(2, -(-rows // each))


def _buckets(known: DataFrame, rows: int) -> DataFrame:
    """(bucket, digest, n) of the buckets that hold more than one class, n of their documents."""
    parts = _parts(rows * BANDS, 500_000)
    dealt = known.select("digest", F.explode("bands").alias("bucket"))
    own = F.xxhash64("digest")
    shared = dealt.groupBy("bucket").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.count("*").alias("n")).where("low <> high").select("bucket", "n")
    shared = materialise(shared.coalesce(parts), "shared")
    members = materialise(dealt.join(shared, "bucket").distinct().coalesce(parts), "buckets")
    discard(shared)
    return members


def _star_pairs(members: DataFrame, parts: int) -> DataFrame:
    """(a, b): of each bucket the member whose buckets hold the most documents, and each other member."""
    weighed = members.withColumn("weight", F.sum("n").over(Window.partitionBy("digest"))).select("bucket", "digest", "weight")  # at most BANDS rows
    star = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "digest")).alias("star")).select("bucket", F.col("star.digest").alias("a")).coalesce(parts)
    return weighed.join(star, "bucket").where("a <> digest").select("a", F.col("digest").alias("b")).distinct().coalesce(parts)


def _cross_pairs(members: DataFrame, active: DataFrame, component: DataFrame, share: float, parts: int) -> DataFrame:
    """The pairs (a, b, rep_a, rep_b) that share a bucket, lie in different components and aren't ruled out by their sketches; each once."""
    top = _number(F.coalesce("component", "rep"), active.schema["rep"].dataType).alias("top")
    own = active.join(component.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", "rep", top, "n_shingles", "bands", "sketch").coalesce(parts)
    now = members.select("bucket", "digest").join(own.select("digest", "top"), "digest").select("bucket", "digest", "top").coalesce(parts)
    tops = now.groupBy("bucket", "top").agg(F.count("*").alias("m")).coalesce(parts)
    mixed = tops.groupBy("bucket").agg(F.sum("m").alias("n"), F.max(F.struct("m", "top")).alias("main"), F.count("*").alias("tops")).where("tops > 1").coalesce(parts)
    mixed = mixed.select("bucket", F.col("main.top").alias("main"), F.ceil(F.col("n") / STREAM).cast("int").alias("streams"), F.ceil((F.col("n") - F.col("main.m")) / BLOCK).cast("int").alias("blocks"))
    rows = materialise(now.join(mixed, "bucket").withColumn("lot", F.xxhash64("digest")).coalesce(parts), "mixed")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = rows.where("top <> main").select("bucket", "digest", F.expr("cast(pmod(lot, blocks) as int)").alias("block"), every("streams").alias("stream"), F.lit(HELD).alias("role"))
    past = rows.select("bucket", "digest", every("blocks").alias("block"), F.expr("cast(pmod(lot, streams) as int)").alias("stream"), F.when(F.col("top") == F.col("main"), MAIN).otherwise(APART).alias("role"))
    dealt = held.union(past).join(own, "digest").select("bucket", "block", "stream", "role", "digest", "rep", "top", "n_shingles", "bands", "sketch")
    dealt = dealt.repartition("bucket", "block", "stream").sortWithinPartitions("bucket", "block", "stream", "role")
    rep = active.schema["rep"].dataType.simpleString()
    pairs = materialise(dealt.mapInArrow(lambda batches: _compared(batches, share), f"a binary, b binary, rep_a {rep}, rep_b {rep}").coalesce(4 * parts), "cross")
    discard(rows)
    return pairs


def _number(of: Column, kind) -> Column:
    """A node's name as a number."""
    return of.cast("bigint") if isinstance(kind, IntegralType) else F.xxhash64(of)


def _compared(batches, share: float):
    """The pairs of rows of _cross_pairs: of each block first come the members held, then those that stream past."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, block, stream, role, top, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 6, 7))
        own = {"top": top, "n": n, "bands": batch.column(8).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS), "sketch": _matrix(batch.column(9), np.uint64, WORDS64)}
        names = {"digest": np.array(batch.column(4).to_pylist(), dtype=object), "rep": np.array(batch.column(5).to_pylist(), dtype=object)}
        own |= names | {"apart": role == APART}
        turns = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(block) != 0) | (np.diff(stream) != 0) | (np.diff(role == HELD) != 0)) + 1
        found: list[tuple] = []
        for lo, hi in zip([0, *turns], [*turns, len(bucket)]):
            if key != (key := (bucket[lo], block[lo], stream[lo])):
                held = []
            part = {k: v[lo:hi] for k, v in own.items()}
            if role[lo] == HELD:
                held.append(part)
            elif held:
                if len(held) > 1:
                    held = [{k: np.concatenate([h[k] for h in held]) for k in held[0]}]
                i, j = _near(held[0], part, bucket[lo], share)
                found.append((held[0]["digest"][i], part["digest"][j], held[0]["rep"][i], part["rep"][j]))
        columns = [np.concatenate(c) for c in zip(*found)] or [()] * 4
        kinds = [pa.binary(), pa.binary(), batch.column(5).type, batch.column(5).type]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["a", "b", "rep_a", "rep_b"])


def _near(held: dict, past: dict, bucket: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in held and past of the pairs to confirm."""
    at_held, at_past = [], []
    step = max(1, CELLS // len(past["top"]))
    for lo in range(0, len(held["top"]), step):
        h = {k: v[lo : lo + step] for k, v in held.items() if k != "rep"}
        # Sets whose sizes alone rule the similarity out, and pairs within a component, need no sketches.
        n, m = h["n"][:, None], past["n"][None, :]
        i, j = np.nonzero((h["top"][:, None] != past["top"][None, :]) & (np.minimum(n, m) >= share * np.maximum(n, m) - 1e-6))
        for k in range(0, len(i), CELLS):
            x, y = i[k : k + CELLS], j[k : k + CELLS]
            count = np.zeros(len(x), dtype=np.int32)
            for w in range(0, WORDS64, 8):
                count += np.bitwise_count(h["sketch"][x, w : w + 8] ^ past["sketch"][y, w : w + 8]).sum(axis=1, dtype=np.int32)
            near = count <= furthest(h["n"][x] + past["n"][y], share)
            x, y = x[near], y[near]
            # A pair is one of the first bucket that it shares; of two that are both held, one is the first.
            same = h["bands"][x] == past["bands"][y]
            first = h["bands"][x, same.argmax(axis=1)] == bucket
            once = ~past["apart"][y] | (h["digest"][x] < past["digest"][y]) if len(x) else first
            keep = first & once.astype(bool)
            at_held.append(x[keep] + lo)
            at_past.append(y[keep])
    return tuple(np.concatenate(p) if p else np.empty(0, dtype=np.int64) for p in (at_held, at_past))


def _links(docs: DataFrame, signed: DataFrame, classes: DataFrame, rows: int, words: int, percent: int) -> DataFrame:
    """The components (node, component) of all doc_ids that links join."""
    share = percent / 100
    known = signed.where("n_shingles > 0 and doc_id is not null")
    # Rows of one doc_id with different texts join their classes.
    odd = known.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("low"), F.max(F.xxhash64("digest")).alias("high")).where("low <> high").select("doc_id").coalesce(_parts(rows))
    tied = materialise(known.select("doc_id", "digest").join(odd, "doc_id").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct().coalesce(_parts(rows)), "tied")
    members = _buckets(known, rows)
    parts = _parts(members.count())
    wanted = classes.join(members.select("digest").distinct().coalesce(parts), "digest").select("digest", F.col("rep").alias("doc_id"))
    active = known.join(wanted, ["digest", "doc_id"]).select("digest", F.col("doc_id").alias("rep"), "n_shingles", "bands", "sketch")
    active = materialise(active.dropDuplicates(["digest"]).coalesce(parts), "active")
    ids = materialise(active.select(F.col("rep").alias("doc_id")).distinct().coalesce(parts), "ids")
    texts = materialise(_texts(docs, ids, words).coalesce(2 * parts), "texts")

    stars = materialise(_close(_star_pairs(members, parts), active, share).coalesce(parts), "stars")
    links = materialise(_confirmed(stars, texts, words, percent).union(tied).coalesce(2 * parts), "links")
    component = materialise(components(links), "components")
    cross = _cross_pairs(members, active, component, share, parts)
    more = materialise(_confirmed(cross, texts, words, percent).coalesce(4 * parts), "links")
    if not more.isEmpty():
        first, component = component, materialise(components(links.union(more)), "components")
        discard(first)
    discard(tied, members, active, ids, texts, stars, links, cross, more)
    return component


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept."""
    tune(docs.sparkSession)
    signed = materialise(signatures(docs, words), "signatures")
    rows = signed.count()
    known = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(known.groupBy("digest").agg(F.min("doc_id").alias("rep")).coalesce(_parts(rows)), "classes")
    component = _links(docs, signed, classes, rows, words, percent)
    out = signed.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").join(component.select(F.col("node").alias("rep"), "component"), "rep", "left")
    top = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", top.alias("component_id"), F.coalesce(F.col("doc_id") == top, F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each group the one with the smallest doc_id.

    Rows that share the doc_id that stays all stay, as do rows with a null doc_id.
    """
    gone = materialise(near_duplicates(docs, words, percent).where("not kept").select("doc_id").distinct(), "gone")
    return _joined(docs, gone, "left_anti").select(*docs.columns)
