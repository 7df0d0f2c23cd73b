"""Best-fit packing by hierarchical residuals.

Each partition packs its own pieces best-fit, longest first, and emits the bins that are nearly full. The others
become items of the next round, in which several partitions' items meet in one task, pack again and emit again, up a
tree, until one task holds all that is left or a task's items are so many that meeting more would gain nothing.
An item is then a bin's run of pieces that stay together.

A document's ids are those of its text, then the end id; a null text counts as empty. Only documents longer than a
sequence are cut. Repeated rows are packed each on their own.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import tokens
from .common import large_batches, materialise, tune

CAPACITY = 4096
END_ID = 1
#: Bins with no more room than this are emitted at once.
NEARLY = 3
#: Tasks whose residual items meet in one task of the next round, and items beyond which a group meets no other.
FAN_IN = 8
ENOUGH = 50_000


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Each item's bin and its place there; longest first, into the fullest bin with room."""
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    rooms: list[int] = []  # the distinct rooms of open bins, ascending
    open_bins: dict[int, list[int]] = {}
    n = 0
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[i]
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            own = open_bins[room]
            b = own.pop()
            if not own:
                del open_bins[room]
                rooms.pop(at)
        else:
            b, room, n = n, capacity, n + 1
        out[i] = (b, capacity - room)
        if room > size:
            left = room - size
            if left not in open_bins:
                open_bins[left] = []
                insort(rooms, left)
            open_bins[left].append(b)
    return out


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids as bytes), with each piece's bin in its partition and place there."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", *["ids"] * with_ids]
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        encode = tokens.encoder(vocabulary).ids
        task = TaskContext.get().partitionId()
        rows, held = [], 0
        schema = pa.schema([("doc_id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("place", pa.int64()), *[("ids", pa.binary())] * with_ids])
        first = 0

        def packed(rows, first):
            placed = best_fit([r[3] for r in rows], capacity)
            # A task's bins: its number above, the bin's own below.
            full = [(*r[:5], (task << 36) + first + b, at, *r[5:]) for r, (b, at) in zip(rows, placed)]
            return large_batches(full, schema), first + 1 + max((b for b, _ in placed), default=-1)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own), *[own] * with_ids))
                    held += len(own) if with_ids else 64
            if held > 64 << 20:
                out, first = packed(rows, first)
                yield from out
                rows, held = [], 0
            del batch
            tokens.give_back()
        yield from packed(rows, first)[0]
        del rows
        tokens.give_back()

    ddl = {"piece": "int", "ids": "binary", "doc_id": kind}
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} {ddl.get(n, 'bigint')}" for n in names))


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    tune(spark)
    made = materialise(pieces(docs, vocabulary or tokens.vocabulary("word_bpe_49k.json"), capacity, with_ids), "pieces")
    bins = made.groupBy("bin").agg(F.sum("length").alias("fill"))
    moved = _rounds(bins.where(F.col("fill") < capacity - NEARLY), capacity)
    out = made.join(moved, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence", F.col("bin")).alias("sequence_id"), (F.col("place") + F.coalesce("base", F.lit(0))).alias("offset"), *["ids"] * with_ids)


def _rounds(items: DataFrame, capacity: int) -> DataFrame:
    """Where each underfull bin goes: bin, sequence, base (its place in the sequence)."""
    task = F.shiftright("bin", 36)
    # Groups by the task that made the bins, so that one round's group meets whole in a task of the next.
    now = materialise(items.select(F.col("bin").alias("item"), "fill", task.alias("grp")), "residuals")
    path, turn = None, 0
    while True:
        counts = now.agg(F.countDistinct("grp"), F.count("*")).first()
        if not counts[1]:
            break
        turn += 1
        groups = now.groupBy("grp").agg(F.count("*").alias("n"))
        # Groups that are already large stay by themselves: they pack as well alone.
        parents = groups.select("grp", F.when(F.col("n") < ENOUGH, F.floor(F.col("grp") / FAN_IN)).otherwise(-F.col("grp") - 1).alias("parent"))
        last = counts[0] <= 1 or groups.where(F.col("n") < ENOUGH).count() <= 1
        placed = materialise(_packed(now.join(parents, "grp"), turn, capacity), "residuals")
        step = placed.select("item", "bin", "base")
        if path is None:
            path = step.select("item", F.col("bin").alias("sequence"), "base")
        else:
            on = step.select(F.col("item").alias("sequence"), F.col("bin").alias("next"), F.col("base").alias("more"))
            path = path.join(on, "sequence", "left").select("item", F.coalesce("next", "sequence").alias("sequence"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        path = materialise(path, "paths")
        if last:
            break
        now = materialise(placed.groupBy("bin", "parent").agg(F.sum("fill").alias("fill")).where(F.col("fill") < capacity - NEARLY).select(F.col("bin").alias("item"), "fill", F.abs("parent").alias("grp")), "residuals")
    if path is None:
        return items.select("bin", F.lit(0).cast("bigint").alias("sequence"), F.lit(0).cast("bigint").alias("base")).limit(0)
    return path.select(F.col("item").alias("bin"), "sequence", "base")


def _packed(items: DataFrame, turn: int, capacity: int) -> DataFrame:
    """item, fill, parent, bin, base: the items of each parent packed best-fit in one task."""
    schema = pa.schema([("item", pa.int64()), ("fill", pa.int64()), ("parent", pa.int64()), ("bin", pa.int64()), ("base", pa.int64())])

    def run(batches):
        parent, own = None, []

        def flush():
            placed = best_fit([f for _, f in own], capacity)
            first: dict[int, int] = {}
            # A bin takes the name of one of its items, which no other bin of this round can have.
            for (item, _), (b, _) in zip(own, placed):
                first.setdefault(b, item)
            return [(item, fill, parent, first[b], at) for (item, fill), (b, at) in zip(own, placed)]

        for batch in batches:
            for p, item, fill in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if p != parent and own:
                    yield from large_batches(flush(), schema)
                    own = []
                parent = p
                own.append((item, fill))
        if own:
            yield from large_batches(flush(), schema)

    rows = items.select("parent", "item", "fill").repartition("parent").sortWithinPartitions("parent", "item")
    return rows.mapInArrow(run, "item bigint, fill bigint, parent bigint, bin bigint, base bigint")
