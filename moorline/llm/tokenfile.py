"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level k holds the k-th chunk of every id that has one, a bitmap
that tells which of them go on, and a directory of the bitmap's ranks every 512 bits. The place of an id's next chunk
is the rank of its bit, so any id is read by a few bytes at known places, and no block is decoded for it.

A file has documents in ascending doc_id order (null first; equal ids by text), in segments of a fixed number of ids,
then the documents' ids and starts, then a footer with the segments' places. A null or empty text has the end id only.
Repeated rows are written one after another, each with its own start.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import large_batches, materialise, open_fs, shared_dir, tune

MAGIC = b"DACIDS1\n"
END_ID = 2
#: Ids of one segment, which bounds the memory of writers and readers; bits between two ranks of the directory.
SEGMENT, BLOCK = 1 << 20, 512


def encode_segment(ids: np.ndarray) -> tuple[bytes, list[list[int]]]:
    """The levels of ids, and of each level its count and where its chunks, bitmap and directory begin."""
    out, places, at, rest = [], [], 0, ids
    while len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64))[:-1]]).astype("<u4")
        parts = [(rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        places.append([len(rest), at, at + len(parts[0]), at + len(parts[0]) + len(parts[1])])
        out += parts
        at += sum(map(len, parts))
        rest = rest[more] >> 8
    return b"".join(out), places


def decode_segment(raw: bytes, places: list[list[int]]) -> np.ndarray:
    """All ids of a segment."""
    deeper = np.empty(0, dtype="<u4")
    for n, chunks, bits, _ in reversed(places):
        own = np.frombuffer(raw, dtype=np.uint8, count=n, offset=chunks).astype("<u4")
        more = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=-(-n // 8), offset=bits), count=n, bitorder="little").view(bool)
        own[more] |= deeper << 8
        deeper = own
    return deeper


class Writer:
    """Writes one file; add() takes documents in order."""

    def __init__(self, stream):
        self.stream, self.segments, self.held, self.total = stream, [], bytearray(), 0
        self.docs, self.starts, self.at = [], [], len(MAGIC)
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.total)
        self.total += len(ids) // 4
        self.held += ids
        while len(self.held) >= 4 * SEGMENT:
            self._segment(bytes(self.held[: 4 * SEGMENT]))
            del self.held[: 4 * SEGMENT]

    def _segment(self, raw: bytes) -> None:
        data, places = encode_segment(np.frombuffer(raw, dtype="<u4"))
        self.segments.append([self.at, len(data), places])
        self._put(data)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.held:
            self._segment(bytes(self.held))
        index = self.at
        self._put(np.array([d is not None for d in self.docs], dtype=np.uint8).tobytes())
        self._put(np.array([d or 0 for d in self.docs], dtype="<i8").tobytes())
        self._put(np.array(self.starts, dtype="<i8").tobytes())
        footer = json.dumps({"segments": self.segments, "docs": [index, len(self.docs)], "total": self.total}).encode()
        self._put(footer)
        self._put(len(footer).to_bytes(8, "little") + MAGIC)


class Reader:
    """Reads a file, as a whole by documents or any single id."""

    def __init__(self, uri: str):
        filesystem, path = open_fs(uri)
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        tail = self._read(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} has no footer")
        length = int.from_bytes(tail[:8], "little")
        self.footer = json.loads(self._read(size - 16 - length, length))
        self.total = self.footer["total"]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The documents' ids, and their starts with the total behind them."""
        at, n = self.footer["docs"]
        has = self._read(at, n)
        ids = np.frombuffer(self._read(at + n, 8 * n), dtype="<i8").tolist()
        starts = np.frombuffer(self._read(at + 9 * n, 8 * n), dtype="<i8")
        return [i if h else None for i, h in zip(ids, has)], np.append(starts, self.total)

    def segments(self):
        """The ids, a segment at a time."""
        for at, n, places in self.footer["segments"]:
            yield decode_segment(self._read(at, n), places)

    def get(self, k: int) -> int:
        """The k-th id, by a chunk, a bit and a rank of each level."""
        if not 0 <= k < self.total:
            raise IndexError(k)
        at, _, places = self.footer["segments"][k // SEGMENT]
        k %= SEGMENT
        out = 0
        for level, (_, chunks, bits, ranks) in enumerate(places):
            out |= self._read(at + chunks + k, 1)[0] << (8 * level)
            block = k // BLOCK
            flags = int.from_bytes(self._read(at + bits + block * BLOCK // 8, (k % BLOCK) // 8 + 1), "little")
            if not flags >> (k % BLOCK) & 1:
                break
            rank = int.from_bytes(self._read(at + ranks + 4 * block, 4), "little")
            k = rank + (flags & ((1 << (k % BLOCK)) - 1)).bit_count()
        return out

    def crcs(self):
        """Of each document: its id, start, number of ids, and the crc32 of its ids as unsigned 32-bit integers."""
        docs, starts = self.documents()
        at, k, crc = 0, 0, 0
        for ids in self.segments():
            end = at + len(ids)
            while k < len(docs) and starts[k + 1] <= end:
                crc = zlib.crc32(ids[max(0, starts[k] - at) : starts[k + 1] - at].tobytes(), crc)
                yield docs[k], int(starts[k]), int(starts[k + 1] - starts[k]), crc
                k, crc = k + 1, 0
            if k < len(docs) and starts[k] < end:
                crc = zlib.crc32(ids[max(0, starts[k] - at) :].tobytes(), crc)
            at = end


def write(docs: DataFrame, vocabulary: str, folder: str) -> DataFrame:
    """Writes files below folder in doc_id order and returns part, uri, n_docs, n_ids of each file, as a written table."""
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        encode = tokens.encoder(vocabulary).ids
        filesystem, root = open_fs(folder)
        filesystem.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        # An attempt writes its own file; the table lists only files of attempts that ended well.
        name = f"ids-{part:06d}-{uuid.uuid4().hex}.dac"
        writer = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                writer = writer or Writer(filesystem.open_output_stream(f"{root}/{name}"))
                writer.add(doc_id, encode(text) + end)
        if writer:
            writer.close()
            writer.stream.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "uri": [f"{folder}/{name}"], "n_docs": [len(writer.docs)], "n_ids": [writer.total]})

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(run, "part bigint, uri string, n_docs bigint, n_ids bigint"), "manifest")


def read(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start among all files' ids, n_tokens, ids_crc32."""
    spark = files.sparkSession
    # One row a file; what comes before each is summed on the driver.
    before, rows = 0, []
    for r in files.orderBy("part").collect():
        rows.append((r.uri, before))
        before += r.n_ids
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from large_batches(((d, first + s, n, c) for d, s, n, c in Reader(uri).crcs()), schema)

    listed = spark.createDataFrame(rows, "uri string, before bigint").repartition(max(1, len(rows)), "uri")
    return listed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def locate(files: DataFrame, position: int) -> int:
    """The id at a position among all files' ids, read directly."""
    rows = files.orderBy("part").collect()
    starts = np.cumsum([0, *[r.n_ids for r in rows]]).tolist()
    k = bisect_right(starts, position) - 1
    return Reader(rows[k].uri).get(position - starts[k])


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes all documents and reads them back: doc_id, start, n_tokens, ids_crc32."""
    tune(docs.sparkSession)
    files = write(docs, vocabulary or tokens.vocabulary("byte_bpe_50k.json"), shared_dir(docs.sparkSession, "ids"))
    out = read(files)
    return out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "start", "n_tokens", "ids_crc32")
