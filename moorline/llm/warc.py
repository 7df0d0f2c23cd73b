"""WARC archives of pages, and their index by external merging.

Each task writes its pages' records to an archive, one gzip member each, and the records' index entries as runs that
are sorted by URL key, timestamp and page. Ranges of keys, chosen from samples of all runs, are then merged: a task
merges all runs' slices of one range by a tree of losers, so the ranges in a row are the ordered capture histories.

A null html has an empty payload, a null url an empty key. Of equal payloads the record with the largest page_id is
the response; the others are revisits that refer to it. Rows that share that page_id are all responses, as are all
rows of a payload that only has null page_ids.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import large_batches, materialise, open_fs, shared_dir, tune, write_bytes

#: Entries of one run, samples that a run gives, and bytes that all buffers of one merge hold together.
RUN_ENTRIES, RUN_SAMPLES, MERGE_BYTES = 100_000, 32, 32 << 20
#: Entries of one range, about; ranges at most, sampled keys at most that the driver chooses them by, and runs that one
#: tree merges: of more, groups are merged into longer runs first.
RANGE_ENTRIES, RANGES, SAMPLED, FAN_IN = 200_000, 20_000, 200_000, 64
#: Pages without a capture time count from here, a second for each page_id.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ENTRY = "key string, at string, page_id bigint, archive string, first bigint, size bigint, digest string, kind string, refers_to bigint"


def url_key(url: str | None) -> str:
    """The URL's host labels from the top down, then its path: captures of a site sort together."""
    rest = (url or "").strip()
    rest = rest.split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    host, _, port = host.lower().partition(":")
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + slash + path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """text without characters that would end a header line."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, at: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit has no payload, but its length in the HTTP header."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    name = "none" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {at}", f"WARC-Target-URI: {_line(url or '')}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload length, digest, type and reference of a record; a response's payload must have its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length")))
    own = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != own):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    number = lambda x: None if x is None or x == "<urn:page:none>" else int(x[len("<urn:page:") : -1])
    return number(fields["WARC-Record-ID"]), length, own, fields["WARC-Type"], number(fields.get("WARC-Refers-To"))


class LoserTree:
    """Merges sorted iterators of (key, row): an inner node keeps the loser of its two sides, the top the winner.

    Taking the winner replays one path from its leaf, so an entry costs about log2(k) comparisons.
    """

    def __init__(self, sources: list):
        self.sources = [iter(s) for s in sources]
        k = len(self.sources)
        self.heads = [next(s, None) for s in self.sources]
        self.losers = [-1] * max(k, 1)
        self.winner = self._build(1) if k else -1

    def _build(self, node: int) -> int:
        k = len(self.sources)
        if node >= k:
            return node - k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, lost = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None
        return (x[0], a) <= (y[0], b)

    def __iter__(self):
        k = len(self.sources)
        while self.winner >= 0 and (head := self.heads[self.winner]) is not None:
            yield head
            own = self.winner
            self.heads[own] = next(self.sources[own], None)
            node = (own + k) // 2
            while node:
                if self._before(self.losers[node], own):
                    self.losers[node], own = own, self.losers[node]
                node //= 2
            self.winner = own


def _sort_key(e: list) -> tuple:
    """Of an entry: URL key, timestamp, page, archive and place, so no two are equal."""
    return (e[0], e[1], -(1 << 63) if e[2] is None else e[2], e[3], e[4])


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives and sorted runs below folder; of each run uri, n, size and sampled entries with their places."""
    hashed = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"))
    first = hashed.groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("sha", "keeper")
    rows = hashed.join(first, "sha", "left").select("page_id", "url", "html", "keeper")

    def run(batches):
        name = uuid.uuid4().hex
        filesystem, root = open_fs(folder)
        filesystem.create_dir(root, recursive=True)
        archive = f"{folder}/pages-{name}.warc.gz"
        out, at, held, runs = None, 0, [], 0

        def flush(held, number):
            held.sort(key=_sort_key)
            lines, samples, place = [], [], 0
            step = max(1, len(held) // RUN_SAMPLES)
            for i, e in enumerate(held):
                line = json.dumps(e, ensure_ascii=False).encode() + b"\n"
                if i % step == 0:
                    samples.append(json.dumps([e[:5], place]))
                lines.append(line)
                last, place = place, place + len(line)
            samples.append(json.dumps([held[-1][:5], last]))  # the run's last key, so that ranges beyond it needn't look
            uri, size = write_bytes(folder, f"run-{name}-{number:04d}.jsonl", lines)
            return pa.RecordBatch.from_pydict({"uri": [uri], "n": [len(held)], "size": [size], "samples": pa.array([samples], pa.list_(pa.string()))})

        for batch in batches:
            for page_id, url, html, keeper in zip(*(batch.column(i).to_pylist() for i in range(4))):
                out = out or filesystem.open_output_stream(f"{root}/pages-{name}.warc.gz", compression=None)
                payload = (html or "").encode()
                when = (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
                refers_to = keeper if keeper is not None and keeper != page_id else None
                member = record(page_id, url, when, payload, refers_to)
                out.write(member)
                held.append([url_key(url), when, page_id, archive, at, len(member), digest(payload), "response" if refers_to is None else "revisit", refers_to])
                at += len(member)
                if len(held) >= RUN_ENTRIES:
                    yield flush(held, runs)
                    held, runs = [], runs + 1
        if out:
            out.close()
        if held:
            yield flush(held, runs)

    return materialise(rows.mapInArrow(run, "uri string, n bigint, size bigint, samples array<string>"), "runs")


def _slice(uri: str, start: int, end: int, low, high, buffer: int):
    """The entries of a run's bytes from start to end whose keys are at least low and below high."""
    filesystem, path = open_fs(uri)
    with filesystem.open_input_file(path) as f:
        f.seek(start)
        left, rest = end - start, b""
        while left > 0 or rest:
            got = f.read(min(buffer, left)) if left > 0 else b""
            left -= len(got)
            lines = (rest + got).split(b"\n")
            rest = lines.pop()
            if not got and not lines:
                break
            for line in lines:
                e = json.loads(line)
                key = _sort_key(e)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield key, e


def bounds_of(runs: DataFrame) -> list:
    """The keys between ranges, from samples of all runs; of very many samples a part that their hash chooses."""
    entries, sampled = runs.agg(F.sum("n"), F.sum(F.size("samples"))).first()
    keys = runs.select(F.explode("samples").alias("x"))
    if (sampled or 0) > SAMPLED:
        keys = keys.where(F.pmod(F.xxhash64("x"), F.lit(1 << 20)) < (SAMPLED << 20) // sampled)
    listed = sorted({_sort_key(json.loads(r.x)[0]) for r in keys.collect()})
    parts = max(1, min(len(listed), -(-(entries or 0) // RANGE_ENTRIES), RANGES))
    return [listed[len(listed) * i // parts] for i in range(1, parts)]


def slices_of(runs: DataFrame, bounds: list) -> DataFrame:
    """part, uri, first, last: of each range the runs' bytes that may hold entries of it."""
    schema = pa.schema([("part", pa.int64()), ("uri", pa.string()), ("first", pa.int64()), ("last", pa.int64())])

    def rows(batches):
        for batch in batches:
            for uri, size, samples in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = [(_sort_key(e), at) for e, at in map(json.loads, samples)]
                keys = [k for k, _ in own]
                for part in range(bisect_right(bounds, keys[0]), bisect_right(bounds, keys[-1]) + 1):
                    start = own[max(0, bisect_right(keys, bounds[part - 1]) - 1)][1] if part else 0
                    stop = bisect_left(keys, bounds[part]) if part < len(bounds) else len(own)
                    yield part, uri, start, own[stop][1] if stop < len(own) else size

    return runs.select("uri", "size", "samples").mapInArrow(lambda batches: large_batches(rows(batches), schema), "part bigint, uri string, first bigint, last bigint")


class Merger:
    """Merges the slices of one range: FAN_IN of them meet in a tree, whose output is a slice of the next level."""

    def __init__(self, folder: str, low, high):
        self.folder, self.low, self.high = folder, low, high
        self.levels: list[list[tuple[str, int, int]]] = [[]]
        self.made: list[str] = []

    def _tree(self, slices: list[tuple[str, int, int]]) -> LoserTree:
        buffer = max(4096, min(1 << 20, MERGE_BYTES // max(1, len(slices))))
        return LoserTree([_slice(uri, a, b, self.low, self.high, buffer) for uri, a, b in slices])

    def _run(self, slices: list[tuple[str, int, int]]) -> tuple[str, int, int]:
        uri, size = write_bytes(self.folder, f"merged-{uuid.uuid4().hex}.jsonl", (json.dumps(e, ensure_ascii=False).encode() + b"\n" for _, e in self._tree(slices)))
        self.made.append(uri)
        return uri, 0, size

    def add(self, one: tuple[str, int, int], level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(one)
        if len(self.levels[level]) == FAN_IN:
            full, self.levels[level] = self.levels[level], []
            self.add(self._run(full), level + 1)

    def entries(self):
        """All entries in order; what was written on the way is deleted after the last."""
        left = [x for level in self.levels for x in level]
        while len(left) > FAN_IN:
            left = [*left[FAN_IN:], self._run(left[:FAN_IN])]
        yield from (e for _, e in self._tree(left))
        for uri in self.made:
            filesystem, path = open_fs(uri)
            filesystem.delete_file(path)


def merge(runs: DataFrame) -> DataFrame:
    """The entries of all runs in order: part (of the key range), seq (in the range) and the entry's fields."""
    folder = shared_dir(runs.sparkSession, "merges")
    bounds = bounds_of(runs)
    shared = runs.sparkSession.sparkContext.broadcast(bounds)
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("key", pa.string()), ("at", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("first", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64())])

    def rows(batches):
        now, own = None, None
        for batch in batches:
            for part, uri, first, last in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if part != now:
                    if own:
                        yield from ((now, i, *e) for i, e in enumerate(own.entries()))
                    ends = [None, *shared.value, None]
                    now, own = part, Merger(folder, ends[part], ends[part + 1])
                if first < last:
                    own.add((uri, first, last))
        if own:
            yield from ((now, i, *e) for i, e in enumerate(own.entries()))

    dealt = slices_of(runs, bounds).repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "uri")
    return dealt.mapInArrow(lambda batches: large_batches(rows(batches), schema), f"part bigint, seq bigint, {_ENTRY}")


def read(index: DataFrame) -> DataFrame:
    """The records that index entries point to, read from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def rows(batches):
        name, file = None, None
        for batch in batches:
            for archive, first, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    filesystem, path = open_fs(archive)
                    name, file = archive, filesystem.open_input_file(path)
                file.seek(first)
                yield parse(file.read(size))

    # By archive and stretch of it: a large archive is read by several tasks, each from front to back.
    stretch = F.floor(F.col("first") / (64 << 20))
    ordered = index.select("archive", "first", "size").repartition("archive", stretch).sortWithinPartitions("archive", "first")
    return ordered.mapInArrow(lambda batches: large_batches(rows(batches), schema), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages, merges the index and reads the archives back by it."""
    tune(pages.sparkSession)
    runs = write(pages.select("page_id", "url", "html"), shared_dir(pages.sparkSession, "warc"))
    return read(materialise(merge(runs), "captures"))
