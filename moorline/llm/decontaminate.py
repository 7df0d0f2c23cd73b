"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark passages scans each text once.

Texts are normalised to lower-case words, one space between two. Every window of consecutive item words is a
pattern; the scan runs over the normalised text, and its hits are mapped back to code points of the original.

Null and empty texts have no words and hit nothing. Items without words have no patterns, items with a null id are
ignored, and rows of one item_id count as one item. Repeated documents each get their own result. A benchmark
whose patterns exceed one automaton's bound is scanned in several passes, whose hits are joined.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, materialise, tune

WINDOW = 8
#: Characters of all patterns of one automaton, which every worker holds; a larger benchmark takes more passes.
MAX_PATTERN_CHARS = 24_000_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: A-Z to a-z; digits, a-z and all bytes of non-ASCII characters stay; the rest ends words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
HITS = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def patterns(text: str | None, window: int = WINDOW) -> list[tuple[str, int]]:
    """The distinct patterns of an item and how many words each has."""
    own = words(text)
    size = min(window, len(own))
    found = {b" %s " % b" ".join(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
    return [(p.decode("latin-1"), size) for p in sorted(found)]


class Scanner:
    """The automaton of (pattern, words, item ids), built once in each worker."""

    per_task = True
    _built: dict[str, object] = {}

    def __init__(self, shared, key: str):
        self.shared, self.key = shared, key

    def __call__(self):
        import ahocorasick

        if self.key not in Scanner._built:
            automaton = ahocorasick.Automaton()
            for pattern, size, items in self.shared.value:
                automaton.add_word(pattern, (len(pattern), size, items))
            if len(automaton):
                automaton.make_automaton()
            Scanner._built.clear()
            Scanner._built[self.key] = automaton
        automaton = Scanner._built[self.key]
        return lambda texts: [scan(automaton, t) for t in texts]


def scan(automaton, text: str | None) -> dict:
    own = words(text)
    line = b" %s " % b" ".join(own)
    found = list(automaton.iter(line.decode("latin-1"))) if own and len(automaton) else []
    if not found:
        return {"n_words": len(own), "n_hit": 0, "items": [], "spans": []}
    gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    hit = np.zeros(len(own), dtype=bool)
    items: set[str] = set()
    for end, (length, size, of) in found:
        at = int(np.searchsorted(gaps, end - length + 1))
        hit[at : at + size] = True
        items.update(of)
    places = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(edges[::2], edges[1::2])]
    return {"n_words": len(own), "n_hit": int(hit.sum()), "items": sorted(items), "spans": spans}


def _automata(benchmark: DataFrame, window: int, limit: int) -> list[Scanner]:
    """One scanner, or several if the patterns exceed limit characters."""
    spark = benchmark.sparkSession
    table, made = append(benchmark.where("item_id is not null").select("item_id", "text"), "text", lambda texts: [[{"pattern": p, "size": n} for p, n in patterns(t, window)] for t in texts], "array<struct<pattern:string,size:int>>")
    rows = table.select("item_id", F.explode(made).alias("p")).groupBy("p.pattern", "p.size").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    rows = materialise(rows, "patterns")
    chars = rows.agg(F.sum(F.length("pattern"))).first()[0] or 0
    shards = max(1, -(-chars // limit))
    out = []
    for k in range(shards):
        own = rows if shards == 1 else rows.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == k)
        shared = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])
        out.append(Scanner(shared, f"{id(shared)}-{shared._jbroadcast.id()}"))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = MAX_PATTERN_CHARS) -> tuple[DataFrame, str]:
    """docs with all its columns and one more of type HITS, and that column's name."""
    tune(docs.sparkSession)
    scanners = _automata(benchmark, window, limit)
    table, name = append(docs, "text", scanners[0], HITS)
    for scanner in scanners[1:]:
        # Beyond one automaton: each pass is written, so a worker holds one automaton at a time.
        table, other = append(materialise(table, "passes"), "text", scanner, HITS)
        spans = F.array_union(F.col(f"{name}.spans"), F.col(f"{other}.spans"))
        marked, count = append(table.withColumn(name, F.struct(F.col(f"{name}.n_words"), F.lit(0).cast("bigint").alias("n_hit"), F.sort_array(F.array_union(F.col(f"{name}.items"), F.col(f"{other}.items"))).alias("items"), spans.alias("spans"))).withColumn(other, F.struct("text", spans.alias("spans"))), other, lambda rows: [_merged(r) for r in rows], "struct<n_hit:bigint,spans:array<struct<start:bigint,end:bigint>>>")
        table = marked.withColumn(name, F.struct(F.col(f"{name}.n_words"), F.col(f"{count}.n_hit"), F.col(f"{name}.items"), F.col(f"{count}.spans"))).drop(other, count)
    return table, name


def _merged(row: dict) -> dict:
    """The hit words and maximal spans of several passes over one text."""
    places = [m.span() for m in _WORD.finditer(row["text"] or "")]
    hit = np.zeros(len(places), dtype=bool)
    starts = np.array([a for a, _ in places])
    for s in row["spans"]:
        hit[int(np.searchsorted(starts, s["start"])) : int(np.searchsorted(starts, s["end"]))] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return {"n_hit": int(hit.sum()), "spans": [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(edges[::2], edges[1::2])]}


def report(docs: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit spans."""
    table, name = hits(docs.select("doc_id", "text"), benchmark)
    n = F.size(f"{name}.items").cast("bigint")
    return table.select("doc_id", F.col(f"{name}.n_words"), F.col(f"{name}.n_hit"), n.alias("n_items"), F.sha2(F.concat_ws(",", f"{name}.items").cast("binary"), 256).alias("items_sha256"), (n >= min_items).alias("contaminated"), F.col(f"{name}.spans").alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, min_items: int = 1) -> DataFrame:
    """The rows of docs, with all their columns, in which fewer than min_items items occur."""
    table, name = hits(docs, benchmark)
    return table.where(F.size(f"{name}.items") < min_items).drop(name)
