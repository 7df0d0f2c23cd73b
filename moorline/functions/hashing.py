"""64-bit hashes that don't depend on the platform: FNV-1a with a mixing finish, of bytes and of lists of texts."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of FNV-1a and of the finish.
BASIS, PRIME = 14695981039346656037, 1099511628211
FINISH = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))
_MASK = (1 << 64) - 1


def _finish(h: int) -> int:
    for shift, factor in FINISH:
        h = (h ^ (h >> shift)) * factor & _MASK
    return h


def hash64(data: bytes) -> int:
    h = BASIS
    for b in data:
        h = (h ^ b) * PRIME & _MASK
    return _finish(h)


def hash64_fields(fields: Iterable[str]) -> int:
    """Of several texts: each is led by its length, so that where one ends counts."""
    return hash64(b"".join(len(f.encode()).to_bytes(8, "little") + f.encode() for f in fields))


def _hash_rows(rows: list[bytes | None]) -> pd.Series:
    """hash64 of each row, byte by byte over all rows at once."""
    sizes = np.array([0 if r is None else len(r) for r in rows], dtype=np.int64)
    h = np.full(len(rows), BASIS, dtype=np.uint64)
    order = np.argsort(-sizes, kind="stable")
    left = [rows[i] or b"" for i in order]
    for at in range(int(sizes.max(initial=0))):
        n = int((sizes > at).sum())
        own = order[:n]
        h[own] = (h[own] ^ np.fromiter((r[at] for r in left[:n]), dtype=np.uint64, count=n)) * np.uint64(PRIME)
    for shift, factor in FINISH:
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return pd.Series(h.view(np.int64)).astype("Int64").mask(pd.Series([r is None for r in rows], dtype=bool))


def hash64_column(x: Column) -> Column:
    """hash64 of a text's or binary's bytes, as a signed number; null of null."""

    @F.pandas_udf("bigint")
    def run(rows: pd.Series) -> pd.Series:
        return _hash_rows([None if r is None else bytes(r) for r in rows])

    return run(x.cast("binary"))


def hash64_fields_column(x: Column) -> Column:
    """hash64_fields of an array of texts, as a signed number; null of null."""

    @F.pandas_udf("bigint")
    def run(rows: pd.Series) -> pd.Series:
        return _hash_rows([None if r is None else b"".join(len(f.encode()).to_bytes(8, "little") + f.encode() for f in r) for r in rows])

    return run(x)


def holdout(pair: tuple[tuple[int, int], tuple[int, int]], percent: int = 20) -> bool:
    """Whether a pair of (source, key hash) is held out: by a hash of both in order, so that new pairs move no other."""
    told = b"".join(source.to_bytes(4, "little") + (key & _MASK).to_bytes(8, "little") for source, key in sorted((s, k & _MASK) for s, k in pair))
    return hash64(told) % 100 < percent
