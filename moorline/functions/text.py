"""Names and their similarity: tokens, canonical names, phonetics, Jaro and Jaro-Winkler."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .transforms import ascii_upper, let, strip_diacritics

#: Words that say nothing about which port or vessel it is, and short forms of ports' names.
PORT_NOISE = ("PORT", "PORTS", "OF", "THE", "AND", "HARBOR", "HARBOUR", "HAVEN", "TERMINAL", "TERMINALS", "ANCHORAGE", "ROADS", "ROADSTEAD", "DOCK", "DOCKS", "WHARF", "QUAY", "JETTY")
VESSEL_NOISE = ("MV", "MS", "MT", "SS", "MSV", "MY", "RV", "FV", "TS")
PORT_EXPANSIONS = {"ST": "SAINT", "STE": "SAINTE", "PT": "PORT", "HBR": "HARBOR", "IS": "ISLAND", "MT": "MOUNT"}


def tokens(x: Column) -> Column:
    """The runs of ASCII letters and digits, in upper case."""
    return F.filter(F.split(ascii_upper(x), "[^0-9A-Z]+"), lambda t: t != "")


def _without(words: Column, noise: tuple[str, ...]) -> Column:
    both = F.struct(words.alias("all"), F.filter(words, lambda t: ~t.isin(*noise)).alias("left"))
    return let(both, lambda w: F.when(F.size(w["left"]) > 0, w["left"]).otherwise(w["all"]))


def port_tokens(x: Column) -> Column:
    """A port name's words: marks folded, short forms spelt out, noise dropped unless there is nothing else."""
    spelt = F.create_map(*[F.lit(y) for k, v in PORT_EXPANSIONS.items() for y in (k, v)])
    return _without(F.transform(tokens(strip_diacritics(x)), lambda t: F.coalesce(F.try_element_at(spelt, t), t)), PORT_NOISE)


def vessel_tokens(x: Column) -> Column:
    """A vessel name's words: marks folded, slashes closed up (M/V is MV), prefixes dropped unless there is nothing else."""
    return _without(tokens(F.replace(strip_diacritics(x), F.lit("/"), F.lit(""))), VESSEL_NOISE)


def dropped_tokens(x: Column, noise: tuple[str, ...] = PORT_NOISE) -> Column:
    return F.filter(tokens(strip_diacritics(x)), lambda t: t.isin(*noise))


def canonical(words: Column) -> Column:
    return F.array_join(words, " ")


def soundex(word: Column) -> Column:
    """American Soundex of the letters of a word; empty without letters."""
    letters = F.regexp_replace(ascii_upper(word), "[^A-Z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(letters))


def soundex_phrase(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, r"\s+"), soundex), lambda c: c != ""), " ")


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct words; 1 if neither has any."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ == 0, 1.0).otherwise(both / all_)


def tokens_contained(a: Column, b: Column) -> Column:
    """Whether all words of the one with fewer are among the other's; false if either has none."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


#: Pairs compared at once, and bytes of one side of them.
PAIRS, CELLS = 512, 1 << 22
WEIGHT, LEAST = 0.1, 0.7


def _bytes(texts: list[bytes], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts as rows of bytes, and their lengths; fill stands behind an end."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.full((len(texts), max(int(sizes.max(initial=0)), 1)), fill, dtype=np.int16)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return out, sizes


def _packed(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen bytes of each row moved to its front, -1 behind them."""
    out = np.full(x.shape, -1, dtype=np.int16)
    row, column = np.nonzero(chosen)
    out[row, (np.cumsum(chosen, axis=1) - 1)[row, column]] = x[row, column]
    return out


def jaro_of(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Jaro similarity of pairs of texts' bytes, all pairs a byte of a at a time; half transpositions count."""
    (x, n), (y, m) = _bytes(a, -2), _bytes(b, -3)
    width = min(x.shape[1], y.shape[1])
    reach = np.maximum(np.maximum(n, m) // 2, 1) - 1
    met, taken = np.zeros(x.shape, dtype=bool), np.zeros(y.shape, dtype=bool)
    places = np.arange(y.shape[1])
    for i in range(x.shape[1]):
        fits = (y == x[:, i, None]) & ~taken & (np.abs(places - i) <= reach[:, None])
        at = fits.argmax(axis=1)
        met[:, i] = fits[np.arange(len(at)), at]
        taken[np.flatnonzero(met[:, i]), at[met[:, i]]] = True
    common = met.sum(axis=1)
    moved = (_packed(x, met)[:, :width] != _packed(y, taken)[:, :width]).sum(axis=1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (common / n + common / m + (common - moved) / common) / 3
    same = np.array([p == q for p, q in zip(a, b)], dtype=bool)
    return np.where(same, 1.0, np.where(common == 0, 0.0, out))


def jaro_winkler_of(a: list[bytes], b: list[bytes]) -> np.ndarray:
    base = jaro_of(a, b)
    (x, _), (y, _) = _bytes([t[:4] for t in a], -2), _bytes([t[:4] for t in b], -3)
    width = min(x.shape[1], y.shape[1])
    same = np.cumprod(x[:, :width] == y[:, :width], axis=1).sum(axis=1)
    return np.where(base < LEAST, base, base + same * WEIGHT * (1 - base))


def _pairwise(of: Callable[[list[bytes], list[bytes]], np.ndarray], a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        # Equal pairs are compared once, and pairs of like lengths together.
        pairs = {(p, q) for p, q in zip(x, y) if p is not None and q is not None}
        told = sorted(((p.encode(), q.encode(), p, q) for p, q in pairs), key=lambda t: max(len(t[0]), len(t[1])))
        found: dict[tuple[str, str], float] = {}
        while told:
            n = max(1, min(PAIRS, CELLS // max(1, len(told[-1][0]), len(told[-1][1]))))
            own, told = told[-n:], told[:-n]
            found.update(zip(((p, q) for *_, p, q in own), of([t[0] for t in own], [t[1] for t in own]).tolist()))
        return pd.Series([found.get((p, q)) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def jaro(a: Column, b: Column) -> Column:
    return _pairwise(jaro_of, a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _pairwise(jaro_winkler_of, a, b)
