"""Geohashes and distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .transforms import let

EARTH_KM = 6371.0088
#: The geohash alphabet.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def _bits(precision: int) -> tuple[int, int]:
    """Bits of longitude and latitude: they alternate, longitude first."""
    return (5 * precision + 1) // 2, 5 * precision // 2


def _cells(x: Column, low: float, high: float, bits: int) -> Column:
    """Which of 2^bits equal stretches holds x, values outside taken as the nearest."""
    at = F.floor((x - low) / (high - low) * (1 << bits))
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), at)).cast("bigint")


def _text(lon: Column, lat: Column, precision: int) -> Column:
    """The geohash of cell numbers: bits interleaved, five a character."""
    n_lon, n_lat = _bits(precision)
    bit = lambda i: F.shiftright(lon, n_lon - 1 - i // 2).bitwiseAND(1) if i % 2 == 0 else F.shiftright(lat, n_lat - 1 - i // 2).bitwiseAND(1)
    chars = []
    for k in range(precision):
        value = sum((F.shiftleft(bit(5 * k + j), 4 - j) for j in range(1, 5)), F.shiftleft(bit(5 * k), 4))
        chars.append(F.substring(F.lit(ALPHABET), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def geohash(lat: Column, lon: Column, precision: int = 4) -> Column:
    n_lon, n_lat = _bits(precision)
    at = F.struct(_cells(lon, -180.0, 180.0, n_lon).alias("x"), _cells(lat, -90.0, 90.0, n_lat).alias("y"))
    return let(at, lambda c: _text(c["x"], c["y"], precision))


def geohash_with_neighbours(lat: Column, lon: Column, precision: int = 4) -> Column:
    """The cell and up to eight around it: they go round the date line, and none lies beyond a pole."""
    n_lon, n_lat = _bits(precision)
    at = F.struct(_cells(lon, -180.0, 180.0, n_lon).alias("x"), _cells(lat, -90.0, 90.0, n_lat).alias("y"))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in (0, -1, 1) for dx in (0, -1, 1)])

    def around(c: Column) -> Column:
        cells = F.filter(F.transform(steps, lambda s: F.struct(F.pmod(c["x"] + s["dx"], F.lit(1 << n_lon)).alias("x"), (c["y"] + s["dy"]).alias("y"))), lambda q: q["y"].between(0, (1 << n_lat) - 1))
        return F.array_distinct(F.transform(cells, lambda q: _text(q["x"], q["y"], precision)))

    return F.when(lat.isNotNull() & lon.isNotNull(), let(at, around))


def geohash_neighbours(lat: Column, lon: Column, precision: int = 4) -> Column:
    own = geohash(lat, lon, precision)
    return F.array_remove(geohash_with_neighbours(lat, lon, precision), own)


def geohash_decode(text: Column) -> Column:
    """The middle of a cell as struct(lat, lon); null for other characters or an empty text."""
    number = lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1
    bits = F.array_join(F.transform(F.split(F.lower(text), ""), lambda c: F.lpad(F.bin(number(c)), 5, "0")), "")

    def middle(b: Column) -> Column:
        def half(low: float, high: float, own: Column) -> Column:
            at = F.conv(own, 2, 10).cast("double")
            return low + (high - low) * (at + 0.5) / F.pow(F.lit(2.0), F.length(own))

        return F.struct(half(-90.0, 90.0, F.regexp_replace(b, "(.)(.?)", "$2")).alias("lat"), half(-180.0, 180.0, F.regexp_replace(b, "(.)(.?)", "$1")).alias("lon"))

    return F.when(F.lower(text).rlike(f"^[{ALPHABET}]+$"), let(bits, middle))
