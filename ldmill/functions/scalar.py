"""Scalar column functions of the decay model and small helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def d_from_rho(a: Column, rho: Column | float) -> Column:
    """Distance at which a share ``rho`` of the decay is over: rho / (a (1 - rho)); null for a = 0 or rho = 1."""
    rho = F.lit(rho) if isinstance(rho, float) else rho
    return F.try_divide(rho, a * (1 - rho))


def ld_from_rho(b: Column, c: Column, rho: Column | float) -> Column:
    """Expected r2 once a share ``rho`` of the decay is over: b + (c - b)(1 - rho)."""
    return b + (c - b) * (1 - rho)


def decayed(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The decay curve b + (c - b) / (1 + a d)."""
    return b + (c - b) / (1 + a * d)


def finite(c: Column) -> Column:
    """The value where it is a finite number, null elsewhere."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def half_even(c: Column) -> Column:
    """Round half to even, as consensus scores need."""
    return F.rint(c)


def palette_index(rank: Column, size: int = 12) -> Column:
    return F.pmod(rank - 1, F.lit(size)) + 1


def log_stratum(d: Column, low: Column, high: Column, n: int) -> Column:
    """1..n: the equal-width stratum of log distance, right-closed with the lowest value included; clamped at both ends."""
    width = (F.log(high) - F.log(low)) / n
    k = F.ceil(F.try_divide(F.log(d) - F.log(low), width))
    return F.greatest(F.lit(1), F.least(F.lit(n), F.coalesce(k, F.lit(1)))).cast("int")


def pair_hash(*ids: Column) -> Column:
    """A portable hash of integers in 0..2^32-1, the same in any SQL engine, to rank rows for sampling without replacement."""
    return F.pmod(reduce(lambda h, x: F.pmod(h * 31 + x, F.lit(4294967296)) * 1103515245 + 12345, ids, F.lit(17).cast("bigint")), F.lit(4294967296))


def pearson_r2(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Squared correlation from integer sums: one double division at the end; null for a constant side."""
    top = n * sxy - sx * sy
    bottom = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return F.when(bottom > 0, (top * top).cast("double") / bottom.cast("double"))


def marker_parts(name: Column) -> tuple[Column, Column]:
    """Chromosome (without its prefix) and position of a marker name ``CHR<chromosome>:<position>``; null for any other form."""
    pattern = "^CHR([0-9]+|[XYM]):([0-9]+)$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return F.when(part(1) != "", part(1)), F.when(part(2) != "", part(2)).try_cast("bigint")
