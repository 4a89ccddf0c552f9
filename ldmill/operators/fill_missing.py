"""Filling missing values from similar records (problem 4).

Hierarchical group statistics: each cell without a usable value takes the median (numbers) or the mode (names) of the finest
group with enough support and backs off to coarser ones; a flag and the level used are kept beside every filled cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ldmill.session import Tables, broadcast_if_small


def medians(usable: DataFrame, keys: Sequence[str], fields: dict[str, str], min_support: int, tag: str = "__") -> DataFrame:
    """One row per key: for every ``value: out`` of ``fields`` the median over the value's usable rows, null with fewer than ``min_support``; all in one aggregate.

    The lower middle value, from Spark's mergeable quantile summary (rank error at most 1/10000 of the group, none in small groups), so a group with a third of all rows
    sends a bounded state per map task."""
    rows = usable
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    both = [c for v, out in fields.items() for c in (F.count(v).alias(f"n{tag}{out}"), F.percentile_approx(F.col(v).cast("double"), 0.5, 10000).alias(f"m{tag}{out}"))]
    return rows.groupBy(*keys).agg(*both).select(*keys, *[F.when(F.col(f"n{tag}{out}") >= min_support, F.col(f"m{tag}{out}")).alias(out) for out in fields.values()])


def modes(usable: DataFrame, keys: Sequence[str], value: str, out: str, min_support: int, tag: str = "__") -> DataFrame:
    """One row per key with at least ``min_support`` usable values: the most frequent one, the smallest of equals, from a count per (key, value) that combines in the map tasks."""
    n, support = f"n{tag}", f"s{tag}"
    rows = usable.where(F.col(value).isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(n))
    # per key the largest count, then the first value: the extreme of (-count, value)
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col(n)).alias("n"), F.col(value).alias("v"))).alias("b"), F.sum(n).alias(support))
    return best.where(F.col(support) >= min_support).select(*keys, F.col("b.v").alias(out))


def fill_missing(df: DataFrame, usable: dict[str, Column], levels: dict[str, Sequence[Sequence[str]]], kinds: dict[str, str], min_support: int = 2, last_resort: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``<field>_filled`` (value), ``<field>_is_filled`` (flag) and ``<field>_level`` (index of the level used, the number of
    levels for the last resort, null where the cell was usable or nothing could fill it).

    ``usable``: per field, whether its value counts (null counts as no). ``levels``: per field, key lists from fine to coarse; ``[]`` is the whole table.
    Integer fields come back rounded to their own type. A key that is null has no group; the row then backs off. Output columns that the input already has are replaced.
    Empty tables come back empty; repeated rows each count. Fields with a level in common share its aggregate and its join; a level with few groups is broadcast,
    so that rows are not shuffled by a key of a few values.
    """
    tag = "__"
    while any(c.endswith(tag) for c in df.columns):  # inner columns keep clear of the caller's
        tag += "_"
    tables = Tables(df.sparkSession, "fill")
    fields = list(usable)
    good = {f: F.coalesce(usable[f], F.lit(False)) for f in fields}
    value = {f: f"v{i}{tag}" for i, f in enumerate(fields)}
    pick = {(f, i): f"p{fields.index(f)}_{i}{tag}" for f in fields for i in range(len(levels[f]))}
    values = df.select(*{k for f in fields for keys in levels[f] for k in keys}, *[F.when(good[f], F.col(f)).alias(value[f]) for f in fields])
    out = df
    shared: dict[tuple, dict[str, str]] = {}
    for f in fields:
        for i, keys in enumerate(levels[f]):
            if kinds[f] == "median":
                shared.setdefault(tuple(keys), {})[value[f]] = pick[f, i]
    every = [(keys, medians(values, keys, own, min_support if keys else 1, tag)) for keys, own in shared.items()]
    every += [(tuple(keys), modes(values, keys, value[f], pick[f, i], min_support if keys else 1, tag)) for f in fields if kinds[f] == "mode" for i, keys in enumerate(levels[f])]
    for keys, stats in every:
        stats = tables.cut(stats)
        out = out.join(broadcast_if_small(stats), list(keys), "left") if keys else out.join(F.broadcast(stats), how="left")  # keyless: one row
    for f in fields:
        found = [F.col(pick[f, i]) for i in range(len(levels[f]))] + ([last_resort[f]] if last_resort and f in last_resort else [])
        best = F.coalesce(*[p if kinds[f] == "mode" else F.round(p) for p in found]).cast(df.schema[f].dataType)
        level = F.coalesce(*[F.when(p.isNotNull(), F.lit(i)) for i, p in enumerate(found)])
        out = out.withColumns({f"{f}_filled": F.when(good[f], F.col(f)).otherwise(best), f"{f}_is_filled": ~good[f] & best.isNotNull(), f"{f}_level": F.when(~good[f], level)})
    return out.drop(*pick.values())
