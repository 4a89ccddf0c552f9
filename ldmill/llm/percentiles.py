"""Percentiles of very large numeric columns (problem 2): distributed multi-select, and summaries of days that combine.

Multi-select: every wanted order statistic of every group sits in an interval of values. A round lets each partition propose its local median of
each interval; the median of these, weighted by the partitions' counts, becomes the pivot; a combining count three ways (below, equal, above)
tells in which part each wanted rank lies, and all other values are discarded. This repeats for all groups at once until every rank is found.
Groups of any size work: per round a partition sends one median and three counts an interval. A round is two jobs, and reads only what the last one left.

Days: a summary keeps, per group and day, ``points`` order statistics evenly spaced in rank with the number of rows each stands for; percentiles of any
union of summaries come from the same multi-select over the weighted points, with a rank error of at most 1/points of the rows together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ldmill.session import Tables, broadcast_if_small, figure


def pivots(live: DataFrame, accuracy: int) -> DataFrame:
    """``grp, part, pivot``: the weighted median of the partitions' medians of every interval, each weighted by the rows behind it."""
    local = live.groupBy("grp", "part", F.spark_partition_id().alias("p")).agg(F.percentile_approx("v", 0.5, accuracy).alias("m"), F.sum("w").alias("w"))
    order = Window.partitionBy("grp", "part").orderBy("m")
    ranked = local.withColumns({"upto": F.sum("w").over(order), "all": F.sum("w").over(Window.partitionBy("grp", "part"))})
    return ranked.where("2 * upto >= all").groupBy("grp", "part").agg(F.min("m").alias("pivot"))


def multi_select(values: DataFrame, ranks: DataFrame, tables: Tables, accuracy: int = 200) -> DataFrame:
    """``values (grp, v, w)`` with positive integer weights and ``ranks (grp, k)``, 1 <= k <= sum of the group's w: ``grp, k, v``, the value at weighted rank k.

    ``values`` must be a table; null groups and values must have been left out. Ties and repeated rows each count. Exact.
    A part is named by the weight below it in its group. Each round finds a pivot that occurs in every part, so each makes them smaller.
    """
    start = F.lit(0).cast("long").alias("part")
    want = tables.cut(ranks.distinct().select("grp", start, "k", F.lit(None).cast("double").alias("v")))
    live = values.select("grp", start, "v", "w")
    found: list[DataFrame] = []
    below, equal, above = F.col("v") < F.col("pivot"), F.col("v") == F.col("pivot"), F.col("v") > F.col("pivot")
    left = figure(want)
    while left:
        split = live.join(broadcast_if_small(pivots(live, accuracy), within=want), ["grp", "part"])
        side = lambda cond: F.sum(F.when(cond, F.col("w")).otherwise(0))
        counts = split.groupBy("grp", "part").agg(side(below).alias("c0"), side(equal).alias("c1"), F.max("pivot").alias("pivot"))
        asked = want.where("v IS NULL").select("grp", "part", "k")
        placed = broadcast_if_small(asked, within=want).join(counts, ["grp", "part"])
        upper = F.col("part") + F.col("c0") + F.col("c1")
        low, high = F.col("k") <= F.col("part") + F.col("c0"), F.col("k") > upper
        hit = F.when(~low & ~high, F.col("pivot"))
        # a rank is found, or goes on below or above the pivot
        placed = placed.select("grp", F.when(high, upper).otherwise(F.col("part")).alias("part"), "k", hit.alias("v"), F.col("part").alias("old"), "pivot", upper.alias("upper"))
        want = tables.cut(placed, left=F.count_if(F.col("v").isNull()))
        found.append(want.where("v IS NOT NULL").select("grp", "k", "v"))
        left = figure(want, "left")
        if not left:
            break
        on = want.where("v IS NULL").groupBy("grp", F.col("old").alias("part")).agg(F.max("pivot").alias("pivot"), F.max("upper").alias("upper"), F.bool_or(F.col("part") == F.col("old")).alias("low"), F.bool_or(F.col("part") != F.col("old")).alias("high"))
        kept = live.join(broadcast_if_small(on, within=want), ["grp", "part"]).where((below & F.col("low")) | (above & F.col("high")))
        after = tables.cut(kept.select("grp", F.when(below, F.col("part")).otherwise(F.col("upper")).alias("part"), "v", "w"))
        if hasattr(live, "_table_path"):
            tables.drop(live)
        live = after
    if not found:
        return want.select("grp", "k", "v")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _coded(df: DataFrame, keys: list[str], value: str, weight: str | None, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Tables ``(grp, v, w)`` of the finite values and ``(keys..., g__, n__)`` of the groups, ``g__`` a number of its own for each."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select(*keys, v.alias("v__"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w__"))
    groups = tables.cut(rows.groupBy(*keys).agg(F.sum("w__").alias("n__")))
    groups = tables.cut(groups.withColumn("g__", F.monotonically_increasing_id()))
    named = broadcast_if_small(groups.select(*[F.col(k).alias(f"{k}__") for k in keys], "g__"), within=groups)
    same = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]
    return tables.cut(rows.join(named, same).select(F.col("g__").alias("grp"), F.col("v__").alias("v"), F.col("w__").alias("w"))), groups


def _looked_up(marks: DataFrame, got: DataFrame) -> DataFrame:
    """``marks`` (g__, k__, ...) with the value ``v__`` found at each rank."""
    return marks.join(got.select(F.col("grp").alias("g__"), F.col("k").alias("k__"), F.col("v").alias("v__")), ["g__", "k__"])


def percentiles(df: DataFrame, keys: list[str], value: str, qs: list[float], weight: str | None = None) -> DataFrame:
    """``keys..., q, value, n``: the exact lower percentile (the value at rank ``ceil(q * n)``, at least 1) of the finite values of every group.

    Null and NaN or infinite values are left out; a null key is a group of its own; an empty table gives no rows; other columns are ignored.
    """
    tables = Tables(df.sparkSession, "percentiles")
    rows, groups = _coded(df, keys, value, weight, tables)
    marks = groups.withColumn("q__", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("k__", F.greatest(F.lit(1), F.ceil(F.col("q__") * F.col("n__"))).cast("long"))
    got = multi_select(rows, marks.select(F.col("g__").alias("grp"), F.col("k__").alias("k")), tables)
    return _looked_up(marks, got).select(*keys, F.col("q__").alias("q"), F.col("v__").alias("value"), F.col("n__").alias("n"))


def day_summaries(df: DataFrame, keys: list[str], value: str, time: str, points: int = 100) -> DataFrame:
    """``keys..., day, value, weight``: of every group and day ``points`` order statistics with the rows they stand for, to be stored and combined.

    A day with fewer rows keeps them all; a null time is a day of its own. The statistics are the exact values at ranks ``ceil(i * n / points)``.
    """
    tables = Tables(df.sparkSession, "summaries")
    rows, groups = _coded(df.select(*keys, F.to_date(time).alias("day"), F.col(value).alias("value__")), [*keys, "day"], "value__", None, tables)
    m = F.least(F.lit(points).cast("long"), F.col("n__"))
    rank = lambda j: F.ceil(j * F.col("n__") / m).cast("long")
    i = F.explode(F.transform(F.sequence(F.lit(1).cast("long"), m), lambda j: F.struct(rank(j).alias("k"), (rank(j) - rank(j - 1)).alias("w")))).alias("i__")
    marks = groups.select(*keys, "day", "g__", i).select(*keys, "day", "g__", F.col("i__.k").alias("k__"), F.col("i__.w").alias("w__"))
    got = multi_select(rows, marks.select(F.col("g__").alias("grp"), F.col("k__").alias("k")), tables)
    return _looked_up(marks, got).select(*keys, "day", F.col("v__").alias("value"), F.col("w__").alias("weight"))


def combined(summaries: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """Percentiles of all rows behind stored day summaries; rank error at most 1/points of the rows, plus one row a day."""
    return percentiles(summaries, keys, "value", qs, "weight")


def unit_values(el: DataFrame) -> DataFrame:
    """``chr, value, computed_at`` of the finite r2 within 0..1, with the first marker's chromosome."""
    return el.where(F.col("r2").between(0.0, 1.0)).select(F.col("chr1").alias("chr"), F.col("r2").alias("value"), "computed_at")


def long_parameters(decay_sum: DataFrame, fields: list[str]) -> DataFrame:
    """``chr, field, value, computed_at``: the parameters of the decay table one to a row, in one scan."""
    return decay_sum.select("chr", "computed_at", *[F.col(f).cast("double").alias(f) for f in fields]).unpivot(["chr", "computed_at"], fields, "field", "value")
