"""Ranks, cumulative sums, running minima and quantiles over an order, without one task that sees all rows of a table or of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ldmill.session import Tables, broadcast_if_small, figure

BUCKET_ROWS = 200_000  # rows that a task may sort at once; more of them, with different values, are split by value first
MAX_BUCKETS = 10_000


def in_buckets(df: DataFrame, order: str, rows: int, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """``df`` with ``bucket_``: 0.. in the order of a numeric column, nulls last, about ``bucket_rows`` rows each as the number of ``rows`` asks for, from approximate
    quantiles; equal values share one. Also the number of buckets."""
    n = min(MAX_BUCKETS, -(-rows // bucket_rows))
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("c")).first()["c"] if n > 1 else None
    edges = sorted({float(c) for c in cuts or []})
    if not edges:
        return df.withColumn("bucket_", F.lit(0)), 1
    # the number of edges below a value, by halving
    e, top = F.array(*[F.lit(x) for x in edges]), len(edges).bit_length()
    halves = F.array(*[F.lit(1 << i) for i in range(top - 1, -1, -1)])
    below = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(e, at + half - 1) < F.col(order), at + half).otherwise(at))
    return df.withColumn("bucket_", F.when(F.col(order).isNull(), len(edges)).otherwise(below)), len(edges) + 1


def _same(keys: list[str], right: str) -> list[Column]:
    return [F.col(f"a.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def _with_offsets(b: DataFrame, keys: list[str], per: DataFrame, columns: list[str]) -> DataFrame:
    """``b`` with the ``columns`` of ``per (keys..., bucket_, columns...)``, null keys included."""
    on = [*_same(keys, "o"), F.col("a.bucket_") == F.col("o.bucket_")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return b.alias("a").join(broadcast_if_small(per).alias("o"), cond).select("a.*", *[F.col(f"o.{c}") for c in columns])


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same keys up to and including this one in ``order``, equal ones together."""
    rows = Tables(df.sparkSession, "running").cut(df)
    b, n = in_buckets(rows, order, figure(rows), bucket_rows)
    inner = Window.partitionBy(*keys, "bucket_").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    summed = b.withColumn("in_", F.sum(value).over(inner))
    if n == 1:
        return summed.withColumnRenamed("in_", out).drop("bucket_")
    per = b.groupBy(*keys, "bucket_").agg(F.sum(value).alias("s_"))
    before = per.withColumn("before_", F.sum("s_").over(Window.partitionBy(*keys).orderBy("bucket_")) - F.col("s_")).drop("s_")
    return _with_offsets(summed, keys, before, ["before_"]).withColumn(out, F.col("before_") + F.col("in_")).drop("bucket_", "before_", "in_")


def ranked(df: DataFrame, keys: list[str], order: str, ties: list[str], out: str = "rk", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``out``: 0.. within the keys by a numeric column (nulls last), then ``ties``. A key of any size: only rows of one bucket of values meet in a task."""
    rows = Tables(df.sparkSession, "ranked").cut(df)
    b, n = in_buckets(rows, order, figure(rows), bucket_rows)
    r = b.withColumn("in_", (F.row_number().over(Window.partitionBy(*keys, "bucket_").orderBy(F.asc_nulls_last(order), *ties)) - 1).cast("long"))
    if n == 1:
        return r.withColumnRenamed("in_", out).drop("bucket_")
    per = b.groupBy(*keys, "bucket_").agg(F.count(F.lit(1)).alias("n_"))
    before = per.withColumn("before_", F.sum("n_").over(Window.partitionBy(*keys).orderBy("bucket_")) - F.col("n_")).drop("n_")
    return _with_offsets(r, keys, before, ["before_"]).withColumn(out, F.col("before_") + F.col("in_")).drop("bucket_", "before_", "in_")


def blocks_of(df: DataFrame, rank: str, before: int, after: int, size: int = BUCKET_ROWS) -> DataFrame:
    """Rows with a dense ``rank`` as blocks of ``size`` ranks, each with the ``before`` and ``after`` rows next to it: ``block_`` and ``own_`` (false for a neighbour's row), so
    that a window over keys and ``block_`` by rank sees for own rows what a window over the keys would."""
    block = lambda shift: F.floor((F.col(rank) + shift) / size)
    # a row also stands in later blocks that look back at it and in earlier ones that look ahead to it
    at = F.sequence(F.greatest(F.lit(0), block(-after)), block(before))
    return df.withColumn("block_", F.explode(at)).withColumn("own_", F.col("block_") == block(0))


def quantiles(df: DataFrame, value: str, qs: list[float], bucket_rows: int = BUCKET_ROWS) -> list[float | None]:
    """The exact quantiles of all rows by linear interpolation between neighbouring ranks, nulls and NaN left out; null where there is no value.

    Equal values combine first. Only the buckets that hold a wanted rank are sorted; the driver gets the buckets' sizes and two values a quantile."""
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v_")).agg(F.count(F.lit(1)).alias("n_"))
    values = Tables(df.sparkSession, "quantiles").cut(counts, all=F.sum("n_"))
    total = figure(values, "all")
    if not total:
        return [None] * len(qs)
    low = [int(q * (total - 1)) + 1 for q in qs]
    b, n = in_buckets(values, "v_", figure(values), bucket_rows)
    wanted, upto = [], 0
    for bucket, size in sorted((r[0], r[1]) for r in b.groupBy("bucket_").agg(F.sum("n_")).collect()) if n > 1 else [(0, total)]:
        wanted += [(bucket, k, k - upto) for k in sorted({x for k in low for x in (k, min(k + 1, total))}) if upto < k <= upto + size]
        upto += size
    want = F.broadcast(df.sparkSession.createDataFrame(wanted, "bucket_ int, k bigint, local_ bigint"))  # two a quantile
    summed = b.join(want.select("bucket_").distinct(), "bucket_", "left_semi").withColumn("upto_", F.sum("n_").over(Window.partitionBy("bucket_").orderBy("v_")))
    at = {r["k"]: r["v_"] for r in summed.join(want, "bucket_").where("local_ <= upto_ AND local_ > upto_ - n_").select("k", "v_").collect()}
    part = [q * (total - 1) - (k - 1) for q, k in zip(qs, low, strict=True)]
    return [at[k] + (p * (at[min(k + 1, total)] - at[k]) if p > 0 else 0.0) for k, p in zip(low, part, strict=True)]


def bh_adjust(df: DataFrame, p: str, out: str, keys: list[str] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with the false-discovery-rate-adjusted ``p`` (within ``keys``): min over larger p of p m / rank, at most 1; null, NaN and missing p stay null and
    don't count. Keys must not be null. Ties are aggregated first, so repeated values never meet in one task."""
    keys = keys or []
    ok = F.when(~F.isnan(p), F.col(p).cast("double"))
    values = df.select(*keys, ok.alias("p_")).where("p_ IS NOT NULL").groupBy(*keys, "p_").agg(F.count(F.lit(1)).alias("n_"))
    values = Tables(df.sparkSession, "adjusted").cut(values)
    b, n = in_buckets(values, "p_", figure(values), bucket_rows)
    inner, down = Window.partitionBy(*keys, "bucket_").orderBy("p_"), Window.partitionBy(*keys, "bucket_").orderBy(F.desc("p_"))
    per = b.groupBy(*keys, "bucket_").agg(F.sum("n_").alias("s_"))
    offsets = per.withColumns({"before_": F.sum("s_").over(Window.partitionBy(*keys).orderBy("bucket_")) - F.col("s_"), "m_": F.sum("s_").over(Window.partitionBy(*keys))}).drop("s_")
    r = b.join(broadcast_if_small(offsets, within=values), [*keys, "bucket_"]).withColumn("ratio_", F.col("p_") * F.col("m_") / (F.col("before_") + F.sum("n_").over(inner)))
    q = r.withColumn("run_", F.min("ratio_").over(down))
    if n > 1:
        later = r.groupBy(*keys, "bucket_").agg(F.min("ratio_").alias("least_")).withColumn("later_", F.min("least_").over(Window.partitionBy(*keys).orderBy(F.desc("bucket_")).rowsBetween(Window.unboundedPreceding, -1))).drop("least_")
        q = q.join(broadcast_if_small(later), [*keys, "bucket_"]).withColumn("run_", F.least("run_", "later_"))
    return df.withColumn("p_", ok).join(q.select(*keys, "p_", F.least(F.lit(1.0), "run_").alias(out)), [*keys, "p_"], "left").drop("p_")


def running_max(df: DataFrame, keys: list[str], order: str, ties: list[str], value: str, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``out``: the largest ``value`` of the same keys' rows up to and including this one in a numeric ``order``, then ``ties``."""
    rows = Tables(df.sparkSession, "running").cut(df)
    b, n = in_buckets(rows, order, figure(rows), bucket_rows)
    inner = Window.partitionBy(*keys, "bucket_").orderBy(F.asc_nulls_last(order), *ties).rowsBetween(Window.unboundedPreceding, 0)
    r = b.withColumn("in_", F.max(value).over(inner))
    if n == 1:
        return r.withColumnRenamed("in_", out).drop("bucket_")
    per = b.groupBy(*keys, "bucket_").agg(F.max(value).alias("m_"))
    before = per.withColumn("before_", F.max("m_").over(Window.partitionBy(*keys).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))).drop("m_")
    return _with_offsets(r, keys, before, ["before_"]).withColumn(out, F.greatest("before_", "in_")).drop("bucket_", "before_", "in_")
