"""Figures per key where a few keys hold most rows (problem 5).

Every figure is algebraic (counts, sums, extremes), so Spark's hash aggregate combines each key's rows inside the map task;
a key with a third of all rows sends one partial state per map task into the shuffle, whatever its size.
Several key fields of one table are taken in one scan through grouping sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_figures(df: DataFrame, fields: list[str], value: str | None = None) -> DataFrame:
    """``field_name, key_value, n_rows, n_total`` for every value of every field, null keys included, and of ``value``
    (if given) the finite ``n_value, sum_value, min_value, max_value``.

    ``n_total`` counts all rows of the table as stored. Names of other columns do not matter. An empty table gives no rows;
    a null key is one key with ``key_value`` null; a table of nulls only gives that key.
    """
    slim = df.select(*[F.col(f).cast("string").alias(f"k{i}") for i, f in enumerate(fields)], *([F.col(value).cast("double").alias("v")] if value else []))
    if value:
        slim = slim.withColumn("v", F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v")))
    keys = [F.col(f"k{i}") for i in range(len(fields))]
    figures = [F.count(F.lit(1)).alias("n_rows")]
    if value:
        figures += [F.count("v").alias("n_value"), F.sum("v").alias("sum_value"), F.min("v").alias("min_value"), F.max("v").alias("max_value")]
    per_key = slim.groupingSets([[k] for k in keys], *keys).agg(*figures, F.grouping_id().alias("gid")) if len(keys) > 1 else slim.groupBy(*keys).agg(*figures).withColumn("gid", F.lit(0))
    every = (1 << len(fields)) - 1
    name, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, f in enumerate(fields):
        alone = F.col("gid") == (every ^ (1 << (len(fields) - 1 - i)))
        name, key = F.when(alone, F.lit(f)).otherwise(name), F.when(alone, F.col(f"k{i}")).otherwise(key)
    out = per_key.select(name.alias("field_name"), key.alias("key_value"), *[c for c in per_key.columns if c not in {f"k{i}" for i in range(len(fields))} | {"gid"}])
    total = df.agg(F.count(F.lit(1)).alias("n_total"))  # reads no column
    return out.crossJoin(F.broadcast(total))  # one row


def heavy_keys(df: DataFrame, fields: list[str], min_share: float = 0.04) -> DataFrame:
    """The non-null keys that hold at least ``min_share`` of all rows of the table, with their share."""
    figures = key_figures(df, fields).where(F.col("key_value").isNotNull())
    return figures.where(F.col("n_rows") >= min_share * F.col("n_total")).withColumn("share", F.col("n_rows") / F.col("n_total"))
