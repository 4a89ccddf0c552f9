"""Genetic positions by linear interpolation in a piecewise-linear map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ldmill.functions.ordered import blocks_of, ranked
from ldmill.session import broadcast_if_small


def interpolate_cm(genetic_map: DataFrame, points: DataFrame, width: int = 1_000_000) -> DataFrame:
    """``points (chr, pos, ...)`` with ``cm``: interpolated between the map's neighbouring points, constant beyond its ends, null on chromosomes with
    fewer than two different map positions. ``genetic_map (chr, pos, cm)``; the lowest cm of a repeated position counts.

    A range join made an equal one: segments and points meet in buckets of ``width`` base pairs.
    """
    m = genetic_map.where("chr IS NOT NULL AND pos IS NOT NULL AND cm IS NOT NULL").groupBy("chr", "pos").agg(F.min("cm").alias("cm"))
    near = blocks_of(ranked(m, ["chr"], "pos", [], "rk_"), "rk_", 0, 1)
    order = Window.partitionBy("chr", "block_").orderBy("rk_")
    seg = near.select("own_", "chr", F.col("pos").alias("p0"), F.col("cm").alias("c0"), F.lead("pos").over(order).alias("p1"), F.lead("cm").over(order).alias("c1")).where("own_ AND p1 IS NOT NULL").drop("own_")
    bucket = lambda c: F.floor(F.col(c) / width)
    seg = seg.withColumn("bucket", F.explode(F.sequence(bucket("p0"), bucket("p1"))))
    ends = m.groupBy("chr").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min_by("cm", "pos").alias("cm_first"), F.max_by("cm", "pos").alias("cm_last")).where("first < last")
    p = points.withColumn("bucket", bucket("pos")).join(broadcast_if_small(ends), "chr", "left")
    hit = (F.col("p.chr") == F.col("s.chr")) & (F.col("p.bucket") == F.col("s.bucket")) & (F.col("pos") >= F.col("p0")) & (F.col("pos") < F.col("p1"))
    at = F.col("c0") + (F.col("c1") - F.col("c0")) * (F.col("pos") - F.col("p0")) / (F.col("p1") - F.col("p0"))
    cm = F.when(F.col("pos") <= F.col("first"), F.col("cm_first")).when(F.col("pos") >= F.col("last"), F.col("cm_last")).otherwise(at)
    return p.alias("p").join(broadcast_if_small(seg).alias("s"), hit, "left").select(*[F.col(f"p.{c}") for c in points.columns], cm.alias("cm"))
