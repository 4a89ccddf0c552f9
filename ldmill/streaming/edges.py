"""LD edges as they are computed: late and repeated rows of a stream, and running figures per chromosome and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "snp1 string, snp2 string, chr1 string, chr2 string, pos1 bigint, pos2 bigint, r2 double, d bigint, batch_id int, computed_at timestamp"


def read_edge_stream(spark: SparkSession, folder: str, schema: str = EDGE_SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """Edge rows from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def usable_edges(edges: DataFrame, late: str = "7 days") -> DataFrame:
    """Rows with a usable r2 and two different markers, each (unordered pair, time) once within the watermark."""
    name = lambda c: F.upper(F.trim(F.col(c)))
    rows = edges.where(F.col("r2").between(0.0, 1.0) & (name("snp1") != name("snp2")))
    rows = rows.withColumns({"a": F.least(name("snp1"), name("snp2")), "b": F.greatest(name("snp1"), name("snp2"))})
    return rows.withWatermark("computed_at", late).dropDuplicates(["a", "b", "computed_at"])


def daily_figures(edges: DataFrame) -> DataFrame:
    """``chr, day, n, mean_r2, max_r2`` per chromosome and day of computation; algebraic, so a state is a few numbers."""
    per = edges.groupBy(F.col("chr1").alias("chr"), F.window("computed_at", "1 day").alias("w"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg("r2").alias("mean_r2"), F.max("r2").alias("max_r2")).select("chr", F.col("w.start").alias("day"), "n", "mean_r2", "max_r2")
