"""Table sources and sinks: one Parquet table per name, edge lists partitioned by chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_edges(edges: DataFrame, path: str) -> None:
    """Edge-list sink, one folder per chromosome so that later reads prune partitions."""
    edges.withColumn("chr", F.col("chr1")).write.mode("overwrite").partitionBy("chr").parquet(path)


def read_edges(spark: SparkSession, path: str, chromosomes: list[str] | None = None) -> DataFrame:
    """Edge-list source; ``chromosomes`` becomes a partition filter."""
    edges = spark.read.parquet(path)
    return edges if chromosomes is None else edges.where(F.col("chr").isin(chromosomes))


def write_genotypes(geno: DataFrame, path: str) -> None:
    """Genotype-store sink: long calls partitioned by chromosome, dosages rounded half to even."""
    geno.withColumn("dosage", F.bround(F.col("dosage").cast("double"), 0).cast("int")).write.mode("overwrite").partitionBy("chr").parquet(path)


def read_genotypes(spark: SparkSession, path: str, chromosomes: list[str] | None = None) -> DataFrame:
    geno = spark.read.parquet(path)
    return geno if chromosomes is None else geno.where(F.col("chr").isin(chromosomes))
