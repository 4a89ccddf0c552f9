"""Local LD support of markers: the median r2 to all partners within the distance that a share rho of the decay takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ldmill.functions.scalar import d_from_rho
from ldmill.session import broadcast_if_small


def ld_support(edges: DataFrame, markers: DataFrame, params: DataFrame, rhos: list[float]) -> DataFrame:
    """``marker, chr, rho, ld_w, n_partners`` for every marker and rho; ld_w is null for markers without a partner closer than ``rho / (a (1 - rho))``.

    ``edges (snp1, snp2, chr1, chr2, r2, d)``, ``markers (marker, chr)``, ``params (chr, a)``. Each edge counts for both its ends; distances compare strictly.
    """
    grid = sorted({float(r) for r in rhos})
    near = edges.where("chr1 = chr2 AND r2 IS NOT NULL AND d IS NOT NULL").join(broadcast_if_small(params.select(F.col("chr").alias("chr1"), "a")), "chr1")
    near = near.where(F.col("d") < d_from_rho(F.col("a"), grid[-1]))
    ends = near.select("a", "d", "r2", F.explode(F.array("snp1", "snp2")).alias("marker"), )
    ends = ends.withColumn("rho", F.explode(F.array(*[F.lit(r) for r in grid]))).where(F.col("d") < d_from_rho(F.col("a"), F.col("rho")))
    medians = ends.groupBy("marker", "rho").agg(F.percentile("r2", 0.5).alias("ld_w"), F.count(F.lit(1)).alias("n_partners"))
    wanted = markers.select("marker", "chr").withColumn("rho", F.explode(F.array(*[F.lit(r) for r in grid])))
    return wanted.join(medians, ["marker", "rho"], "left").select("marker", "chr", "rho", "ld_w", F.coalesce("n_partners", F.lit(0)).cast("bigint").alias("n_partners"))


def wide_support(support: DataFrame, rhos: list[float]) -> DataFrame:
    """One column ``rho_<v>`` per rho, as a matrix of markers by rho."""
    grid = sorted({float(r) for r in rhos})
    return support.groupBy("marker", "chr").pivot("rho", grid).agg(F.max("ld_w")).select("marker", "chr", *[F.col(f"`{r}`").alias(f"rho_{r}") for r in grid])
