"""Genotype store: marker table, allele frequencies, input kind, packed marker vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ldmill.functions.ordered import ranked


def allele_frequencies(geno: DataFrame) -> DataFrame:
    """``chr, snp_idx, pos, n_obs, maf`` per marker, missing calls left out; a marker without calls has maf null."""
    p = F.avg("dosage") / 2
    return geno.groupBy("chr", "snp_idx", "pos").agg(F.count("dosage").alias("n_obs"), F.least(p, 1 - p).alias("maf"))


def n_individuals(geno: DataFrame) -> DataFrame:
    return geno.agg(F.countDistinct("ind_id").alias("n_ind"))


def input_kind(geno: DataFrame, keys: list[str], tolerance: float = 1e-8) -> DataFrame:
    """``keys..., kind``: ``hard`` if every call is 0, 1 or 2 (also without calls), else ``dosage``."""
    x = F.col("dosage").cast("double")
    off = x.isNotNull() & ~((F.abs(x - F.rint(x)) < tolerance) & F.rint(x).isin(0.0, 1.0, 2.0))
    return geno.groupBy(*keys).agg(F.when(F.coalesce(F.bool_or(off), F.lit(False)), "dosage").otherwise("hard").alias("kind"))


def ranked_markers(geno: DataFrame) -> DataFrame:
    """``chr, snp_idx, pos, rk``: markers numbered from 0 along each chromosome. Works on the marker table, not on calls."""
    markers = geno.select("chr", "snp_idx", "pos").distinct()
    return ranked(markers, ["chr"], "pos", ["snp_idx"])


def packed(geno: DataFrame) -> DataFrame:
    """``chr, snp_idx, pos, inds, calls``: one row a marker, its non-missing calls in the order of individuals (none: empty arrays)."""
    call = F.when(F.col("dosage").isNotNull(), F.struct("ind_id", F.col("dosage").cast("double").alias("g")))
    rows = geno.groupBy("chr", "snp_idx", "pos").agg(F.sort_array(F.collect_list(call)).alias("x"))
    return rows.select("chr", "snp_idx", "pos", F.col("x.ind_id").alias("inds"), F.col("x.g").alias("calls"))
