"""Consensus genotypes of marker clusters: polarity, expected dosage, how cleanly it rounds, and the single marker closest to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ldmill.functions.scalar import clamp, finite, half_even


def _corr(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums, null where a side is constant (up to rounding)."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 1e-9) & (vy > 1e-9), (n * sxy - sx * sy) / F.sqrt(vx) / F.sqrt(vy))


def correlations(rows: DataFrame, keys: list[str], x: str, y: str, out: str = "r") -> DataFrame:
    """Correlation of two columns per key over the rows that have both, from combining sums."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    s = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    return s.select(*keys, _corr(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).alias(out))


def polarity(geno: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``cluster, ord, flip`` for ``geno (cluster, ord, ind_id, dosage)``: whether a marker runs against its cluster's reference, the first of the most
    complete markers: correlation with it finite and below ``threshold``."""
    complete = geno.groupBy("cluster", "ord").agg(F.count("dosage").alias("n_obs"))
    ref = complete.groupBy("cluster").agg(F.min(F.struct((-F.col("n_obs")).alias("k"), "ord")).alias("m")).select("cluster", F.col("m.ord").alias("ref"))
    ref_calls = geno.join(ref, "cluster").where("ord = ref").select("cluster", "ind_id", F.col("dosage").alias("ref_dosage"))
    r = correlations(geno.join(ref_calls, ["cluster", "ind_id"]), ["cluster", "ord"], "ref_dosage", "dosage")
    return complete.join(r, ["cluster", "ord"], "left").select("cluster", "ord", F.coalesce(F.col("r") < threshold, F.lit(False)).alias("flip"))


def polarized(geno: DataFrame, threshold: float = 0.0) -> DataFrame:
    return geno.join(polarity(geno, threshold), ["cluster", "ord"]).withColumn("dosage", F.when(F.col("flip"), 2 - F.col("dosage")).otherwise(F.col("dosage")))


def consensus(geno: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``cluster, ind_id, value``: the mean call of the polarized markers; null for individuals without a call in the cluster.

    The same for hard calls, where it is the expected allele count, and for dosages."""
    return polarized(geno, threshold).groupBy("cluster", "ind_id").agg(F.avg(F.col("dosage").cast("double")).alias("value"))


def scores(cons: DataFrame) -> DataFrame:
    """``cluster, score``: squared correlation of the consensus with itself rounded half to even; null where either is constant."""
    r = correlations(cons.withColumn("rounded", half_even(F.col("value"))), ["cluster"], "rounded", "value")
    return cons.select("cluster").distinct().join(r, "cluster", "left").select("cluster", (F.col("r") * F.col("r")).alias("score"))


def make_emlgs(geno: DataFrame, kind: str = "auto", l_min: int = 10, threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Consensus values and ``cluster, n_loci, score`` of the clusters with at least ``l_min`` markers; an error if there is none.

    ``kind``: hard, dosage or auto; hard calls must be 0, 1 or 2."""
    if kind not in ("auto", "hard", "dosage"):
        raise ValueError(f"unknown input kind {kind}")
    if kind == "hard" and not geno.where("dosage IS NOT NULL AND dosage NOT IN (0, 1, 2)").isEmpty():
        raise ValueError("calls other than 0, 1 and 2")
    sizes = geno.groupBy("cluster").agg(F.countDistinct("ord").alias("n_loci")).where(F.col("n_loci") >= l_min)
    if sizes.isEmpty():
        raise ValueError(f"no cluster of at least {l_min} markers")
    cons = consensus(geno.join(sizes.select("cluster"), "cluster", "left_semi"), threshold)
    return cons, sizes.join(scores(cons), "cluster")


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """``keys..., value``: the weighted mean over the rows that have a value."""
    has = F.col(value).isNotNull()
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.when(has, F.col(value) * F.col(weight))), F.sum(F.when(has, F.col(weight)))).alias("value"))


def best_markers(geno: DataFrame, cons: DataFrame, heads: DataFrame) -> DataFrame:
    """``cluster, representative, best_ord, best_r, rep_r, rep_is_best, flipped``: per cluster the member with the strongest correlation to the consensus, the
    first of equals; the representative where none is defined. ``heads (cluster, representative)`` by ord."""
    r = correlations(geno.join(cons, ["cluster", "ind_id"]), ["cluster", "ord"], "dosage", "value")
    strength = F.round(F.abs("r"), 12)  # equal up to rounding is equal
    top = r.where("r IS NOT NULL").groupBy("cluster").agg(F.min(F.struct((-strength).alias("k"), "ord", "r")).alias("m"))
    at_head = heads.join(r.select("cluster", F.col("ord").alias("representative"), F.col("r").alias("rep_r")), ["cluster", "representative"], "left")
    out = at_head.join(top, "cluster", "left").withColumn("best_ord", F.coalesce("m.ord", "representative"))
    return out.select("cluster", "representative", "best_ord", F.col("m.r").alias("best_r"), "rep_r", (F.col("best_ord") == F.col("representative")).alias("rep_is_best"), F.coalesce(F.col("m.r") < 0, F.lit(False)).alias("flipped"))


def fill_best(geno: DataFrame, cons: DataFrame, best: DataFrame, round_fill: bool = True) -> DataFrame:
    """``cluster, ind_id, observed, filled``: the best marker's calls, the missing ones from the consensus turned its way (rounded and within 0..2 if asked)."""
    calls = geno.select("cluster", "ind_id", F.col("ord").alias("best_ord"), "dosage")
    rows = cons.join(best.select("cluster", "best_ord", "flipped"), "cluster").join(calls, ["cluster", "ind_id", "best_ord"], "left")
    turned = F.when(F.col("flipped"), 2 - F.col("value")).otherwise(F.col("value"))
    guess = clamp(half_even(turned), 0.0, 2.0) if round_fill else turned
    return rows.select("cluster", "ind_id", F.col("dosage").cast("double").alias("observed"), F.coalesce(F.col("dosage").cast("double"), finite(guess)).alias("filled"))


def fill_counts(filled: DataFrame) -> DataFrame:
    """``cluster, n_ind, n_obs, n_filled, n_resid_na``, which add up."""
    return filled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_ind"), F.count("observed").alias("n_obs"), (F.count("filled") - F.count("observed")).alias("n_filled"), (F.count(F.lit(1)) - F.count("filled")).alias("n_resid_na"))
