"""Data behind the usual figures, as DataFrames."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ldmill.functions.ordered import blocks_of, ranked, running_sum
from ldmill.functions.scalar import decayed, palette_index
from ldmill.operators.emlg import polarized
from ldmill.operators.graph import linkage_order
from ldmill.session import broadcast_if_small

#: Twelve distinguishable colours (fixed values).
PALETTE = ["#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf", "#393b79", "#637939"]


def by_first_appearance(rows: DataFrame, key: str, order: str, within: list[str] | None = None) -> DataFrame:
    """``rows`` with ``appearance`` (1.. in the order in which keys first occur) and ``colour`` (1..12)."""
    keys = within or []
    first = rows.where(F.col(key).isNotNull()).groupBy(*keys, key).agg(F.min(order).alias("first_"))
    placed = ranked(first, keys, "first_", [key], "appearance").withColumn("appearance", F.col("appearance") + 1).drop("first_")
    return rows.join(broadcast_if_small(placed), [*keys, key], "left").withColumn("colour", palette_index(F.col("appearance")))


def stage_points(clustered: DataFrame, groups: DataFrame, chromosome: str | None, ld_w: str, threshold: float, direction: str = "high", min_n_loci_flag: float = float("inf"), result_params: dict | None = None) -> DataFrame:
    """``panel, chr, marker, pos, value, id, colour`` of one chromosome, or of each (null): the markers of flagged (``high``) or all other (``low``) clusters by their Stage-1 cluster and
    by their Stage-2 group. ``clustered (marker, chr, pos, cluster, <ld_w>)``, ``groups (group_id, members)``. Nothing that matches is an empty result.
    Warns where the parameters differ from those the groups were made with."""
    if direction not in ("high", "low"):
        raise ValueError(f"unknown direction {direction}")
    for k, v in (("ld_w_threshold", threshold), ("min_n_loci_flag", min_n_loci_flag)):
        if result_params and k in result_params and result_params[k] != v:
            warnings.warn(f"{k} = {v}, but the groups were made with {result_params[k]}", stacklevel=2)
    m = clustered.where("chr IS NOT NULL") if chromosome is None else clustered.where(F.col("chr") == chromosome)
    flag = m.groupBy("chr", "cluster").agg((F.coalesce(F.bool_or(F.col(ld_w) > threshold), F.lit(False)) | (F.lit(min_n_loci_flag != float("inf")) & (F.count(F.lit(1)) >= F.lit(min_n_loci_flag)))).alias("flagged"))
    m = m.join(broadcast_if_small(flag.where(F.col("flagged") == (direction == "high")).select("chr", "cluster")), ["chr", "cluster"], "left_semi")
    points = m.select("chr", "marker", "pos", F.col(ld_w).alias("value"), F.col("cluster").cast("string").alias("id"))
    stage1 = by_first_appearance(points, "id", "pos", ["chr"]).withColumn("panel", F.lit("stage1"))
    member = groups.select(F.col("group_id").alias("id"), F.explode("members").alias("marker"))
    stage2 = by_first_appearance(points.drop("id").join(member, "marker"), "id", "pos", ["chr"]).withColumn("panel", F.lit("stage2"))
    cols = ["panel", "chr", "marker", "pos", "value", "id", "colour"]
    return stage1.select(*cols).unionByName(stage2.select(*cols))


def decay_panels(decay_sum: DataFrame) -> DataFrame:
    """``panel, chr, x, y``: rate against chromosome size, its prediction, the start of the curve and the share of decay that the slide reaches."""
    size = F.col("chr_size").cast("double")
    panels = [("rate", F.col("a")), ("predicted_rate", F.col("a_pred")), ("start", F.col("c")), ("reached", F.col("rho_slide_pred"))]
    return decay_sum.where("chr IS NOT NULL").select("chr", F.explode(F.array(*[F.struct(F.lit(n).alias("panel"), size.alias("x"), v.cast("double").alias("y")) for n, v in panels])).alias("p")).select("p.panel", "chr", "p.x", "p.y").where("y IS NOT NULL AND NOT isnan(y)")


def chromosome_curves(params: DataFrame, points: int = 200) -> DataFrame:
    """``chr, k, d, r2``: each row's curve over 0..``slide_bp``."""
    at = params.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("d", F.col("slide_bp") * F.col("k") / (points - 1))
    return at.select("chr", "k", "d", decayed(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("r2"))


def heatmap_cells(geno: DataFrame, annotation: DataFrame | None = None, polarize: bool = True, strict: bool = True) -> DataFrame:
    """``cluster, ind_id, ord, value`` and the annotation's columns: calls as drawn, turned to the reference marker's polarity if asked. Individuals without annotation
    are an error if ``strict``. Markers read best in the order of ``display_order``."""
    cells = (polarized(geno) if polarize else geno).select("cluster", "ind_id", "ord", F.col("dosage").cast("double").alias("value"))
    if annotation is None:
        return cells
    if strict:
        lost = cells.select("ind_id").distinct().join(annotation, "ind_id", "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"no annotation for {[r['ind_id'] for r in lost]}")
    return cells.join(annotation, "ind_id", "left")


def display_order(edges: DataFrame) -> DataFrame:
    """``marker, tree, place``: markers in the order of a single-linkage tree on 1 - r2 (missing is 0), sorted by tree, then place: neighbours in the tree stand together."""
    e = edges.select(F.col("snp1").alias("u"), F.col("snp2").alias("v"), F.coalesce("r2", F.lit(0.0)).alias("s"))
    return linkage_order(e).withColumnRenamed("v", "marker")


def group_kinds(groups: DataFrame, prefix: str = "F") -> DataFrame:
    """``chr, flagged, n_groups, n_loci, largest`` of Stage-2 ``groups (group_id, chr, n_loci)``, flagged where the identifier starts with ``prefix``."""
    flagged = F.startswith(F.col("group_id"), F.lit(prefix)).alias("flagged")
    return groups.groupBy("chr", flagged).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_loci").cast("bigint").alias("n_loci"), F.max("n_loci").alias("largest"))


def rolling_median(rows: DataFrame, value: str, half: int = 100) -> DataFrame:
    """``rows`` with ``rolling``: the median over the marker and ``half`` neighbours on either side along its chromosome."""
    near = blocks_of(ranked(rows, ["chr"], "pos", ["marker"], "rk_"), "rk_", half, half)
    w = Window.partitionBy("chr", "block_").orderBy("rk_").rowsBetween(-half, half)
    near = near.withColumn("near_", F.array_sort(F.collect_list(value).over(w))).where("own_")  # at most 2 half + 1 values; nulls are left out
    n = F.size("near_")
    at = lambda i: F.element_at("near_", i.cast("int"))
    return near.withColumn("rolling", F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)).drop("near_", "rk_", "block_", "own_")


def ecdf(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with a value, with ``ecdf``: the share of rows at or below it."""
    ok = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    counts = ok.groupBy(F.col(value).alias("v_")).agg(F.count(F.lit(1)).alias("n_"))
    total = counts.agg(F.sum("n_").alias("all_"))
    share = running_sum(counts, [], "v_", "n_", "upto_").crossJoin(F.broadcast(total)).select("v_", (F.col("upto_") / F.col("all_")).alias("ecdf"))  # one row
    return ok.join(share, ok[value] == share["v_"]).drop("v_")


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    return rows.where(F.col(value).between(low, high)).groupBy(F.least(F.lit(bins), F.floor((F.col(value) - low) / (high - low) * bins) + 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
