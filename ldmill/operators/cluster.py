"""Stage 1: markers in strong LD become complete-linkage clusters, each with the marker that stands for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ldmill.functions.scalar import ld_from_rho
from ldmill.operators.graph import complete_linkage
from ldmill.session import broadcast_if_small


def threshold_edges(edges: DataFrame, params: DataFrame, rho: float = 0.5, idx: DataFrame | None = None) -> DataFrame:
    """``u, v, s, chr``: pairs within a chromosome with r2 at or above b + (c - b)(1 - rho) of that chromosome; ``idx (marker)`` restricts both ends."""
    level = params.select(F.col("chr").alias("chr1"), ld_from_rho(F.col("b"), F.col("c"), rho).alias("r2_th"))
    e = edges.where("chr1 = chr2").join(broadcast_if_small(level), "chr1").where("r2 >= r2_th")
    if idx is not None:
        e = e.join(idx.select(F.col("marker").alias("snp1")), "snp1", "left_semi").join(idx.select(F.col("marker").alias("snp2")), "snp2", "left_semi")
    return e.select(F.col("snp1").alias("u"), F.col("snp2").alias("v"), F.col("r2").alias("s"), F.col("chr1").alias("chr"))


def stage1(markers: DataFrame, edges: DataFrame, params: DataFrame, rho: float = 0.5, on_missing: str = "error") -> DataFrame:
    """``marker, chr, pos, core, n_loci, is_core, median_ld`` for every marker of ``markers (marker, chr, pos)``.

    Every pair inside a cluster is at or above its chromosome's threshold. The core of a cluster of one is itself (median_ld null), of two the first by
    position (both carry the pair's r2), else the marker with the highest median r2 to the others, the first of equals.
    Chromosomes without parameters raise, or with ``on_missing='singletons'`` keep each marker alone.
    """
    if on_missing == "error":
        lost = markers.join(params.select("chr"), "chr", "left_anti").select("chr").distinct().limit(5).collect()
        if lost:
            raise ValueError(f"no decay parameters for {[r['chr'] for r in lost]}")
    e = threshold_edges(edges, params, rho, markers.select("marker"))
    linked = complete_linkage(e)
    own = linked.select(F.col("v"), "cluster")
    inside = e.join(own.select(F.col("v").alias("u"), F.col("cluster").alias("cu")), "u").join(own.select("v", F.col("cluster").alias("cv")), "v").where("cu = cv")
    medians = inside.select(F.explode(F.array("u", "v")).alias("marker"), "s").groupBy("marker").agg(F.percentile("s", 0.5).alias("median_ld"))
    m = markers.join(own.withColumnRenamed("v", "marker"), "marker", "left").withColumn("cluster", F.coalesce("cluster", "marker")).join(medians, "marker", "left")
    sizes = m.groupBy("chr", "cluster").agg(F.count(F.lit(1)).alias("n_loci"), F.min(F.struct((-F.col("median_ld")).alias("k"), "pos", "marker")).alias("by_ld"), F.min(F.struct("pos", "marker")).alias("by_pos"))
    core = F.when(F.col("n_loci") <= 2, F.col("by_pos.marker")).otherwise(F.col("by_ld.marker"))
    out = m.join(sizes.select("chr", "cluster", "n_loci", core.alias("core")), ["chr", "cluster"])
    return out.select("marker", "chr", "pos", "core", "n_loci", (F.col("marker") == F.col("core")).alias("is_core"), "median_ld")


def cluster_table(clustered: DataFrame) -> DataFrame:
    """``chr, core, median_ld, n_snps, members``: one row a cluster, members by position."""
    return clustered.groupBy("chr", "core").agg(F.max(F.when(F.col("is_core"), F.col("median_ld"))).alias("median_ld"), F.count(F.lit(1)).alias("n_snps"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "marker"))), lambda x: x["marker"]).alias("members"))


def pruned(clustered: DataFrame) -> DataFrame:
    """The markers kept: every cluster's core."""
    return clustered.where("is_core").select("marker", "chr", "pos", "n_loci", "median_ld")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """``chr, n_markers, n_clusters, kept_share, n_single, single_share, largest`` a chromosome."""
    c = clustered.groupBy("chr").agg(F.count(F.lit(1)).alias("n_markers"), F.count_if("is_core").alias("n_clusters"), F.count_if(F.col("is_core") & (F.col("n_loci") == 1)).alias("n_single"), F.max("n_loci").alias("largest"))
    return c.withColumns({"kept_share": F.col("n_clusters") / F.col("n_markers"), "single_share": F.try_divide("n_single", "n_clusters")})


def size_distribution(clustered: DataFrame) -> DataFrame:
    return clustered.where("is_core").groupBy("n_loci").agg(F.count(F.lit(1)).alias("n_clusters"))


def cluster_level_map(map_snp: DataFrame, cluster: str = "cl_id") -> DataFrame:
    """Per cluster: chromosome, first, last and median position, span and number of loci, by first position within the chromosome (``ord``)."""
    c = map_snp.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster)).agg(F.min("chr").alias("chr"), F.min("pos").alias("pos_min"), F.max("pos").alias("pos_max"), F.percentile("pos", 0.5).alias("pos_median"), F.count(F.lit(1)).alias("n_loci"))
    return c.withColumn("span", F.col("pos_max") - F.col("pos_min"))


def with_positions(map_cl: DataFrame, reference: DataFrame) -> DataFrame:
    """All markers of the reference map with their position, and what is known of their cluster (outer on the reference side)."""
    keys = [c for c in ("marker", "chr", "pos") if c in map_cl.columns and c in reference.columns]
    return map_cl.join(reference.select("marker", "chr", "pos").distinct(), keys, "right")
