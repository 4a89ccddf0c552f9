"""Outlier clusters: candidates by local LD support, significance among them, LD clusters and a null that respects their size."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ldmill.functions.ordered import bh_adjust, quantiles, ranked, running_sum
from ldmill.functions.scalar import finite
from ldmill.operators.assoc import NullModel, f_tail, null_statistics
from ldmill.operators.graph import connected_components
from ldmill.session import Tables, broadcast_if_small

GRID = [i / 100 for i in range(99)]


def usable(rows: DataFrame) -> DataFrame:
    """``marker, chr, pos, pval, ld_w`` with values that aren't finite numbers as null."""
    return rows.select("marker", "chr", "pos", finite(F.col("pval").cast("double")).alias("pval"), finite(F.col("ld_w").cast("double")).alias("ld_w"))


def rmsc_curve(rows: DataFrame, fdr: float = 0.05, grid: list[float] | None = None) -> DataFrame:
    """``q, threshold, n_kept, rejections``: for each quantile of ld_w, the markers at or above it and how many of them the adjusted p-value keeps below ``fdr``.

    A marker is kept up to the last quantile it reaches. Only p-values below ``fdr`` can be rejected, so only they are ranked once a quantile.
    """
    grid = grid or GRID
    ok = rows.where("pval IS NOT NULL AND ld_w IS NOT NULL")
    cuts = ok.sparkSession.createDataFrame(list(enumerate(quantiles(ok, "ld_w", grid))), "i int, threshold double").where("threshold IS NOT NULL")
    thresholds = cuts.agg(F.sort_array(F.collect_list("threshold")).alias("t"))  # one row of as many numbers as the grid
    reach = ok.crossJoin(F.broadcast(thresholds)).select("pval", F.size(F.filter("t", lambda x: x <= F.col("ld_w"))).alias("reach"))
    kept = reach.groupBy("reach").agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.sequence(F.lit(0), F.col("reach") - 1)).alias("i"), "n").groupBy("i").agg(F.sum("n").alias("n_kept"))
    low = reach.where(F.col("pval") < fdr).groupBy("reach", "pval").agg(F.count(F.lit(1)).alias("n")).select("pval", "n", F.explode(F.sequence(F.lit(0), F.col("reach") - 1)).alias("i"))
    low = low.groupBy("i", "pval").agg(F.sum("n").alias("n"))
    placed = running_sum(low, ["i"], "pval", "n", "k").join(F.broadcast(kept), "i")
    best = placed.where(F.col("pval") * F.col("n_kept") / F.col("k") < fdr).groupBy("i").agg(F.max("k").alias("rejections"))
    q = F.element_at(F.array(*[F.lit(float(x)) for x in grid]), F.col("i") + 1)
    return cuts.join(kept, "i", "left").join(best, "i", "left").select(q.alias("q"), "threshold", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce("rejections", F.lit(0)).alias("rejections"))


def rmsc_choice(curve: DataFrame) -> DataFrame:
    """``q_star, threshold, peak, no_elbow``: the first quantile with most rejections; no elbow if that is the lowest, or nothing beats the one nearest 0."""
    best = F.min(F.struct((-F.col("rejections")).alias("k"), "q", "threshold")).alias("m")
    base = F.min(F.struct(F.abs("q").alias("z"), "q", "rejections")).alias("b")
    c = curve.agg(best, base, F.min("q").alias("q0"))
    return c.select(F.col("m.q").alias("q_star"), F.col("m.threshold").alias("threshold"), (-F.col("m.k")).alias("peak"), ((F.col("m.q") <= F.col("q0") + 1e-9) | (-F.col("m.k") <= F.col("b.rejections"))).alias("no_elbow"))


def candidates(rows: DataFrame, threshold: float, fdr: float = 0.05) -> DataFrame:
    """``rows`` at or above the ld_w threshold with ``q_snp`` (adjusted among them) and ``sig``."""
    c = bh_adjust(rows.where("pval IS NOT NULL").where(F.col("ld_w") >= threshold), "pval", "q_snp")
    return c.withColumn("sig", F.coalesce(F.col("q_snp") < fdr, F.lit(False)))


def ld_clusters(cand: DataFrame, edges: DataFrame, r2_link: float = 0.5, r2_by_chr: DataFrame | None = None, gap: float | None = None, gap_by_chr: DataFrame | None = None) -> DataFrame:
    """``cand`` with ``cluster``: single linkage of candidates on edges with r2 at or above the link level within a chromosome, then split where neighbours in
    position are more than the gap apart. Levels ``(chr, r2_link)`` and ``(chr, gap)`` by chromosome go before the common ones."""
    e = edges.where("chr1 = chr2").select(F.col("chr1").alias("chr"), F.col("snp1").alias("u"), F.col("snp2").alias("v"), "r2")
    level = F.lit(float(r2_link))
    if r2_by_chr is not None:
        e = e.join(broadcast_if_small(r2_by_chr.select("chr", F.col("r2_link").alias("own_"))), "chr", "left")
        level = F.coalesce("own_", level)
    e = e.where(F.col("r2") >= level)
    mine = cand.select(F.col("marker").alias("u"))
    e = e.join(mine, "u", "left_semi").join(mine.withColumnRenamed("u", "v"), "v", "left_semi").select("u", "v")
    linked = connected_components(e).withColumnRenamed("v", "marker")
    c = cand.join(linked, "marker", "left").withColumn("component", F.coalesce("component", "marker"))
    limit = F.lit(float(gap) if gap is not None else None).cast("double")
    if gap_by_chr is not None:
        c = c.join(broadcast_if_small(gap_by_chr.select("chr", F.col("gap").alias("gap_"))), "chr", "left")
        limit = F.coalesce("gap_", limit)
    order = Window.partitionBy("chr", "component").orderBy("pos", "marker")
    new = F.coalesce((F.col("pos") - F.lag("pos").over(order) > limit).cast("int"), F.lit(0))
    c = c.withColumn("new_", new).withColumn("run_", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    name = F.concat_ws("#", "component", F.col("run_").cast("string"))
    return c.withColumn("cluster", name).drop("component", "new_", "run_", "gap_")


def cluster_counts(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("chr", "cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if("sig").alias("n_sig"), F.min("pos").alias("start"), F.max("pos").alias("end"))


def background_exact(background: DataFrame, clusters: DataFrame, pcut: float, b: int = 1000) -> DataFrame:
    """``cluster, frac, emp_p``: of all rotations of the chromosome's background markers (in position order, a hit where p <= pcut), the share whose first n
    (wrapping around) hold at least n_sig hits; emp_p = (1 + b frac) / (b + 1), null where a chromosome has fewer than two background markers.

    The window sums come from one cumulative count. Clusters of one chromosome share one pass over its rotations a window length.
    """
    spark = background.sparkSession
    s = background.where("pval IS NOT NULL").select("chr", "marker", "pos", (F.col("pval") <= pcut).cast("bigint").alias("hit"))
    line = ranked(s, ["chr"], "pos", ["marker"], "i")
    line = Tables(spark, "rotations").cut(running_sum(line.withColumn("x_", F.col("i")), ["chr"], "x_", "hit", "cum").select("chr", "hit", (F.col("i") + 1).alias("i"), "cum"))
    total = broadcast_if_small(Tables(spark, "totals").cut(line.groupBy("chr").agg(F.count(F.lit(1)).alias("nb"), F.sum("hit").alias("all_hits"))))
    clusters = Tables(spark, "tested").cut(clusters)
    shapes = clusters.select("chr", "n", "n_sig").distinct().join(total, "chr").where("nb >= 2")
    shapes = Tables(spark, "shapes").cut(shapes.withColumns({"whole": F.floor(F.col("n") / F.col("nb")), "rest": F.col("n") % F.col("nb")}))
    # one pass over the rotations a window length: a window of `rest` markers from rotation i on ends at i + rest - 1, perhaps beyond the end
    lengths = shapes.select("chr", "rest", "nb", "all_hits").distinct()
    starts = line.select("chr", F.col("i").alias("i0"), (F.col("cum") - F.col("hit")).alias("before")).join(broadcast_if_small(lengths, within=shapes), "chr")
    ends = starts.withColumns({"wrapped": F.col("i0") + F.col("rest") - 1 > F.col("nb"), "last": F.pmod(F.col("i0") + F.col("rest") - 2, F.col("nb")) + 1})
    got = ends.join(line.select("chr", F.col("i").alias("last"), F.col("cum").alias("at_last")), ["chr", "last"])
    part = F.when(F.col("rest") == 0, 0).otherwise(F.col("at_last") - F.col("before") + F.when(F.col("wrapped"), F.col("all_hits")).otherwise(0))
    # how many rotations of a length have how many hits; every n_sig reads its share from these counts
    histogram = Tables(spark, "histogram").cut(got.select("chr", "rest", part.alias("hits")).groupBy("chr", "rest", "hits").agg(F.count(F.lit(1)).alias("rotations")))
    both = shapes.join(broadcast_if_small(histogram), ["chr", "rest"])
    reached = F.when(F.col("whole") * F.col("all_hits") + F.col("hits") >= F.col("n_sig"), F.col("rotations")).otherwise(0)
    frac = both.groupBy("chr", "n", "n_sig").agg((F.sum(reached) / F.max("nb")).alias("frac"))
    out = clusters.join(broadcast_if_small(frac, within=shapes), ["chr", "n", "n_sig"], "left")
    return out.select("cluster", "frac", ((1 + b * F.col("frac")) / (b + 1)).alias("emp_p"))


def background_sampled(background: DataFrame, clusters: DataFrame, pcut: float, b: int = 1000, seed: int = 0) -> DataFrame:
    """As ``background_exact``, with ``b`` rotations drawn by seed: the number that reach n_sig is binomial with the exact share."""

    @F.pandas_udf("double")
    def draw(frac: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([np.nan if pd.isna(f) else (1 + np.random.default_rng([seed, zlib.crc32(n.encode())]).binomial(b, f)) / (b + 1) for f, n in zip(frac, name, strict=True)])

    exact = background_exact(background, clusters, pcut, b)
    return exact.select("cluster", "frac", finite(draw("frac", "cluster")).alias("emp_p"))


def permutation_null(geno: DataFrame, model: NullModel | dict[str, NullModel], clustered: DataFrame, clusters: DataFrame, pcut: float, b: int = 1000, seed: int = 0) -> DataFrame:
    """``cluster, emp_p``: how often a permuted phenotype gives a cluster at least its number of significant markers.

    ``geno`` holds the candidates' calls with ``snp_idx`` as in ``clustered``; one model, or each chromosome's own. A kinship is decomposed once; a draw only re-estimates the variance components."""
    mine = clustered.select("snp_idx", "cluster")
    calls = geno.join(broadcast_if_small(mine.select("snp_idx").distinct()), "snp_idx", "left_semi")
    n = len((model if isinstance(model, NullModel) else next(iter(model.values()))).y)
    # p falls as F grows: the cutoff on p is one on F
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f_tail([mid], 1, n - 2)[0] > pcut else (low, mid)
    hits = null_statistics(calls, model, b, seed).where(~F.isnan("f") & (F.col("f") >= high))
    counts = hits.join(broadcast_if_small(mine), "snp_idx").groupBy("cluster", "draw").agg(F.count(F.lit(1)).alias("k"))
    reached = clusters.select("cluster", "n_sig").join(counts, "cluster", "left").groupBy("cluster", "n_sig").agg(F.count_if(F.col("k") >= F.col("n_sig")).alias("m"))
    m = F.when(F.col("n_sig") == 0, F.lit(b)).otherwise(F.col("m"))
    return reached.select("cluster", ((1 + m) / (b + 1)).alias("emp_p"))


@dataclass
class OutlierClusters:
    clusters: DataFrame
    candidates: DataFrame
    curve: DataFrame
    threshold: float
    q_star: float | None
    pcut: float | None
    null: str
    b: int
    diagnostics: dict = field(default_factory=dict)

    def __repr__(self) -> str:
        return f"OutlierClusters(threshold={self.threshold:.4g}, pcut={self.pcut}, null={self.null}, B={self.b}, {self.diagnostics})"


def reading_order(scored: DataFrame) -> DataFrame:
    """``scored`` with ``rank`` (1.., equal ones alike): significant clusters first, then by emp_p with untested ones first, then by n_sig from the largest down."""
    like = scored.groupBy("significant", F.coalesce("emp_p", F.lit(-1.0)).alias("p_"), "n_sig").agg(F.count(F.lit(1)).alias("c_"))
    placed = ranked(like.withColumn("o_", F.when(F.col("significant"), 0).otherwise(4) + F.col("p_")), [], "o_", [F.desc("n_sig")], "rk_")
    first = running_sum(placed, [], "rk_", "c_", "upto_").select("significant", "p_", "n_sig", (F.col("upto_") - F.col("c_") + 1).alias("rank"))
    return scored.withColumn("p_", F.coalesce("emp_p", F.lit(-1.0))).join(broadcast_if_small(first), ["significant", "p_", "n_sig"]).drop("p_")


def outlier_clusters(rows: DataFrame, edges: DataFrame, threshold: float | None = None, fdr: float = 0.05, r2_link: float = 0.5, r2_by_chr: DataFrame | None = None, gap: float | None = None, gap_by_chr: DataFrame | None = None, min_cluster_sig: int = 1, null: str = "background_exact", cluster_fdr: float = 0.05, b: int = 1000, grid: list[float] | None = None, geno: DataFrame | None = None, model: NullModel | dict[str, NullModel] | None = None, seed: int = 0) -> OutlierClusters:
    """Clusters of candidate markers with more significant ones than chance gives clusters of their size.

    ``rows (marker, chr, pos, pval, ld_w)``; ``threshold``: a quantile of ld_w, chosen on the discovery curve if null. Sorted by ``rank``, see ``reading_order``.
    """
    if null not in ("background_exact", "background", "permutation"):
        raise ValueError(f"unknown null {null}")
    if null == "permutation" and (geno is None or model is None):
        raise ValueError("the permutation null needs genotypes and a null model")
    tables = Tables(rows.sparkSession, "outliers")
    r = tables.cut(usable(rows))
    curve = tables.cut(rmsc_curve(r, fdr, grid))
    choice = rmsc_choice(curve).first()
    ok = r.where("pval IS NOT NULL AND ld_w IS NOT NULL")
    level = choice["threshold"] if threshold is None else quantiles(ok, "ld_w", [threshold])[0]
    if level is None:
        raise ValueError("no marker with a p-value and support")
    cand = tables.cut(candidates(r, level, fdr))
    pcut = cand.where("sig").agg(F.max("pval").alias("p")).first()["p"]
    clustered = tables.cut(ld_clusters(cand, edges, r2_link, r2_by_chr, gap, gap_by_chr))
    counts = tables.cut(cluster_counts(clustered))
    quiet = r.join(cand.select("marker"), "marker", "left_anti")
    if pcut is None:
        scored = counts.withColumn("emp_p", F.lit(None).cast("double"))
    else:
        tested = counts.where(F.col("n_sig") >= min_cluster_sig)
        if null == "permutation":
            ids = geno.select("marker", "snp_idx").distinct()
            p = permutation_null(geno, model, clustered.join(ids, "marker"), tested, pcut, b, seed)
        else:
            p = (background_exact if null == "background_exact" else background_sampled)(quiet, tested, pcut, b)
        scored = counts.join(p.select("cluster", "emp_p"), "cluster", "left")
    scored = bh_adjust(scored, "emp_p", "emp_q").withColumn("significant", F.coalesce(F.col("emp_q") < cluster_fdr, F.lit(False)))
    scored = tables.cut(reading_order(scored.select("chr", "cluster", "n", "n_sig", "start", "end", "emp_p", "emp_q", "significant")))
    n_chr = r.select("chr").distinct().count()
    chr_sig = scored.where("significant").select("chr").distinct().count()
    rate = quiet.where("pval IS NOT NULL").agg(F.avg((F.col("pval") <= F.lit(pcut)).cast("double")).alias("x")).first()["x"] if pcut is not None else None
    found = {"no_elbow": bool(choice["no_elbow"]) and threshold is None, "peak_rejections": choice["peak"], "background_rate": rate, "chr_with_signal": chr_sig, "all_chr_flagged": n_chr > 1 and chr_sig == n_chr}
    return OutlierClusters(scored.orderBy("rank"), clustered, curve, level, choice["q_star"] if threshold is None else threshold, pcut, null, b, found)
