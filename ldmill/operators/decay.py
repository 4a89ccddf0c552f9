"""Decay of LD with distance: background level, windows, distance strata, curve fits, per-chromosome summaries and what they recommend."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ldmill.functions.ordered import quantiles, ranked
from ldmill.functions.scalar import d_from_rho, decayed, log_stratum, pair_hash
from ldmill.operators.genotypes import allele_frequencies
from ldmill.operators.pairs import edge_list
from ldmill.session import Tables, broadcast_if_small, figure
from ldmill.sources.tables import read_edges, write_edges


def sampled_markers(geno: DataFrame, n_sub: int, min_maf: float) -> DataFrame:
    """``chr, snp_idx`` of a sample proportional to each chromosome's markers with maf > ``min_maf``: ``ceil(n_sub * share)`` by hash rank."""
    ok = allele_frequencies(geno).where(F.col("maf") > min_maf)
    sizes = ok.groupBy("chr").agg(F.count(F.lit(1)).alias("n_chr"))
    total = sizes.agg(F.sum("n_chr").alias("n_all"))
    quota = sizes.crossJoin(F.broadcast(total)).withColumn("quota", F.ceil(F.lit(n_sub) * F.col("n_chr") / F.col("n_all")))  # one row of totals
    own = F.crc32(F.col("snp_idx").cast("binary")) if ok.schema["snp_idx"].dataType.simpleString() == "string" else F.col("snp_idx")
    placed = ranked(ok.withColumn("hash", pair_hash(own)), ["chr"], "hash", ["snp_idx"], "rank")
    return placed.join(broadcast_if_small(quota), "chr").where("rank < quota").select("chr", "snp_idx")


def background_ld(geno: DataFrame, q: float = 0.95, n_sub: int = 5000, min_maf: float = 0.1) -> DataFrame:
    """``n_pairs, b``: the q-quantile of r2 between sampled markers of different chromosomes; b is null where there is no such pair."""
    sample = sampled_markers(geno, n_sub, min_maf)
    pairs = edge_list(geno.join(broadcast_if_small(sample), ["chr", "snp_idx"], "left_semi"), slide=0, by_chr=False, across_only=True)
    pairs = Tables(geno.sparkSession, "background").cut(pairs.select("r2"))
    return geno.sparkSession.createDataFrame([(figure(pairs), quantiles(pairs, "r2", [q])[0])], "n_pairs bigint, b double")


def chromosome_scale(markers: DataFrame, slide: int = 1000, n_win: int = 20, overlap: float = 0.5) -> DataFrame:
    """``chr, chr_size, n_snp_chr, bp_per_snp, slide_bp, window_size, step`` from ``markers (chr, pos)``; chromosomes of one marker have null spacing."""
    s = markers.where("chr IS NOT NULL AND pos IS NOT NULL").groupBy("chr").agg(F.max("pos").alias("chr_size"), (F.max("pos") - F.min("pos")).alias("span"), F.count(F.lit(1)).alias("n_snp_chr"))
    spacing = F.when(F.col("n_snp_chr") > 1, F.col("span") / (F.col("n_snp_chr") - 1))
    return s.select("chr", "chr_size", "n_snp_chr", spacing.alias("bp_per_snp"), (spacing * slide).alias("slide_bp"), (F.col("span") / n_win).alias("window_size"), (F.col("span") / n_win * overlap).alias("step"))


def decay_pairs(edges: DataFrame, scale: DataFrame, maf: DataFrame | None = None, min_maf: float = 0.1) -> DataFrame:
    """The pairs that curves are fitted to: within a chromosome, 0 < d < window_size, both markers' maf above ``min_maf`` (``maf (marker, maf)``, optional)."""
    e = edges.where("chr1 = chr2 AND d > 0").select("snp1", "snp2", "chr1", "pos1", "pos2", "d", "r2")
    if maf is not None:
        ok = maf.where(F.col("maf") > min_maf).select("marker")
        e = e.join(ok.withColumnRenamed("marker", "snp1"), "snp1", "left_semi").join(ok.withColumnRenamed("marker", "snp2"), "snp2", "left_semi")
    near = e.withColumnRenamed("chr1", "chr").join(broadcast_if_small(scale.select("chr", "window_size", "step")), "chr").where("d < window_size")
    return Tables(edges.sparkSession, "decay").cut(near.select("chr", "pos1", "pos2", "d", "r2", "window_size", "step"))


def windowed(pairs: DataFrame, min_pairs: int = 100) -> DataFrame:
    """``chr, win, start, end, pos1, pos2, d, r2, n_pairs``: each pair in every window that holds both its ends, for windows with more than ``min_pairs`` pairs.

    Windows start every ``step`` from the first position on, while they end within the last; they are regular, so a pair's windows are computed, not joined.
    """
    lo, hi = F.least("pos1", "pos2"), F.greatest("pos1", "pos2")
    tables = Tables(pairs.sparkSession, "windows")
    ends = broadcast_if_small(tables.cut(pairs.groupBy("chr").agg(F.min(lo).alias("p0"), F.max(hi).alias("p1"))))
    p = pairs.join(ends, "chr")
    last = F.floor((F.col("p1") - F.col("window_size") - F.col("p0")) / F.col("step"))
    first_i = F.greatest(F.lit(0), F.floor((hi - F.col("window_size") - F.col("p0")) / F.col("step")) + 1)
    last_i = F.least(last, F.floor((lo - F.col("p0")) / F.col("step")))
    p = p.withColumn("i0", first_i).withColumn("i1", last_i).where("i0 <= i1").withColumn("win", F.explode(F.sequence("i0", "i1")))
    p = p.withColumn("start", F.col("p0") + F.col("win") * F.col("step")).withColumn("end", F.col("start") + F.col("window_size"))
    p = p.where((lo >= F.col("start")) & (hi < F.col("end")))
    counts = tables.cut(p.groupBy("chr", "win").agg(F.count(F.lit(1)).alias("n_pairs")).where(F.col("n_pairs") > min_pairs))
    return p.join(broadcast_if_small(counts), ["chr", "win"]).select("chr", "win", "start", "end", "pos1", "pos2", "d", "r2", "n_pairs")


def strata(pairs: DataFrame, q: float = 0.95, max_pairs: int = 5000, n_strata: int = 20, min_rows: int = 100, min_strata: int = 10) -> DataFrame:
    """``chr, win, stratum, d_mid, r2_q, n``: per window and log-distance stratum the geometric mean distance and the q-quantile of r2, each stratum
    capped at ``floor(min(N, max_pairs) / n_strata)`` pairs by hash rank; windows left with too few pairs or strata fall out."""
    tables = Tables(pairs.sparkSession, "strata")
    by_window = tables.cut(pairs.groupBy("chr", "win").agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.floor(F.least(F.count(F.lit(1)), F.lit(max_pairs)) / n_strata).alias("cap")))
    p = pairs.join(broadcast_if_small(by_window), ["chr", "win"]).withColumn("stratum", log_stratum(F.col("d").cast("double"), F.col("d0").cast("double"), F.col("d1").cast("double"), n_strata))
    p = tables.cut(p.select("chr", "win", "stratum", "cap", "pos1", "pos2", "d", "r2", pair_hash(F.col("pos1"), F.col("pos2")).alias("hash")))
    # only hashes that can be among the first cap of their stratum are ranked: those up to a quantile with room to spare, or all where that leaves too few
    sizes = p.groupBy("chr", "win", "stratum").agg(F.count(F.lit(1)).alias("all_"), F.max("cap").alias("cap_"))
    bound = F.when(F.col("all_") > 2 * F.col("cap_"), (F.col("cap_") + 8 * F.sqrt("cap_") + 64) / F.col("all_") * float(2**32)).otherwise(float(2**32))
    sizes = broadcast_if_small(tables.cut(sizes.select("chr", "win", "stratum", bound.alias("bound_"))))
    near = p.join(sizes, ["chr", "win", "stratum"]).groupBy("chr", "win", "stratum").agg(F.max("bound_").alias("bound_"), F.count_if(F.col("hash") < F.col("bound_")).alias("below_"))
    first = p.join(broadcast_if_small(tables.cut(near)), ["chr", "win", "stratum"]).where("hash < bound_ OR below_ < cap")
    kept = ranked(first.drop("bound_", "below_"), ["chr", "win", "stratum"], "hash", ["pos1", "pos2"], "rank").where("rank < cap")
    s = kept.groupBy("chr", "win", "stratum").agg(F.exp(F.avg(F.log("d"))).alias("d_mid"), F.percentile("r2", q).alias("r2_q"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("chr", "win")
    return s.withColumns({"rows_": F.sum("n").over(w), "strata_": F.count(F.lit(1)).over(w)}).where((F.col("rows_") >= min_rows) & (F.col("strata_") >= min_strata)).drop("rows_", "strata_")


def rate_grid(low: float = 1e-8, high: float = 1e2, points: int = 241) -> list[float]:
    return [float(f"{x:.12g}") for x in np.exp(np.linspace(np.log(low), np.log(high), points))]


def fit_curves(strata_: DataFrame, b: float | None = None, grid: list[float] | None = None, steps: int = 40) -> DataFrame:
    """``chr, win, a, b, c, sse``: the curve b + (c - b) / (1 + a d) with weights sqrt(n), c within b..1, of least weighted error.

    For a given a the best c has a closed form. The best point of a log grid (the smaller a of equals) is refined by halving the interval between its neighbours ``steps``
    times towards the zero of the error's slope, where c is above b. A window's strata (at most ``n_strata`` of them) meet in one row, so all fits are column expressions.
    ``b``: one background level, or null to take column ``b`` of the strata.
    """
    s = strata_ if b is None else strata_.withColumn("b", F.lit(float(b)))
    points = [float(x) for x in grid or rate_grid()]
    x = F.struct(F.col("d_mid").alias("d"), F.col("r2_q").alias("r"), F.sqrt(F.col("n").cast("double")).alias("w"))
    rows = s.groupBy("chr", "win", "b").agg(F.sort_array(F.collect_list(x)).alias("s"))

    def sums(a: Column) -> Column:
        """Over a window's strata: c's closed form (gz, gg), the error (zz) and its slope in a (dz, dg)."""
        g = lambda e: 1 / (1 + a * e["d"])
        z = lambda e: e["r"] - F.col("b") * (1 - g(e))
        terms = {"gz": lambda e: e["w"] * g(e) * z(e), "gg": lambda e: e["w"] * g(e) * g(e), "zz": lambda e: e["w"] * z(e) * z(e), "dz": lambda e: e["w"] * e["d"] * g(e) * g(e) * z(e), "dg": lambda e: e["w"] * e["d"] * g(e) * g(e) * g(e)}
        return F.aggregate("s", F.struct(*[F.lit(0.0).alias(k) for k in terms]), lambda acc, e: F.struct(*[(acc[k] + f(e)).alias(k) for k, f in terms.items()]))

    best_c = lambda t: F.greatest(F.col("b"), F.least(F.lit(1.0), t["gz"] / t["gg"]))
    error = lambda t, c: t["zz"] - 2 * c * t["gz"] + c * c * t["gg"]
    all_ = F.array(*[F.lit(p) for p in points])
    tried = F.transform(F.transform(all_, lambda a: F.struct(a.alias("a"), sums(a).alias("t"))), lambda y: F.struct(F.round(error(y["t"], best_c(y["t"])), 12).alias("sse"), y["a"].alias("a"), best_c(y["t"]).alias("c")))
    rows = rows.withColumn("m", F.array_min(tried))
    near = F.array_position(all_, F.col("m.a")).cast("int")
    rows = rows.withColumns({"lo": F.element_at(all_, F.greatest(F.lit(1), near - 1)), "hi": F.element_at(all_, F.least(F.lit(len(points)), near + 1))})
    # slope of the error: negative left of the optimum
    up = lambda t: t["dz"] - best_c(t) * t["dg"] > 0

    def halve(at: Column, _: Column) -> Column:
        mid = F.sqrt(at["lo"] * at["hi"])
        return F.transform(F.array(sums(mid)), lambda t: F.struct(F.when(up(t), at["lo"]).otherwise(mid).alias("lo"), F.when(up(t), mid).otherwise(at["hi"]).alias("hi")))[0]

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct("lo", "hi"), halve)
    rows = rows.withColumn("e", F.when(F.col("m.c") > F.col("b"), ends)).withColumn("a", F.coalesce(F.sqrt(F.col("e.lo") * F.col("e.hi")), F.col("m.a")))
    rows = rows.withColumn("t", sums(F.col("a"))).withColumn("c", best_c(F.col("t")))
    return rows.select("chr", "win", "a", "b", "c", F.round(error(F.col("t"), F.col("c")), 12).alias("sse"))


def with_regime(fits: DataFrame, weak: float = 0.05) -> DataFrame:
    contrast = F.col("c") - F.col("b")
    return fits.withColumn("contrast", contrast).withColumn("regime", F.when(contrast < weak, "weak").otherwise("structured"))


def summarize(fits: DataFrame, prob: float = 0.95, min_valid: int = 5, min_kept: int = 3) -> DataFrame:
    """``chr, a, b, c, n_used``: medians over the chromosome's fits with a in the central ``prob`` of its values; n_used counts fits before that trimming.
    Chromosomes with too few fits have no row."""
    valid = fits.where("chr IS NOT NULL AND a IS NOT NULL AND a > 0 AND c IS NOT NULL").where(~F.isnan("a") & ~F.isnan("c"))
    tail = round((1 - prob) / 2, 12)  # 0.025, not the double above it, which would leave out a value that is itself the quantile
    limits = valid.groupBy("chr").agg(F.percentile("a", tail).alias("lo"), F.percentile("a", 1 - tail).alias("hi"), F.count(F.lit(1)).alias("n_used")).where(F.col("n_used") >= min_valid)
    kept = valid.join(broadcast_if_small(limits), "chr").where("a BETWEEN lo AND hi")
    out = kept.groupBy("chr").agg(F.percentile("a", 0.5).alias("a"), F.min("b").alias("b"), F.percentile("c", 0.5).alias("c"), F.max("n_used").alias("n_used"), F.count(F.lit(1)).alias("kept"))
    return out.where(F.col("kept") >= min_kept).drop("kept")


def huber_line(x: np.ndarray, y: np.ndarray, k: float = 1.345, rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope of a robust line: reweighted least squares with Huber weights and the MAD scale."""
    w = np.ones(len(x))
    beta = np.zeros(2)
    for _ in range(rounds):
        mx, my = np.average(x, weights=w), np.average(y, weights=w)
        slope = np.sum(w * (x - mx) * (y - my)) / max(np.sum(w * (x - mx) ** 2), 1e-300)
        new = np.array([my - slope * mx, slope])
        r = y - new[0] - new[1] * x
        scale = np.median(np.abs(r)) / 0.6745
        if scale < 1e-12 or np.allclose(new, beta, rtol=1e-10, atol=1e-12):
            return float(new[0]), float(new[1])
        beta, w = new, np.minimum(1.0, k * scale / np.maximum(np.abs(r), 1e-300))
    return float(beta[0]), float(beta[1])


@dataclass
class SizeModel:
    intercept: float | None
    slope: float | None


def size_model(summary: DataFrame, max_chromosomes: int = 100_000) -> tuple[DataFrame, SizeModel]:
    """``summary`` (chr, a, c, chr_size, ...) with ``a_pred`` and ``c_pred``, and the model behind it: log a on log size, robust; with fewer than three
    different sizes the median of a. One row a chromosome comes to the driver, at most ``max_chromosomes``."""
    rows = summary.select("chr_size", "a", "c").where("a > 0 AND chr_size > 0").limit(max_chromosomes + 1).toPandas()
    if len(rows) > max_chromosomes:
        raise ValueError("too many chromosomes for the size model")
    c = float(rows["c"].median()) if len(rows) else None
    if rows["chr_size"].nunique() < 3:
        a = F.lit(float(rows["a"].median()) if len(rows) else None).cast("double")
        return summary.withColumns({"a_pred": a, "c_pred": F.lit(c).cast("double")}), SizeModel(None, None)
    i, s = huber_line(np.log(rows["chr_size"].to_numpy(dtype=float)), np.log(rows["a"].to_numpy(dtype=float)))
    return summary.withColumns({"a_pred": F.exp(F.lit(i) + F.lit(s) * F.log("chr_size")), "c_pred": F.lit(c).cast("double")}), SizeModel(i, s)


def slide_targets(summary: DataFrame, rhos: list[float]) -> DataFrame:
    """``summary`` rows by rho (those within 0..1, once each): ``rho, slide_bp, slide_snp`` that reach it with ``a_pred`` and ``bp_per_snp``."""
    good = sorted({float(r) for r in rhos if r is not None and 0 < r < 1})
    long = summary.withColumn("rho", F.explode(F.array(*[F.lit(r) for r in good])))
    return long.withColumn("slide_bp", d_from_rho(F.col("a_pred"), F.col("rho"))).withColumn("slide_snp", F.try_divide("slide_bp", "bp_per_snp"))


def recommendation(targets: DataFrame) -> DataFrame:
    """Per rho the median, 90 % and largest slide in markers and base pairs."""
    return targets.where("slide_snp IS NOT NULL").groupBy("rho").agg(*[f.alias(f"{c}_{n}") for c in ("slide_snp", "slide_bp") for n, f in (("median", F.percentile(c, 0.5)), ("p90", F.percentile(c, 0.9)), ("max", F.max(c)))])


def reached_rho(summary: DataFrame) -> DataFrame:
    """What share of the decay the slide in use reaches, by the fitted and the predicted rate."""
    at = lambda a: F.try_divide(F.col(a) * F.col("slide_bp"), 1 + F.col(a) * F.col("slide_bp"))
    return summary.withColumns({"rho_slide_raw": at("a"), "rho_slide_pred": at("a_pred")})


def curve_points(params: DataFrame, points: int = 200) -> DataFrame:
    """``chr, d, r2``: each chromosome's curve at ``points`` distances from 0 to ``window_size``."""
    at = params.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("d", F.col("window_size") * F.col("k") / (points - 1))
    return at.select("chr", "k", "d", decayed(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("r2"))


@dataclass
class LDDecay:
    """The result of the whole decay analysis; DataFrames stay lazy."""

    edges: DataFrame | None
    windows: DataFrame
    fits: DataFrame
    summary: DataFrame
    targets: DataFrame
    recommendation: DataFrame
    model: SizeModel
    b: float
    params: dict

    def __repr__(self) -> str:
        p = self.params
        return f"LDDecay(b={self.b:.4g}, q={p['q']}, windows a chromosome={p['n_win']}, slide={p['slide']}, markers a chromosome={p['max_snps'] or 'all'}, size model slope={self.model.slope})"


def compute_decay(geno: DataFrame, q: float = 0.95, n_sub_bg: int = 5000, n_win: int = 20, overlap: float = 0.5, slide: int = 1000, method: str = "corr", max_pairs: int = 5000, n_strata: int = 20, prob_robust: float = 0.95, rho_targets: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), min_maf: float = 0.1, min_pairs: int = 100, min_strata: int = 10, max_snps: int | None = None, keep_edges: bool = True, edge_folder: str | None = None) -> LDDecay:
    """Background, edges, windows, fits, summary, size model and recommendation from genotypes, in one call.

    ``max_snps``: fit to the pairs among so many markers a chromosome, drawn by hash; edges are still those of all markers. ``edge_folder``: where the edges are stored, one
    part a chromosome, and read again, here and by later calls of other operators. ``keep_edges=False`` leaves them out of the result.
    """
    b = background_ld(geno, q, n_sub_bg, min_maf).first()["b"]
    if b is None:
        raise ValueError("no pair of markers on different chromosomes")
    edges = edge_list(geno, slide, method)
    if edge_folder is not None:
        write_edges(edges, edge_folder)
        edges = read_edges(geno.sparkSession, edge_folder)
    else:
        edges = Tables(geno.sparkSession, "edges").cut(edges)
    scale = Tables(geno.sparkSession, "scale").cut(chromosome_scale(geno.select("chr", "pos", "snp_idx").distinct(), slide, n_win, overlap))
    maf = allele_frequencies(geno).select("chr", F.col("snp_idx").alias("marker"), "maf")
    if max_snps is not None:
        maf = ranked(maf.where(F.col("maf") > min_maf).withColumn("hash", F.xxhash64("marker")), ["chr"], "hash", ["marker"], "rank").where(F.col("rank") < max_snps)
    windows = windowed(decay_pairs(edges, scale, maf.select("marker", "maf"), min_maf), min_pairs)
    fits = Tables(geno.sparkSession, "fits").cut(with_regime(fit_curves(strata(windows, q, max_pairs, n_strata, min_strata=min_strata), b)))
    summary = summarize(fits.where("regime = 'structured'"), prob_robust).join(broadcast_if_small(scale), "chr")
    summary, model = size_model(summary)
    summary = reached_rho(summary)
    targets = slide_targets(summary, list(rho_targets))
    return LDDecay(edges if keep_edges else None, windows, fits, summary, targets, recommendation(targets), model, b, {"q": q, "n_win": n_win, "overlap": overlap, "slide": slide, "method": method, "prob_robust": prob_robust, "max_snps": max_snps})


def recommend_slide(geno: DataFrame, rho: float = 0.95, first_slide: int = 200, **settings) -> int:
    """Two phases: a preliminary run with a small slide, whose recommendation at ``rho`` gives the slide (in markers) for the full one."""
    out = compute_decay(geno, slide=first_slide, rho_targets=(rho,), **settings).recommendation.first()
    if out is None:
        raise ValueError("no chromosome with a usable fit")
    return int(np.ceil(out["slide_snp_median"]))
