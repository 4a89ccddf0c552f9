"""Stage 2: clusters with strong local support are merged along the chromosome as long as their consensus genotypes stay clean."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ldmill.functions.numerics import cross_r2
from ldmill.functions.ordered import blocks_of, ranked, running_sum
from ldmill.functions.ordered import running_max as running_max_of
from ldmill.functions.scalar import d_from_rho, finite
from ldmill.operators.emlg import consensus, scores
from ldmill.operators.genmap import interpolate_cm
from ldmill.operators.graph import roots
from ldmill.session import Tables, broadcast_if_small, figure


def flag_clusters(clustered: DataFrame, ld_w: str, threshold: float, min_n_loci_flag: float = float("inf")) -> DataFrame:
    """``chr, cluster, pos_min, pos_max, n_loci, flagged`` for ``clustered (chr, cluster, marker, pos, <ld_w>)``: flagged if any member's support is above
    the threshold (null is not), or, where a size is given, the cluster has that many loci."""
    by_size = F.lit(False) if min_n_loci_flag == float("inf") else F.count(F.lit(1)) >= min_n_loci_flag
    above = (F.col(ld_w) > threshold) & ~F.isnan(ld_w)
    return clustered.groupBy("chr", "cluster").agg(F.min("pos").alias("pos_min"), F.max("pos").alias("pos_max"), F.count(F.lit(1)).alias("n_loci"), (F.coalesce(F.bool_or(above), F.lit(False)) | by_size).alias("flagged"))


def split_runs(clusters: DataFrame, gap: str = "gap", start: str = "pos_min", end: str = "pos_max", running_max: bool = False) -> DataFrame:
    """``clusters`` with ``run`` (1.. along each chromosome): a new run starts where a cluster begins more than the row's ``gap`` after the end of the one before it, or
    where either is unknown. ``running_max`` compares with the furthest end so far instead, so that a nested short cluster doesn't split a long block."""
    placed = ranked(clusters, ["chr"], start, [F.asc_nulls_last(end), "cluster"], "rk_")
    value = end
    if running_max:
        placed, value = running_max_of(placed, ["chr"], "rk_", [], end, "far_"), "far_"
    # the row before, also over the edge of a block of ranks
    near = blocks_of(placed, "rk_", 1, 0)
    last = F.lag(value).over(Window.partitionBy("chr", "block_").orderBy("rk_"))
    new = F.coalesce((F.col(start) - last > F.col(gap)), F.lit(True)).cast("int")
    near = near.withColumn("new_", new).where("own_").drop("block_", "own_")
    return running_sum(near, ["chr"], "rk_", "new_", "run").drop("rk_", "new_", "far_")


def gaps(clusters: DataFrame, params: DataFrame | None = None, rho: float | None = 0.95, distance_threshold: float | None = None, genetic_map: DataFrame | None = None, cm_threshold: float | None = None, on_missing: str = "error") -> tuple[DataFrame, str, str]:
    """``clusters`` with ``gap`` and the columns to compare: a genetic map (with its threshold) goes before a fixed distance, that before the distance at ``rho``.

    ``on_missing``: on chromosomes without parameters ``error`` raises; ``singletons`` leaves the gap null, which makes each of their clusters a run of its own."""
    if genetic_map is not None:
        if cm_threshold is None:
            raise ValueError("a genetic map needs cm_threshold")
        at = interpolate_cm(genetic_map, clusters.withColumnRenamed("pos_min", "pos")).withColumnRenamed("pos", "pos_min").withColumnRenamed("cm", "cm_min")
        at = interpolate_cm(genetic_map, at.withColumnRenamed("pos_max", "pos")).withColumnRenamed("pos", "pos_max").withColumnRenamed("cm", "cm_max")
        return at.withColumn("gap", F.lit(float(cm_threshold))), "cm_min", "cm_max"
    if distance_threshold is not None:
        return clusters.withColumn("gap", F.lit(float(distance_threshold))), "pos_min", "pos_max"
    if params is None or rho is None:
        raise ValueError("give a genetic map, a distance threshold, or decay parameters and rho")
    if on_missing not in ("error", "singletons"):
        raise ValueError(f"unknown on_missing {on_missing}")
    if on_missing == "error":
        lost = clusters.join(params.select("chr"), "chr", "left_anti").select("chr").distinct().limit(5).collect()
        if lost:
            raise ValueError(f"no decay parameters for {[r['chr'] for r in lost]}")
    return clusters.join(broadcast_if_small(params.select("chr", F.col("a_pred"))), "chr", "left").withColumn("gap", d_from_rho(F.col("a_pred"), float(rho))).drop("a_pred"), "pos_min", "pos_max"


def _corr(x: np.ndarray, y: np.ndarray) -> float:
    ok = np.isfinite(x) & np.isfinite(y)
    if ok.sum() < 2:
        return np.nan
    a, b = x[ok] - x[ok].mean(), y[ok] - y[ok].mean()
    s = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / s) if s > 1e-12 else np.nan


def clean_score(x: np.ndarray) -> float:
    return _corr(np.rint(x), x) ** 2


def merge_pair(left: np.ndarray, right: np.ndarray, w_left: float, w_right: float) -> np.ndarray:
    """Weighted mean of two consensus vectors after turning the less complete one (the right one if equal) to the other's polarity."""
    flip_left = np.isfinite(right).sum() > np.isfinite(left).sum()
    if _corr(left, right) < 0:
        left, right = (2 - left, right) if flip_left else (left, 2 - right)
    hl, hr = np.isfinite(left), np.isfinite(right)
    w = w_left * hl + w_right * hr
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(w > 0, (w_left * np.where(hl, left, 0) + w_right * np.where(hr, right, 0)) / w, np.nan)


def vectors(cons: DataFrame) -> DataFrame:
    """``cluster, inds, vals``: each cluster's consensus in the order of individuals, as one row."""
    x = cons.groupBy(F.col("cluster").cast("string").alias("cluster")).agg(F.sort_array(F.collect_list(F.struct("ind_id", F.col("value").cast("double").alias("value")))).alias("x"))
    return x.select("cluster", F.col("x.ind_id").alias("inds"), F.col("x.value").alias("vals"))


def _matrix(pdf: pd.DataFrame, inds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(pdf), len(inds)))
    for i, (who, v) in enumerate(zip(pdf["inds"], pdf["vals"], strict=True)):
        x[i] = _aligned(np.asarray(who), np.asarray(v, dtype=float), inds)
    m = np.isfinite(x).astype(float)
    return np.where(m > 0, x, 0.0), m


def _aligned(who: np.ndarray, v: np.ndarray, inds: np.ndarray) -> np.ndarray:
    out = np.full(len(inds), np.nan)
    out[np.searchsorted(inds, who)] = v
    return out


def similarities(rows: DataFrame, block: int = 256) -> DataFrame:
    """``chr, run, u, v, s``: the r2 of all pairs u < v of clusters of one run, 0 where undefined, from ``rows (chr, run, cluster, inds, vals)``.

    Clusters of a run meet in tiles of two hashed blocks of about ``block``, so a run of any length is many tasks' work."""
    tables = Tables(rows.sparkSession, "similar")
    rows = tables.cut(rows)
    blocks = tables.cut(rows.groupBy("chr", "run").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb")).where("nb > 0"))
    r = rows.join(broadcast_if_small(blocks), ["chr", "run"]).withColumn("b", F.pmod(F.xxhash64("cluster"), "nb").cast("int"))
    r = r.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({"lo": F.least("b", "k"), "hi": F.greatest("b", "k")})

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        inds = np.unique(np.concatenate([np.asarray(i) for i in pdf["inds"]]))
        x, m = _matrix(pdf, inds)
        names, b = pdf["cluster"].to_numpy(), pdf["b"].to_numpy()
        left = np.flatnonzero(b == pdf["lo"].iloc[0])
        right = np.flatnonzero(b == pdf["hi"].iloc[0])
        s = cross_r2(x[left], m[left], x[right], m[right])
        i, j = np.nonzero(names[left][:, None] < names[right][None, :]) if pdf["lo"].iloc[0] == pdf["hi"].iloc[0] else np.indices(s.shape).reshape(2, -1)
        one, two = names[left][i], names[right][j]
        first = one < two
        return pd.DataFrame({"chr": pdf["chr"].iloc[0], "run": pdf["run"].iloc[0], "u": np.where(first, one, two), "v": np.where(first, two, one), "s": s[i, j]})

    return r.groupBy("chr", "run", "lo", "hi").applyInPandas(tile, "chr string, run bigint, u string, v string, s double")


def dynamic_cut(rows: DataFrame, sims: DataFrame, threshold: float, min_r2: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Pieces of every run, ``chr, run, piece, inds, vals, score``, and their clusters, ``piece, cluster``; a piece is named by its smallest cluster.

    ``rows (chr, run, cluster, n_loci, inds, vals)``, ``sims`` of all their pairs. The average-linkage tree on 1 - r2 is walked from the leaves: a merge is taken if the two sides'
    r2 is at least ``min_r2`` and the merged consensus scores at least ``threshold``; a refused merge closes both sides, and everything above a closed side stays closed.

    Average linkage is reducible: nodes that are each other's most similar can merge in any order. So every round merges all such pairs of all runs at once, sums of
    similarities add up between merged nodes, and what is open moves up as rows; neither a run nor its tree has to fit a task. Equal similarities go by the smaller, then the larger name.
    """
    tables = Tables(rows.sparkSession, "cut")
    open_ = tables.cut(rows.select("chr", "run", F.col("cluster").alias("node"), F.col("n_loci").cast("double").alias("w"), "inds", "vals"))
    live = tables.cut(sims.select("chr", "run", F.struct(F.col("u").alias("name"), F.lit(1).cast("long").alias("n")).alias("a"), F.struct(F.col("v").alias("name"), F.lit(1).cast("long").alias("n")).alias("b"), "s"))
    clusters, done, forest = open_.select(F.col("node").alias("cluster")), [], []

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                inds = np.union1d(np.asarray(r.inds), np.asarray(r.inds2))
                left, right = _aligned(np.asarray(r.inds), np.asarray(r.vals, dtype=float), inds), _aligned(np.asarray(r.inds2), np.asarray(r.vals2, dtype=float), inds)
                merged = merge_pair(left, right, r.w, r.w2)
                ok = _corr(left, right) ** 2 >= min_r2 and clean_score(merged) >= threshold
                out.append((r.chr, r.run, r.node, r.node2, r.w + r.w2, inds, merged, bool(ok)))
            yield pd.DataFrame(out, columns=["chr", "run", "node", "node2", "w", "inds", "vals", "ok"])

    kinds = "chr string, run bigint, node string, node2 string, w double, inds array<bigint>, vals array<double>, ok boolean"
    while figure(live) and figure(open_):
        mean = F.col("s") / F.col("a.n") / F.col("b.n")
        ends = live.select("chr", "run", F.struct((-mean).alias("k"), "a", "b").alias("e")).withColumn("w", F.explode(F.array("e.a.name", "e.b.name")))
        best = ends.groupBy("chr", "run", "w").agg(F.min("e").alias("e")).groupBy("chr", "run", "e").agg(F.count(F.lit(1)).alias("c")).where("c = 2")
        pairs = tables.cut(best.select("chr", "run", F.col("e.a.name").alias("node"), F.col("e.b.name").alias("node2"), (F.col("e.a.n") + F.col("e.b.n")).alias("n")))
        taken = broadcast_if_small(pairs.select(F.explode(F.array("node", "node2")).alias("w"), F.col("node").alias("name"), "n"), within=pairs)
        # both sides open: try the merge; a side whose partner is closed closes too
        two = open_.select(*[F.col(c).alias(f"{c}2") for c in ("node", "w", "inds", "vals")])
        tried = tables.cut(broadcast_if_small(pairs.drop("n"), within=pairs).join(open_, ["chr", "run", "node"]).join(two, "node2").mapInPandas(merge, kinds))
        won = tried.where("ok")
        forest.append(won.select(F.col("node2").alias("w"), F.col("node").alias("p")))
        paired = open_.join(taken.select(F.col("w").alias("node")), "node", "left_semi")
        done.append(paired.join(broadcast_if_small(won.select(F.explode(F.array("node", "node2")).alias("node")), within=pairs), "node", "left_anti"))
        side = lambda c: live.join(taken.withColumnRenamed("w", f"{c}_"), F.col(f"{c}.name") == F.col(f"{c}_"), "left").withColumn(c, F.when(F.col(f"{c}_").isNotNull(), F.struct("name", "n")).otherwise(F.col(c))).drop(f"{c}_", "name", "n")  # noqa: B023, E731
        live_ = live
        live = side("a")
        live = side("b")
        after = tables.cut(live.where("a.name <> b.name").groupBy("chr", "run", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s")))
        tables.drop(live_)
        live = after
        rest = open_.join(taken.select(F.col("w").alias("node")), "node", "left_anti")
        open_ = tables.cut(rest.select("chr", "run", "node", "w", "inds", "vals").unionByName(won.select("chr", "run", "node", "w", "inds", "vals")))
    pieces = reduce(DataFrame.unionByName, [d.select("chr", "run", "node", "inds", "vals") for d in [*done, open_]])

    @F.pandas_udf("double")
    def score(vals: pd.Series) -> pd.Series:
        return pd.Series([clean_score(np.asarray(v, dtype=float)) for v in vals])

    pieces = tables.cut(pieces.select("chr", "run", F.col("node").alias("piece"), "inds", "vals", finite(score("vals")).alias("score")))
    if not forest:
        return pieces, clusters.select(F.col("cluster").alias("piece"), "cluster")
    up = roots(reduce(DataFrame.unionByName, forest), tables)
    return pieces, clusters.join(up, clusters["cluster"] == up["w"], "left").select(F.coalesce("p", "cluster").alias("piece"), "cluster")


@dataclass
class Stage2:
    groups: DataFrame
    emlg: DataFrame
    pruned: DataFrame
    params: dict


def pick_representative(sims: DataFrame, members: DataFrame) -> DataFrame:
    """``piece, cluster`` for ``members (piece, cluster)``: the cluster with the highest median r2 of its consensus to the others', the first of equals."""
    end = lambda c: members.select(F.col("cluster").alias(c), F.col("piece").alias(f"p{c}"))
    inside = sims.join(end("u"), "u").join(end("v"), "v").where("pu = pv")
    medians = inside.select(F.col("pu").alias("piece"), "s", F.explode(F.array("u", "v")).alias("cluster")).groupBy("piece", "cluster").agg(F.round(F.percentile("s", 0.5), 12).alias("m"))
    best = medians.groupBy("piece").agg(F.min(F.struct((-F.col("m")).alias("k"), "cluster")).alias("b")).select("piece", F.col("b.cluster").alias("best"))
    return members.groupBy("piece").agg(F.min("cluster").alias("first")).join(best, "piece", "left").select("piece", F.coalesce("best", "first").alias("cluster"))


def stage2(geno: DataFrame, clustered: DataFrame, ld_w: str, ld_w_threshold: float, params: DataFrame | None = None, rho: float | None = 0.95, score_threshold: float = 0.8, min_r2: float = 0.2, distance_threshold: float | None = None, genetic_map: DataFrame | None = None, cm_threshold: float | None = None, compute_unflagged: bool = True, min_n_loci_emlg: int = 1, min_n_loci_flag: float = float("inf")) -> Stage2:
    """Groups, consensus and pruned markers from ``geno (ind_id, marker, dosage)`` and ``clustered (marker, chr, pos, cluster, core, is_core, <ld_w>)``.

    Clusters that are not flagged pass through as ``U<cluster>``; flagged ones are cut within distance runs and come out as ``F<chr>:<run>:<first cluster>``.
    """
    flags = flag_clusters(clustered, ld_w, ld_w_threshold, min_n_loci_flag)
    flagged, start, end = gaps(flags.where("flagged"), params, rho, distance_threshold, genetic_map, cm_threshold)
    runs = split_runs(flagged, "gap", start, end)
    calls = geno.join(broadcast_if_small(clustered.select("marker", "cluster", F.struct("pos", "marker").alias("ord"))), "marker").select("cluster", "ord", "ind_id", "dosage")
    tables = Tables(geno.sparkSession, "stage2")
    cons = tables.cut(consensus(calls))
    own = tables.cut(runs.select("chr", "run", F.col("cluster").cast("string").alias("cluster"), "n_loci"))
    rows = tables.cut(vectors(cons).join(broadcast_if_small(own), "cluster").select("chr", "run", "cluster", "n_loci", "inds", "vals"))
    sims = tables.cut(similarities(rows.drop("n_loci")))
    pieces, members = dynamic_cut(rows, sims, score_threshold, min_r2)
    members = tables.cut(members)
    group = F.concat(F.lit("F"), F.concat_ws(":", "chr", F.col("run").cast("string"), "piece")).alias("group_id")
    heads = clustered.where("is_core").select(F.col("cluster").cast("string").alias("cluster"), "core")
    sizes = flags.select(F.col("cluster").cast("string").alias("cluster"), "n_loci", "flagged", "chr")
    best = pick_representative(sims, members).join(heads, "cluster").select("piece", F.col("core").alias("representative"))
    f = members.join(own.select("cluster", "n_loci"), "cluster").groupBy("piece").agg(F.sum("n_loci").alias("n_loci"))
    f = pieces.select("chr", "run", "piece", "score").join(f, "piece").join(best, "piece").select(group, "chr", "representative", "n_loci", "score", (F.col("n_loci") >= min_n_loci_emlg).alias("has_emlg"))
    quiet = sizes.where("NOT flagged")
    has = F.lit(bool(compute_unflagged)) & (F.col("n_loci") >= min_n_loci_emlg)
    u_scores = scores(cons).select(F.col("cluster").cast("string").alias("cluster"), "score")
    u = quiet.join(heads, "cluster").join(u_scores, "cluster", "left").select(F.concat(F.lit("U"), "cluster").alias("group_id"), "chr", "n_loci", F.col("core").alias("representative"), F.when(has, F.col("score")).alias("score"), has.alias("has_emlg"))
    cols = ["group_id", "chr", "representative", "n_loci", "score", "has_emlg"]
    groups = u.select(*cols).unionByName(f.select(*cols))
    u_values = cons.select(F.concat(F.lit("U"), F.col("cluster").cast("string")).alias("group_id"), "ind_id", "value")
    f_values = pieces.select(group, F.explode(F.arrays_zip("inds", "vals")).alias("x")).select("group_id", F.col("x.inds").alias("ind_id"), finite(F.col("x.vals")).alias("value"))
    emlg = u_values.unionByName(f_values).join(groups.where("has_emlg").select("group_id"), "group_id", "left_semi")
    return Stage2(groups, emlg, groups.select(F.col("representative").alias("marker"), "chr", "group_id"), {"ld_w": ld_w, "ld_w_threshold": ld_w_threshold, "min_n_loci_flag": min_n_loci_flag, "score_threshold": score_threshold, "min_r2": min_r2})
