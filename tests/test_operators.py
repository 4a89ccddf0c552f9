"""Exact cases and invariants of the LD operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ldmill.functions.numerics import f_tail
from ldmill.functions.ordered import bh_adjust, blocks_of, quantiles, ranked, running_sum
from ldmill.functions.scalar import d_from_rho, ld_from_rho
from ldmill.operators import assoc, cluster, decay, emlg, genmap, genotypes, graph, ldw, outlier, pairs, plotdata, popgen, prune
from ldmill.plans import reference_queries
from ldmill.sources import tables

from brute_cut import average_linkage, dynamic_cut, pairwise_r2


def long_calls(spark, matrix, chrs=None, pos=None):
    m = len(matrix[0])
    rows = [(i, int(j), (chrs or ["A"] * m)[j], int((pos or range(m))[j]), None if v is None else float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "ind_id bigint, snp_idx bigint, chr string, pos bigint, dosage double")


# scalar functions and genetic map


def test_rho_helpers(spark):
    a, b, c = F.lit(1e-5), F.lit(0.1), F.lit(1.0)
    r = spark.range(1).select(d_from_rho(a, 0.99).alias("d99"), d_from_rho(a, 0.9).alias("d90"), ld_from_rho(b, c, 0.5).alias("l5"), ld_from_rho(b, c, 0.99).alias("l99"), d_from_rho(F.lit(0.0), 0.5).alias("none")).first()
    assert r["d99"] == pytest.approx(0.99 / (1e-5 * 0.01)) and r["d99"] > r["d90"] and 0.1 < r["l5"] < 1 and r["l99"] < r["l5"] and r["none"] is None


def test_interpolation(spark):
    m = spark.createDataFrame([("C1", 0, 0.0), ("C1", 10**6, 5.0), ("C1", 2 * 10**6, 20.0), ("C1", 3 * 10**6, 22.0), ("C2", 0, 0.0), ("C2", 10**6, 1.0), ("C3", 5, 1.0)], "chr string, pos bigint, cm double")
    points = [("C1", 0, 0.0), ("C1", 500_000, 2.5), ("C1", 10**6, 5.0), ("C2", 10**6, 1.0), ("C1", -100, 0.0), ("C1", 5 * 10**6, 22.0), ("C3", 5, None), ("C9", 5, None), (None, 1, None)]
    got = genmap.interpolate_cm(m, spark.createDataFrame([p[:2] for p in points], "chr string, pos bigint")).collect()
    assert {(r["chr"], r["pos"]): r["cm"] for r in got} == {p[:2]: p[2] for p in points}


# pairs


def test_edges_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (40, 13)).astype(object)
    x[rng.random(x.shape) < 0.1] = None
    x[:, 5] = 1  # constant
    g = long_calls(spark, x.tolist())
    for slide, block in ((4, 0), (0, 3)):
        got = {(r["snp1"], r["snp2"]): r["r2"] for r in pairs.edge_list(g, slide, block=block or 512).collect()}
        want = {}
        for i in range(13):
            for j in range(i):
                ok = [k for k in range(40) if x[k, i] is not None and x[k, j] is not None]
                a, b = np.array([x[k, i] for k in ok], float), np.array([x[k, j] for k in ok], float)
                if (slide <= 0 or i - j <= slide) and a.std() > 0 and b.std() > 0:
                    want[i, j] = np.corrcoef(a, b)[0, 1] ** 2
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_edges_across_chromosomes(spark):
    rng = np.random.default_rng(2)
    g = long_calls(spark, rng.integers(0, 3, (30, 6)).tolist(), ["A", "A", "B", "B", "B", "C"], [1, 2, 1, 2, 3, 1])
    every = pairs.edge_list(g, 0, by_chr=False, block=2)
    assert every.count() == 15 and every.where("chr1 = chr2").count() == 4 and every.where("d IS NULL").count() == 11
    assert pairs.edge_list(g, 0, by_chr=False, across_only=True, block=2).count() == 11


def test_gametic_r2(spark):
    rng = np.random.default_rng(3)
    hap = rng.random((400, 2)) < 0.4
    other = np.where(rng.random((400, 2)) < 0.9, hap, ~hap)
    g = long_calls(spark, np.column_stack([hap.sum(axis=1), other.sum(axis=1)]).tolist())
    r2 = pairs.edge_list(g, 1, "r").first()["r2"]
    assert r2 == pytest.approx(np.corrcoef(hap.ravel(), other.ravel())[0, 1] ** 2, abs=0.05)
    same = long_calls(spark, [[0, 0], [1, 1], [2, 2], [1, 1]])
    assert pairs.edge_list(same, 1, "r").first()["r2"] == pytest.approx(1.0, abs=1e-6)
    with pytest.raises(ValueError):
        pairs.edge_list(g, 1, "dprime")


def test_frequencies_and_kind(spark):
    g = long_calls(spark, [[0, 2, None], [1, 2, None], [2, 1.5, None]])
    maf = {r["snp_idx"]: r["maf"] for r in genotypes.allele_frequencies(g).collect()}
    assert maf[0] == 0.5 and maf[2] is None
    kind = {r["snp_idx"]: r["kind"] for r in genotypes.input_kind(g, ["snp_idx"]).collect()}
    assert kind == {0: "hard", 1: "dosage", 2: "hard"}
    assert genotypes.n_individuals(g).first()["n_ind"] == 3


def test_sources_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("a", "b", "A", "A", 0.5), ("c", "d", "B", "B", 0.1)], "snp1 string, snp2 string, chr1 string, chr2 string, r2 double")
    tables.write_edges(e, str(tmp_path / "el"))
    assert tables.read_edges(spark, str(tmp_path / "el"), ["B"]).select("snp1").collect()[0][0] == "c"
    g = long_calls(spark, [[0.5, 1.5, None]])
    tables.write_genotypes(g, str(tmp_path / "g"))
    assert [r["dosage"] for r in tables.read_genotypes(spark, str(tmp_path / "g"), ["A"]).orderBy("snp_idx").collect()] == [0, 2, None]


# decay


def test_grid_fit_finds_the_curve(spark):
    a, b, c = 1e-3, 0.05, 0.8
    d = np.geomspace(10, 50_000, 20)
    rows = [("A", 0, i, float(x), float(b + (c - b) / (1 + a * x)), 50) for i, x in enumerate(d)]
    fit = decay.fit_curves(spark.createDataFrame(rows, "chr string, win int, stratum int, d_mid double, r2_q double, n bigint"), b).first()
    assert fit["a"] == pytest.approx(a, rel=1e-6) and fit["c"] == pytest.approx(c, abs=1e-6)


def test_fit_is_the_weighted_optimum(spark):
    rng = np.random.default_rng(41)
    d = np.geomspace(10, 50_000, 20)
    schema, rows = "chr string, win int, stratum int, d_mid double, r2_q double, n bigint", []
    for win, (a, b, c) in enumerate([(1e-3, 0.05, 0.8), (3e-5, 0.05, 0.4), (2e-2, 0.05, 0.99), (1e-3, 0.05, 0.05)]):
        rows += [("A", win, i, float(x), float(np.clip(b + (c - b) / (1 + a * x) + rng.normal() * 0.02, 0, 1)), int(rng.integers(5, 200))) for i, x in enumerate(d)]
    for r in decay.fit_curves(spark.createDataFrame(rows, schema), 0.05).collect():
        own = np.array([x[3:] for x in rows if x[1] == r["win"]])
        g = 1 / (1 + np.exp(np.linspace(np.log(1e-8), np.log(1e2), 200_001))[:, None] * own[:, 0])
        w, z = np.sqrt(own[:, 2]), own[:, 1] - 0.05 * (1 - g)
        c = np.clip((w * g * z).sum(axis=1) / (w * g * g).sum(axis=1), 0.05, 1)
        assert r["sse"] <= (w * (z - c[:, None] * g) ** 2).sum(axis=1).min() + 1e-9


def test_windows_against_brute_force(spark):
    rng = np.random.default_rng(4)
    p = np.sort(rng.choice(10_000, 60, replace=False))
    rows = [("A", int(p[i]), int(p[j]), int(p[i] - p[j]), 0.5, 2500.0, 1250.0) for i in range(60) for j in range(i) if p[i] - p[j] < 2500]
    df = spark.createDataFrame(rows, "chr string, pos1 bigint, pos2 bigint, d bigint, r2 double, window_size double, step double")
    got = {r["win"]: r["count"] for r in decay.windowed(df, 10).groupBy("win").count().collect()}
    lo, hi = min(r[2] for r in rows), max(r[1] for r in rows)
    want = {}
    for k in range(100):
        s = lo + k * 1250.0
        if s > hi - 2500:
            break
        n = sum(1 for r in rows if r[2] >= s and r[1] < s + 2500)
        if n > 10:
            want[k] = n
    assert got == want


def test_summary_needs_enough_fits_and_trims(spark):
    rows = [("A", float(a), 0.1, 0.5) for a in (1, 2, 3, 4, 100)] + [("B", 1.0, 0.1, 0.5)] * 4 + [("C", 1.0, 0.1, None)] * 9
    got = decay.summarize(spark.createDataFrame(rows, "chr string, a double, b double, c double")).collect()
    assert len(got) == 1 and got[0]["chr"] == "A" and got[0]["a"] == 3.0 and got[0]["n_used"] == 5


def test_size_model(spark):
    sizes = [1e6, 2e6, 4e6, 8e6, 16e6, 32e6]
    rows = [(f"c{i}", s, float(1e3 / s) * (50 if i == 5 else 1), 0.6, 0.05) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "chr string, chr_size double, a double, c double, b double")
    out, model = decay.size_model(df)
    assert model.slope == pytest.approx(-1, abs=0.2)
    assert {r["chr"]: r["a_pred"] for r in out.collect()}["c0"] == pytest.approx(1e-3, rel=0.3)
    two, none = decay.size_model(df.limit(2))
    assert none.slope is None and two.select("a_pred").distinct().count() == 1


def test_whole_decay_analysis(spark, tmp_path):
    rng = np.random.default_rng(5)
    n, m = 150, 200
    cols, chrs, pos = [], [], []
    for c in ("A", "B", "C"):
        base = rng.random((n, 2, m + 8))
        hap = np.stack([(base[:, :, k : k + 8].mean(axis=2) > 0.5) for k in range(m)], axis=2).sum(axis=1)
        cols.append(hap)
        chrs += [c] * m
        pos += [k * 500 for k in range(m)]
    g = long_calls(spark, np.concatenate(cols, axis=1).tolist(), chrs, pos)
    out = decay.compute_decay(g, n_win=4, slide=60, n_sub_bg=30)
    s = out.summary.collect()
    assert s and all(r["a"] > 0 and np.isfinite(r["a_pred"]) for r in s) and 0 < out.b < 0.2 and "LDDecay" in repr(out)
    t = {r["rho"]: r["slide_snp_median"] for r in out.recommendation.collect()}
    assert t[0.5] < t[0.9] < t[0.99]
    folder = str(tmp_path / "edges")
    some = decay.compute_decay(g, n_win=4, slide=60, n_sub_bg=30, max_snps=120, edge_folder=folder, keep_edges=False)
    assert some.edges is None and some.windows.count() < out.windows.count()
    assert tables.read_edges(spark, folder).count() == out.edges.count() and tables.read_edges(spark, folder, ["A"]).select("chr1").distinct().count() == 1


def test_support_counts_both_ends_and_keeps_lonely_markers(spark):
    e = spark.createDataFrame([("b", "a", "A", "A", 0.4, 10), ("c", "a", "A", "A", 0.2, 20), ("c", "b", "A", "A", 0.8, 100)], "snp1 string, snp2 string, chr1 string, chr2 string, r2 double, d bigint")
    m = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "A"), ("z", "B")], "marker string, chr string")
    got = {(r["marker"], r["rho"]): r["ld_w"] for r in ldw.ld_support(e, m, spark.createDataFrame([("A", 0.19)], "chr string, a double"), [0.95, 0.5]).collect()}
    assert got["a", 0.95] == pytest.approx(0.3) and got["c", 0.95] == pytest.approx(0.2) and got["b", 0.95] == pytest.approx(0.4)  # 0.95 -> exactly 100, strictly less
    assert got["z", 0.95] is None and got["a", 0.5] is None
    assert ldw.wide_support(ldw.ld_support(e, m, spark.createDataFrame([("A", 0.19)], "chr string, a double"), [0.95]), [0.95]).columns == ["marker", "chr", "rho_0.95"]


# graphs and stage 1


def components_by_hand(pairs_):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs_:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "repeats"])
def test_components(spark, kind):
    rng = np.random.default_rng(6)
    e = {"random": [tuple(map(int, rng.integers(0, 200, 2))) for _ in range(120)], "chain": [(i, i + 1) for i in range(300)], "star": [(0, i) for i in range(1, 200)], "repeats": [(1, 2), (2, 1), (1, 2), (3, 3), (4, 5)]}[kind]
    got = {r["v"]: r["component"] for r in graph.connected_components(spark.createDataFrame(e, "u bigint, v bigint"), spark.createDataFrame([(1000,)], "v bigint")).collect()}
    want = components_by_hand(e) | {1000: 1000}
    assert got == want
    assert graph.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def complete_by_hand(n, sim):
    groups = {i: [i] for i in range(n)}
    while True:
        best = None
        for a in groups:
            for b in groups:
                if a < b and all((min(i, j), max(i, j)) in sim for i in groups[a] for j in groups[b]):
                    s = min(sim[min(i, j), max(i, j)] for i in groups[a] for j in groups[b])
                    if best is None or (-s, a, b) < best:
                        best = (-s, a, b)
        if best is None:
            return {frozenset(g) for g in groups.values()}
        groups[best[1]] += groups.pop(best[2])


@pytest.mark.parametrize("seed", range(4))
def test_complete_linkage(spark, seed):
    rng = np.random.default_rng(seed)
    sim = {(i, j): float(rng.random()) for i in range(24) for j in range(i + 1, 24) if rng.random() < 0.5 or i // 6 == j // 6}
    df = spark.createDataFrame([(i, j, s) for (i, j), s in sim.items()], "u bigint, v bigint, s double")
    got = {}
    for r in graph.complete_linkage(df).collect():
        got.setdefault(r["cluster"], set()).add(r["v"])
    assert all(min(g) == k for k, g in got.items())
    assert {frozenset(g) for g in got.values()} == {g for g in complete_by_hand(24, sim) if len(g) > 1 or next(iter(g)) in {x for p in sim for x in p}}


def test_stage1_invariants(spark):
    rng = np.random.default_rng(7)
    m = spark.createDataFrame([(f"m{i:02d}", "A", i) for i in range(20)] + [("x", "B", 1)], "marker string, chr string, pos bigint")
    sim = {(i, j): float(rng.random()) for i in range(20) for j in range(i) if i - j < 6}
    e = spark.createDataFrame([(f"m{i:02d}", f"m{j:02d}", "A", "A", s) for (i, j), s in sim.items()], "snp1 string, snp2 string, chr1 string, chr2 string, r2 double")
    p = spark.createDataFrame([("A", 1e-3, 0.1, 0.9), ("B", 1e-3, 0.1, 0.9)], "chr string, a double, b double, c double")
    rows = cluster.stage1(m, e, p, 0.5).collect()
    assert len(rows) == 21 and sum(r["is_core"] for r in rows) == len({r["core"] for r in rows})
    by = {}
    for r in rows:
        by.setdefault(r["core"], []).append(r)
    for members in by.values():
        assert all(r["n_loci"] == len(members) for r in members)
        assert (members[0]["median_ld"] is None) == (len(members) == 1)
        idx = [int(r["marker"][1:]) for r in members if r["marker"] != "x"]
        assert all(sim[max(i, j), min(i, j)] >= 0.5 for i in idx for j in idx if i != j)
        if len(members) == 2:
            assert [r["marker"] for r in members if r["is_core"]] == [min(r["marker"] for r in members)]
    with pytest.raises(ValueError):
        cluster.stage1(m, e, p.where("chr = 'A'"), 0.5)
    table = cluster.cluster_table(cluster.stage1(m, e, p, 0.5)).collect()
    assert sum(len(r["members"]) for r in table) == 21


# consensus


def test_polarity_consensus_and_best(spark):
    x = [[0, 2, None], [1, 1, 1], [2, 0, None], [0, 2, None], [None, 0, None]]
    g = long_calls(spark, x).select(F.lit(1).alias("cluster"), F.col("snp_idx").alias("ord"), "ind_id", "dosage")
    flips = {r["ord"]: r["flip"] for r in emlg.polarity(g).collect()}
    assert flips == {0: True, 1: False, 2: False}  # marker 1 is the most complete; marker 2 has one call only
    value = {r["ind_id"]: r["value"] for r in emlg.consensus(g).collect()}
    assert value == {0: 2.0, 1: 1.0, 2: 0.0, 3: 2.0, 4: 0.0}
    assert emlg.scores(emlg.consensus(g)).first()["score"] == pytest.approx(1.0)
    heads = spark.createDataFrame([(1, 0)], "cluster int, representative bigint")
    best = emlg.best_markers(g, emlg.consensus(g), heads)
    b = best.first()
    assert b["best_ord"] == 0 and b["flipped"] and b["best_r"] == pytest.approx(-1) and b["rep_is_best"]
    filled = emlg.fill_best(g, emlg.consensus(g), best)
    assert {r["ind_id"]: r["filled"] for r in filled.collect()}[4] == 2.0
    c = emlg.fill_counts(filled).first()
    assert c["n_obs"] + c["n_filled"] + c["n_resid_na"] == c["n_ind"] == 5
    with pytest.raises(ValueError):
        emlg.make_emlgs(g, l_min=10)
    with pytest.raises(ValueError):
        emlg.make_emlgs(g, kind="fuzzy")


def test_weighted_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0), (1, 2.0, 1.0), (1, None, 9.0), (2, None, 1.0)], "k int, v double, w double")
    assert {r["k"]: r["value"] for r in emlg.weighted_mean(df, ["k"], "v", "w").collect()} == {1: 1.25, 2: None}


# stage 2


def test_dynamic_cut_gate(spark):
    a, b = np.zeros(200), np.full(200, 2.0)
    a[0], b[1] = 1, 1
    x = np.column_stack([a, b])
    assert len(dynamic_cut(x, np.array([1, 1]), 0.8, 0.2)) == 2
    assert len(dynamic_cut(x, np.array([1, 1]), 0.8, 0.0)) == 1


def test_dynamic_cut_keeps_every_column_once_and_weighs(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 3, (100, 4)).astype(float)
    x = np.column_stack([base[:, i % 4] for i in range(12)])
    x[rng.random(x.shape) < 0.02] = np.nan
    groups = dynamic_cut(x, np.ones(12), 0.8)
    assert sorted(m for g in groups for m in g[0]) == list(range(12)) and len(groups) == 4
    assert dynamic_cut(x[:, :1], np.ones(1), 0.8)[0][0] == [0]
    got = prune.merge_pair(np.array([0.0, 2.0]), np.array([1.0, 2.0]), 100, 1)
    assert got == pytest.approx([1 / 101, 2.0])
    with pytest.raises(ValueError):
        dynamic_cut(x, np.ones(3), 0.8)


@pytest.mark.parametrize(("threshold", "min_r2", "block"), [(0.8, 0.2, 7), (0.5, 0.2, 1000), (0.9, 0.0, 7)])
def test_distributed_cut_is_the_textbook_one(spark, threshold, min_r2, block):
    rng = np.random.default_rng(21)
    rows, want = [], set()
    for run, n in ((1, 40), (2, 1), (3, 17)):
        base = rng.integers(0, 3, (90, 6)).astype(float)
        x = np.column_stack([base[:, i % 6] for i in range(n)])
        noise = rng.random(x.shape)
        x = np.where(noise < 0.08, rng.integers(0, 3, x.shape), x)
        x[noise > 0.98] = np.nan
        names = [f"c{run}_{i:02d}" for i in range(n)]
        loci = rng.integers(1, 9, n)
        rows += [("A", run, names[i], int(loci[i]), list(range(90)), [None if np.isnan(v) else float(v) for v in x[:, i]]) for i in range(n)]
        for members, values, score in dynamic_cut(x, loci, threshold, min_r2):
            want.add((min(names[m] for m in members), tuple(sorted(names[m] for m in members)), None if np.isnan(score) else round(score, 6), round(float(np.nansum(values)), 5)))
    df = spark.createDataFrame(rows, "chr string, run bigint, cluster string, n_loci int, inds array<bigint>, vals array<double>")
    sims = prune.similarities(df.drop("n_loci"), block)
    assert sims.count() == 40 * 39 // 2 + 17 * 16 // 2
    pieces, members = prune.dynamic_cut(df, sims, threshold, min_r2)
    of = {}
    for r in members.collect():
        of.setdefault(r["piece"], []).append(r["cluster"])
    got = {(r["piece"], tuple(sorted(of[r["piece"]])), None if r["score"] is None else round(r["score"], 6), round(float(np.nansum(np.array(r["vals"], dtype=float))), 5)) for r in pieces.collect()}
    assert got == want and sum(len(m) for m in of.values()) == 58


def test_average_linkage_order():
    s = np.array([[1, 0.9, 0.1], [0.9, 1, 0.3], [0.1, 0.3, 1]])
    m = average_linkage(s)
    assert m[0][:2] == (0, 1) and m[1][:2] == (3, 2) and m[1][2] == pytest.approx(0.8)
    x = np.random.default_rng(9).random((30, 5))
    assert pairwise_r2(x) == pytest.approx(np.corrcoef(x.T) ** 2)


def stage2_input(spark):
    blocks = [(1000, 3, 0.9), (1010, 3, 0.9), (5000, 3, 0.9), (2000, 2, 0.05), (3000, 6, 0.05)]
    rng = np.random.default_rng(10)
    shared = rng.integers(0, 3, 60)
    rows, clustered = [], []
    for c, (start, n, w) in enumerate(blocks):
        for k in range(n):
            name = f"c{c}_{k}"
            clustered.append((name, "A", start + k, c, f"c{c}_0", k == 0, w))
            for i in range(60):
                rows.append((i, name, int(shared[i]) if w > 0.5 else int((shared[i] + c) % 3)))
    return spark.createDataFrame(rows, "ind_id bigint, marker string, dosage int"), spark.createDataFrame(clustered, "marker string, chr string, pos bigint, cluster int, core string, is_core boolean, w double")


def test_stage2_distance_runs(spark):
    g, clustered = stage2_input(spark)
    out = prune.stage2(g, clustered, "w", 0.5, distance_threshold=100)
    groups = {r["group_id"]: r for r in out.groups.collect()}
    assert sorted(r["n_loci"] for k, r in groups.items() if k[0] == "F") == [3, 6]
    assert sorted(r["n_loci"] for k, r in groups.items() if k[0] == "U") == [2, 6]
    a = prune.stage2(g, clustered, "w", 0.5, params=spark.createDataFrame([("A", 0.19)], "chr string, a_pred double"), rho=0.95)  # exactly 100 bp
    assert {r["group_id"] for r in a.groups.collect()} == set(groups)
    sized = prune.stage2(g, clustered, "w", 0.5, distance_threshold=100, min_n_loci_flag=5).groups.collect()
    assert sum(r["group_id"][0] == "F" for r in sized) == 3
    quiet = prune.stage2(g, clustered, "w", 0.5, distance_threshold=100, compute_unflagged=False, min_n_loci_emlg=4)
    assert {r["marker"] for r in quiet.pruned.collect()} == {r["marker"] for r in out.pruned.collect()}
    assert {r["group_id"][0] for r in quiet.groups.where("has_emlg").collect()} == {"F"}
    m = spark.createDataFrame([("A", 1000, 0.0), ("A", 1012, 0.01), ("A", 5002, 0.02)], "chr string, pos bigint, cm double")
    merged = prune.stage2(g, clustered, "w", 0.5, distance_threshold=1, genetic_map=m, cm_threshold=1.0).groups.collect()
    assert [r["n_loci"] for r in merged if r["group_id"][0] == "F"] == [9]
    with pytest.raises(ValueError):
        prune.gaps(clustered, genetic_map=m)
    with pytest.raises(ValueError):
        prune.gaps(clustered)


def test_runs_keep_clusters_without_parameters(spark):
    flagged = spark.createDataFrame([("A", 1, 0, 10), ("A", 2, 50, 60), ("B", 3, 0, 10), ("B", 4, 11, 12), ("B", 5, None, None)], "chr string, cluster int, pos_min bigint, pos_max bigint")
    p = spark.createDataFrame([("A", 0.19)], "chr string, a_pred double")  # exactly 100 bp
    with pytest.raises(ValueError):
        prune.gaps(flagged, p)
    runs = prune.split_runs(*prune.gaps(flagged, p, on_missing="singletons")[:1])
    assert {(r["chr"], r["cluster"]): r["run"] for r in runs.collect()} == {("A", 1): 1, ("A", 2): 1, ("B", 3): 1, ("B", 4): 2, ("B", 5): 3}


def test_every_flagged_cluster_has_a_run(spark, data, monkeypatch):
    monkeypatch.setattr(reference_queries, "params", lambda spark, sf_dir: spark.createDataFrame([("none", 1.0)], "chr string, a double"))
    flagged = reference_queries.flag_clusters(spark, data).where("flagged").count()
    assert reference_queries.run_split_all(spark, data).count() == flagged > 0


def test_nested_cluster_in_runs(spark):
    rows = [("A", 1, 0, 1000), ("A", 2, 10, 20), ("A", 3, 900, 950), ("A", 4, None, None)]
    df = spark.createDataFrame(rows, "chr string, cluster int, pos_min bigint, pos_max bigint").withColumn("gap", F.lit(100.0))
    assert [r["run"] for r in prune.split_runs(df).orderBy("cluster").collect()] == [1, 1, 2, 3]
    assert [r["run"] for r in prune.split_runs(df, running_max=True).orderBy("cluster").collect()] == [1, 1, 1, 2]


# populations


def test_population_statistics_by_hand(spark):
    rows = [(i, "m", p, d) for i, (p, d) in enumerate([("a", 0), ("a", 0), ("a", 1), ("b", 2), ("b", 2), ("b", 1), ("b", None), (None, 2)])]
    r = popgen.population_stats(spark.createDataFrame(rows, "ind_id bigint, marker string, pop string, dosage int"), ["marker"]).first()
    g, k = np.array([0, 0, 1, 2, 2, 1.0]), np.array([0, 0, 0, 1, 1, 1])
    between = sum(3 * (g[k == i].mean() - g.mean()) ** 2 for i in (0, 1)) / ((g - g.mean()) ** 2).sum()
    assert r["r2_pop"] == pytest.approx(between) and 0 < r["fst"] < 1
    flat = spark.createDataFrame([(i, "m", "a", 1) for i in range(5)], "ind_id bigint, marker string, pop string, dosage int")
    assert popgen.population_stats(flat, ["marker"]).first()["fst"] is None


def test_ohta_variants(spark):
    rng = np.random.default_rng(11)
    rows = [(i, m, f"p{i % 3}", int(rng.integers(0, 3))) for i in range(60) for m in ("x", "y")] + [(100, "z", "p0", 0)]
    g = spark.createDataFrame(rows, "ind_id bigint, marker string, pop string, dosage int")
    pr = spark.createDataFrame([("x", "y"), ("x", "z")], "snp1 string, snp2 string")
    fast = {r["snp2"]: r for r in popgen.ohta_scan(pr, g).collect()}
    slow = {r["snp2"]: r for r in popgen.ohta_scan(pr, g, variant="original").collect()}
    assert fast["y"]["n_pops"] == 3 and fast["z"]["d2is"] is None
    assert slow["y"]["dp2st"] == pytest.approx(4 * fast["y"]["dp2st"], abs=4e-6) and slow["y"]["d2it"] == fast["y"]["d2it"]
    # total = within + between in expectation over states: D2it is at least D'2is, which uses each state's own mean
    assert fast["y"]["d2it"] >= fast["y"]["dp2is"]
    with pytest.raises(ValueError):
        popgen.prepare(g.union(g))


# association


def test_f_tail_closed_forms():
    f = np.array([0.0, 0.5, 1.0, 4.0, 30.0])
    assert f_tail(f, 2, 10) == pytest.approx((1 + 2 * f / 10) ** -5)
    assert f_tail(f, 1, 1) == pytest.approx(1 - 2 / np.pi * np.arctan(np.sqrt(f)))
    assert np.isnan(f_tail(np.array([np.nan]), 1, 5)[0])


def test_emmax_with_unrelated_individuals_is_regression(spark):
    rng = np.random.default_rng(12)
    x = rng.binomial(2, 0.3, (60, 40))
    y = x[:, 0] * 2.0 + rng.normal(size=60)
    g = long_calls(spark, x.tolist())
    model = assoc.null_model(np.arange(60), y, np.eye(60))
    got = {r["snp_idx"]: r for r in assoc.emmax(g, model).collect()}
    plain = {r["snp_idx"]: r for r in assoc.simple_association(g, spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "ind_id bigint, y double")).collect()}
    assert all(got[k]["f"] == pytest.approx(plain[k]["f"], rel=1e-6) for k in plain)
    assert max(got, key=lambda k: got[k]["f"]) == 0
    assert got[0]["p"] == pytest.approx(float(f_tail(np.array([got[0]["f"]]), 1, 58)[0]))
    k = assoc.kinship(g, np.arange(60))
    related = assoc.null_model(np.arange(60), y, k, covariate=np.ones(60))
    again = {r["snp_idx"]: r["f"] for r in assoc.emmax(g, related).collect()}
    assert max(again, key=again.get) == 0 and related.vg >= 0 and related.ve > 0
    assert assoc.emmax(g.where("snp_idx = 3"), related).count() == 1
    step = {r["snp_idx"]: r["p_corr"] for r in assoc.stepdown_p(assoc.emmax(g, related), assoc.null_statistics(g, related, 19), 19).collect()}
    assert step[0] <= 0.1 and max(step.values()) > 0.5


def test_display_order_keeps_clusters_together(spark):
    rng = np.random.default_rng(31)
    names = [f"m{i:02d}" for i in rng.permutation(30)]
    e = [(names[i], names[j], float(0.9 - 0.01 * rng.random() if i // 6 == j // 6 else 0.1 * rng.random())) for i in range(30) for j in range(i)]
    rows = plotdata.display_order(spark.createDataFrame(e + [("x", "y", 0.5)], "snp1 string, snp2 string, r2 double")).orderBy("tree", "place").collect()
    order = [r["marker"] for r in rows if r["marker"] in names]
    block = [names.index(m) // 6 for m in order]
    assert len(order) == 30 and sum(a != b for a, b in zip(block, block[1:], strict=False)) == 4 and len({r["tree"] for r in rows}) == 2


def test_kinship_by_chromosome(spark):
    rng = np.random.default_rng(32)
    x = rng.binomial(2, 0.4, (50, 30))
    chrs = ["A"] * 12 + ["B"] * 10 + ["C"] * 8
    g = long_calls(spark, x.tolist(), chrs)
    inds = np.arange(50)
    got = assoc.kinship_by_chromosome(g, inds)
    for c in "ABC":
        v = x[:, [k for k in range(30) if chrs[k] != c]].astype(float)
        v -= v.mean(axis=0)
        want = v @ v.T
        assert got[c] == pytest.approx(want / np.mean(np.diag(want)))
    y = x[:, 3] + rng.normal(size=50)
    models = assoc.null_models(inds, y, got)
    f = {r["snp_idx"]: r["f"] for r in assoc.emmax(g, models).collect()}
    alone = {r["snp_idx"]: r["f"] for r in assoc.emmax(g.where("chr = 'A'"), models["A"]).collect()}
    assert len(f) == 30 and all(f[k] == pytest.approx(alone[k]) for k in alone) and max(f, key=f.get) == 3
    nulls = assoc.null_statistics(g, models, 5)
    assert nulls.count() == 150 and nulls.where("chr = 'B'").select("snp_idx").distinct().count() == 10


@pytest.mark.parametrize("block", [None, 4])
def test_emmax_by_chromosome_is_each_under_its_own_model(spark, block):
    rng = np.random.default_rng(33)
    x = rng.binomial(2, 0.4, (50, 40)).astype(object)
    x[rng.random((50, 40)) < 0.1] = None
    x[:, 5] = 1  # constant
    chrs = ["A"] * 17 + ["B"] * 11 + [None] * 4 + [f"s{k}" for k in range(8)]
    g = long_calls(spark, x.tolist(), chrs)
    inds = np.arange(2, 50)  # two individuals have no phenotype
    y, z = rng.normal(size=48) + inds % 2, inds % 3
    got = {r["snp_idx"]: r for r in assoc.emmax_by_chromosome(g, inds, y, z, block=block).collect()}
    want = assoc.emmax(g, assoc.null_models(inds, y, assoc.kinship_by_chromosome(g, inds), z)).collect()
    assert len(got) == len(want) == 40 and got[5]["f"] is None
    for r in want:
        assert got[r["snp_idx"]]["chr"] == r["chr"] and all(got[r["snp_idx"]][c] == (None if r[c] is None else pytest.approx(r[c], rel=1e-7)) for c in ("f", "p", "r2"))


@pytest.mark.parametrize("block", [None, 4])
def test_emmax_by_chromosome_of_a_single_one_is_regression(spark, block):
    rng = np.random.default_rng(34)
    x = rng.binomial(2, 0.4, (50, 12))
    y = x[:, 1] + rng.normal(size=50)
    g = long_calls(spark, x.tolist())
    got = {r["snp_idx"]: r["f"] for r in assoc.emmax_by_chromosome(g, np.arange(50), y, block=block).collect()}
    plain = {r["snp_idx"]: r["f"] for r in assoc.simple_association(g, spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "ind_id bigint, y double")).collect()}
    assert len(got) == 12 and all(got[k] == pytest.approx(plain[k], rel=1e-6) for k in plain)
    assert assoc.emmax_by_chromosome(g.where("false"), np.arange(50), y, block=block).count() == 0


def test_emmax_by_chromosome_query_plan_does_not_grow_with_chromosomes(spark, monkeypatch):
    x = np.random.default_rng(35).binomial(2, 0.4, (30, 60))
    monkeypatch.setattr(reference_queries, "calls", lambda spark, sf_dir: long_calls(spark, x.tolist(), [f"s{k}" for k in range(60)]))
    monkeypatch.setattr(reference_queries, "phenotype", lambda spark, sf_dir: spark.createDataFrame([(i, i % 2) for i in range(30)], "ind_id bigint, y int"))
    found = reference_queries.emmax_by_chromosome(spark, "")
    assert str(found._jdf.queryExecution().optimizedPlan()).count("InPandas") < 10 and found.count() == 60


def test_reading_order(spark):
    rows = [("a", True, 0.001, 3), ("b", True, 0.001, 5), ("c", False, None, 1), ("d", False, 0.2, 2), ("e", False, 0.2, 2), ("f", False, None, 4)]
    got = {r["cluster"]: r["rank"] for r in outlier.reading_order(spark.createDataFrame(rows, "cluster string, significant boolean, emp_p double, n_sig int")).collect()}
    assert got == {"b": 1, "a": 2, "f": 3, "c": 4, "d": 5, "e": 5}


@pytest.mark.parametrize("name", ["ld_edges_default", "ld_edges_gametic"])
def test_edge_queries_reach_far_markers(spark, monkeypatch, name):
    x = np.random.default_rng(9).integers(0, 3, (50, 40))
    monkeypatch.setattr(reference_queries, "calls", lambda spark, sf_dir: long_calls(spark, x.tolist()))
    got = {(r["snp1"], r["snp2"]): r["r2"] for r in getattr(reference_queries, name)(spark, "").collect()}
    assert got.keys() == {(i, j) for i in range(40) for j in range(i)}
    if name == "ld_edges_default":
        assert all(r2 == pytest.approx(np.corrcoef(x[:, i], x[:, j])[0, 1] ** 2, abs=1e-6) for (i, j), r2 in got.items())


@pytest.fixture
def causal_pair(spark, monkeypatch):
    """Calls of 30 unlinked markers, of which M00 and M25 are the same and decide the phenotype."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (80, 30))
    x[:, 25] = x[:, 0]
    g = long_calls(spark, x.tolist()).select("ind_id", "chr", "pos", "dosage", F.format_string("M%02d", "snp_idx").alias("marker")).withColumn("snp_idx", F.col("marker"))
    y = spark.createDataFrame([(i, int(v)) for i, v in enumerate((x[:, 0] > 0) ^ (rng.random(80) < 0.05))], "ind_id bigint, y int")
    monkeypatch.setattr(reference_queries, "calls", lambda spark, sf_dir: g)
    monkeypatch.setattr(reference_queries, "phenotype", lambda spark, sf_dir: y)


def test_stepdown_query_reaches_small_p(spark, causal_pair):
    p = {r["snp_idx"]: r["p_corr"] for r in reference_queries.emmax_stepdown(spark, "").collect()}
    assert len(p) == 30 and max(p["M00"], p["M25"]) < 1 / 21
    assert all(v * 1001 == pytest.approx(round(v * 1001)) for v in p.values())


def test_permutation_query_links_far_markers_and_reaches_small_p(spark, causal_pair):
    found = [r for r in reference_queries.permutation_null(spark, "").collect() if r["significant"]]
    assert [(r["n"], r["n_sig"], r["start"], r["end"]) for r in found] == [(2, 2, 0, 25)] and found[0]["emp_p"] < 1 / 51


# ordered helpers and outliers


def bh_by_hand(p):
    p = np.asarray(p)
    m = len(p)
    o = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[o] * m / np.arange(1, m + 1))[::-1])[::-1]
    out = np.empty(m)
    out[o] = np.minimum(1, q)
    return out


def test_bh(spark):
    rng = np.random.default_rng(13)
    p = np.round(rng.random(500) ** 2, 2)
    got = {r["i"]: r["q"] for r in bh_adjust(spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(900, None), (901, float("nan"))], "i int, p double"), "p", "q").collect()}
    assert [got[i] for i in range(500)] == pytest.approx(bh_by_hand(p)) and got[900] is None and got[901] is None
    assert bh_adjust(spark.createDataFrame([], "p double"), "p", "q").count() == 0


def test_running_sum(spark):
    df = pd.DataFrame({"k": np.repeat([1, 2], 300), "o": np.tile(np.arange(300) // 2, 2), "v": 1})
    got = running_sum(spark.createDataFrame(df), ["k"], "o", "v", "s", bucket_rows=40).toPandas().sort_values(["k", "o"])
    assert (got["s"] == (got["o"] + 1) * 2).all()


@pytest.mark.parametrize("bucket_rows", [30, 1_000_000])
def test_ranks_quantiles_and_blocks(spark, bucket_rows):
    rng = np.random.default_rng(15)
    pdf = pd.DataFrame({"k": np.where(rng.random(900) < 0.5, "hot", rng.choice(["a", "b"], 900)), "v": np.round(rng.random(900), 2), "t": rng.permutation(900), "in_": 1})
    pdf.loc[:9, "k"] = None
    rows = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("t") % 50 != 0, F.col("v")))
    got = ranked(rows.drop("in_"), ["k"], "v", ["t"], bucket_rows=bucket_rows).toPandas()
    for _, g in got.groupby("k", dropna=False):
        assert (g.sort_values(["v", "t"], na_position="last")["rk"] == np.arange(len(g))).all()
    v = got["v"].dropna().to_numpy()
    qs = [0.0, 0.1, 0.5, 0.777, 0.95, 1.0]
    assert quantiles(rows, "v", qs, bucket_rows) == pytest.approx(np.quantile(v, qs)) and quantiles(rows.limit(0), "v", [0.5]) == [None]
    assert (np.sort(bh_adjust(rows.where("v IS NOT NULL"), "v", "q", bucket_rows=bucket_rows).toPandas()["q"]) == pytest.approx(np.sort(bh_by_hand(v))))
    one = spark.range(100).withColumn("rk", F.col("id"))
    w = Window.partitionBy("block_").orderBy("rk").rowsBetween(-7, 3)
    near = blocks_of(one, "rk", 7, 3, 5).withColumn("n", F.sum("rk").over(w)).where("own_").toPandas().sort_values("rk")
    assert list(near["n"]) == [sum(range(max(0, i - 7), min(99, i + 3) + 1)) for i in range(100)]


def test_rmsc(spark):
    rng = np.random.default_rng(14)
    w = rng.random(2000)
    p = np.where(rng.random(2000) < w**4 * 0.3, rng.random(2000) * 1e-4, rng.random(2000))
    rows = spark.createDataFrame([(f"m{i}", "A", i, float(p[i]), float(w[i])) for i in range(2000)], "marker string, chr string, pos bigint, pval double, ld_w double")
    got = outlier.rmsc_curve(rows, grid=[0, 0.5, 0.9]).orderBy("q").collect()
    for r in got:
        t = np.quantile(w, r["q"])
        assert r["rejections"] == (bh_by_hand(p[w >= t]) < 0.05).sum() and r["n_kept"] == (w >= t).sum()
    c = outlier.rmsc_choice(outlier.rmsc_curve(rows, grid=[0, 0.5, 0.9])).first()
    assert c["peak"] == max(r["rejections"] for r in got)


def outlier_input(spark):
    rng = np.random.default_rng(15)
    rows, e = [], []
    for c in ("A", "B"):
        for i in range(25):
            rows.append((f"{c}s{i}", c, 1000 + i, float(rng.random() * 1e-4 if c == "A" else 0.2 + 0.8 * rng.random()), 0.6 + 0.3 * float(rng.random())))
            if i:
                e.append((f"{c}s{i}", f"{c}s{i - 1}", c, c, 0.9))
        for i in range(75):
            rows.append((f"{c}b{i}", c, 5000 + i, float(rng.random()), 0.2 * float(rng.random())))
    return spark.createDataFrame(rows, "marker string, chr string, pos bigint, pval double, ld_w double"), spark.createDataFrame(e, "snp1 string, snp2 string, chr1 string, chr2 string, r2 double")


def test_outlier_clusters_flag_the_causal_block(spark):
    rows, e = outlier_input(spark)
    for null in ("background_exact", "background"):
        out = outlier.outlier_clusters(rows, e, threshold=0.75, null=null, b=200)
        sig = [r for r in out.clusters.collect() if r["significant"]]
        assert len(sig) == 1 and sig[0]["chr"] == "A" and sig[0]["n"] == 25 and sig[0]["n_sig"] == 25
        assert not out.diagnostics["all_chr_flagged"] and "OutlierClusters" in repr(out)
    calm = outlier.outlier_clusters(rows.withColumn("pval", F.lit(0.9)), e, threshold=0.75)
    assert calm.pcut is None and calm.clusters.where("significant").count() == 0
    with pytest.raises(ValueError):
        outlier.outlier_clusters(rows, e, null="guess")
    gapped = outlier.ld_clusters(outlier.candidates(rows, 0.5), e, gap=5.0)
    assert gapped.select("cluster").distinct().count() == 2


def test_background_rotations_by_hand(spark):
    hits = [1, 0, 0, 1, 1, 0, 0]
    bg = spark.createDataFrame([(f"m{i}", "A", i // 2, 0.01 if h else 0.9) for i, h in enumerate(hits)] + [("z", "B", 1, 0.5)], "marker string, chr string, pos bigint, pval double")
    shapes = [(f"c{n}_{k}", "A", n, k) for n in (1, 3, 7, 10) for k in (1, 2, 4)] + [("few", "B", 2, 1)]
    got = {r["cluster"]: r for r in outlier.background_exact(bg, spark.createDataFrame(shapes, "cluster string, chr string, n bigint, n_sig bigint"), 0.05, 100).collect()}
    for name, chrom, n, k in shapes[:-1]:
        want = np.mean([sum(hits[(s + j) % 7] for j in range(n)) >= k for s in range(7)])
        assert got[name]["frac"] == pytest.approx(want) and got[name]["emp_p"] == pytest.approx((1 + 100 * want) / 101)
    assert got["few"]["emp_p"] is None


# plot data


def test_stage_points(spark):
    m = spark.createDataFrame([("a", "A", 1, 1, 0.9), ("b", "A", 2, 1, 0.1), ("c", "A", 3, 2, 0.2)], "marker string, chr string, pos bigint, cluster int, w double")
    g = spark.createDataFrame([("F1", ["a", "b"]), ("U2", ["c"])], "group_id string, members array<string>")
    high = plotdata.stage_points(m, g, "A", "w", 0.5).collect()
    assert {(r["panel"], r["marker"], r["id"]) for r in high} == {("stage1", "a", "1"), ("stage1", "b", "1"), ("stage2", "a", "F1"), ("stage2", "b", "F1")}
    assert {r["marker"] for r in plotdata.stage_points(m, g, "A", "w", 0.5, "low").collect()} == {"c"}
    assert plotdata.stage_points(m, g, "A", "w", 2.0).count() == 0
    with pytest.warns(UserWarning):
        plotdata.stage_points(m, g, "A", "w", 0.5, result_params={"ld_w_threshold": 0.7})


def test_heatmap(spark):
    g = long_calls(spark, [[0, 2], [1, 1], [2, 0]]).select(F.lit(1).alias("cluster"), F.col("snp_idx").alias("ord"), "ind_id", "dosage")
    v = lambda df: {(r["ind_id"], r["ord"]): r["value"] for r in df.collect()}
    turned, raw = v(plotdata.heatmap_cells(g)), v(plotdata.heatmap_cells(g, polarize=False))
    assert all(turned[i, 1] == turned[i, 0] for i in range(3)) and raw[0, 1] == 2
    with pytest.raises(ValueError):
        plotdata.heatmap_cells(g, spark.createDataFrame([(0, "x")], "ind_id bigint, note string"))
    e = spark.createDataFrame([("a", "b", 0.1), ("c", "b", 0.9), ("c", "a", None)], "snp1 string, snp2 string, r2 double")
    order = [r["marker"] for r in plotdata.display_order(e).orderBy("tree", "place").collect()]
    assert sorted(order) == ["a", "b", "c"] and abs(order.index("b") - order.index("c")) == 1
