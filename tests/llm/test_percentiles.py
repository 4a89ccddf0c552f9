import math
from datetime import datetime, timedelta

import numpy as np

from ldmill.llm import percentiles as P
from ldmill.llm import queries

QS = [0.0, 0.05, 0.5, 0.95, 1.0]


def lower(values, q):
    v = sorted(values)
    return v[max(1, math.ceil(q * len(v))) - 1]


def test_multi_select_is_exact(spark):
    rng = np.random.default_rng(2)
    groups = {"big": rng.random(3000), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([7.0]), "skew": np.exp(rng.normal(size=200) * 4), "same": np.full(40, 2.5)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "grp string, v double").repartition(5)
    got = {(r["grp"], r["q"]): (r["value"], r["n"]) for r in P.percentiles(df, ["grp"], "v", QS).collect()}
    assert got == {(g, q): (lower(vs, q), len(vs)) for g, vs in groups.items() for q in QS}


def test_unusable_values_null_keys_and_empty(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", None), ("a", float("nan")), ("a", float("inf")), ("b", 2.0), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").selectExpr("*", "1 AS w", "2 AS part", "3 AS g__")
    got = {(r["k"], r["value"], r["n"]) for r in P.percentiles(df, ["k"], "v", [0.5]).collect()}
    assert got == {(None, 1.0, 2), ("b", 2.0, 1)}
    assert P.percentiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_weights(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, 1), ("a", 3.0, 4)], "k string, v double, n int")
    got = {r["q"]: r["value"] for r in P.percentiles(df, ["k"], "v", [0.5, 0.6, 0.7], weight="n").collect()}
    assert got == {0.5: 1.0, 0.6: 2.0, 0.7: 3.0}


def test_days_combine_within_the_bound(spark):
    rng = np.random.default_rng(3)
    start = datetime(2025, 1, 1)
    rows = [("a", float(rng.normal() + day), start + timedelta(days=int(day), minutes=int(m))) for day in range(4) for m in range(700)] + [("b", 1.0, None), ("b", 2.0, start)]
    df = spark.createDataFrame(rows, "k string, v double, at timestamp")
    days = P.day_summaries(df, ["k"], "v", "at", points=50)
    kept = days.groupBy("k", "day").sum("weight").collect()
    assert sorted(r["sum(weight)"] for r in kept) == [1, 1, 700, 700, 700, 700] and days.where("k = 'a'").count() <= 200
    every = np.sort([r[1] for r in rows if r[0] == "a"])
    for r in P.combined(days, ["k"], [0.1, 0.5, 0.9]).where("k = 'a'").collect():
        assert r["n"] == 2800 and abs(np.searchsorted(every, r["value"]) / 2800 - r["q"]) <= 1 / 50 + 4 / 2800


def test_sources(spark):
    el = spark.createDataFrame([("A", 0.5, None), ("A", 2.0, None), ("B", float("nan"), None), (None, 0.1, None)], "chr1 string, r2 double, computed_at timestamp")
    assert {(r["chr"], r["value"]) for r in P.unit_values(el).collect()} == {("A", 0.5), (None, 0.1)}
    ds = spark.createDataFrame([("A", None, 1.0, 2.0)], "chr string, computed_at timestamp, a double, c double")
    assert {(r["field"], r["value"]) for r in P.long_parameters(ds, ["a", "c"]).collect()} == {("a", 1.0), ("c", 2.0)}


def test_days_combine_for_every_parameter(spark, data):
    exact = {(r["chr"], r["field"], r["q"]): (r["value"], r["n"]) for r in queries.p2_percentiles_all(spark, data).collect()}
    days = {(r["chr"], r["field"], r["q"]): (r["value"], r["n"]) for r in queries.p2_combined_days(spark, data).collect()}
    assert {k[1] for k in days} == {"r2", *queries.ALL_PARAMETERS} and {"rho_slide_pred", "bp_per_snp", "slide_bp", "slide_snp"} <= {k[1] for k in days}
    assert days.keys() == exact.keys() and all(days[k][1] == exact[k][1] for k in exact)
    assert all(days[k] == exact[k] for k in exact if k[1] != "r2")  # days this small keep all their values
