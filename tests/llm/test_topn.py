from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ldmill.llm import topn

SCHEMA = "g string, item string, score double, flag boolean"


def by_hand(rows, n):
    out = set()
    for g in {r[0] for r in rows}:
        out |= {(r[0], r[1]) for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], not r[3], r[1].encode()))[:n]}
    return out


@pytest.mark.parametrize(("n", "bits"), [(1, 1), (3, 6), (10, 2)])
def test_against_sorting(spark, n, bits):
    rng = np.random.default_rng(4)
    flags = [True, False, None]
    rows = [("hot", f"Chr{rng.integers(9)}:{i}", float(np.round(rng.random(), 2)), flags[rng.integers(3)]) for i in range(1500)]
    rows += [(f"g{i % 40}", f"m{i}", float(rng.random()), flags[rng.integers(3)]) for i in range(300)]
    rows += [("ties", f"same-long-prefix-{i:04d}", 0.5, None) for i in range(200)] + [("tiny", f"t{i}", 1e-18 * i, False) for i in range(30)] + [("ends", "a", 0.0, None), ("ends", "b", 1.0, None)]
    got = [(r["g"], r["item"]) for r in topn.top_n(spark.createDataFrame(rows, SCHEMA), "g", "score", "flag", "item", n, bits).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(rows, n)


def test_codes_are_the_stored_doubles(spark):
    two = 2.0 ** np.arange(-1074, 1024)
    x = np.concatenate([two, -two, np.nextafter(two, 0), np.nextafter(two, np.inf), np.random.default_rng(1).normal(size=500) * 1e300, [0.0, -0.0, np.inf, -np.inf]])
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", topn.score_code(F.col("x")).alias("code")).toPandas()
    bits = np.abs(got["x"].to_numpy()).view(np.int64)
    assert (np.where(got["x"] < 0, -bits, bits) == got["code"]).all()


def test_any_score_and_repeated_rows(spark):
    rows = [("g", "a", 0.5, None)] * 4 + [("h", f"x{i}", v, None) for i, v in enumerate([1e300, -1e300, 5.0, -3.0, 1e308, -1e308, -0.0])]
    rows += [("t", "b" * 20, 0.5, True)] * 5 + [("t", "b" * 20 + "\0", 0.5, True), ("t", "b" * 20 + "a", 0.5, True), ("neg", "a", -2.0, None), ("neg", "b", -1.0, None), ("neg", "c", -1.5, None)]
    rows += [(None, "a", 1.0, None), ("g", None, 1.0, None), ("g", "n", None, None), ("g", "n", float("nan"), None)]
    got = sorted(tuple(r) for r in topn.top_n(spark.createDataFrame(rows, SCHEMA), "g", "score", "flag", "item", 2).collect())
    assert got == [("g", "a"), ("g", "a"), ("h", "x0"), ("h", "x4"), ("neg", "b"), ("neg", "c"), ("t", "b" * 20), ("t", "b" * 20)]
    six = sorted(r["item"] for r in topn.top_n(spark.createDataFrame(rows, SCHEMA).where("g = 't'"), "g", "score", "flag", "item", 6).collect())
    assert six == ["b" * 20] * 5 + ["b" * 20 + "\0"]


def test_code_point_order_and_long_names(spark):
    rows = [("g", x, 0.5, None) for x in ("z" * 30_000, "z" * 29_999, "é", "Z", "a", "\U0001f600", "￿", "zz")]
    got = {r["item"] for r in topn.top_n(spark.createDataFrame(rows, SCHEMA), "g", "score", "flag", "item", 5).collect()}
    assert got == {x[1] for x in sorted(rows, key=lambda r: r[1].encode())[:5]}


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([("g", f"i{i}", i / 10, None) for i in range(9)], SCHEMA)
    assert topn.top_n(df.limit(0), "g", "score", "flag", "item", 3).count() == 0
    odd = df.selectExpr("g AS grp", "item AS code", "score AS lo", "flag AS rest", "1 AS hi", "2 AS cutoff", "3 AS g")
    assert {r["code"] for r in topn.top_n(odd, "grp", "lo", "rest", "code", 3).collect()} == {"i6", "i7", "i8"}


def test_latest_valid(spark):
    t = [datetime(2025, 1, d) for d in (1, 2, 3)]
    rows = [("m", "g", 0.9, True, t[0]), ("m", "g", 0.2, True, t[1]), ("m", "g", float("nan"), True, t[2]), ("x", None, 0.5, True, t[0]), ("y", "g", -9.0, None, t[0]), (None, "g", 0.5, None, t[0]), ("z", "g", 0.4, None, None), ("z", "g", 0.4, None, None)]
    df = spark.createDataFrame(rows, "marker string, grp string, median_ld double, is_core boolean, loaded_at timestamp").selectExpr("*", "1 AS m", "2 AS t")
    assert {(r["marker"], r["median_ld"]) for r in topn.latest_valid(df).collect()} == {("m", 0.2), ("z", 0.4)}
    assert topn.latest_valid(df).count() == 2
