"""Filling missing values and figures per key, with their edge cases."""

from pyspark.sql import functions as F

from ldmill.operators.fill_missing import fill_missing
from ldmill.operators.heavy_keys import heavy_keys, key_figures

SCHEMA = "id int, g string, run int, x int, name string, x_level string"


def fill(df, **settings):
    usable = {"x": F.col("x") >= 0, "name": F.col("name") != "?"}
    return fill_missing(df, usable, {"x": [["g"], ["run"], []], "name": [["g"]]}, {"x": "median", "name": "mode"}, **settings)


def test_fill_backs_off_and_flags(spark):
    rows = [(1, "a", 1, 4, "m", None), (2, "a", 1, 6, "m", None), (3, "a", 2, -9, "?", None), (4, "b", 1, None, "n", None), (5, None, 3, -1, None, None)]
    got = {r["id"]: r for r in fill(spark.createDataFrame(rows, SCHEMA), last_resort={"name": F.lit("last")}).collect()}
    assert (got[3]["x_filled"], got[3]["x_is_filled"], got[3]["x_level"]) == (4, True, 0)
    assert (got[4]["x_filled"], got[4]["x_level"]) == (4, 1)  # group b has no usable value; run 1 has
    assert (got[5]["x_filled"], got[5]["x_level"]) == (4, 2)  # no group, no run: the whole table
    assert (got[1]["x_filled"], got[1]["x_is_filled"], got[1]["x_level"]) == (4, False, None)
    assert (got[3]["name_filled"], got[3]["name_level"]) == ("m", 0)
    assert (got[5]["name_filled"], got[5]["name_level"]) == ("last", 1)


def test_fill_mode_takes_the_smallest_of_equals_and_counts_repeats(spark):
    rows = [(1, "a", 1, 1, "z", None), (2, "a", 1, 1, "y", None), (3, "a", 1, 1, None, None), (4, "b", 1, 1, "z", None), (5, "b", 1, 1, "z", None), (6, "b", 1, 1, "y", None), (7, "b", 1, 1, "?", None)]
    got = {r["id"]: r["name_filled"] for r in fill(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3] == "y" and got[7] == "z"


def test_fill_empty_all_null_and_clashing_names(spark):
    assert fill(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = fill(spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA)).first()
    assert nothing["x_filled"] is None and nothing["x_is_filled"] is False
    odd = spark.createDataFrame([(1, "a", 1, 1, "m"), (2, "a", 1, 3, "m"), (3, "a", 1, None, None)], "id int, g string, run int, x int, name string")
    odd = odd.withColumns({c: F.lit(7) for c in ("p0__", "v__", "n__", "s__", "top__")})
    assert {r["id"]: r["x_filled"] for r in fill(odd).collect()} == {1: 1, 2: 3, 3: 1}


def test_key_figures(spark):
    rows = [("a", 1, 1.0), ("a", None, float("nan")), (None, 1, 2.0), ("b", 2, None), ("a", 1, float("inf"))]
    got = {(r["field_name"], r["key_value"]): r for r in key_figures(spark.createDataFrame(rows, "k string, n int, v double"), ["k", "n"], "v").collect()}
    assert (got["k", "a"]["n_rows"], got["k", "a"]["n_value"], got["k", "a"]["sum_value"], got["k", "a"]["n_total"]) == (3, 1, 1.0, 5)
    assert got["k", None]["n_rows"] == 1 and got["n", "1"]["n_rows"] == 3 and got["n", None]["n_rows"] == 1
    assert len(got) == 6


def test_heavy_keys_edges(spark):
    empty = spark.createDataFrame([], "k string, field_name string")
    assert heavy_keys(empty, ["k"]).count() == 0
    rows = spark.createDataFrame([("a",)] * 6 + [("b",)] * 4 + [(None,)] * 10, "k string")
    assert {r["key_value"] for r in heavy_keys(rows, ["k"], 0.25).collect()} == {"a"}
    assert {r["key_value"] for r in heavy_keys(rows, ["k"], 0.2).collect()} == {"a", "b"}  # at least, nulls counted in the total
    clash = rows.withColumns({"gid": F.lit(1), "n_rows": F.lit(1), "v": F.lit("x"), "k0": F.lit(1)})
    assert heavy_keys(clash, ["k", "k0"], 0.25).count() == 2
    long = spark.createDataFrame([("x" * 200_000,)] * 3, "k string")
    assert len(heavy_keys(long, ["k"]).first()["key_value"]) == 200_000
