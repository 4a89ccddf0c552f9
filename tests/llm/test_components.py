import numpy as np
import pytest

from ldmill.llm import components
from ldmill.session import Tables

EL = "snp1 string, snp2 string, r2 double, computed_at timestamp"


def by_hand(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {(find(x), x) for x in list(root)}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "clique", "tree"])
def test_groups_against_union_find(spark, kind):
    rng = np.random.default_rng(1)
    e = {
        "random": [tuple(rng.integers(0, 300, 2)) for _ in range(200)],
        "chain": [(i, i + 1) for i in range(400)],
        "star": [(150, i) for i in range(300)],
        "clique": [(i, j) for i in range(25) for j in range(i)] + [(30, 31)],
        "tree": [(i, i // 2) for i in range(1, 300)],
    }[kind]
    pairs = [(f"m{a:03d}", f"m{b:03d}") for a, b in e if a != b]
    got = {(r["grp_snp"], r["snp"]) for r in components.marker_groups(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == by_hand(pairs)


def test_loops_repeats_and_empty(spark):
    t = Tables(spark, "test")
    got = components.seed_tree_components(spark.createDataFrame([(1, 1), (2, 3), (3, 2), (2, 3)], "u bigint, v bigint"), t).collect()
    assert {(r["id"], r["seed"]) for r in got} == {(2, 2), (3, 2)}
    assert components.seed_tree_components(spark.createDataFrame([], "u bigint, v bigint"), t).count() == 0
    assert components.marker_groups(spark.createDataFrame([], "a string, b string")).count() == 0


def test_linked_pairs_rules(spark):
    from datetime import datetime as d

    rows = [
        (" a ", "B", 0.9, d(2025, 1, 1)), ("b", "A", 0.1, d(2025, 1, 2)),  # corrected to below the level
        ("c", "D", 0.1, d(2025, 1, 1)), ("d", "c", 0.6, d(2025, 1, 3)), ("C", "d", 0.6, d(2025, 1, 3)),  # corrected to above, repeated
        ("e", "E ", 0.9, d(2025, 1, 1)), ("f", "g", float("nan"), d(2025, 1, 1)), ("f", "g", float("inf"), d(2025, 1, 1)), ("f", "g", -9.0, d(2025, 1, 1)), ("f", "g", None, None),
        ("h", "i", 0.5, None), ("h", "i", 0.4, d(2025, 1, 1)), (None, "k", 0.9, d(2025, 1, 1)), ("", "k", 0.9, d(2025, 1, 1)), ("l", "m", 0.5, None), ("n", "o", 0.2, d(2025, 1, 1)), ("n", "o", 0.7, d(2025, 1, 1)),
    ]
    df = spark.createDataFrame(rows, EL)
    got = {(r["a"], r["b"]) for r in components.linked_pairs(df).collect()}
    assert got == {("C", "D"), ("L", "M"), ("N", "O")}
    clash = df.selectExpr("*", "1 AS x", "2 AS y", "3 AS a", "4 AS u", "5 AS t")
    assert components.linked_pairs(clash).count() == 3
    assert components.linked_pairs(df.limit(0)).count() == 0


def test_spelling_decides_the_smallest_name(spark):
    pairs = spark.createDataFrame([("A1", "B1"), ("X" * 50_000, "B1")], "a string, b string")
    names = components.spelling(spark.createDataFrame([("a1",), ("B1",), (None,), ("B1",)], "marker string"))
    got = {(r["grp_snp"], r["snp"]) for r in components.marker_groups(pairs, names).collect()}
    assert got == {("B1", "a1"), ("B1", "B1"), ("B1", "X" * 50_000)}
