import os
from itertools import islice

import pytest

from ldmill.llm import mixture

needs_vocabulary = pytest.mark.skipif(not os.path.exists(mixture.VOCABULARY), reason="no vocabulary file")


def test_pfair_deviation():
    weights = {"a": 0.37, "b": 0.33, "c": 0.2, "d": 0.07, "e": 0.03}
    slots = mixture.pfair_slots(weights, 100)
    assert sorted(s for v in slots.values() for s in v) == list(range(100))
    for name, w in weights.items():
        for t in range(101):
            assert abs(sum(s < t for s in slots[name]) - w * t) < 1


def test_pfair_deviation_of_any_weights():
    weights = {"a": 0.6123457, "b": 0.3, "c": 0.0776543, "d": 0.0099, "e": 0.0001}
    slots = mixture.pfair_slots(weights, 50_000)
    assert sorted(s for v in slots.values() for s in v) == list(range(50_000))
    for name, w in weights.items():
        for k, t in enumerate(slots[name]):  # the deviation is largest just before and just after a source's own slot
            assert abs(k - w * t) < 1 + 1e-6 and abs(k + 1 - w * (t + 1)) < 1 + 1e-6
    ended = list(mixture.pfair({"a": 1000, "b": 1}, {"a": 10, "b": 1}))
    assert sorted((s, j) for _, s, j in ended) == [("a", j) for j in range(10)] + [("b", 0)] and len({t for t, _, _ in ended}) == 11


def test_pfair_from_anywhere():
    weights = {"a": 61_234, "b": 30_001, "c": 7_765, "d": 991, "e": 9}
    blocks = {s: -(-w // 4) for s, w in weights.items()}
    whole = list(mixture.pfair(weights, blocks))
    assert [x[0] for x in whole] == list(range(sum(blocks.values())))
    few = {s: w for s, w in weights.items() if s != "e"}
    order, lead = list(islice(mixture.pfair(few), 20_000)), mixture.settled(few)
    assert lead < 200
    for start in [*range(1, 150), 4_999, 12_345]:
        assert list(islice(mixture.pfair(few, start=start), 500))[lead:] == order[start + lead : start + 500]


def test_schedule_in_parts(spark):
    budgets = {"a": 61_234, "b": 30_001, "c": 7_765, "d": 991}
    blocks = {s: -(-n // 3) for s, n in budgets.items()}
    want = list(mixture.pfair(budgets, blocks))
    for rows in (1000, 1_000_000):
        got = mixture.schedule(spark, budgets, 3, rows)
        assert sorted((r["slot"], r["key"], r["j"]) for r in got.collect()) == want
    plan = spark.createDataFrame([(s, s, n) for s, n in budgets.items()], "key string, source string, budget bigint")
    off = {r["source"]: r["deviation"] for r in mixture.deviations(got, plan).collect()}
    assert off.keys() == budgets.keys() and all(x < 1 for x in off.values())


def counts(spark, sizes, each=50):
    rows = [(k * 10_000 + i, s, each) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_shares_caps_and_order(spark):
    c = counts(spark, {"Big Source": 3000, "small": 60, "tiny": 4, None: 10, "other": 10})
    t = spark.createDataFrame([("big_source", 0.5, 1), ("small", 0.3, 30), ("tiny", 0.1, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed, plan = mixture.mix(c, t, total=60_000, block=500, bucket_docs=100)
    got = {r["source"]: r for r in mixture.reached_shares(mixed, plan).collect()}
    assert got["big_source"]["reached_share"] == pytest.approx(0.5, abs=0.001) and got["small"]["reached_share"] == pytest.approx(0.3, abs=0.001)
    assert got["tiny"]["drawn_tokens"] == 4 * 3 * 50 and got["tiny"]["repeats"] == 3  # capped
    assert got["absent"]["drawn_tokens"] == 0 and got["absent"]["n_docs"] == 0
    rows = mixed.collect()
    assert {r["source"] for r in rows} == {"big_source", "small", "tiny"}
    assert len({(r["doc_id"], r["repeat_no"]) for r in rows}) == len(rows)
    # at every point of the sequence each source is within a few blocks of its share of what came so far
    rows.sort(key=lambda r: (r["slot"], r["source"]))
    whole = {s: sum(r["n_tokens"] for r in rows if r["source"] == s) for s in ("big_source", "small", "tiny")}
    seen, total = dict.fromkeys(whole, 0), 0
    for r in rows:
        seen[r["source"]] += r["n_tokens"]
        total += r["n_tokens"]
        for s, n in whole.items():
            assert abs(seen[s] - total * n / sum(whole.values())) <= 3 * 500


def test_mixture_stays_within_a_block_over_many_blocks(spark):
    sizes = {"a": 8003, "b": 3993, "c": 3}  # a document is a block; c has less than 1/1000
    t = spark.createDataFrame([(s, n / 11_999, 1) for s, n in sizes.items()], "source string, target_share double, max_repeats int")
    mixed, _ = mixture.mix(counts(spark, sizes), t, block=50, bucket_docs=5000)
    order = [r["source"] for r in mixed.sort("slot", "source").collect()]
    whole, seen = {s: order.count(s) for s in sizes}, dict.fromkeys(sizes, 0)
    assert all(abs(whole[s] - n) <= 1 for s, n in sizes.items())
    for k, s in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[x] - k * whole[x] / len(order)) < 1.5 for x in sizes)


def test_empty_and_one_document(spark):
    t = spark.createDataFrame([("a", 1.0, 2), (None, 0.5, 1), ("b", None, None)], "source string, target_share double, max_repeats int")
    mixed, plan = mixture.mix(counts(spark, {}), t)
    assert mixed.count() == 0 and mixture.reached_shares(mixed, plan).count() == 2
    mixed, _ = mixture.mix(counts(spark, {"a": 1}), t)
    assert [(r["repeat_no"], r["n_tokens"]) for r in mixed.collect()] == [(1, 50)]
    zero, _ = mixture.mix(counts(spark, {"a": 3}, each=0), t)
    assert zero.count() == 0


@needs_vocabulary
def test_token_counts(spark):
    rows = [(1, "a", "Hello world"), (2, None, None), (None, "a", ""), (4, "a", "x" * 100_000), (5, "a", "привет мир " * 10)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "7 AS n_tokens", "8 AS enc")
    got = {r["doc_id"]: r["n_tokens"] for r in mixture.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == 0 and got[None] == 0 and got[4] > 1000 and got[5] > 20
