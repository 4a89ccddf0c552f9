import numpy as np
import pytest

from ldmill.llm import encoding as E

WORDS = {
    "de": "über die Straße fährt ein schöner Bär und küsst früh das Mädchen möchte süße Äpfel".split(),
    "fr": "l’été déjà le garçon préfère la forêt où tu sais à cause de l’hôtel très tôt cœur".split(),
    "ru": "моя сестра снова потерял карту города поздно ночью никто здесь никогда не видел песню про кафе".split(),
    "pl": "ktoś obcy chciał zobaczyć cały mapę późną nocą księżyc źródło łódź pieśń".split(),
    "en": "the captain wanted to see some naïve map of the café before the tide comes in — fine…".split(),
}


def text(lang, seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS[lang], n))


def misread(t, true, read):
    chars = E.byte_chars(read)
    return "".join(chr(chars[b]) for b in t.encode(true, "ignore"))


@pytest.fixture(scope="module")
def model(spark):
    docs = [(i, text(lang, i)) for lang in WORDS for i in range(60)]
    docs += [(1000, misread(text("de", 900), "utf-8", "cp1252")), (1001, None), (1002, "")]
    return E.fit(spark.createDataFrame(docs, "doc_id bigint, text string"))


@pytest.mark.parametrize(("lang", "true", "read"), [("de", "utf-8", "cp1252"), ("fr", "utf-8", "mac_roman"), ("ru", "utf-8", "cp1251"), ("ru", "cp1251", "cp1252"), ("ru", "koi8-r", "cp1251"), ("de", "cp1252", "cp1251"), ("de", "cp850", "cp1252"), ("pl", "cp1250", "cp1252"), ("fr", "utf-8", "latin-1"), ("en", "utf-8", "cp437")])
def test_round_trip(model, lang, true, read):
    before = text(lang, 77).replace("’", "'").replace("œ", "oe").replace("—", "-").replace("…", ".") if true != "utf-8" else text(lang, 77)
    (after, states), = E.repair([misread(before, true, read)], model)
    assert after == before and states


def test_twice_and_partial_spans(model):
    de = text("de", 5)
    (after, states), = E.repair([misread(misread(de, "utf-8", "cp1252"), "utf-8", "cp1252")], model)
    assert after == de and "utf-8 as cp1252, twice" in states
    mixed = text("de", 6) + "\n" + misread("fährt über die Straße", "utf-8", "cp1252") + "\n" + text("de", 7)
    (after, states), = E.repair([mixed], model)
    assert "fährt über die Straße" in after and sum(states.values()) == 3


def test_clean_and_odd_but_right_text_stays(model):
    texts = [text(lang, 50 + i) for i, lang in enumerate(WORDS)] + ["São Vento, Â and Ã — that’s the riddle.", "© Name Media ® 2024 — 5 €", "Ångrim wrote “Ça va?” on the wall.", "plain ascii", "漢字かな交じり文", "😀 ok"]
    for before, (after, states) in zip(texts, E.repair(texts, model), strict=True):
        assert (after, states) == (before, {})


def test_lost_characters_are_found_but_stay(model):
    (after, states), = E.repair(["caf� au lait"], model)
    assert after == "caf� au lait" and set(states) == {"lost"}


@pytest.mark.parametrize(("true", "read"), [("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("cp1251", "cp1252")])
def test_a_third_misread_one_way(spark, true, read):
    plain = [(i, text(lang, i).replace("’", "'").replace("œ", "oe")) for k, lang in enumerate(("de", "fr", "ru", "pl")) for i in range(60 * k, 60 * k + 60)]
    langs = ("de", "fr") if true == "cp1252" else ("ru",)
    bad = [i for k, lang in enumerate(("de", "fr", "ru", "pl")) if lang in langs for i in range(60 * k, 60 * k + 60, 3)]
    docs = spark.createDataFrame([(i, misread(t, true, read) if i in bad else t) for i, t in plain], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in E.restore_documents(docs, E.fit(docs)).collect()}
    assert set(got) <= set(bad) and len(got) >= 0.95 * len(bad) and sum(got.get(i) == dict(plain)[i] for i in bad) >= 0.9 * len(bad)


def test_parts_of_a_text_are_labelled_as_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    n = 6000
    gains = rng.normal(-4, 2, (n, len(E.STATES))).astype(np.float32)
    for start in range(0, n, 150):  # stretches that some state explains, of any length, with quiet or doubtful runs between
        end = start + rng.integers(1, 148)
        gains[start:end, rng.integers(1, len(E.STATES))] += rng.uniform(2, 12)
        gains[end : start + 150, 1:] -= rng.choice([0, 12])
    gains[:, 0] = 0
    text = np.sort(rng.integers(0, 5, n))
    parts, got = E.stretches(text, gains), E.label_runs(text, gains)
    assert parts.max() > 20 and (got > 0).sum() > 300
    monkeypatch.setattr(E, "QUIET", n)
    assert (E.label_runs(text, gains) == got).all()


@pytest.mark.parametrize("chars", [100_000, 2_000_000])
def test_long_text_is_one_sequence(model, chars):
    long = " ".join(text("fr", i) for i in range(chars // 300))[:chars]
    cut = chars // 2
    garbled = long[:cut] + misread(long[cut : cut + 60_000].replace("’", "'").replace("œ", "oe"), "cp1252", "mac_roman") + long[cut + 60_000 :]
    (whole,), (states,) = E.repaired([garbled], model)
    assert whole.replace("’", "'").replace("œ", "oe") == long.replace("’", "'").replace("œ", "oe") and states


def test_operator_edges(spark, model):
    long = " ".join(text("de", i) for i in range(3500))
    assert len(long) > E.BLOCK
    rows = [(1, misread(text("de", 1), "utf-8", "cp1252")), (1, misread(text("de", 1), "utf-8", "cp1252")), (2, None), (3, ""), (4, text("ru", 1)), (None, misread(text("fr", 1), "utf-8", "cp1252")), (5, misread(long, "utf-8", "cp1252"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS states", "1 AS lang")
    got = E.restore_documents(df, model).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 1, 5]
    assert next(r["text"] for r in got if r["doc_id"] == 5) == long
    assert E.restore_documents(df.limit(0), model).count() == 0
    empty = E.fit(df.limit(0))
    assert np.isfinite(empty).all()
