import numpy as np
import pytest

from ldmill.llm import contamination as C
from ldmill.llm import subtitles as S

WORDS = [f"{a}{b}" for a in ("gal", "tov", "mir", "bel", "sor", "wen", "dak", "pim") for b in ("an", "ik", "os", "ur", "et", "ym", "ab", "oz")]


def passage(seed, n=20):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def srt(lines, start=1):
    return "".join(f"{i}\n00:00:{i:02d},000 --> 00:00:{i:02d},900\n{x}\n\n" for i, x in enumerate(lines, start))


def run(spark, docs, items, **settings):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS pos", "2 AS item_id", "'x' AS gram")
    i = spark.createDataFrame(items, "item_id bigint, passage string").selectExpr("*", "3 AS doc_id", "4 AS size")
    return {(r["doc_id"], r["item_id"]): r for r in C.leaks(d, i, **settings).collect()}


def test_whole_partial_short_and_near(spark):
    p, q = passage(1), passage(2)
    w = p.split()
    docs = [(1, "intro words here " + p + " and more"), (2, " ".join(["one"] + w[3:15] + ["two"])), (3, " ".join(["one"] + w[3:14] + ["two"])), (4, "gal tov bel " * 30), (5, f"well {passage(3, 5)} then")]
    got = run(spark, docs, [(10, p), (11, p), (12, q), (13, passage(3, 5))], coverage=2.0)
    assert set(got) == {(1, 10), (1, 11), (2, 10), (2, 11), (5, 13)}
    assert got[1, 10]["longest"] == 20 and got[2, 10]["longest"] == 12 and got[1, 10]["covered"] == 1.0 and got[5, 13]["n_words"] == 5


def test_dirt_does_not_matter(spark):
    p = "Der süße Bär wohnt hinter der Mühle; später fährt er, wie immer, sehr schnell — über die Straße nach Hause zurück!"
    w = p.split()
    cues = [" ".join(w[:5]), "[Tür knarrt]", "ANNA: " + " ".join(w[5:9]) + " *glas*", "- <i>" + " ".join(w[9:14]) + "</i>", "(seufzt)", "♪ leise ♪", " ".join(w[14:]).upper()]
    texts = {
        1: srt(cues), 2: srt(cues).replace("\n", "\r\n"), 3: "WEBVTT\n\n" + srt(cues).replace(",", "."), 4: "".join(f"{{{i}}}{{{i + 9}}}{c}\n" for i, c in enumerate(cues)).replace(" hinter ", "|hinter "),
        5: p.replace("ü", "u").replace("ä", "a").replace("ß", "ss"), 6: "".join(c if ord(c) < 128 else "�" for c in p), 7: p.replace("l", "I").replace("o", "0").replace("e", "c"), 8: p.replace("schnell", "schn ell").replace("wie immer", "wieimmer"),
    }
    got = run(spark, list(texts.items()), [(1, p)])
    assert {d for d, _ in got} == set(texts)
    assert all(r["longest"] == r["n_words"] for (d, _), r in got.items() if d != 8), {k: r["longest"] for k, r in got.items()}
    assert got[8, 1]["longest"] >= 19


def test_reordered_passage_is_covered_by_tiles(spark):
    w = passage(5, 30).split()
    doc = " ".join(w[20:] + ["break"] + w[10:20] + ["again"] + w[:10])
    got = run(spark, [(1, doc)], [(1, " ".join(w))])
    assert got[1, 1]["covered"] == 1.0 and got[1, 1]["n_tiles"] == 3 and got[1, 1]["longest"] == 10


def test_tiles_by_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a, b = rng.integers(0, 3, 25), rng.integers(0, 3, 25)
        least = 3

        def longest(free_a, free_b, a=a, b=b):
            out = []
            for i in range(25):
                for j in range(25):
                    n = 0
                    while i + n < 25 and j + n < 25 and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                        n += 1
                    if n >= least:
                        out.append((-n, i, j))
            return min(out, default=None)

        fa, fb, want = [True] * 25, [True] * 25, []
        while (m := longest(fa, fb)) is not None:
            n, i, j = -m[0], m[1], m[2]
            fa[i : i + n], fb[j : j + n] = [False] * n, [False] * n
            want.append((i, j, n))
        matches = []
        for i in range(25):
            for j in range(25):
                if a[i] == b[j] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
                    n = 0
                    while i + n < 25 and j + n < 25 and a[i + n] == b[j + n]:
                        n += 1
                    if n >= least:
                        matches.append((i, j, n))
        got = C.tiles(matches, least)
        assert sum(t[2] for t in got) == sum(t[2] for t in want) and max((t[2] for t in got), default=0) == max((t[2] for t in want), default=0)


def test_edges(spark):
    p = passage(7)
    docs = [(1, None), (2, ""), (3, "♪♪"), (None, p), (4, p), (4, p), (5, " ".join(passage(100 + i, 2000) for i in range(50)) + " " + p)]
    got = run(spark, docs, [(1, p), (2, None), (3, ""), (None, p), (4, "—")], coverage=2.0)
    assert set(got) == {(4, 1), (5, 1)}
    assert run(spark, docs[:0], [(1, p)]) == {} and run(spark, docs, []) == {}


def test_several_blocks_give_the_same(spark, monkeypatch):
    items = [(i, passage(i)) for i in range(12)]
    docs = [(i, f"before {passage(i % 12)} after") for i in range(30)]
    one = set(run(spark, docs, items))
    monkeypatch.setattr(C, "BLOCK_CHARS", 400)
    assert set(run(spark, docs, items)) == one == {(i, i % 12) for i in range(30)}


def test_many_passages_and_a_long_text(spark, monkeypatch):
    items = [(i, passage(i // 2)) for i in range(6000)]  # every passage twice
    long = " ".join(passage(50_000 + i) for i in range(900)) + " " + passage(7) + " " + passage(2999)
    assert len(long) > 100_000
    docs = [(i, f"before {passage(i * 29)} after") for i in range(100)] + [(1000, long)]
    want = {(i, 2 * i * 29 + k) for i in range(100) for k in (0, 1)} | {(1000, 14 + k) for k in (0, 1)} | {(1000, 5998 + k) for k in (0, 1)}
    monkeypatch.setattr(C, "BLOCK_CHARS", 100_000)  # four blocks
    assert set(run(spark, docs, items, coverage=2.0)) == want


@pytest.mark.parametrize("k", [1, 3, 8])
def test_running_hashes(k):
    w = S.words_of(["aa bb cc aa bb cc dd", "", "bb cc"])
    g, start = S.grams(S.mixed(w.raw), w.text, k)
    words = [("a", "b", "c", "a", "b", "c", "d"), ("b", "c")]
    flat = [tuple(t[i : i + k]) for t in words for i in range(len(t) - k + 1)]
    assert len(g) == len(flat)
    assert all((g[i] == g[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
