"""Evaluation texts leaking into training text (problem 6): greedy string tiling over shared word seeds.

Documents and passages become running Karp-Rabin hashes of ``seed`` consecutive words (damaged encodings restored, damaged words mended). A join on
these seeds finds, for each document and item, where they share words; seeds in a row on one diagonal are one maximal match. Of these the longest is
marked, again and again, each match cut to the words still free on both sides, so that tiles don't overlap and a passage in another order is still covered.
Longest tile and share of the passage that is covered decide.

Items with one passage are one class, which documents are joined with; members come back at the end. Passages are the stated query side: their seeds and words are
made by tasks, and what fits is broadcast; more of them go in several blocks, while documents are read, restored and hashed once for all. Only matching
seeds are shuffled, by document and class, so no passage or document becomes one hot task: a pair has at most as many matches as its two texts have words.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ldmill.llm import subtitles
from ldmill.llm.encoding import repaired
from ldmill.session import Tables, broadcast_if_small, figure

BLOCK_CHARS = 20_000_000  # characters of passages held against the documents at once
MAX_WORDS = 10_000_000  # different words of all passages (three hashes each) that tasks hold; beyond it, words are mended with those of each block
TEXTS = 512  # texts that are hashed together


def item_seeds(items: list[tuple[int, str]], seed: int) -> pd.DataFrame:
    """``item_id, at, gram, size, n_words`` of the passages' seeds; a passage of fewer words than ``seed`` is one seed of its own size."""
    w = subtitles.words_of([subtitles.spoken(p) for _, p in items])
    h = subtitles.mixed(w.raw)
    n_words = np.bincount(w.text, minlength=len(items))
    first = np.cumsum(n_words) - n_words
    parts = []
    for k in sorted({seed, *(int(n) for n in n_words if 0 < n < seed)}):
        g, start = subtitles.grams(h, w.text, k)
        text = w.text[start]
        ok = n_words[text] >= seed if k == seed else n_words[text] == k
        parts.append(pd.DataFrame({"item_id": np.array([i for i, _ in items])[text[ok]], "at": start[ok] - first[text[ok]], "gram": g[ok], "size": k, "n_words": n_words[text[ok]]}))
    return pd.concat(parts, ignore_index=True)


def word_vocabulary(passages: DataFrame) -> DataFrame:
    """``kind, key, x, y`` of ``subtitles.vocabulary_rows`` over all passages, each key once."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield subtitles.vocabulary_rows([subtitles.spoken(p) for p in b["passage"]])

    rows = passages.select("passage").mapInPandas(work, "kind int, key bigint, x bigint, y bigint")
    return rows.groupBy("kind", "key").agg(F.min(F.struct("x", "y")).alias("m")).select("kind", "key", "m.x", "m.y")


def _words(part: pd.DataFrame, lp: np.ndarray | None) -> subtitles.Words:
    texts = repaired(part["text"], lp)[0] if lp is not None else part["text"]
    return subtitles.words_of([subtitles.spoken(t or "") for t in texts])


def hashed_words(docs: DataFrame, lp: np.ndarray | None) -> DataFrame:
    """``doc_id, raw, size, lost``: the words of every document's spoken text, restored, as arrays of hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(lp)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), TEXTS):
                part = b.iloc[i : i + TEXTS]
                w = _words(part, shared.value)
                cut = np.searchsorted(w.text, np.arange(1, len(part)))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "raw": np.split(w.raw.view(np.int64), cut), "size": np.split(w.size.astype(np.int32), cut), "lost": np.split(w.lost, cut)})

    return docs.mapInPandas(work, "doc_id bigint, raw array<bigint>, size array<int>, lost array<boolean>")


def matching_seeds(docs: DataFrame, seeds: pd.DataFrame, words: subtitles.Vocabulary, lp: np.ndarray | None) -> DataFrame:
    """``doc_id, pos, gram, size`` of the seeds in the documents that some passage has too; ``docs`` with texts, or as of ``hashed_words``."""
    known = {int(k): np.sort(part["gram"].unique()) for k, part in seeds.groupby("size")}
    shared, whole = docs.sparkSession.sparkContext.broadcast((known, words, lp)), "text" in docs.columns

    def read(part: pd.DataFrame) -> subtitles.Words:
        n = np.array([len(x) for x in part["raw"]], dtype=np.int64)
        flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *[np.asarray(x, dtype=kind) for x in part[c]]])
        return subtitles.Words(flat("raw", np.int64).view(np.uint64), flat("size", np.int64), np.repeat(np.arange(len(part)), n), flat("lost", bool))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, words, lp = shared.value
        for b in batches:
            for i in range(0, len(b), TEXTS):
                part = b.iloc[i : i + TEXTS]
                h, text = subtitles.mended(_words(part, lp) if whole else read(part), words)
                first = np.searchsorted(text, np.arange(len(part)))
                ids = part["doc_id"].to_numpy()
                for k, keys in known.items():
                    g, start = subtitles.grams(h, text, k)
                    hit = subtitles.among(keys, g)
                    g, start = g[hit], start[hit]
                    yield pd.DataFrame({"doc_id": ids[text[start]], "pos": start - first[text[start]], "gram": g, "size": np.full(len(g), k)})

    return docs.mapInPandas(work, "doc_id bigint, pos bigint, gram bigint, size int")


def maximal_matches(hits: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_words, pos, at, length`` from single seed hits: those in a row on one diagonal are one match."""
    diagonal = Window.partitionBy("doc_id", "item_id", "size", "diag").orderBy("pos")
    rows = hits.distinct().withColumn("diag", F.col("pos") - F.col("at"))
    rows = rows.withColumn("island", F.col("pos") - F.row_number().over(diagonal))
    runs = rows.groupBy("doc_id", "item_id", "size", "diag", "island").agg(F.max("n_words").alias("n_words"), F.min("pos").alias("pos"), F.min("at").alias("at"), (F.count(F.lit(1)) + F.col("size") - 1).alias("length"))
    return runs.select("doc_id", "item_id", "n_words", "pos", "at", "length")


def tiles(matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest match first, each later one cut to what is still free in both texts, none shorter than ``least``."""
    out: list[tuple[int, int, int]] = []
    todo = [(-n, pos, at) for pos, at, n in matches]
    heapify(todo)
    while todo:
        n, pos, at = heappop(todo)
        n = -n
        free = np.ones(n, dtype=bool)
        for p, a, m in out:
            free[max(0, p - pos) : max(0, p - pos + m)] = False
            free[max(0, a - at) : max(0, a - at + m)] = False
        if free.all():
            out.append((pos, at, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for i, j in zip(edge[::2], edge[1::2], strict=True):
            if j - i >= least:
                heappush(todo, (int(i - j), int(pos + i), int(at + i)))
    return out


def leaks(docs: DataFrame, items: DataFrame, lp: np.ndarray | None = None, seed: int = 8, coverage: float = 0.5, words: int = 12) -> DataFrame:
    """``doc_id, item_id, n_words, n_tiles, longest, covered`` for every document and item that share a tile of at least ``words`` words (or the whole
    passage if that is shorter), or tiles that cover at least ``coverage`` of the passage.

    ``lp``: the clean model of ``encoding.fit``, to restore wrong encodings first. Null, empty and wordless texts and passages share nothing; items with one passage
    all match; repeated rows count once; empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "leaks")
    usable = tables.cut(items.where("passage IS NOT NULL AND item_id IS NOT NULL").select("item_id", F.col("passage").cast("string").alias("passage")).distinct())
    classes = tables.cut(usable.groupBy("passage").agg(F.min("item_id").alias("cls")), chars=F.sum(F.length("passage")))
    blocks = -(-(figure(classes, "chars") or 0) // BLOCK_CHARS)
    nothing = spark.createDataFrame([], "doc_id bigint, item_id bigint, n_words int, n_tiles int, longest int, covered double")
    if not blocks:
        return nothing

    def seed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield item_seeds(list(zip(b["cls"], b["passage"], strict=True)), seed)

    own = F.pmod(F.xxhash64("cls"), F.lit(blocks)).alias("block")
    placed = classes.select("cls", "passage", own)
    seeds = tables.cut(classes.select("cls", "passage").mapInPandas(seed_rows, "item_id bigint, at bigint, gram bigint, size int, n_words int").withColumnRenamed("item_id", "cls").withColumn("block", F.pmod(F.xxhash64("cls"), F.lit(blocks))))
    if not figure(seeds):
        return nothing
    rows = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text")
    common = None
    if blocks > 1:
        rows = tables.cut(hashed_words(rows, lp))
        all_words = tables.cut(word_vocabulary(classes).where(F.col("kind") != subtitles.PAIR))
        common = all_words.toPandas() if figure(all_words) <= MAX_WORDS else None
    hits = None
    for b in range(blocks):  # one for any usual set of items
        mine = seeds.where(F.col("block") == b)
        keys = mine.select("gram", "size").distinct().toPandas()
        vocabulary = word_vocabulary(placed.where(F.col("block") == b)).toPandas()
        if common is not None:
            vocabulary = pd.concat([common, vocabulary[vocabulary["kind"] == subtitles.PAIR]])
        found = matching_seeds(rows, keys, subtitles.vocabulary(vocabulary), lp)
        part = found.join(broadcast_if_small(mine, within=seeds), ["gram", "size"]).select("doc_id", F.col("cls").alias("item_id"), "n_words", "size", "pos", "at")
        hits = part if hits is None else hits.unionByName(part)
    matches = maximal_matches(tables.cut(hits))
    pairs = matches.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("length").alias("longest"), F.sum("length").alias("sum"), F.sort_array(F.collect_list(F.struct("pos", "at", "length"))).alias("m"))
    enough = F.least(F.lit(words), F.col("n_words"))
    # no tiling can cover more than the sum of its matches
    pairs = pairs.where((F.col("longest") >= enough) | (F.col("sum") >= coverage * F.col("n_words")))

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, i, n, m in zip(b["doc_id"], b["item_id"], b["n_words"], b["m"], strict=True):
                t = tiles([(int(x["pos"]), int(x["at"]), int(x["length"])) for x in m], min(seed, n))
                rows.append((d, i, n, len(t), max(x[2] for x in t), sum(x[2] for x in t) / n))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words", "n_tiles", "longest", "covered"])

    out = pairs.select("doc_id", "item_id", "n_words", "m").mapInPandas(tile, "doc_id bigint, item_id bigint, n_words int, n_tiles int, longest int, covered double")
    leaked = out.where((F.col("longest") >= enough) | (F.col("covered") >= coverage)).withColumnRenamed("item_id", "cls")
    members = usable.join(broadcast_if_small(classes, within=classes), "passage").select("item_id", "cls")
    return leaked.join(broadcast_if_small(members, within=usable), "cls").select("doc_id", "item_id", "n_words", "n_tiles", "longest", "covered")
