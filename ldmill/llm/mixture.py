"""Mixing sources to target weights (problem 7): Pfair scheduling of token blocks.

Every source's documents form one stream in a hashed order, repeated up to its cap; the stream is drawn up to the source's share of the total and
cut into blocks of equal token counts. Block j of a source of weight w is released at slot floor(j / w) and due at ceil((j + 1) / w); taking the
released block with the earliest deadline in every slot keeps each source within one block of its share at every point of the sequence.
Weights are the drawn tokens themselves, in whole numbers, so no rounding adds up. The schedule is a table of a row a block, written by tasks of a part of the
slots each: at any slot a source has at most one block released but not taken, and how many do is known, so a task can start anywhere; whichever it supposes
to be waiting, it agrees with the one schedule from the last of their deadlines on, and starts that much before its part. Documents join the schedule by
source and block. Document positions are prefix sums over hashed buckets, so a source with a third of all documents is never sorted in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice
from math import lcm

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ldmill.session import Tables, broadcast_if_small

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's public splitting pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` of every document's whole text; a null or empty text has 0 tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": n})

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text").mapInPandas(count, "doc_id string, source string, n_tokens bigint")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def source_key(c: Column | str) -> Column:
    """One spelling a source: outer blanks, case, and ``-`` or blanks for ``_`` don't matter."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def pfair(weights: dict[str, int], blocks: dict[str, int] | None = None, start: int = 0) -> Iterator[tuple[int, str, int]]:
    """``(slot, source, block)`` in order, by earliest deadline among released blocks, for positive whole weights; endless without the sources' numbers of ``blocks``.

    From a ``start`` beyond 0 the blocks with the latest deadlines are taken to be waiting there; ``settled`` says from which slot on that makes no difference."""
    total = sum(weights.values())
    due = lambda s, j: -(-(j + 1) * total // weights[s])
    has = lambda s, j: blocks is None or j < blocks[s]
    ready = sorted((due(s, start * w // total), s, start * w // total) for s, w in weights.items() if start * w % total)
    ready = ready[max(0, len(ready) - (sum(-(-start * w // total) for w in weights.values()) - start)) :]
    behind = {s for _, s, _ in ready}
    ready = [x for x in ready if has(x[1], x[2])]
    nexts = {s: -(-start * w // total) for s, w in weights.items()}
    waiting = [(j * total // weights[s], s, j) for s, j in nexts.items() if s not in behind and has(s, j)]
    heapify(waiting)
    t = start
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, s, j = heappop(waiting)
            heappush(ready, (due(s, j), s, j))
        _, s, j = heappop(ready)
        yield t, s, j
        t += 1
        if has(s, j + 1):
            heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))


def settled(weights: dict[str, int]) -> int:
    """The slots after which a schedule is the same whatever waited at its start: the last of the deadlines that could be open there.

    Of two sets of waiting blocks of one size, the block that only one of them takes next is due no later than all in which they still differ; so these never get
    later, and when the last is due both have taken them all."""
    total = sum(weights.values())
    return max((-(-total // w) for w in weights.values()), default=0) + 1


def pfair_slots(weights: dict[str, float], n: int) -> dict[str, list[int]]:
    """The slots 0..n-1 of each source; weights count as the decimal numbers they are written as."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    scale = lcm(*[w.denominator for w in exact.values()])
    slots: dict[str, list[int]] = {s: [] for s in weights}
    for t, s, _ in islice(pfair({s: int(w * scale) for s, w in exact.items()}), n):
        slots[s].append(t)
    return slots


def schedule(spark: SparkSession, budgets: dict[str, int], block: int, rows: int = 200_000) -> DataFrame:
    """``key, j, slot`` of every block of the sources with tokens to draw; the last block of a source may be a part of one.

    A task writes ``rows`` slots, or as many as it takes to settle if that is more (where a source has less than one block in ``rows``)."""
    blocks = {k: -(-n // block) for k, n in budgets.items()}
    slots, before = sum(blocks.values()), settled(budgets)
    step = max(rows, before)
    parts = -(-slots // step)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first in b["id"] * step:
                order = (x for x in pfair(budgets, blocks, max(0, int(first) - before)) if x[0] >= first)
                left = step
                while part := list(islice(order, min(left, 10_000))):
                    left -= len(part)
                    yield pd.DataFrame(part, columns=["slot", "key", "j"])[["key", "j", "slot"]]

    return spark.range(0, parts, 1, max(1, parts)).mapInPandas(run, "key string, j long, slot long")


def deviations(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, n_blocks, deviation``: how far from its share each source ever is, in blocks, just before or after one of its own; ``plan`` as of ``supplies``."""
    weights = plan.where("budget > 0").select("key", "source", "budget", F.sum("budget").over(Window.partitionBy()).alias("all"))  # one row a source
    share = lambda t: F.col("budget") * t / F.col("all")
    off = F.greatest(F.abs(F.col("j") - share(F.col("slot"))), F.abs(F.col("j") + 1 - share(F.col("slot") + 1)))
    return blocks.join(broadcast_if_small(weights), "key").groupBy("source").agg(F.count(F.lit(1)).alias("n_blocks"), F.max(off).alias("deviation"))


def supplies(counts: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """A row per target source: what it has (``n_docs, size``), its ``target_share`` and cap, and the tokens to draw: its share of ``total`` (default: all
    tokens of target sources) or all it may give, ``max_repeats`` times its size. Sources without documents stay, with nothing to draw."""
    sizes = counts.where("n_tokens > 0").groupBy(source_key("source").alias("key")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("size"))
    wanted = targets.where(F.col("source").isNotNull()).groupBy(source_key("source").alias("key")).agg(F.min("source").alias("source"), F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = wanted.join(sizes, "key", "left").na.fill(0, ["n_docs", "size"])
    goal = F.lit(total) if total else F.sum("size").over(Window.partitionBy())  # one row a source
    asked = F.coalesce("target_share", F.lit(0.0)) * goal
    return both.withColumn("total", goal.cast("long")).withColumn("budget", F.floor(F.least(asked, F.col("size") * F.coalesce("max_repeats", F.lit(1)))))


def budgets(plan: DataFrame) -> dict[str, int]:
    """The tokens to draw of every source that gives some; one row a source of the targets comes to the driver."""
    return {r["key"]: r["budget"] for r in plan.where("budget > 0").select("key", "budget").collect()}


def mix(counts: DataFrame, targets: DataFrame, total: int | None = None, block: int = 4096, seed: int = 0, bucket_docs: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """The mixture ``source, doc_id, repeat_no, n_tokens, slot, at`` (read in order of slot, then at) and the table of ``supplies`` behind it.

    ``at`` is where a document starts in its source's stream; it belongs to the block that this is in.

    ``counts`` must be a table of ``doc_id, source, n_tokens``. Documents without tokens, without a source or of a source without a target aren't drawn.
    Each source's drawn tokens differ from its budget by at most half a document; no document comes more than ``max_repeats`` times.
    Repeated rows are documents of their own; empty tables give no rows.
    """
    tables = Tables(counts.sparkSession, "mixture")
    plan = tables.cut(supplies(counts, targets, total))
    slots = broadcast_if_small(tables.cut(schedule(counts.sparkSession, budgets(plan), block)))
    live = broadcast_if_small(plan.where("budget > 0").select("key", F.col("source").alias("name"), "size", "budget", F.ceil(F.col("n_docs") / F.lit(bucket_docs)).alias("buckets")))
    hashed = counts.where("n_tokens > 0").select("doc_id", "n_tokens", source_key("source").alias("key"), F.xxhash64(F.lit(seed), "doc_id").alias("h")).join(live, "key")
    placed = hashed.withColumn("bucket", F.pmod("h", "buckets"))
    sums = placed.groupBy("key", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = broadcast_if_small(tables.cut(sums.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("key").orderBy("bucket")) - F.col("in_bucket")).drop("in_bucket")))
    inner = Window.partitionBy("key", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    start = placed.withColumn("upto", F.sum("n_tokens").over(inner)).join(before, ["key", "bucket"]).withColumn("start", F.col("before") + F.col("upto") - F.col("n_tokens"))
    passes = F.ceil(F.col("budget") / F.col("size")).cast("int")
    copies = start.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), passes))).withColumn("at", (F.col("repeat_no") - 1) * F.col("size") + F.col("start"))
    drawn = copies.where("2 * at + n_tokens <= 2 * budget").withColumn("j", F.floor(F.col("at") / F.lit(block)))
    return drawn.join(slots, ["key", "j"]).select(F.col("name").alias("source"), "doc_id", "repeat_no", "n_tokens", "slot", "at"), plan


def reached_shares(mixture: DataFrame, plan: DataFrame) -> DataFrame:
    """A row per target source: target, supply, what was drawn, how often at most, and the shares reached of the total asked for and of all that was drawn."""
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.max("repeat_no").alias("repeats"))
    both = plan.join(got, "source", "left").na.fill(0, ["drawn_tokens", "repeats"])
    whole = F.sum("drawn_tokens").over(Window.partitionBy())  # one row a source
    return both.select("source", "target_share", "max_repeats", "n_docs", F.col("size").alias("source_tokens"), F.col("total").alias("total_tokens"), "drawn_tokens", "repeats", F.try_divide("drawn_tokens", "total").alias("reached_share"), F.try_divide(F.col("drawn_tokens"), whole).alias("share_of_drawn"))
