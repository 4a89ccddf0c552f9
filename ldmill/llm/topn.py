"""Top N items within every group (problem 3): simultaneous per-group bisection.

Each row gets an order-preserving code; every undecided group keeps an interval of codes that holds its N-th row. A round cuts all these
intervals at once at midpoints (2^bits - 1 of them), counts each group's rows between them (a combining count) and keeps the part with the N-th row;
rows above it belong to the first N, rows below it are dropped, so each round reads only what the last one left. A group ends when the part has exactly
the rows it still lacks. Rows equal in a whole code go on with the next one: first the score, then the flag with the first bytes of the identifier, then
seven further bytes at a time. Groups are at different codes in one round; none is ever sorted or collected, so its size does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ldmill.session import Tables, broadcast_if_small, figure

CHUNK = 7
_NAME = 1 << (8 * CHUNK + 3)


def score_code(score: Column) -> Column:
    """A 64-bit whole number in the order of any finite or infinite double: its exponent and mantissa (as stored), mirrored for negative numbers; 0 and -0 are equal.

    log2 may be off by one next to a power of two, which the mantissa shows; products with powers of two are exact."""
    x = F.abs(score)
    e = F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(x)))).cast("int")
    half = F.floor(e / 2).cast("int")
    m = x * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - e)
    e, m = F.when(m >= 2, e + 1).when((m < 1) & (e > -1022), e - 1).otherwise(e), F.when(m >= 2, m / 2).when((m < 1) & (e > -1022), m * 2).otherwise(m)
    unit = F.lit(float(2**52))
    normal = F.shiftleft((e + 1022).cast("long"), 52) + (m * unit).cast("long")
    code = F.when(x == 0, F.lit(0).cast("long")).when(x == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    return F.when(score < 0, -code).otherwise(code)


def name_code(level: Column, flag: Column, name: Column) -> Column:
    """The code of level 1, 2, ...: seven bytes of the name and how many of them there are, larger for names earlier in code-point order; at level 1 below the flag."""
    part = F.substring(name.cast("binary"), (level - 1) * CHUNK + 1, F.lit(CHUNK))
    value = F.conv(F.rpad(F.hex(part), 2 * CHUNK, "0"), 16, 10).cast("long") * 8 + F.length(part)
    return F.lit(_NAME - 1) - value + F.when((level == 1) & F.coalesce(flag, F.lit(False)), F.lit(_NAME)).otherwise(F.lit(0))


def _ended(code: Column) -> Column:
    """Whether the names behind a code of level 1 or more end within it."""
    return F.pmod(F.lit(_NAME - 1) - F.pmod(code, F.lit(_NAME)), F.lit(8)) < CHUNK


def top_n(df: DataFrame, group: str, score: str, flag: str, item: str, n: int, bits: int = 6) -> DataFrame:
    """``group, item`` of the first ``n`` rows of every group by score (any double, descending), then flag true before false or null, then item ascending in code-point order.

    Rows with a null group or item or a null or NaN score are left out. Repeated rows each count, as in a ranking by row number, so exactly ``n`` rows of a
    group come out, or all of a smaller one. An empty table gives no rows; other columns are ignored.
    """
    tables = Tables(df.sparkSession, "topn")
    value = F.col(score).cast("double")
    rows = df.select(F.col(group).alias("grp"), F.col(item).cast("string").alias("item"), F.col(flag).alias("flag"), score_code(value).alias("code")).where(F.col("grp").isNotNull() & F.col("item").isNotNull() & value.isNotNull() & ~F.isnan(value))
    live = tables.cut(rows)
    # every group's rows still to find, the level of its code and the interval of codes that holds them
    span = live.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.min("code").alias("lo"), F.max("code").alias("hi"))
    state = tables.cut(span.where(F.col("size") > n).select("grp", F.lit(n).cast("long").alias("rest"), F.lit(0).alias("level"), "lo", "hi"))
    kept = [live.join(broadcast_if_small(state.select("grp"), within=state), "grp", "left_anti").select("grp", "item")]  # groups of up to n rows
    # an interval of codes of both signs is cut at 0, which keeps differences of codes within 64 bits
    part = F.when(F.expr("lo < 0 AND hi >= 0"), F.expr("IF(code < 0, 0, 1)")).otherwise(F.expr(f"(code - lo) DIV ((hi - lo) DIV {1 << bits} + 1)")).cast("int")
    undecided, bound = figure(state), state
    while undecided:
        inside = live.join(broadcast_if_small(state, within=bound), "grp").withColumn("part", part)
        parts = inside.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("c"), F.min("code").alias("lo"), F.max("code").alias("hi"), F.max("rest").alias("rest"), F.max("level").alias("level"))
        above = F.coalesce(F.sum("c").over(Window.partitionBy("grp").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = parts.withColumn("above", above).where("above < rest AND above + c >= rest").withColumn("rest", F.col("rest") - F.col("above"))
        # how a group goes on: all rows of the part are wanted, or equal in every respect, or equal so far
        same = F.col("lo") == F.col("hi")
        fate = F.when(F.col("c") == F.col("rest"), "whole").when(same & (F.col("level") > 0) & _ended(F.col("lo")), "equal").when(same, "next").otherwise("again")
        hit = tables.cut(hit.select("grp", "rest", "level", "lo", "hi", fate.alias("fate")))
        both = live.join(broadcast_if_small(hit, within=hit), "grp").where("code >= lo")
        wins = (F.col("code") > F.col("hi")) | (F.col("fate") == "whole")
        deeper = F.when(F.col("fate") == "next", name_code(F.col("level") + 1, F.col("flag"), F.col("item"))).otherwise(F.col("code"))
        slim = both.select("grp", "item", "flag", deeper.alias("code"), F.when(wins, "in").otherwise(F.col("fate")).alias("fate"), "rest", "level")
        on = F.col("fate").isin("again", "next")
        after = tables.cut(slim, undecided=F.count_if(on))
        kept.append(after.where("fate = 'in'").select("grp", "item"))
        copies = after.where("fate = 'equal'").groupBy("grp", "item").agg(F.max("rest").alias("rest"))
        kept.append(copies.select("grp", "item", F.explode(F.sequence(F.lit(1).cast("long"), "rest")).alias("copy")).drop("copy"))
        live, undecided, bound = after.where(on).select("grp", "item", "flag", "code"), figure(after, "undecided"), hit
        level = F.max(F.col("level") + (F.col("fate") == "next").cast("int")).alias("level")
        state = after.where(on).groupBy("grp").agg(F.max("rest").alias("rest"), level, F.min("code").alias("lo"), F.max("code").alias("hi"))
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out.select(F.col("grp").alias(group), F.col("item").alias(item))


def latest_valid(map_snp: DataFrame) -> DataFrame:
    """``grp, marker, median_ld, is_core``: of each marker's rows with a group and a usable median_ld (0..1) the latest loaded one."""
    ok = map_snp.where(F.col("grp").isNotNull() & F.col("marker").isNotNull() & F.col("median_ld").between(0.0, 1.0))
    last = F.max(F.struct(F.unix_micros("loaded_at").alias("t"), "median_ld", "is_core", "grp")).alias("m")
    return ok.groupBy("marker").agg(last).select("marker", "m.grp", "m.median_ld", "m.is_core")
