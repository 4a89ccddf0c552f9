"""Consolidating pairwise matches into groups (problem 1): connected components by seed-tree pruning.

Each round every remaining vertex connects its neighbourhood to the smallest vertex in it; a vertex that is nobody's minimum drops out of
the graph and hangs below its minimum in a propagation forest. When no edge is left, the survivors are the seeds, and their identifiers
flow down the forest, last round first. Vertices are ordered by a 64-bit hash of their name, so chains of sorted names don't slow it down
(the remaining graph shrinks by a constant factor a round in expectation).

All state is in DataFrames; every round's graph is a table in the shared folder. Hubs: minima are taken by combining aggregates, and the
one join of edges with minima is on a unique small side, which AQE splits or broadcasts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ldmill.operators.graph import hashed
from ldmill.session import Tables, figure

BLANKS = " \t\r\n\xa0"


def linked_pairs(el: DataFrame, min_r2: float = 0.5) -> DataFrame:
    """The unordered marker pairs ``a < b`` of an edge list that are linked by their latest usable r2.

    Usable: r2 finite, within 0..1, two different markers after trimming blanks and ignoring case; names come out in upper case.
    Of rows with the same latest time the highest r2 counts. Null names, times and r2: a null name or r2 is unusable, a null time is the earliest.
    """
    name = lambda c: F.upper(F.trim(F.col(c), F.lit(BLANKS)))
    a, b = F.least("x", "y"), F.greatest("x", "y")
    rows = el.select(name("snp1").alias("x"), name("snp2").alias("y"), "r2", "computed_at").where(F.col("r2").between(0.0, 1.0) & (F.col("x") != F.col("y")) & (F.col("x") != "") & (F.col("y") != ""))
    last = rows.groupBy(a.alias("a"), b.alias("b")).agg(F.max(F.struct(F.unix_micros("computed_at").alias("t"), "r2")).alias("m"))
    return last.where(F.col("m.r2") >= min_r2).select("a", "b")


def seed_tree_components(edges: DataFrame, tables: Tables) -> DataFrame:
    """``(id, seed)`` for every vertex of the undirected edges ``(u, v)`` of longs; loops and repeated edges don't matter, no edge gives no row."""
    graph = tables.cut(edges.where("u <> v").select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").distinct())
    forest: list[DataFrame] = []
    first = graph
    while figure(graph):
        # min selection: u tells its whole neighbourhood, itself included, the smallest vertex in it
        low = graph.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        told = graph.join(low, "u").select(F.col("v").alias("w"), "m").unionByName(low.select(F.col("u").alias("w"), "m"))
        told = tables.cut(told.distinct())
        # pruning: w links the minima it heard of; who is nobody's minimum, not even its own, leaves
        best = told.groupBy("w").agg(F.min("m").alias("best"), F.max((F.col("m") == F.col("w")).cast("int")).alias("stays"))
        best = tables.cut(best)
        forest.append(best.where("stays = 0").select(F.col("w").alias("id"), F.col("best").alias("parent")))
        links = told.join(best, "w").where("m <> best").select("best", "m")
        after = tables.cut(links.select(F.explode(F.array(F.struct(F.col("best").alias("u"), F.col("m").alias("v")), F.struct(F.col("m").alias("u"), F.col("best").alias("v")))).alias("e")).select("e.u", "e.v").distinct())
        tables.drop(told, *([] if graph is first else [graph]))
        graph = after
    if not forest:
        return first.select(F.col("u").alias("id"), F.col("u").alias("seed"))
    # whoever never left is a seed; identifiers flow from the round that ended last to the first
    left = forest[0]
    for f in forest[1:]:
        left = left.unionByName(f)
    labels = first.select(F.col("u").alias("id")).distinct().join(left, "id", "left_anti").select("id", F.col("id").alias("seed"))
    for f in reversed(forest):
        down = f.join(labels.select(F.col("id").alias("parent"), "seed"), "parent").select("id", "seed")
        labels = tables.cut(labels.unionByName(down))
    return labels


def marker_groups(pairs: DataFrame, spelled: DataFrame | None = None) -> DataFrame:
    """``grp_snp, snp`` for every marker of the linked ``pairs (a, b)``: the smallest marker name (code-point order) it is linked to directly
    or through others, and the marker. Pairs with a null are left out, repeated pairs and either order don't matter, other columns are ignored, no pair
    gives no row. ``spelled (key, marker)`` gives the spelling for each upper-case key; names without one stay as they are.
    """
    tables = Tables(pairs.sparkSession, "components")
    edges, names = hashed(pairs, "a", "b", tables)
    labels = seed_tree_components(edges, tables)
    if spelled is not None:
        names = names.join(spelled, names["name"] == spelled["key"], "left").select("id", F.coalesce("marker", "name").alias("name"))
    rows = tables.cut(labels.join(names, "id").select("seed", "name"))
    heads = rows.groupBy("seed").agg(F.min("name").alias("grp_snp"))
    return rows.join(heads, "seed").select("grp_snp", F.col("name").alias("snp"))


def spelling(map_snp: DataFrame) -> DataFrame:
    """``key, marker``: the spelling of each marker in the map, keyed by its upper-case name."""
    return map_snp.where("marker IS NOT NULL").groupBy(F.upper(F.trim(F.col("marker"), F.lit(BLANKS))).alias("key")).agg(F.min("marker").alias("marker"))
