"""Graph operators on edge tables: connected components and complete-linkage clusters, both in rounds of joins over the whole graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ldmill.session import Tables, broadcast_if_small, figure


def hashed(pairs: DataFrame, a: str, b: str, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """The ``pairs`` as a table of 64-bit vertex ids ``(u, v)``, and the vertices' own table ``(id, name)``.

    Ids are hashes, and so in no order that a graph could be built against; should two names ever share one, another seed is taken, so equal ids mean equal names.
    """
    rows = tables.cut(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))
    for seed in range(64):
        vid = lambda c: F.xxhash64(F.lit(seed), F.col(c))  # noqa: B023, E731
        names = tables.cut(rows.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.lit(0).alias("z")).select(vid("name").alias("id"), "name"))
        if names.groupBy("id").count().where("count > 1").isEmpty():
            return rows.select(vid("a").alias("u"), vid("b").alias("v")), names
        tables.drop(names)
    raise RuntimeError("no collision-free seed")


def roots(forest: DataFrame, tables: Tables) -> DataFrame:
    """``w, p`` with p the root of each ``w`` in a forest of links ``(w, p)``; pointers double until none moves."""
    up = tables.cut(forest.select("w", "p"))
    while True:
        above = up.select(F.col("w").alias("p"), F.col("p").alias("next"))
        jump = tables.cut(up.join(above, "p", "left").select("w", F.coalesce("next", "p").alias("p"), F.col("next").isNotNull().alias("moved")), moved=F.count_if("moved"))
        up = jump.select("w", "p")
        if not figure(jump, "moved"):
            return up


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``v, component``: the smallest vertex each vertex of the undirected ``edges (u, v)`` is linked to; isolated ``vertices (v)`` are their own component.

    Contraction: every vertex points to the smallest of its neighbourhood and moves four steps along these pointers, which nearly always end at a vertex that points to
    itself; only edges between different ends stay for the next round (and one from an end that points on), so the graph shrinks geometrically. Vertices are
    64-bit ids until the end; rounds end in tables of the shared folder. Runs until no edge is left.
    """
    tables = Tables(edges.sparkSession, "graph")
    ids, names = hashed(edges, "u", "v", tables)
    both_ways = lambda df: df.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").distinct()
    graph = tables.cut(both_ways(ids.where("u <> v")))
    levels: list[DataFrame] = []
    while figure(graph):
        up = tables.cut(graph.groupBy(F.col("u").alias("w")).agg(F.least(F.col("u"), F.min("v")).alias("p")))
        follow = lambda df, by: df.join(by.select(F.col("w").alias("p"), F.col("p").alias("next")), "p").select("w", F.col("next").alias("p"))
        two = follow(up, up)
        four = tables.cut(follow(two, two))
        levels.append(four)
        ends = four.select(F.col("w").alias("u"), F.col("p").alias("pu"))
        moved = graph.where("u < v").join(ends, "u").join(ends.select(F.col("u").alias("v"), F.col("pu").alias("pv")), "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
        # an end that itself moved on: what came to it must stay linked to where it went
        onward = four.join(four.select(F.col("p").alias("w")).distinct(), "w", "left_semi").where("w <> p").select(F.col("w").alias("u"), F.col("p").alias("v"))
        after = tables.cut(both_ways(moved.unionByName(onward)))
        tables.drop(graph, up)
        graph = after
    labels = names.select(F.col("id").alias("w"), F.col("id").alias("root")) if not levels else levels[-1].select("w", F.col("p").alias("root"))
    for level in reversed(levels[:-1]):
        higher = labels.select(F.col("w").alias("p"), F.col("root").alias("top"))
        labels = tables.cut(level.join(higher, "p", "left").select("w", F.coalesce("top", "p").alias("root")))
    rows = tables.cut(names.join(labels, names["id"] == labels["w"], "left").select("name", F.coalesce("root", "id").alias("root")))
    heads = rows.groupBy("root").agg(F.min("name").alias("component"))
    out = rows.join(heads, "root").select(F.col("name").alias("v"), "component")
    if vertices is not None:
        alone = vertices.select("v").distinct().join(rows.select(F.col("name").alias("v")), "v", "left_anti").select("v", F.col("v").alias("component"))
        out = out.unionByName(alone)
    return out


def linkage_order(edges: DataFrame) -> DataFrame:
    """``v, tree, place``: the leaves of the single-linkage trees of ``edges (u, v, s)`` in the order of a dendrogram, for who sorts by tree, then place.

    Single linkage is reducible too: every round merges all clusters that are each other's nearest and keeps the strongest edge between clusters. A round writes one digit in
    front of every leaf's place: 1 for those of the cluster that joined another, 0 for all else, so that members of a cluster stand together. ``tree`` is its smallest vertex.
    """
    tables = Tables(edges.sparkSession, "order")
    live = tables.cut(edges.where("u <> v AND s IS NOT NULL").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("s").alias("s")))
    leaves = tables.cut(live.select(F.explode(F.array("u", "v")).alias("v")).distinct().select("v", F.col("v").alias("tree"), F.lit("").alias("place")))
    while figure(live):
        rank = F.struct((-F.col("s")).alias("k"), "u", "v")
        seen = live.select(F.explode(F.array("u", "v")).alias("w"), rank.alias("e")).groupBy("w").agg(F.min("e").alias("e"))
        pairs = tables.cut(seen.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(F.col("e.v").alias("old"), F.col("e.u").alias("new")))
        moves = broadcast_if_small(pairs)
        to = lambda c: moves.select(F.col("old").alias(c), F.col("new").alias(f"{c}2"))  # noqa: B023, E731
        moved = live.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("u2", "u").alias("a"), F.coalesce("v2", "v").alias("b"), "s").where("a <> b")
        after = tables.cut(moved.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.max("s").alias("s")))
        placed = leaves.join(moves, leaves["tree"] == moves["old"], "left").select("v", F.coalesce("new", "tree").alias("tree"), F.concat(F.when(F.col("new").isNull(), "0").otherwise("1"), "place").alias("place"))
        placed = tables.cut(placed)
        tables.drop(live, leaves)
        live, leaves = after, placed
    return leaves


def complete_linkage(edges: DataFrame) -> DataFrame:
    """``v, cluster``: complete-linkage clusters of ``edges (u, v, s)`` with similarity s, where absent pairs never join; ``cluster`` is its smallest vertex.

    Complete linkage is reducible: clusters that are each other's most similar can merge in any order without changing the tree. So every round merges all
    such pairs at once and keeps an edge between clusters only where every pair of their members has one, at the least similarity of them.
    Equal similarities are taken by the smaller, then the larger vertex. Clusters of any size stay rows; none is collected. The best edge of all is always
    its ends' best, so every round merges something, and rounds end when no edge is left; who merged with whom is a forest, followed to its roots at the end.
    """
    tables = Tables(edges.sparkSession, "linkage")
    live = tables.cut(edges.where("u <> v AND s IS NOT NULL").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("s").alias("s")))
    vertices = tables.cut(live.select(F.explode(F.array("u", "v")).alias("v")).distinct())
    forest: list[DataFrame] = []
    while figure(live):
        # a vertex's best edge: most similar, then smallest ends; both ends agree on the order of edges
        rank = F.struct((-F.col("s")).alias("k"), "u", "v")
        seen = live.select(F.explode(F.array("u", "v")).alias("w"), rank.alias("e")).groupBy("w").agg(F.min("e").alias("e"))
        pairs = tables.cut(seen.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(F.col("e.v").alias("old"), F.col("e.u").alias("new")))
        forest.append(pairs)
        # a vertex that merged, by its old name or the one it keeps, stands for two
        role = broadcast_if_small(pairs.select(F.explode(F.array(F.struct(F.col("old").alias("w"), "new"), F.struct(F.col("new").alias("w"), "new"))).alias("r")).select("r.w", "r.new"), within=pairs)
        side = lambda c: role.select(F.col("w").alias(c), F.col("new").alias(f"{c}2"))  # noqa: B023, E731
        moved = live.join(side("u"), "u", "left").join(side("v"), "v", "left")
        size = lambda c: F.when(F.col(f"{c}2").isNull(), 1).otherwise(2)
        a, b = F.coalesce("u2", "u"), F.coalesce("v2", "v")
        moved = moved.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), (size("u") * size("v")).alias("need"), "s").where("x <> y")
        both = moved.groupBy("x", "y").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("have"), F.max("need").alias("need"))
        after = tables.cut(both.where("have = need").select(F.col("x").alias("u"), F.col("y").alias("v"), "s"))
        tables.drop(live)
        live = after
    if not forest:
        return vertices.withColumn("cluster", F.col("v"))
    up = roots(reduce(DataFrame.unionByName, forest).select(F.col("old").alias("w"), F.col("new").alias("p")), tables)
    return vertices.join(up, vertices["v"] == up["w"], "left").select("v", F.coalesce("p", "v").alias("cluster"))
