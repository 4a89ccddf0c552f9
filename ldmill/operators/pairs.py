"""Pairwise r2 between markers: blocks of markers meet in tiles, and each tile is a handful of matrix products.

Calls are shuffled once a tile they take part in (twice for a band), never once a pair; a tile holds at most two blocks of markers, whatever the chromosome's length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ldmill.operators.genotypes import packed, ranked_markers
from ldmill.session import Tables, broadcast_if_small


def matrix(pdf: pd.DataFrame, inds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Markers x individuals: calls (0 where missing) and which are present."""
    x, m = np.zeros((len(pdf), len(inds))), np.zeros((len(pdf), len(inds)))
    for i, (who, g) in enumerate(zip(pdf["inds"], pdf["calls"], strict=True)):
        at = np.searchsorted(inds, np.asarray(who, dtype=inds.dtype))
        x[i, at], m[i, at] = g, 1
    return x, m


def r2_corr(x: np.ndarray, m: np.ndarray, y: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairwise-complete n and squared correlation of every row of x with every row of y, from sums that are exact for hard calls."""
    n, sx, sy, sxy = m @ k.T, x @ k.T, m @ y.T, x @ y.T
    sxx, syy = (x * x) @ k.T, m @ (y * y).T
    top, bottom = n * sxy - sx * sy, (n * sxx - sx * sx) * (n * syy - sy * sy)
    with np.errstate(divide="ignore", invalid="ignore"):
        return n, np.where(bottom > 0, top * top / bottom, np.nan)


def r2_em(x: np.ndarray, m: np.ndarray, y: np.ndarray, k: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Squared gametic correlation under random mating: the double heterozygotes' phase by fixed-point iteration over all pairs of a tile at once."""
    at = [[((x == i) * m) @ ((y == j) * k).T for j in range(3)] for i in range(3)]
    n = sum(map(sum, at))
    with np.errstate(divide="ignore", invalid="ignore"):
        total = 2 * n
        # haplotypes known without phase, of the alleles counted 2 (first marker, second marker)
        n11 = 2 * at[2][2] + at[2][1] + at[1][2]
        n12 = 2 * at[2][0] + at[2][1] + at[1][0]
        n21 = 2 * at[0][2] + at[0][1] + at[1][2]
        n22 = 2 * at[0][0] + at[0][1] + at[1][0]
        p, q = (n11 + n12 + at[1][1]) / total, (n11 + n21 + at[1][1]) / total
        f11 = p * q
        for _ in range(rounds):
            f12, f21 = p - f11, q - f11
            f22 = 1 - p - q + f11
            same = f11 * f22
            share = np.where(same + f12 * f21 > 0, same / (same + f12 * f21), 0.5)
            f11 = (n11 + at[1][1] * share) / total
        d = f11 - p * q
        bottom = p * (1 - p) * q * (1 - q)
        return n, np.where(bottom > 1e-12, np.minimum(1.0, d * d / bottom), np.nan)


def edge_list(geno: DataFrame, slide: int = 1000, method: str = "corr", by_chr: bool = True, block: int = 512, across_only: bool = False) -> DataFrame:
    """``snp1, snp2, chr1, chr2, pos1, pos2, n, r2, d`` of marker pairs with a finite r2; snp1 is the later marker.

    ``slide`` > 0: pairs at most so many ranks apart on their chromosome; <= 0: all pairs, within chromosomes (``by_chr``), also across, or only across.
    ``method``: ``corr`` (Pearson on calls) or ``r`` (gametic, by iteration; calls are rounded to hard ones). Constant markers and pairs without common calls give no edge.
    """
    if method not in ("corr", "r"):
        raise ValueError(f"unknown method {method}")
    kernel = r2_corr if method == "corr" else r2_em
    if method == "r":
        geno = geno.withColumn("dosage", F.rint(F.col("dosage").cast("double")))
    vectors = Tables(geno.sparkSession, "vectors").cut(packed(geno))
    markers = ranked_markers(vectors)
    rows = vectors.join(broadcast_if_small(markers), ["chr", "snp_idx", "pos"])
    block = max(slide, block)  # a narrow band has tiles of a block all the same
    own = F.floor(F.col("rk") / block).cast("int")
    if slide > 0:
        # tile k holds block k and block k + 1
        rows = rows.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("tile", F.concat_ws(":", "chr", (own - F.col("side")).cast("string"))).where(own >= F.col("side"))
    else:
        blocks = markers.select("chr", own.alias("b")).distinct()
        a, b = blocks.select(F.col("chr").alias("ca"), F.col("b").alias("ba")), blocks.select(F.col("chr").alias("cb"), F.col("b").alias("bb"))
        ordered = F.struct("ca", "ba") <= F.struct("cb", "bb")
        tiles = a.join(b, ordered & (F.col("ca") == F.col("cb")) if by_chr else ordered)  # pairs of blocks, not of markers
        tiles = tiles.where("ca <> cb") if across_only else tiles
        tiles = tiles.withColumn("tile", F.concat_ws(":", "ca", "ba", "cb", "bb"))
        first = tiles.select(F.col("ca").alias("chr"), F.col("ba").alias("b"), "tile", F.lit(0).alias("side"))
        second = tiles.where("ca <> cb OR ba <> bb").select(F.col("cb").alias("chr"), F.col("bb").alias("b"), "tile", F.lit(1).alias("side"))
        rows = rows.withColumn("b", own).join(broadcast_if_small(first.unionByName(second)), ["chr", "b"])

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "chr", "pos", "snp_idx"], ignore_index=True)
        inds = np.unique(np.concatenate([np.asarray(i, dtype=np.int64) for i in pdf["inds"]]))
        x, m = matrix(pdf, inds)
        left = np.flatnonzero(pdf["side"] == 0)
        right = np.flatnonzero(pdf["side"] == 1)
        single = slide <= 0 and not len(right)
        out = []
        for rs in ([left] if single else [left, right] if slide > 0 else [right]):
            if not len(left) or not len(rs):
                continue
            n, r2 = kernel(x[left], m[left], x[rs], m[rs])
            i, j = np.nonzero(np.isfinite(r2))
            a, b = left[i], rs[j]
            ok = a < b if rs is left else np.ones(len(a), dtype=bool)
            if slide > 0:
                ok &= np.abs(pdf["rk"].to_numpy()[a] - pdf["rk"].to_numpy()[b]) <= slide
            a, b, i, j = a[ok], b[ok], i[ok], j[ok]
            late, early = pdf.iloc[b].reset_index(drop=True), pdf.iloc[a].reset_index(drop=True)
            out.append(pd.DataFrame({"snp1": late["snp_idx"], "snp2": early["snp_idx"], "chr1": late["chr"], "chr2": early["chr"], "pos1": late["pos"], "pos2": early["pos"], "n": n[i, j].astype("int64"), "r2": r2[i, j]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["snp1", "snp2", "chr1", "chr2", "pos1", "pos2", "n", "r2"])

    schema = f"snp1 {geno.schema['snp_idx'].dataType.simpleString()}, snp2 {geno.schema['snp_idx'].dataType.simpleString()}, chr1 string, chr2 string, pos1 bigint, pos2 bigint, n bigint, r2 double"
    edges = rows.withColumn("pos", F.col("pos").cast("bigint")).groupBy("tile").applyInPandas(tile, schema)
    return edges.withColumn("d", F.when(F.col("chr1") == F.col("chr2"), F.abs(F.col("pos1") - F.col("pos2"))))


def symmetric(edges: DataFrame, *values: str) -> DataFrame:
    """``snp, other, values...``: every edge seen from both ends."""
    return edges.select(F.explode(F.array(F.struct(F.col("snp1").alias("snp"), F.col("snp2").alias("other")), F.struct(F.col("snp2").alias("snp"), F.col("snp1").alias("other")))).alias("e"), *values).select("e.*", *values)
