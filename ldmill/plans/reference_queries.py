"""Queries of the LD analytics: every operator over whole tables, with SQL where it can express it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ldmill.functions.ordered import bh_adjust, quantiles
from ldmill.functions.scalar import d_from_rho, ld_from_rho
from ldmill.operators import assoc, cluster, decay, emlg, genmap, genotypes, ldw, outlier, pairs, plotdata, popgen, prune
from ldmill.operators.graph import connected_components
from ldmill.plans.sql_parts import EDGES, GENO_FIXTURE, GENO_TABLE, MAP, PARAMS, PVALUES, R2, R2_SUMS, dbl
from ldmill.session import Tables, broadcast_if_small
from ldmill.sources import derived
from ldmill.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.moving_sum_genotypes(table(spark, sf_dir, "embeddings"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genotype table, with the marker name as its index."""
    return derived.clean_genotypes(table(spark, sf_dir, "geno")).withColumn("snp_idx", F.col("marker"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.clean_edges(table(spark, sf_dir, "el"))


def markers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return derived.clean_map(table(spark, sf_dir, "map_snp"), *columns)


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.chromosome_parameters(table(spark, sf_dir, "decay_sum"))


def pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = 1 - F.col("median_ld")
    return markers(spark, sf_dir, "chr", "pos", "ld_w", "median_ld").select("marker", "chr", "pos", F.round(one * one * one * one, 12).alias("pval"), "ld_w")


# genotypes and pairs


@query(f"WITH {GENO_FIXTURE} SELECT chr, snp_idx, pos, count(dosage) AS n_obs, round(least(avg(dosage) / 2, 1 - avg(dosage) / 2), 6) AS maf FROM g GROUP BY chr, snp_idx, pos")
def geno_maf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(genotypes.allele_frequencies(fixture(spark, sf_dir)), "maf")


@query(f"WITH {GENO_TABLE} SELECT chr, marker AS snp_idx, pos, count(dosage) AS n_obs, round(least(avg(dosage) / 2, 1 - avg(dosage) / 2), 6) AS maf FROM h GROUP BY chr, marker, pos")
def geno_table_maf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(genotypes.allele_frequencies(calls(spark, sf_dir)), "maf")


@query("SELECT marker, CASE WHEN coalesce(bool_or(dosage NOT IN (0, 1, 2)), false) THEN 'dosage' ELSE 'hard' END AS kind FROM geno GROUP BY marker")
def geno_input_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes.input_kind(table(spark, sf_dir, "geno"), ["marker"])


_PAIRS = f"SELECT snp1, snp2, chr1, chr2, pos1, pos2, n, round(r2, 6) AS r2, CASE WHEN chr1 = chr2 THEN pos1 - pos2 END AS d FROM (SELECT *, {R2} AS r2 FROM p) WHERE r2 IS NOT NULL"


@query(f"""
    WITH {GENO_TABLE}, m AS (SELECT chr, marker, pos, row_number() OVER (PARTITION BY chr ORDER BY pos, marker) AS rk FROM (SELECT DISTINCT chr, marker, pos FROM h)),
    t AS (SELECT h.ind_id, h.dosage, m.* FROM h JOIN m USING (chr, marker, pos) WHERE dosage IS NOT NULL),
    p AS (SELECT a.marker AS snp1, b.marker AS snp2, a.chr AS chr1, b.chr AS chr2, a.pos AS pos1, b.pos AS pos2, {R2_SUMS}
          FROM (SELECT *, dosage AS x FROM t) a JOIN (SELECT *, dosage AS y FROM t) b ON a.chr = b.chr AND a.ind_id = b.ind_id AND a.rk > b.rk AND a.rk - b.rk <= 10 GROUP BY ALL) {_PAIRS}""")
def ld_edges_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.edge_list(calls(spark, sf_dir), slide=10), "r2")


@query(SQL["ld_edges_band"].replace("a.rk - b.rk <= 10", "a.rk - b.rk <= 1000"))
def ld_edges_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``ld_edges_band``, with the band of default width."""
    return rounded(pairs.edge_list(calls(spark, sf_dir)), "r2")


@query(f"""
    WITH {GENO_FIXTURE}, t AS (SELECT * FROM g WHERE dosage IS NOT NULL),
    p AS (SELECT a.snp_idx AS snp1, b.snp_idx AS snp2, a.chr AS chr1, b.chr AS chr2, a.pos AS pos1, b.pos AS pos2, {R2_SUMS}
          FROM (SELECT *, dosage AS x FROM t) a JOIN (SELECT *, dosage AS y FROM t) b ON a.chr = b.chr AND a.ind_id = b.ind_id AND (a.pos, a.snp_idx) > (b.pos, b.snp_idx) GROUP BY ALL) {_PAIRS}""")
def ld_edges_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.edge_list(fixture(spark, sf_dir), slide=0, block=64), "r2")


@query(f"""
    WITH RECURSIVE {GENO_TABLE}, m AS (SELECT chr, marker, pos, row_number() OVER (PARTITION BY chr ORDER BY pos, marker) AS rk FROM (SELECT DISTINCT chr, marker, pos FROM h)),
    t AS (SELECT h.ind_id, h.dosage, m.* FROM h JOIN m USING (chr, marker, pos) WHERE dosage IS NOT NULL),
    p AS (SELECT a.marker AS snp1, b.marker AS snp2, a.chr AS chr1, b.chr AS chr2, a.pos AS pos1, b.pos AS pos2, count(*) AS n, {", ".join(f"count(*) FILTER (a.dosage = {i} AND b.dosage = {j}) AS a{i}{j}" for i in range(3) for j in range(3))}
          FROM t a JOIN t b ON a.chr = b.chr AND a.ind_id = b.ind_id AND a.rk > b.rk AND a.rk - b.rk <= 1000 GROUP BY ALL),
    s AS (SELECT *, 2.0e0 * n AS total, CAST(a11 AS DOUBLE) AS het, 2.0e0 * a22 + a21 + a12 AS n11, 2.0e0 * a20 + a21 + a10 AS n12, 2.0e0 * a02 + a12 + a01 AS n21 FROM p),
    f AS (SELECT *, (n11 + n12 + het) / total AS pa, (n11 + n21 + het) / total AS pb FROM s),
    it(snp1, snp2, k, pa, pb, n11, het, total, f11) AS (
        SELECT snp1, snp2, 0, pa, pb, n11, het, total, pa * pb FROM f
        UNION ALL
        SELECT snp1, snp2, k + 1, pa, pb, n11, het, total, (n11 + het * CASE WHEN f11 * (1 - pa - pb + f11) + (pa - f11) * (pb - f11) > 0
            THEN f11 * (1 - pa - pb + f11) / (f11 * (1 - pa - pb + f11) + (pa - f11) * (pb - f11)) ELSE 0.5 END) / total FROM it WHERE k < 50),
    r AS (SELECT snp1, snp2, CASE WHEN pa * (1 - pa) * pb * (1 - pb) > 1e-12 THEN least(1.0, (f11 - pa * pb) * (f11 - pa * pb) / (pa * (1 - pa) * pb * (1 - pb))) END AS r2 FROM it WHERE k = 50)
    SELECT p.snp1, p.snp2, chr1, chr2, pos1, pos2, n, round(r2, 6) AS r2, CASE WHEN chr1 = chr2 THEN pos1 - pos2 END AS d FROM p JOIN r USING (snp1, snp2) WHERE r2 IS NOT NULL""")
def ld_edges_gametic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.edge_list(calls(spark, sf_dir), method="r"), "r2")


# decay

_HASH = "((((((17 * 31 + {0}) % 4294967296) * 1103515245 + 12345)) * 31 + {1}) % 4294967296 * 1103515245 + 12345) % 4294967296"


@query(f"""
    WITH {GENO_FIXTURE}, f AS (SELECT chr, snp_idx, least(avg(dosage) / 2, 1 - avg(dosage) / 2) AS maf FROM g GROUP BY ALL HAVING maf > 0.1),
    k AS (SELECT chr, snp_idx FROM (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY ((17 * 31 + snp_idx) % 4294967296 * 1103515245 + 12345) % 4294967296, snp_idx) AS rk,
          ceil(60 * count(*) OVER (PARTITION BY chr) / count(*) OVER ()) AS quota FROM f) WHERE rk <= quota),
    t AS (SELECT g.* FROM g JOIN k USING (chr, snp_idx) WHERE dosage IS NOT NULL),
    p AS (SELECT a.snp_idx AS snp1, b.snp_idx AS snp2, {R2_SUMS} FROM (SELECT *, dosage AS x FROM t) a JOIN (SELECT *, dosage AS y FROM t) b ON a.ind_id = b.ind_id AND a.chr > b.chr GROUP BY ALL)
    SELECT count(*) AS n_pairs, round(quantile_cont(r2, 0.95), 6) AS b FROM (SELECT {R2} AS r2 FROM p) WHERE r2 IS NOT NULL""")
def background_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decay.background_ld(fixture(spark, sf_dir), n_sub=60), "b")


_SCALE = """
    sc AS (SELECT chr, max(pos) AS chr_size, max(pos) - min(pos) AS span, count(*) AS n_snp_chr FROM mp WHERE chr IS NOT NULL AND pos IS NOT NULL GROUP BY chr),
    scale AS (SELECT chr, chr_size, n_snp_chr, CASE WHEN n_snp_chr > 1 THEN span / (n_snp_chr - 1) END AS bp_per_snp, span / 4 AS window_size, span / 4 * 0.5e0 AS step FROM sc)"""


@query(f"WITH {MAP}, {_SCALE} SELECT chr, chr_size, n_snp_chr, round(bp_per_snp, 6) AS bp_per_snp, round(bp_per_snp * 1000, 2) AS slide_bp, round(window_size, 6) AS window_size, round(step, 6) AS step FROM scale")
def chr_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(decay.chromosome_scale(markers(spark, sf_dir, "chr", "pos"), n_win=4), "bp_per_snp", "window_size", "step"), "slide_bp", places=2)


_WINDOWS = f"""
    {EDGES}, {MAP}, {_SCALE}, ok AS (SELECT marker FROM mp WHERE maf > 0.1),
    dp AS (SELECT e.chr1 AS chr, pos1, pos2, d, r2, window_size, step FROM edges e JOIN scale s ON s.chr = e.chr1 WHERE chr1 = chr2 AND d > 0 AND d < window_size AND snp1 IN (SELECT marker FROM ok) AND snp2 IN (SELECT marker FROM ok)),
    en AS (SELECT chr, min(pos2) AS p0, max(pos1) AS p1 FROM dp GROUP BY chr),
    wn AS (SELECT chr, p0, unnest(range(0, CAST(floor((p1 - window_size - p0) / step) AS BIGINT) + 1)) AS win, window_size, step FROM en JOIN scale USING (chr) WHERE p1 - window_size >= p0),
    wp AS (SELECT dp.*, win, p0 + win * wn.step AS "start", p0 + win * wn.step + wn.window_size AS "end" FROM dp JOIN wn USING (chr) WHERE pos2 >= p0 + win * wn.step AND pos1 < p0 + win * wn.step + wn.window_size),
    w AS (SELECT *, count(*) OVER (PARTITION BY chr, win) AS n_pairs FROM wp QUALIFY n_pairs > 100)"""


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = decay.chromosome_scale(markers(spark, sf_dir, "chr", "pos"), n_win=4)
    return decay.windowed(decay.decay_pairs(edges(spark, sf_dir), scale, markers(spark, sf_dir, "maf")))


@query(f'WITH {_WINDOWS} SELECT chr, win, round(min("start"), 6) AS "start", round(min("end"), 6) AS "end", count(*) AS n_pairs FROM w GROUP BY chr, win')
def decay_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(spark, sf_dir).groupBy("chr", "win").agg(F.round(F.min("start"), 6).alias("start"), F.round(F.min("end"), 6).alias("end"), F.count(F.lit(1)).alias("n_pairs"))


_STRATA = f"""
    {_WINDOWS}, lim AS (SELECT chr, win, min(d) AS d0, max(d) AS d1, floor(least(count(*), 5000) / 10) AS cap FROM w GROUP BY chr, win),
    st AS (SELECT w.*, cap, greatest(1, least(10, coalesce(CASE WHEN d1 > d0 THEN CAST(ceil((ln(d) - ln(d0)) / ((ln(d1) - ln(d0)) / 10)) AS INT) END, 1))) AS stratum FROM w JOIN lim USING (chr, win)),
    kept AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY chr, win, stratum ORDER BY {_HASH.format("pos1", "pos2")}, pos1, pos2) <= cap),
    agg AS (SELECT chr, win, stratum, exp(avg(ln(d))) AS d_mid, quantile_cont(r2, 0.95) AS r2_q, count(*) AS n FROM kept GROUP BY chr, win, stratum),
    strata AS (SELECT * FROM agg QUALIFY sum(n) OVER (PARTITION BY chr, win) >= 100 AND count(*) OVER (PARTITION BY chr, win) >= 5)"""


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decay.strata(_windowed(spark, sf_dir), n_strata=10, min_strata=5)


@query(f"WITH {_STRATA} SELECT chr, win, stratum, round(d_mid, 3) AS d_mid, round(r2_q, 9) AS r2_q, n FROM strata")
def decay_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(_strata(spark, sf_dir), "r2_q", places=9), "d_mid", places=3)


_GRID = decay.rate_grid(1e-7, 1e-2, 61)


def _fit_sql(grid: list[float], background: str) -> str:
    """Fits of the windows in ``strata``: the best point of the grid, refined between its neighbours by 40 halvings towards the zero of the error's slope."""
    return f"""
    sb AS MATERIALIZED (SELECT s.*, sqrt(CAST(n AS DOUBLE)) AS w, {background} AS b FROM strata s),
    grid AS (SELECT a, coalesce(lag(a) OVER (ORDER BY a), a) AS lo, coalesce(lead(a) OVER (ORDER BY a), a) AS hi FROM (SELECT unnest([{dbl(grid)}]) AS a)),
    t AS (SELECT chr, win, a, lo, hi, w, 1 / (1 + a * d_mid) AS g, r2_q, b FROM sb, grid),
    u AS (SELECT chr, win, a, lo, hi, b, sum(w * g * (r2_q - b * (1 - g))) AS gz, sum(w * g * g) AS gg, sum(w * (r2_q - b * (1 - g)) * (r2_q - b * (1 - g))) AS zz FROM t GROUP BY ALL),
    v AS (SELECT *, greatest(b, least(1, gz / gg)) AS c FROM u),
    o AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY chr, win ORDER BY round(zz - 2 * c * gz + c * c * gg, 12), a) = 1),
    bis(chr, win, b, k, lo, hi) AS (
        SELECT chr, win, b, 0, lo, hi FROM o WHERE c > b
        UNION ALL
        SELECT chr, win, b, k + 1, CASE WHEN dz - greatest(b, least(1, gz / gg)) * dg > 0 THEN lo ELSE sqrt(lo * hi) END, CASE WHEN dz - greatest(b, least(1, gz / gg)) * dg > 0 THEN sqrt(lo * hi) ELSE hi END
        FROM (SELECT chr, win, b, k, lo, hi, sum(w * g * z) AS gz, sum(w * g * g) AS gg, sum(w * d_mid * g * g * z) AS dz, sum(w * d_mid * g * g * g) AS dg
              FROM (SELECT bis.*, w, d_mid, 1 / (1 + sqrt(lo * hi) * d_mid) AS g, r2_q - bis.b * (1 - 1 / (1 + sqrt(lo * hi) * d_mid)) AS z FROM bis JOIN sb USING (chr, win) WHERE k < 40) GROUP BY ALL)),
    fa AS (SELECT o.chr, o.win, o.b, coalesce(sqrt(bis.lo * bis.hi), o.a) AS a FROM o LEFT JOIN bis ON bis.chr = o.chr AND bis.win = o.win AND k = 40),
    fg AS (SELECT fa.chr, fa.win, fa.a, fa.b, sum(w * g * z) AS gz, sum(w * g * g) AS gg, sum(w * z * z) AS zz FROM (SELECT fa.*, w, 1 / (1 + a * d_mid) AS g, r2_q - fa.b * (1 - 1 / (1 + a * d_mid)) AS z FROM fa JOIN sb USING (chr, win)) fa GROUP BY ALL),
    fits AS (SELECT chr, win, a, b, greatest(b, least(1, gz / gg)) AS c, zz - 2 * greatest(b, least(1, gz / gg)) * gz + greatest(b, least(1, gz / gg)) * greatest(b, least(1, gz / gg)) * gg AS sse FROM fg)"""


@query(f"WITH RECURSIVE {_STRATA}, {_fit_sql(_GRID, 'CAST(0.02 AS DOUBLE)')} SELECT chr, win, round(a, 12) AS a, b, round(c, 6) AS c, round(sse, 6) AS sse, CASE WHEN c - b < 0.05e0 THEN 'weak' ELSE 'structured' END AS regime FROM fits")
def decay_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = decay.with_regime(decay.fit_curves(_strata(spark, sf_dir), 0.02, _GRID)).drop("contrast")
    return rounded(rounded(fits, "c", "sse"), "a", places=12)


# the whole analysis of the derived genotypes: their pairs, background, windows, fits and summary
_PIPE = _STRATA.replace(EDGES, f"""
    {GENO_FIXTURE}, gt AS (SELECT * FROM g WHERE dosage IS NOT NULL), fq AS (SELECT snp_idx, least(avg(dosage) / 2, 1 - avg(dosage) / 2) AS maf FROM g GROUP BY snp_idx),
    pp AS (SELECT a.snp_idx AS snp1, b.snp_idx AS snp2, a.chr AS chr1, b.chr AS chr2, a.pos AS pos1, b.pos AS pos2, {R2_SUMS}
           FROM (SELECT *, dosage AS x FROM gt) a JOIN (SELECT *, dosage AS y FROM gt) b ON a.ind_id = b.ind_id AND (a.chr, a.pos, a.snp_idx) > (b.chr, b.pos, b.snp_idx) GROUP BY ALL),
    every AS MATERIALIZED (SELECT * FROM (SELECT *, {R2} AS r2 FROM pp) WHERE r2 IS NOT NULL),
    bgd AS (SELECT quantile_cont(r2, 0.95) AS bg FROM every WHERE chr1 <> chr2 AND snp1 IN (SELECT snp_idx FROM fq WHERE maf > 0.1) AND snp2 IN (SELECT snp_idx FROM fq WHERE maf > 0.1)),
    edges AS (SELECT snp1, snp2, chr1, chr2, pos1, pos2, r2, pos1 - pos2 AS d FROM every WHERE chr1 = chr2)""").replace(MAP, "mp AS (SELECT DISTINCT g.snp_idx AS marker, chr, pos, maf FROM g JOIN fq USING (snp_idx))")


def _decay_of_fixture(spark: SparkSession, sf_dir: str) -> decay.LDDecay:
    g = Tables(spark, "genotypes").cut(fixture(spark, sf_dir).select("ind_id", "chr", "snp_idx", "pos", "dosage"))
    return decay.compute_decay(g, n_win=4, n_strata=10, min_strata=5)


@query(f"""
    WITH RECURSIVE {_PIPE}, {_fit_sql(decay.rate_grid(), '(SELECT bg FROM bgd)')}, f AS (SELECT * FROM fits WHERE c - b >= 0.05e0),
    l AS (SELECT chr, quantile_cont(a, 0.025) AS lo, quantile_cont(a, 0.975) AS hi, count(*) AS n_used FROM f GROUP BY chr HAVING count(*) >= 5),
    su AS (SELECT chr, quantile_cont(a, 0.5) AS a, min(b) AS b, quantile_cont(c, 0.5) AS c, max(n_used) AS n_used FROM f JOIN l USING (chr) WHERE a BETWEEN lo AND hi GROUP BY chr HAVING count(*) >= 3)
    SELECT chr, round(a, 9) AS a, round(b, 6) AS b, round(c, 6) AS c, n_used, round((SELECT quantile_cont(a, 0.5) FROM su), 9) AS a_pred FROM su""")
def decay_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``compute_decay`` from genotypes to the summary of each chromosome; two chromosomes have the median rate as prediction."""
    s = _decay_of_fixture(spark, sf_dir).summary.select("chr", "a", "b", "c", "n_used", "a_pred")
    return rounded(rounded(s, "b", "c"), "a", "a_pred", places=9)


_FITS = "f AS (SELECT chr, a, b, c FROM decay_sum WHERE chr IS NOT NULL AND a IS NOT NULL AND c IS NOT NULL AND a > 0 AND NOT isnan(a) AND NOT isnan(c))"


@query(f"""
    WITH {_FITS}, l AS (SELECT chr, quantile_cont(a, 0.025) AS lo, quantile_cont(a, 0.975) AS hi, count(*) AS n_used FROM f GROUP BY chr HAVING count(*) >= 5)
    SELECT chr, round(quantile_cont(a, 0.5), 12) AS a, round(min(b), 6) AS b, round(quantile_cont(c, 0.5), 9) AS c, max(n_used) AS n_used FROM f JOIN l USING (chr) WHERE a BETWEEN lo AND hi GROUP BY chr HAVING count(*) >= 3""")
def decay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(rounded(decay.summarize(table(spark, sf_dir, "decay_sum")), "b"), "c", places=9), "a", places=12)


RHOS = [0.5, 0.9, 0.95, 0.99]
_TARGETS = f"t AS (SELECT rho, rho / (a_pred * (1 - rho)) AS slide_bp, rho / (a_pred * (1 - rho)) / bp_per_snp AS slide_snp FROM decay_sum, (SELECT unnest([{dbl(RHOS)}]) AS rho) WHERE a_pred > 0 AND bp_per_snp > 0)"


@query(f"""WITH {_TARGETS} SELECT rho, round(quantile_cont(slide_snp, 0.5), 6) AS slide_snp_median, round(quantile_cont(slide_snp, 0.9), 6) AS slide_snp_p90, round(max(slide_snp), 6) AS slide_snp_max,
    round(quantile_cont(slide_bp, 0.5), 3) AS slide_bp_median, round(quantile_cont(slide_bp, 0.9), 3) AS slide_bp_p90, round(max(slide_bp), 3) AS slide_bp_max FROM t GROUP BY rho""")
def slide_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decay.recommendation(decay.slide_targets(table(spark, sf_dir, "decay_sum").where("a_pred > 0 AND bp_per_snp > 0"), [*RHOS, 1.0, -1.0]))
    return rounded(rounded(got, *[f"slide_snp_{x}" for x in ("median", "p90", "max")]), *[f"slide_bp_{x}" for x in ("median", "p90", "max")], places=3)


@query(f"""SELECT rep, chr, rho, round(CASE WHEN a * (1 - rho) <> 0 THEN rho / (a * (1 - rho)) END, 3) AS d, round(b + (c - b) * (1 - rho), 10) AS ld
    FROM (SELECT DISTINCT rep, chr, a, b, c FROM decay_sum), (SELECT unnest([{dbl(RHOS)}]) AS rho) WHERE a IS NOT NULL AND c IS NOT NULL AND b IS NOT NULL""")
def rho_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "decay_sum").select("rep", "chr", "a", "b", "c").distinct().where("a IS NOT NULL AND c IS NOT NULL AND b IS NOT NULL")
    rows = rows.withColumn("rho", F.explode(F.array(*[F.lit(r) for r in RHOS])))
    return rows.select("rep", "chr", "rho", F.round(d_from_rho(F.col("a"), F.col("rho")), 3).alias("d"), F.round(ld_from_rho(F.col("b"), F.col("c"), F.col("rho")), 10).alias("ld"))


@query(f"""
    WITH RECURSIVE {MAP}, {_FITS}, l AS (SELECT chr, quantile_cont(a, 0.025) AS lo, quantile_cont(a, 0.975) AS hi, count(*) AS n_used FROM f GROUP BY chr HAVING count(*) >= 5),
    su AS (SELECT chr, quantile_cont(a, 0.5) AS a, min(b) AS b, quantile_cont(c, 0.5) AS c FROM f JOIN l USING (chr) WHERE a BETWEEN lo AND hi GROUP BY chr HAVING count(*) >= 3),
    sc AS (SELECT chr, max(pos) AS chr_size, CASE WHEN count(*) > 1 THEN (max(pos) - min(pos)) / (count(*) - 1) END AS bp_per_snp FROM mp WHERE chr IS NOT NULL AND pos IS NOT NULL GROUP BY chr),
    j AS (SELECT su.*, chr_size, bp_per_snp FROM su JOIN sc USING (chr)), xy AS MATERIALIZED (SELECT ln(chr_size) AS x, ln(a) AS y FROM j WHERE a > 0 AND chr_size > 0),
    it(k, i, s, scale) AS (
        SELECT 0, 0.0e0, 0.0e0, 0.0e0
        UNION ALL
        SELECT k + 1, my - slope * mx, slope, median(abs(xy.y - (my - slope * mx) - slope * xy.x)) / 0.6745e0 FROM (
            SELECT it.k, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / (sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) AS slope
            FROM (SELECT it.k, x - 16 AS x, y, CASE WHEN k = 0 THEN 1.0e0 ELSE least(1.0e0, 1.345e0 * scale / greatest(abs(y - (i - 16 * s) - s * x + s * 0), 1e-300)) END AS w FROM it, xy WHERE k < 50 AND (k < 2 OR scale >= 1e-12)) it GROUP BY it.k) g,
            (SELECT x - 16 AS x, y FROM xy) xy GROUP BY ALL),
    be AS (SELECT i, s FROM it ORDER BY k DESC LIMIT 1)
    SELECT chr, round(a, 12) AS a, round(c, 9) AS c, round(exp(i + s * (ln(chr_size) - 16)), 9) AS a_pred, round((SELECT quantile_cont(c, 0.5) FROM j), 9) AS c_pred,
        round(a * bp_per_snp * 1000 / (1 + a * bp_per_snp * 1000), 6) AS rho_slide_raw, round(exp(i + s * (ln(chr_size) - 16)) * bp_per_snp * 1000 / (1 + exp(i + s * (ln(chr_size) - 16)) * bp_per_snp * 1000), 6) AS rho_slide_pred FROM j, be""".replace("(i - 16 * s) - s * x + s * 0", "i - s * (x - 16)"))
def size_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trimmed summary of every chromosome with its rate as the robust size model predicts it, and the share of decay that the default slide reaches."""
    scale = decay.chromosome_scale(markers(spark, sf_dir, "chr", "pos"))
    summary, _ = decay.size_model(Tables(spark, "sizes").cut(decay.summarize(table(spark, sf_dir, "decay_sum")).join(broadcast_if_small(scale), "chr")))
    out = rounded(rounded(decay.reached_rho(summary), "rho_slide_raw", "rho_slide_pred"), "c", "c_pred", "a_pred", places=9)
    return rounded(out, "a", places=12).select("chr", "a", "c", "a_pred", "c_pred", "rho_slide_raw", "rho_slide_pred")


_LDW = f"""
    {EDGES}, {MAP}, {PARAMS}, n AS (SELECT e.*, a, rho FROM edges e JOIN params p ON p.chr = e.chr1, (SELECT unnest([{{rhos}}]) AS rho) WHERE chr1 = chr2 AND d < rho / (a * (1 - rho))),
    u AS (SELECT snp1 AS marker, rho, r2 FROM n UNION ALL SELECT snp2, rho, r2 FROM n), v AS (SELECT marker, rho, quantile_cont(r2, 0.5) AS ld_w, count(*) AS n_partners FROM u GROUP BY marker, rho)
    SELECT m.marker, m.chr, r.rho, round(v.ld_w, 9) AS ld_w, coalesce(n_partners, 0) AS n_partners FROM mp m CROSS JOIN (SELECT unnest([{{rhos}}]) AS rho) r LEFT JOIN v ON v.marker = m.marker AND v.rho = r.rho"""


@query("WITH " + _LDW.replace("{rhos}", dbl([0.95])))
def ld_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ldw.ld_support(edges(spark, sf_dir), markers(spark, sf_dir, "chr"), params(spark, sf_dir), [0.95]), "ld_w", places=9)


@query("WITH " + _LDW.replace("{rhos}", dbl(RHOS)))
def ld_w_multi_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ldw.ld_support(edges(spark, sf_dir), markers(spark, sf_dir, "chr"), params(spark, sf_dir), RHOS), "ld_w", places=9)


# graph and stage 1

_CC = """
    cc(v, component) USING KEY (v) AS (
        SELECT DISTINCT u, u FROM ee UNION
        SELECT ee.v, min(cc.component) FROM cc JOIN ee ON ee.u = cc.v JOIN recurring.cc AS old ON old.v = ee.v GROUP BY ee.v HAVING min(cc.component) < min(old.component))"""
_TH = f"""
    {EDGES}, {PARAMS}, th AS (SELECT snp1 AS u, snp2 AS v FROM edges e JOIN params p ON p.chr = e.chr1 WHERE chr1 = chr2 AND r2 >= b + (c - b) * (1 - 0.5e0)),
    ee AS (SELECT u, v FROM th UNION SELECT v, u FROM th)"""


@query(f"WITH RECURSIVE {_TH}, {_CC}, {MAP} SELECT v, component FROM cc UNION ALL SELECT marker, marker FROM mp WHERE marker NOT IN (SELECT v FROM cc)")
def ld_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(cluster.threshold_edges(edges(spark, sf_dir), params(spark, sf_dir), 0.5), markers(spark, sf_dir, "chr").select(F.col("marker").alias("v")))


def _stage1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.stage1(markers(spark, sf_dir, "chr", "pos"), edges(spark, sf_dir), params(spark, sf_dir), 0.5, on_missing="singletons")


#: Complete linkage in rounds, as sets: a state of edges (kind 0) between clusters named by their smallest marker, and merges (kind 1) of each round.
_STAGE1 = f"""
    {EDGES}, {PARAMS}, {MAP}, th AS MATERIALIZED (SELECT snp1, snp2, r2 FROM edges e JOIN params p ON p.chr = e.chr1 WHERE chr1 = chr2 AND r2 >= b + (c - b) * (1 - 0.5e0) AND snp1 IN (SELECT marker FROM mp) AND snp2 IN (SELECT marker FROM mp)),
    rounds(kind, u, v, s) AS (
        SELECT 0, least(snp1, snp2), greatest(snp1, snp2), max(r2) FROM th GROUP BY ALL
        UNION ALL
        (WITH live AS (SELECT u, v, s FROM rounds WHERE kind = 0), ends AS (SELECT u AS w, u, v, s FROM live UNION ALL SELECT v, u, v, s FROM live),
         best AS (SELECT w, arg_min((u, v), (-s, u, v)) AS e FROM ends GROUP BY w), merges AS (SELECT e[2] AS old, e[1] AS new FROM best GROUP BY e HAVING count(*) = 2),
         role AS (SELECT old AS w, new FROM merges UNION ALL SELECT new, new FROM merges),
         moved AS (SELECT coalesce(a.new, u) AS x, coalesce(b.new, v) AS y, (CASE WHEN a.w IS NULL THEN 1 ELSE 2 END) * (CASE WHEN b.w IS NULL THEN 1 ELSE 2 END) AS need, s FROM live LEFT JOIN role a ON a.w = u LEFT JOIN role b ON b.w = v)
         SELECT 0, least(x, y), greatest(x, y), min(s) FROM moved WHERE x <> y GROUP BY 2, 3 HAVING count(*) = max(need)
         UNION ALL SELECT 1, old, new, NULL FROM merges)),
    up AS MATERIALIZED (SELECT u AS old, v AS new FROM rounds WHERE kind = 1),
    climb(marker, cluster) AS (SELECT marker, marker FROM mp UNION ALL SELECT climb.marker, up.new FROM climb JOIN up ON up.old = climb.cluster),
    own AS MATERIALIZED (SELECT marker, cluster FROM climb WHERE cluster NOT IN (SELECT old FROM up)),
    med AS (SELECT marker, quantile_cont(r2, 0.5) AS median_ld FROM (SELECT unnest([snp1, snp2]) AS marker, r2 FROM th JOIN own a ON a.marker = snp1 JOIN own b ON b.marker = snp2 WHERE a.cluster = b.cluster) GROUP BY marker),
    rw AS (SELECT mp.marker, mp.chr, mp.pos, cluster, med.median_ld, count(*) OVER (PARTITION BY mp.chr, cluster) AS n_loci FROM mp JOIN own USING (marker) LEFT JOIN med USING (marker) WHERE mp.chr IS NOT NULL),
    cl1 AS (SELECT marker, chr, pos, first_value(marker) OVER (PARTITION BY chr, cluster ORDER BY CASE WHEN n_loci > 2 THEN -median_ld END NULLS FIRST, pos NULLS FIRST, marker) AS core, n_loci, median_ld FROM rw)"""


@query(f"WITH RECURSIVE {_STAGE1} SELECT marker, chr, pos, core, n_loci, marker = core AS is_core, round(median_ld, 9) AS median_ld FROM cl1")
def stage1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_stage1(spark, sf_dir), "median_ld", places=9)


@query(f"WITH RECURSIVE {_STAGE1} SELECT marker, chr, pos, n_loci, round(median_ld, 9) AS median_ld FROM cl1 WHERE marker = core")
def stage1_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.pruned(_stage1(spark, sf_dir)), "median_ld", places=9)


@query(f"WITH RECURSIVE {_STAGE1} SELECT chr, core, round(max(CASE WHEN marker = core THEN median_ld END), 9) AS median_ld, count(*) AS n_snps, array_to_string(list(marker ORDER BY pos NULLS FIRST, marker), ',') AS members FROM cl1 GROUP BY chr, core")
def stage1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.cluster_table(_stage1(spark, sf_dir)), "median_ld", places=9).withColumn("members", F.array_join("members", ","))


_CL = f"{MAP}, cl AS (SELECT marker, chr, pos, cl_id, ld_w, CAST(count(*) OVER (PARTITION BY cl_id) AS BIGINT) AS n_loci, is_core IS TRUE AS is_core FROM mp WHERE cl_id IS NOT NULL)"


def _loaded_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markers(spark, sf_dir).where("cl_id IS NOT NULL")
    sizes = m.groupBy("cl_id").agg(F.count(F.lit(1)).alias("size"))
    return m.join(sizes, "cl_id").select("marker", "chr", "pos", "cl_id", "ld_w", F.col("size").alias("n_loci"), F.coalesce("is_core", F.lit(False)).alias("is_core"))


@query(f"WITH {_CL} SELECT chr, count(*) AS n_markers, count(*) FILTER (is_core) AS n_clusters, count(*) FILTER (is_core AND n_loci = 1) AS n_single, max(n_loci) AS largest, round(count(*) FILTER (is_core) / count(*), 6) AS kept_share, round(CASE WHEN count(*) FILTER (is_core) > 0 THEN count(*) FILTER (is_core AND n_loci = 1) / count(*) FILTER (is_core) END, 6) AS single_share FROM cl GROUP BY chr")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.cluster_summary(_loaded_clusters(spark, sf_dir)), "kept_share", "single_share")


@query(f"WITH {_CL} SELECT n_loci, count(*) AS n_clusters FROM cl WHERE is_core GROUP BY n_loci")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.size_distribution(_loaded_clusters(spark, sf_dir))


@query(f"WITH {MAP} SELECT cl_id, min(chr) AS chr, min(pos) AS pos_min, max(pos) AS pos_max, quantile_cont(pos, 0.5) AS pos_median, count(*) AS n_loci, max(pos) - min(pos) AS span FROM mp WHERE cl_id IS NOT NULL GROUP BY cl_id")
def cluster_level_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_level_map(markers(spark, sf_dir, "chr", "pos", "cl_id"))


@query(f"WITH {MAP}, {GENO_TABLE}, r AS (SELECT DISTINCT marker, chr, pos FROM h) SELECT r.marker, r.chr, r.pos, mp.cl_id, mp.grp FROM mp RIGHT JOIN r ON mp.marker = r.marker AND mp.chr = r.chr AND mp.pos = r.pos")
def genotyped_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All genotyped markers with what the map knows of their cluster."""
    return cluster.with_positions(markers(spark, sf_dir).select("marker", "chr", "pos", "cl_id", "grp"), calls(spark, sf_dir))


# stage 2

_FLAG = f"{MAP}, fl AS (SELECT chr, cl_id AS cluster, min(pos) AS pos_min, max(pos) AS pos_max, count(*) AS n_loci, coalesce(bool_or(ld_w > 0.4e0), false) OR count(*) >= 20 AS flagged FROM mp WHERE cl_id IS NOT NULL AND chr IS NOT NULL GROUP BY chr, cl_id)"


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prune.flag_clusters(markers(spark, sf_dir, "chr", "pos", "ld_w", "cl_id").where("cl_id IS NOT NULL AND chr IS NOT NULL").withColumnRenamed("cl_id", "cluster"), "ld_w", 0.4, 20)


@query(f"WITH {_FLAG} SELECT * FROM fl")
def flag_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir)


@query(f"""
    WITH {_FLAG}, {PARAMS}, t AS (SELECT fl.*, 0.95e0 / (a * (1 - 0.95e0)) AS gap FROM fl JOIN params USING (chr) WHERE flagged),
    u AS (SELECT *, CASE WHEN coalesce(pos_min - lag(pos_max) OVER w > gap, true) THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY chr ORDER BY pos_min NULLS LAST, pos_max NULLS LAST, cluster))
    SELECT chr, cluster, CAST(sum(new) OVER (PARTITION BY chr ORDER BY pos_min NULLS LAST, pos_max NULLS LAST, cluster ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM u""")
def run_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = params(spark, sf_dir).withColumnRenamed("a", "a_pred")
    known = _flags(spark, sf_dir).where("flagged").join(broadcast_if_small(p.select("chr")), "chr", "left_semi")
    clusters, start, end = prune.gaps(known, p, 0.95)
    return prune.split_runs(clusters, "gap", start, end).select("chr", "cluster", "run")


@query(SQL["run_split"].replace("fl JOIN params USING (chr)", "fl LEFT JOIN params USING (chr)"))
def run_split_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``run_split``, with the flagged clusters of chromosomes without a usable fit, each as a run of its own."""
    p = params(spark, sf_dir).withColumnRenamed("a", "a_pred")
    clusters, start, end = prune.gaps(_flags(spark, sf_dir).where("flagged"), p, 0.95, on_missing="singletons")
    return prune.split_runs(clusters, "gap", start, end).select("chr", "cluster", "run")


_GENMAP = "gm AS (SELECT chr, pos, CAST(max(cm) AS DOUBLE) AS cm FROM (SELECT chr, (pos // 500000) * 500000 AS pos, count(*) OVER (PARTITION BY chr ORDER BY pos // 500000) / 10.0e0 AS cm FROM mp WHERE chr IS NOT NULL AND pos IS NOT NULL) GROUP BY chr, pos)"


def _genetic_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up recombination map: a tenth of a centimorgan a marker, known every half megabase."""
    from pyspark.sql.window import Window

    bins = markers(spark, sf_dir, "chr", "pos").where("chr IS NOT NULL AND pos IS NOT NULL").groupBy("chr", F.expr("pos DIV 500000").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return bins.select("chr", (F.col("k") * 500000).alias("pos"), (F.sum("n").over(Window.partitionBy("chr").orderBy("k")) / 10).alias("cm"))


@query(f"""
    WITH {MAP}, {_GENMAP}, seg AS (SELECT chr, pos AS p0, cm AS c0, lead(pos) OVER w AS p1, lead(cm) OVER w AS c1 FROM gm WINDOW w AS (PARTITION BY chr ORDER BY pos)),
    en AS (SELECT chr, min(pos) AS f, max(pos) AS l, arg_min(cm, pos) AS cf, arg_max(cm, pos) AS cl FROM gm GROUP BY chr HAVING min(pos) < max(pos))
    SELECT marker, mp.chr, mp.pos, round(CASE WHEN pos <= f THEN cf WHEN pos >= l THEN cl ELSE c0 + (c1 - c0) * (pos - p0) / (p1 - p0) END, 6) AS cm
    FROM mp LEFT JOIN en ON en.chr = mp.chr LEFT JOIN seg ON seg.chr = mp.chr AND p1 IS NOT NULL AND pos >= p0 AND pos < p1""")
def interpolate_cm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(genmap.interpolate_cm(_genetic_map(spark, sf_dir), markers(spark, sf_dir, "chr", "pos")), "cm")


def clustered_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived genotypes with four neighbouring positions as one cluster of twelve markers."""
    return fixture(spark, sf_dir).select(F.expr("CAST(snp_idx DIV 12 AS BIGINT)").alias("cluster"), F.col("snp_idx").alias("ord"), "ind_id", "dosage")


_POL = f"""
    {GENO_FIXTURE}, q AS (SELECT snp_idx // 12 AS cluster, snp_idx AS ord, ind_id, dosage FROM g),
    cmp AS (SELECT cluster, ord, count(dosage) AS n_obs FROM q GROUP BY cluster, ord),
    rf AS (SELECT cluster, ord AS ref FROM cmp QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n_obs DESC, ord) = 1),
    rr AS (SELECT a.cluster, a.ord, count(*) AS n, sum(a.dosage) AS sx, sum(b.dosage) AS sy, sum(a.dosage * a.dosage) AS sxx, sum(b.dosage * b.dosage) AS syy, sum(a.dosage * b.dosage) AS sxy
           FROM q a JOIN rf USING (cluster) JOIN q b ON b.cluster = a.cluster AND b.ord = rf.ref AND b.ind_id = a.ind_id WHERE a.dosage IS NOT NULL AND b.dosage IS NOT NULL GROUP BY 1, 2),
    pol AS (SELECT cmp.cluster, cmp.ord, coalesce(n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0 AND n * sxy - sx * sy < 0, false) AS flip FROM cmp LEFT JOIN rr USING (cluster, ord)),
    con AS (SELECT q.cluster, ind_id, avg(CAST(CASE WHEN flip THEN 2 - dosage ELSE dosage END AS DOUBLE)) AS value FROM q JOIN pol USING (cluster, ord) GROUP BY 1, 2),
    sco AS (SELECT cluster, corr(round_even(value, 0), value) AS r FROM con GROUP BY cluster)"""


@query(f"WITH {_POL} SELECT cluster, ord, flip FROM pol")
def emlg_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emlg.polarity(clustered_fixture(spark, sf_dir))


@query(f"WITH {_POL} SELECT cluster, ind_id, round(value, 6) AS value FROM con")
def emlg_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(emlg.consensus(clustered_fixture(spark, sf_dir)), "value")


@query(f"WITH {_POL} SELECT cluster, 12 AS n_loci, round(r * r, 6) AS score FROM sco")
def make_emlgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(emlg.make_emlgs(clustered_fixture(spark, sf_dir))[1], "score")


_BEST = f"""
    {_POL}, mr AS (SELECT q.cluster, q.ord, corr(CAST(dosage AS DOUBLE), value) AS r FROM q JOIN con USING (cluster, ind_id) WHERE dosage IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2),
    best AS (SELECT cluster, ord AS best_ord, r AS best_r FROM mr WHERE r IS NOT NULL AND NOT isnan(r) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(abs(r), 12) DESC, ord) = 1),
    hd AS (SELECT cluster, min(ord) AS representative FROM q GROUP BY cluster)"""


def _best(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    g = clustered_fixture(spark, sf_dir)
    cons = emlg.consensus(g)
    return g, cons, emlg.best_markers(g, cons, g.groupBy("cluster").agg(F.min("ord").alias("representative")))


@query(f"WITH {_BEST} SELECT cluster, representative, best_ord, round(best_r, 6) AS best_r, round(mr.r, 6) AS rep_r, best_ord = representative AS rep_is_best, best_r < 0 AS flipped FROM hd JOIN best USING (cluster) LEFT JOIN mr ON mr.cluster = hd.cluster AND mr.ord = hd.representative")
def best_snp_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_best(spark, sf_dir)[2], "best_r", "rep_r")


@query(f"""
    WITH {_BEST}, fil AS (SELECT con.cluster, con.ind_id, CAST(q.dosage AS DOUBLE) AS observed, coalesce(CAST(q.dosage AS DOUBLE), greatest(0, least(2, round_even(CASE WHEN best_r < 0 THEN 2 - value ELSE value END, 0)))) AS filled
        FROM con JOIN best USING (cluster) LEFT JOIN q ON q.cluster = con.cluster AND q.ind_id = con.ind_id AND q.ord = best.best_ord)
    SELECT cluster, count(*) AS n_ind, count(observed) AS n_obs, count(filled) - count(observed) AS n_filled, count(*) - count(filled) AS n_resid_na FROM fil GROUP BY cluster""")
def best_snp_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emlg.fill_counts(emlg.fill_best(*_best(spark, sf_dir)))


def _fixture_stage1(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Derived genotypes as ``ind_id, marker, dosage`` and clusters of three neighbouring markers with a support of their own."""
    g = fixture(spark, sf_dir)
    clustered = g.select(F.col("snp_idx").alias("marker"), "chr", "pos").distinct().withColumn("cluster", F.expr("marker DIV 3"))
    clustered = clustered.withColumns({"is_core": F.col("marker") % 3 == 1, "core": F.col("cluster") * 3 + 1, "ld_w": F.when(F.col("cluster") % 3 < 2, 0.8).otherwise(0.1)})
    return g.select("ind_id", F.col("snp_idx").alias("marker"), "dosage"), clustered


@query()
def stage2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, clustered = _fixture_stage1(spark, sf_dir)
    return rounded(prune.stage2(g, clustered, "ld_w", 0.5, distance_threshold=1500, score_threshold=0.5).groups, "score")


@query()
def stage2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, clustered = _fixture_stage1(spark, sf_dir)
    return rounded(prune.stage2(g, clustered, "ld_w", 0.5, distance_threshold=1500, score_threshold=0.5).emlg, "value")


# population structure

_POPS = """
    pp AS (SELECT marker, pop, count(*) AS n, CAST(sum(dosage) AS DOUBLE) AS s, CAST(sum(dosage * dosage) AS DOUBLE) AS q, min(dosage) AS lo, max(dosage) AS hi FROM h WHERE dosage IS NOT NULL AND pop IS NOT NULL GROUP BY marker, pop)"""


@query(f"""
    WITH {GENO_TABLE}, {_POPS}, t AS (SELECT marker, sum(n) AS n_obs, count(*) AS n_pops, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b, sum(n * 2 * (s / (2 * n)) * (1 - s / (2 * n))) AS w, min(lo) AS lo, max(hi) AS hi FROM pp GROUP BY marker)
    SELECT marker, CAST(n_obs AS BIGINT) AS n_obs, n_pops, CASE WHEN n_obs >= 3 AND n_pops >= 2 AND lo < hi THEN round((b - s * s / n_obs) / (q - s * s / n_obs), 6) END AS r2_pop,
        CASE WHEN n_obs >= 3 AND n_pops >= 2 AND lo < hi THEN round(greatest(0, least(1, (2 * (s / (2 * n_obs)) * (1 - s / (2 * n_obs)) - w / n_obs) / (2 * (s / (2 * n_obs)) * (1 - s / (2 * n_obs))))), 6) END AS fst FROM t""")
def population_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(popgen.population_stats(calls(spark, sf_dir), ["marker"]), "r2_pop", "fst")


@query(f"WITH {GENO_TABLE}, {_POPS} SELECT marker, pop, round(s / n, 6) AS mean FROM pp")
def ohta_population_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(popgen.prepare(calls(spark, sf_dir))[0], "mean")


_NEAR = "m AS (SELECT chr, marker, row_number() OVER (PARTITION BY chr ORDER BY pos, marker) AS rk FROM (SELECT DISTINCT chr, marker, pos FROM h)), prs AS (SELECT a.marker AS snp1, b.marker AS snp2 FROM m a JOIN m b ON a.chr = b.chr AND a.rk - b.rk BETWEEN 1 AND 3)"


def _near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = genotypes.ranked_markers(calls(spark, sf_dir))
    later = m.select("chr", F.col("snp_idx").alias("snp1"), F.col("rk"))
    earlier = m.select("chr", F.col("snp_idx").alias("snp2"), F.explode(F.array(*[F.col("rk") + i for i in (1, 2, 3)])).alias("rk"))
    return later.join(earlier, ["chr", "rk"]).select("snp1", "snp2")


@query(f"""
    WITH {GENO_TABLE}, {_NEAR} SELECT snp1, snp2, count(*) AS n, {", ".join(f"count(*) FILTER (a.dosage = {i} AND b.dosage = {j}) AS n{i}{j}" for i in range(3) for j in range(3))}
    FROM prs JOIN h a ON a.marker = snp1 JOIN h b ON b.marker = snp2 AND b.ind_id = a.ind_id WHERE a.dosage IS NOT NULL AND b.dosage IS NOT NULL GROUP BY snp1, snp2""")
def joint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popgen.joint_counts(_near_pairs(spark, sf_dir), calls(spark, sf_dir))


_OHTA = f"""
    WITH {GENO_TABLE}, {_NEAR}, c AS (SELECT * FROM h WHERE dosage IS NOT NULL AND pop IS NOT NULL),
    tm AS (SELECT marker, avg(dosage) AS mu FROM c GROUP BY marker), pm AS (SELECT marker, pop, avg(dosage) AS mu FROM c GROUP BY marker, pop),
    kp AS (SELECT snp1, snp2, p.pop FROM prs JOIN tm t ON t.marker = snp1 AND t.mu BETWEEN 0.2 AND 1.8 JOIN tm u ON u.marker = snp2 AND u.mu BETWEEN 0.2 AND 1.8
           JOIN pm p ON p.marker = snp1 AND p.mu BETWEEN 0.1 AND 1.9 JOIN pm r ON r.marker = snp2 AND r.pop = p.pop AND r.mu BETWEEN 0.1 AND 1.9),
    jo AS (SELECT kp.snp1, kp.snp2, kp.pop, CAST(a.dosage AS DOUBLE) AS x, CAST(b.dosage AS DOUBLE) AS y FROM kp JOIN c a ON a.marker = snp1 AND a.pop = kp.pop JOIN c b ON b.marker = snp2 AND b.ind_id = a.ind_id),
    f AS (SELECT snp1, snp2, pop, count(*) AS n, 1 - sum(x) / (2 * count(*)) AS p0, sum(x) / (2 * count(*)) AS p2, 1 - sum(y) / (2 * count(*)) AS q0, sum(y) / (2 * count(*)) AS q2,
        (count(*) FILTER (x = 0 AND y = 0) * 2 + count(*) FILTER (x = 0 AND y = 1) + count(*) FILTER (x = 1 AND y = 0) + 0.5e0 * count(*) FILTER (x = 1 AND y = 1)) / count(*) AS t00,
        (count(*) FILTER (x = 0 AND y = 2) * 2 + count(*) FILTER (x = 0 AND y = 1) + count(*) FILTER (x = 1 AND y = 2) + 0.5e0 * count(*) FILTER (x = 1 AND y = 1)) / count(*) AS t02,
        (count(*) FILTER (x = 2 AND y = 0) * 2 + count(*) FILTER (x = 1 AND y = 0) + count(*) FILTER (x = 2 AND y = 1) + 0.5e0 * count(*) FILTER (x = 1 AND y = 1)) / count(*) AS t20,
        (count(*) FILTER (x = 2 AND y = 2) * 2 + count(*) FILTER (x = 2 AND y = 1) + count(*) FILTER (x = 1 AND y = 2) + 0.5e0 * count(*) FILTER (x = 1 AND y = 1)) / count(*) AS t22
        FROM jo GROUP BY snp1, snp2, pop),
    lo AS (SELECT snp1, snp2, pop, unnest(['00', '02', '20', '22']) AS st, unnest([t00, t02, t20, t22]) AS t, unnest([2 * p0 * q0, 2 * p0 * q2, 2 * p2 * q0, 2 * p2 * q2]) AS p, unnest([p0, p0, p2, p2]) AS fi, unnest([q0, q2, q0, q2]) AS fj FROM f),
    av AS (SELECT snp1, snp2, st, count(*) AS k, avg(t) AS tb, 2 * avg(fi) * avg(fj) AS pb FROM lo GROUP BY ALL),
    d AS (SELECT snp1, snp2, max(k) AS n_pops, sum((t - pb) * (t - pb)) / max(k) AS d2it, sum((t - p) * (t - p)) / max(k) AS d2is, sum((p / 2 - pb / 2) * (p / 2 - pb / 2)) / max(k) AS d2st,
          sum((tb - pb) * (tb - pb)) / max(k) / 4 AS dp2st, sum((t - tb) * (t - tb)) / max(k) / 4 AS dp2is FROM lo JOIN av USING (snp1, snp2, st) GROUP BY snp1, snp2),
    rr AS (SELECT snp1, snp2, CASE WHEN count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN pow(corr(x, y), 2) END AS r2 FROM jo GROUP BY snp1, snp2),
    ps AS (SELECT marker, pop, CAST(count(*) AS DOUBLE) AS n, CAST(sum(dosage) AS DOUBLE) AS s, CAST(sum(dosage * dosage) AS DOUBLE) AS q, min(dosage) AS lo, max(dosage) AS hi FROM c GROUP BY marker, pop),
    sd AS (SELECT kp.*, 1 AS side, ps.* EXCLUDE (marker, pop) FROM kp JOIN ps ON ps.marker = snp1 AND ps.pop = kp.pop UNION ALL SELECT kp.*, 2, ps.* EXCLUDE (marker, pop) FROM kp JOIN ps ON ps.marker = snp2 AND ps.pop = kp.pop),
    ls AS (SELECT snp1, snp2, side, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b, sum(n * 2 * (s / (2 * n)) * (1 - s / (2 * n))) AS w, min(lo) < max(hi) AND sum(n) >= 3 AND count(*) >= 2 AS ok FROM sd GROUP BY ALL),
    lm AS (SELECT snp1, snp2, avg(CASE WHEN ok THEN (b - s * s / n) / (q - s * s / n) END) AS r2_pop_mean,
        avg(CASE WHEN ok AND s / (2 * n) * (1 - s / (2 * n)) > 0 THEN greatest(0, least(1, (2 * (s / (2 * n)) * (1 - s / (2 * n)) - w / n) / (2 * (s / (2 * n)) * (1 - s / (2 * n))))) END) AS fst_mean FROM ls GROUP BY ALL)
    SELECT snp1, snp2, CAST(n_pops AS DOUBLE) AS n_pops, round(d2it, 6) AS d2it, round(d2is, 6) AS d2is, round(d2st, 6) AS d2st, round(dp2st, 6) AS dp2st, round(dp2is, 6) AS dp2is, round(r2, 6) AS r2,
        CASE WHEN n_pops > 0 THEN round(r2_pop_mean, 6) END AS r2_pop_mean, CASE WHEN n_pops > 0 THEN round(fst_mean, 6) END AS fst_mean
    FROM prs LEFT JOIN d USING (snp1, snp2) LEFT JOIN rr USING (snp1, snp2) LEFT JOIN lm USING (snp1, snp2)"""


@query(_OHTA)
def ohta_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popgen.ohta_scan(_near_pairs(spark, sf_dir), calls(spark, sf_dir))


@query(_OHTA.replace(" / max(k) / 4 AS dp2st", " / max(k) AS dp2st").replace(" / max(k) / 4 AS dp2is", " / max(k) AS dp2is"))
def ohta_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popgen.ohta_scan(_near_pairs(spark, sf_dir), calls(spark, sf_dir), variant="original")


# association


def phenotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 for individuals of the marine ecotype, 0 for the others that have one."""
    return table(spark, sf_dir, "pheno").where("ecotype IS NOT NULL").select(F.col("id").alias("ind_id"), (F.col("ecotype") == "Marine").cast("int").alias("y"))


@query(f"""
    WITH {GENO_TABLE}, t AS (SELECT chr, marker AS snp_idx, count(*) AS n, CAST(sum(dosage) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(dosage * dosage) AS BIGINT) AS sxx, CAST(sum(y * y) AS BIGINT) AS syy, CAST(sum(dosage * y) AS BIGINT) AS sxy
        FROM h JOIN (SELECT id AS ind_id, CASE WHEN ecotype = 'Marine' THEN 1 ELSE 0 END AS y FROM pheno WHERE ecotype IS NOT NULL) USING (ind_id) WHERE dosage IS NOT NULL GROUP BY chr, marker),
    u AS (SELECT *, CASE WHEN n >= 3 THEN {R2} END AS r2 FROM t) SELECT chr, snp_idx, n, round(r2, 6) AS r2, CASE WHEN r2 < 1 THEN round(r2 / (1 - r2) * (n - 2), 6) END AS f FROM u""")
def assoc_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assoc.simple_association(calls(spark, sf_dir), phenotype(spark, sf_dir)), "r2", "f")


def _null_model(spark: SparkSession, sf_dir: str) -> assoc.NullModel:
    who = assoc.cohort(phenotype(spark, sf_dir))
    inds = who["ind_id"].to_numpy()
    return assoc.null_model(inds, who["y"].to_numpy(), assoc.kinship(calls(spark, sf_dir), inds))


@query()
def emmax_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assoc.emmax(calls(spark, sf_dir), _null_model(spark, sf_dir))


@query(f"""
    WITH {GENO_TABLE}, co AS (SELECT id AS ind_id, max(CASE WHEN ecotype = 'Marine' THEN 1.0e0 ELSE 0 END) AS y, max(coalesce(pop_id, 0)) AS z FROM pheno WHERE ecotype IS NOT NULL AND id IS NOT NULL GROUP BY id),
    rs AS (SELECT ind_id, y - i - s * z AS e FROM co, (SELECT regr_intercept(y, z) AS i, regr_slope(y, z) AS s FROM co)), mk AS (SELECT DISTINCT chr, marker FROM h),
    mm AS (SELECT marker, avg(dosage) AS mu FROM h JOIN co USING (ind_id) GROUP BY marker),
    x AS (SELECT mk.chr, mk.marker, coalesce(h.dosage, mu, 0) AS x, e FROM mk CROSS JOIN rs LEFT JOIN h ON h.marker = mk.marker AND h.ind_id = rs.ind_id LEFT JOIN mm ON mm.marker = mk.marker),
    r AS (SELECT chr, marker, count(*) AS n, CASE WHEN var_pop(x) > 1e-9 THEN corr(x, e) * corr(x, e) END AS r2 FROM x GROUP BY chr, marker)
    SELECT chr, marker AS snp_idx, round(r2 / (1 - r2) * (n - 2), 6) AS f, round(r2, 6) AS r2 FROM r""")
def emmax_unrelated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed model where nobody is related, with the population as covariate: regression on what the covariate leaves."""
    z = table(spark, sf_dir, "pheno").where("ecotype IS NOT NULL AND id IS NOT NULL").groupBy(F.col("id").alias("ind_id")).agg(F.max(F.coalesce("pop_id", F.lit(0)).cast("double")).alias("z"))
    who = assoc.cohort(phenotype(spark, sf_dir)).merge(z.toPandas(), on="ind_id")  # one row an individual
    model = assoc.null_model(who["ind_id"].to_numpy(), who["y"].to_numpy(), np.eye(len(who)), who["z"].to_numpy())
    return rounded(assoc.emmax(calls(spark, sf_dir), model), "f", "r2").drop("p")


@query()
def emmax_by_chromosome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chromosome's markers against the kinship of all others."""
    who = assoc.cohort(phenotype(spark, sf_dir))
    return assoc.emmax_by_chromosome(calls(spark, sf_dir), who["ind_id"].to_numpy(), who["y"].to_numpy())


@query()
def emmax_stepdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, g = _null_model(spark, sf_dir), calls(spark, sf_dir)
    return assoc.stepdown_p(assoc.emmax(g, model), assoc.null_statistics(g, model, 1000, how="model", binary=True), 1000)


# outliers


@query(f"""
    WITH {PVALUES}, k AS (SELECT *, count(*) OVER (ORDER BY pval) AS rk, count(*) OVER () AS m FROM pv WHERE pval IS NOT NULL)
    SELECT marker, chr, pos, pval, round(least(1, min(pval * m / rk) OVER (ORDER BY pval DESC)), 9) AS q FROM k""")
def bh_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bh_adjust(pvalues(spark, sf_dir).where("pval IS NOT NULL").drop("ld_w"), "pval", "q"), "q", places=9)


_RMSC = f"""
    {PVALUES}, ok AS (SELECT * FROM pv WHERE pval IS NOT NULL AND ld_w IS NOT NULL),
    cut AS (SELECT q, t AS threshold FROM (SELECT unnest([{dbl(outlier.GRID)}]) AS q, unnest(quantile_cont(ld_w, [{", ".join(map(str, outlier.GRID))}])) AS t FROM ok)),
    kept AS (SELECT q, threshold, pval, count(*) OVER (PARTITION BY q) AS m, count(*) OVER (PARTITION BY q ORDER BY pval) AS k FROM cut JOIN ok ON ld_w >= threshold),
    curve AS (SELECT q, min(threshold) AS threshold, max(m) AS n_kept, coalesce(max(k) FILTER (pval * m / k < 0.05e0), 0) AS rejections FROM kept GROUP BY q)"""


@query(f"WITH {_RMSC} SELECT q, round(threshold, 9) AS threshold, n_kept, rejections FROM curve")
def rmsc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outlier.rmsc_curve(outlier.usable(pvalues(spark, sf_dir))), "threshold", places=9)


_CAND_OF = """
    k AS (SELECT ok.*, count(*) OVER (ORDER BY pval) AS rk, count(*) OVER () AS m FROM ok, th WHERE ld_w >= t),
    cand AS (SELECT marker, chr, pos, pval, ld_w, least(1, min(pval * m / rk) OVER (ORDER BY pval DESC)) AS q_snp FROM k)"""
_CAND = f"{PVALUES}, ok AS (SELECT * FROM pv WHERE pval IS NOT NULL AND ld_w IS NOT NULL), th AS (SELECT quantile_cont(ld_w, 0.5) AS t FROM ok), {_CAND_OF}"


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tables = Tables(spark, "candidates")
    rows = tables.cut(outlier.usable(pvalues(spark, sf_dir)))
    level = quantiles(rows.where("pval IS NOT NULL"), "ld_w", [0.5])[0]
    return rows, tables.cut(outlier.candidates(rows, level))


@query(f"WITH {_CAND} SELECT marker, chr, pos, pval, ld_w, round(q_snp, 9) AS q_snp, q_snp < 0.05e0 AS sig FROM cand")
def outlier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_candidates(spark, sf_dir)[1], "q_snp", places=9)


_TABLE_OF = f"""
    {EDGES}, th2 AS (SELECT snp1 AS u, snp2 AS v FROM edges WHERE chr1 = chr2 AND r2 >= 0.5e0 AND snp1 IN (SELECT marker FROM cand) AND snp2 IN (SELECT marker FROM cand)),
    ee AS (SELECT u, v FROM th2 UNION SELECT v, u FROM th2), {_CC},
    lab AS (SELECT cand.*, coalesce(component, marker) AS component FROM cand LEFT JOIN cc ON cc.v = marker),
    br AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chr, component ORDER BY pos, marker) > 500000 THEN 1 ELSE 0 END AS new FROM lab),
    mem AS (SELECT *, component || '#' || CAST(sum(new) OVER (PARTITION BY chr, component ORDER BY pos, marker ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM br),
    tab AS (SELECT chr, cluster, count(*) AS n, count(*) FILTER (q_snp < 0.05e0) AS n_sig, min(pos) AS "start", max(pos) AS "end" FROM mem GROUP BY chr, cluster)"""


_OUTLIER = f"{_CAND}, {_TABLE_OF}"


@query(f"WITH RECURSIVE {_OUTLIER} SELECT * FROM tab")
def outlier_cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlier.cluster_counts(outlier.ld_clusters(_candidates(spark, sf_dir)[1], edges(spark, sf_dir), 0.5, gap=500_000))


_NULL_OF = """
    pc AS (SELECT max(pval) AS pcut FROM cand WHERE q_snp < 0.05e0),
    bg AS (SELECT chr, list(CASE WHEN pval <= pcut THEN 1 ELSE 0 END ORDER BY pos, marker) AS h, count(*) AS nb FROM pv, pc WHERE pval IS NOT NULL AND marker NOT IN (SELECT marker FROM cand) GROUP BY chr HAVING count(*) >= 2),
    sh AS (SELECT DISTINCT chr, n, n_sig FROM tab),
    ro AS (SELECT chr, n, n_sig, unnest(range(1, nb + 1)) AS st, nb, h FROM sh JOIN bg USING (chr)),
    su AS (SELECT chr, n, n_sig, (n // nb) * list_sum(h) + CASE WHEN n % nb = 0 THEN 0 ELSE list_sum(list_slice(h || h, st, st + n % nb - 1)) END AS hits FROM ro),
    fr AS (SELECT chr, n, n_sig, avg(CASE WHEN hits >= n_sig THEN 1.0e0 ELSE 0 END) AS frac FROM su GROUP BY chr, n, n_sig)"""


@query(f"WITH RECURSIVE {_OUTLIER}, {_NULL_OF} SELECT cluster, round(frac, 9) AS frac, round((1 + 1000 * frac) / 1001, 9) AS emp_p FROM tab LEFT JOIN fr USING (chr, n, n_sig)")
def background_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cand = _candidates(spark, sf_dir)
    pcut = cand.where("sig").agg(F.max("pval").alias("p")).first()["p"]
    counts = outlier.cluster_counts(outlier.ld_clusters(cand, edges(spark, sf_dir), 0.5, gap=500_000))
    return rounded(outlier.background_exact(rows.join(cand.select("marker"), "marker", "left_anti"), counts, pcut), "frac", "emp_p", places=9)


@query(f"""
    WITH RECURSIVE {_RMSC}, th AS (SELECT threshold AS t FROM curve ORDER BY rejections DESC, q LIMIT 1), {_CAND_OF}, {_TABLE_OF}, {_NULL_OF},
    te AS (SELECT tab.*, CASE WHEN n_sig >= 1 THEN (1 + 1000 * frac) / 1001 END AS emp_p FROM tab LEFT JOIN fr USING (chr, n, n_sig)),
    rk AS (SELECT cluster, emp_p, count(*) OVER (ORDER BY emp_p) AS rk, count(*) OVER () AS m FROM te WHERE emp_p IS NOT NULL),
    ad AS (SELECT cluster, least(1, min(emp_p * m / rk) OVER (ORDER BY emp_p DESC)) AS emp_q FROM rk)
    SELECT chr, cluster, n, n_sig, "start", "end", round(emp_p, 9) AS emp_p, round(emp_q, 9) AS emp_q, coalesce(emp_q < 0.05e0, false) AS significant,
        rank() OVER (ORDER BY coalesce(emp_q < 0.05e0, false) DESC, emp_p NULLS FIRST, n_sig DESC) AS rank FROM te LEFT JOIN ad USING (cluster)""")
def outlier_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outlier.outlier_clusters(pvalues(spark, sf_dir), edges(spark, sf_dir), gap=500_000).clusters, "emp_p", "emp_q", places=9)


@query()
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotyped markers clustered by the pairs among them, against permuted phenotypes."""
    g, model = calls(spark, sf_dir), _null_model(spark, sf_dir)
    tested = assoc.emmax(g, model)
    pos = g.select("snp_idx", "marker", "pos").distinct()
    rows = tested.join(pos, "snp_idx").select("marker", "chr", "pos", F.col("p").alias("pval"), F.lit(1.0).alias("ld_w"))
    # every marker has the same support, so the threshold keeps them all
    return outlier.outlier_clusters(rows, pairs.edge_list(g), threshold=0.0, null="permutation", geno=g, model=model).clusters


# data behind figures

_FIRST = "SELECT chr, id, dense_rank() OVER (PARTITION BY chr ORDER BY min(pos), id) AS k FROM {0} GROUP BY chr, id"


@query(f"""
    WITH {MAP}, gr AS (SELECT group_id AS id, upper(unnest(members)) AS marker FROM ld_groups),
    c AS (SELECT chr, marker, pos, ld_w AS value, cl_id FROM mp WHERE cl_id IS NOT NULL AND (chr, cl_id) IN (SELECT (chr, cl_id) FROM mp WHERE ld_w > 0.4e0)),
    s1 AS (SELECT chr, marker, pos, value, CAST(cl_id AS VARCHAR) AS id FROM c), s2 AS (SELECT c.chr, c.marker, pos, value, gr.id FROM c JOIN gr USING (marker))
    SELECT 'stage1' AS panel, chr, marker, pos, value, id, (k - 1) % 12 + 1 AS colour FROM s1 JOIN ({_FIRST.format("s1")}) USING (chr, id)
    UNION ALL SELECT 'stage2', chr, marker, pos, value, id, (k - 1) % 12 + 1 FROM s2 JOIN ({_FIRST.format("s2")}) USING (chr, id)""")
def plot_stage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markers(spark, sf_dir, "chr", "pos", "ld_w", "cl_id").where("cl_id IS NOT NULL").withColumnRenamed("cl_id", "cluster")
    groups = table(spark, sf_dir, "ld_groups").select("group_id", F.transform("members", F.upper).alias("members"))
    return plotdata.stage_points(m, groups, None, "ld_w", 0.4)


@query(SQL["plot_stage_points"].replace("(chr, cl_id) IN (", "(chr, cl_id) NOT IN ("))
def plot_stage_points_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``plot_stage_points``, of the clusters without strong support."""
    m = markers(spark, sf_dir, "chr", "pos", "ld_w", "cl_id").where("cl_id IS NOT NULL").withColumnRenamed("cl_id", "cluster")
    groups = table(spark, sf_dir, "ld_groups").select("group_id", F.transform("members", F.upper).alias("members"))
    return plotdata.stage_points(m, groups, None, "ld_w", 0.4, direction="low")


@query("SELECT chr, starts_with(group_id, 'F') AS flagged, count(*) AS n_groups, CAST(sum(n_loci) AS BIGINT) AS n_loci, max(n_loci) AS largest FROM ld_groups GROUP BY ALL")
def group_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.group_kinds(table(spark, sf_dir, "ld_groups"))


@query(f"""
    WITH RECURSIVE {GENO_FIXTURE}, t AS (SELECT * FROM g WHERE dosage IS NOT NULL),
    p AS (SELECT a.snp_idx AS u, b.snp_idx AS v, {R2_SUMS} FROM (SELECT *, dosage AS x FROM t) a JOIN (SELECT *, dosage AS y FROM t) b ON a.chr = b.chr AND a.ind_id = b.ind_id AND a.snp_idx < b.snp_idx GROUP BY ALL),
    rounds(k, kind, u, v, s) AS (
        SELECT 0, 0, u, v, round(r2, 9) FROM (SELECT *, {R2} AS r2 FROM p) WHERE r2 IS NOT NULL
        UNION ALL
        (WITH live AS (SELECT k, u, v, s FROM rounds WHERE kind = 0), ends AS (SELECT k, u AS w, u, v, s FROM live UNION ALL SELECT k, v, u, v, s FROM live),
         best AS (SELECT k, w, arg_min((u, v), (-s, u, v)) AS e FROM ends GROUP BY k, w), merges AS (SELECT k, e[2] AS old, e[1] AS new FROM best GROUP BY k, e HAVING count(*) = 2),
         moved AS (SELECT live.k, coalesce(a.new, u) AS x, coalesce(b.new, v) AS y, s FROM live LEFT JOIN merges a ON a.old = u LEFT JOIN merges b ON b.old = v)
         SELECT k + 1, 0, least(x, y), greatest(x, y), max(s) FROM moved WHERE x <> y GROUP BY 1, 3, 4 UNION ALL SELECT k + 1, 1, old, new, NULL FROM merges)),
    m AS MATERIALIZED (SELECT k, u AS old, v AS new FROM rounds WHERE kind = 1), top AS (SELECT max(k) AS k FROM m),
    climb(marker, tree, k, place) AS (
        SELECT marker, marker, 0, '' FROM (SELECT DISTINCT unnest([u, v]) AS marker FROM rounds WHERE k = 0)
        UNION ALL SELECT marker, coalesce(m.new, tree), climb.k + 1, (CASE WHEN m.old IS NULL THEN '0' ELSE '1' END) || place FROM climb JOIN top ON climb.k < top.k LEFT JOIN m ON m.k = climb.k + 1 AND m.old = tree)
    SELECT marker, tree, place FROM climb JOIN top USING (k)""")
def plot_heatmap_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a heatmap's columns within each chromosome, from the r2 of all its pairs."""
    return plotdata.display_order(rounded(pairs.edge_list(fixture(spark, sf_dir), slide=0, block=64), "r2", places=9))


@query(" UNION ALL ".join(f"SELECT '{p}' AS panel, chr, CAST(chr_size AS DOUBLE) AS x, CAST({c} AS DOUBLE) AS y FROM decay_sum WHERE chr IS NOT NULL AND {c} IS NOT NULL AND NOT isnan({c})" for p, c in (("rate", "a"), ("predicted_rate", "a_pred"), ("start", "c"), ("reached", "rho_slide_pred"))))
def plot_decay_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.decay_panels(table(spark, sf_dir, "decay_sum"))


@query(f"""
    WITH {PARAMS}, w AS (SELECT chr, quantile_cont(slide_bp, 0.5) AS slide_bp FROM decay_sum WHERE chr IS NOT NULL AND slide_bp > 0 GROUP BY chr), k AS (SELECT unnest(range(0, 200)) AS k)
    SELECT chr, k, round(slide_bp * k / 199, 3) AS d, round(b + (c - b) / (1 + a * (slide_bp * k / 199)), 6) AS r2 FROM params JOIN w USING (chr), k""")
def plot_decay_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "decay_sum").where("chr IS NOT NULL AND slide_bp > 0").groupBy("chr").agg(F.percentile("slide_bp", 0.5).alias("slide_bp"))
    return rounded(rounded(plotdata.chromosome_curves(params(spark, sf_dir).join(w, "chr")), "r2"), "d", places=3)


@query(f"""WITH {_POL} SELECT q.cluster, q.ind_id, q.ord, CAST(CASE WHEN flip THEN 2 - dosage ELSE dosage END AS DOUBLE) AS value, a.ecotype FROM q JOIN pol USING (cluster, ord) LEFT JOIN (SELECT id AS ind_id, any_value(ecotype) AS ecotype FROM pheno GROUP BY id) a USING (ind_id)""")
def plot_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "pheno").groupBy(F.col("id").alias("ind_id")).agg(F.max("ecotype").alias("ecotype"))
    return plotdata.heatmap_cells(clustered_fixture(spark, sf_dir), notes, strict=False)


@query(f"WITH {MAP} SELECT marker, chr, pos, round(median(ld_w) OVER (PARTITION BY chr ORDER BY pos, marker ROWS BETWEEN 100 PRECEDING AND 100 FOLLOWING), 9) AS rolling FROM mp")
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(plotdata.rolling_median(markers(spark, sf_dir, "chr", "pos", "ld_w"), "ld_w"), "rolling", places=9).drop("ld_w")


@query(f"WITH {MAP} SELECT marker, ld_w, round(cume_dist() OVER (ORDER BY ld_w), 9) AS ecdf FROM mp WHERE ld_w IS NOT NULL")
def ecdf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(plotdata.ecdf(markers(spark, sf_dir, "ld_w"), "ld_w"), "ecdf", places=9)


@query("SELECT CAST(least(20, floor(r2 * 20) + 1) AS INT) AS bin, count(*) AS n FROM el WHERE isfinite(r2) AND r2 BETWEEN 0 AND 1 GROUP BY 1")
def r2_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.histogram(table(spark, sf_dir, "el"), "r2", 0.0, 1.0, 20)


