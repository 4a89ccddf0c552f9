"""Queries of the stores, subsets, names and small reports around the analytics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ldmill.functions.scalar import marker_parts
from ldmill.operators import cluster, emlg, genotypes, ldw
from ldmill.plans.reference_queries import _POL, RHOS, calls, clustered_fixture, edges, markers, params, rounded
from ldmill.plans.sql_parts import EDGES, GENO_TABLE, MAP, PARAMS, dbl
from ldmill.session import Tables
from ldmill.sources import tables
from ldmill.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


@query(f"WITH {EDGES} SELECT snp1, snp2, chr1, pos1, pos2, r2, d FROM edges WHERE chr1 = 'Chr1'")
def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge list written by chromosome and read back for one of them."""
    path = f"{Tables(spark, 'store').root}/edges"
    tables.write_edges(edges(spark, sf_dir), path)
    return tables.read_edges(spark, path, ["Chr1"]).select("snp1", "snp2", "chr1", "pos1", "pos2", "r2", "d")


@query(f"WITH {GENO_TABLE} SELECT ind_id, marker, pos, CAST(dosage AS INT) AS dosage FROM h WHERE chr = 'Chr1'")
def stored_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genotype store written by chromosome and read back for one of them."""
    path = f"{Tables(spark, 'store').root}/genotypes"
    tables.write_genotypes(calls(spark, sf_dir).drop("snp_idx"), path)
    return tables.read_genotypes(spark, path, ["Chr1"]).select("ind_id", "marker", "pos", "dosage")


@query("SELECT count(DISTINCT ind_id) AS n_ind FROM geno WHERE ind_id IS NOT NULL AND marker IS NOT NULL")
def cohort_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes.n_individuals(calls(spark, sf_dir))


@query(f"""
    WITH {EDGES}, {PARAMS}, {MAP}, s AS (SELECT marker FROM mp WHERE ld_w > 0.4e0)
    SELECT snp1 AS u, snp2 AS v, r2 AS s, chr1 AS chr FROM edges e JOIN params p ON p.chr = e.chr1 WHERE chr1 = chr2 AND r2 >= b + (c - b) * (1 - 0.5e0) AND snp1 IN (FROM s) AND snp2 IN (FROM s)""")
def threshold_edges_of_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges above their chromosome's threshold among the markers with strong support."""
    return cluster.threshold_edges(edges(spark, sf_dir), params(spark, sf_dir), 0.5, markers(spark, sf_dir, "ld_w").where("ld_w > 0.4").select("marker"))


_WIDE = f"""
    {EDGES}, {MAP}, {PARAMS}, n AS (SELECT e.*, a, rho FROM edges e JOIN params p ON p.chr = e.chr1, (SELECT unnest([{dbl(RHOS)}]) AS rho) WHERE chr1 = chr2 AND d < rho / (a * (1 - rho))),
    u AS (SELECT snp1 AS marker, rho, r2 FROM n UNION ALL SELECT snp2, rho, r2 FROM n), v AS (SELECT marker, rho, quantile_cont(r2, 0.5) AS ld_w FROM u GROUP BY marker, rho)"""


@query(f"""WITH {_WIDE} SELECT m.marker, m.chr, {", ".join(f'round(max(CASE WHEN rho = {r!r} THEN v.ld_w END), 9) AS "rho_{r}"' for r in RHOS)} FROM mp m LEFT JOIN v ON v.marker = m.marker GROUP BY m.marker, m.chr""")
def ld_w_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local support as a matrix: a row a marker, a column a share of the decay."""
    wide = ldw.wide_support(ldw.ld_support(edges(spark, sf_dir), markers(spark, sf_dir, "chr"), params(spark, sf_dir), RHOS), RHOS)
    return wide.select("marker", "chr", *[F.round(F.col(f"`rho_{r}`"), 9).alias(f"rho_{r}") for r in RHOS])


@query(f"WITH {_POL} SELECT cluster, ind_id, round(sum(dosage * (ord + 1)) / sum(CASE WHEN dosage IS NOT NULL THEN ord + 1 END), 6) AS value FROM q GROUP BY cluster, ind_id")
def weighted_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean call of each individual in each cluster, with weights that grow along the cluster."""
    return rounded(emlg.weighted_mean(clustered_fixture(spark, sf_dir).withColumn("w", F.col("ord") + 1), ["cluster", "ind_id"], "dosage", "w"), "value")


@query(f"WITH {MAP} SELECT marker, chr, ld_w FROM mp WHERE ld_w IS NOT NULL ORDER BY ld_w DESC, marker LIMIT 25")
def most_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the 25 markers with the strongest support."""
    return markers(spark, sf_dir, "chr", "ld_w").where("ld_w IS NOT NULL").select("marker", "chr", "ld_w").orderBy(F.desc("ld_w"), "marker").limit(25)


@query("""
    SELECT DISTINCT upper(trim(snp1)) AS marker, nullif(regexp_extract(upper(trim(snp1)), '^CHR([0-9]+|[XYM]):([0-9]+)$', 1), '') AS chr_part,
        TRY_CAST(nullif(regexp_extract(upper(trim(snp1)), '^CHR([0-9]+|[XYM]):([0-9]+)$', 2), '') AS BIGINT) AS pos_part FROM el WHERE snp1 IS NOT NULL""")
def marker_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the spelled names of the edge list say of chromosome and position; null where a name has another form."""
    names = table(spark, sf_dir, "el").where("snp1 IS NOT NULL").select(F.upper(F.trim("snp1")).alias("marker")).distinct()
    chr_part, pos_part = marker_parts(F.col("marker"))
    return names.select("marker", chr_part.alias("chr_part"), pos_part.alias("pos_part"))
