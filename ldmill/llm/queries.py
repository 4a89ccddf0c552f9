"""Queries of the problems solved in this subpackage, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ldmill.llm import components, contamination, encoding, mixture, percentiles, topn
from ldmill.session import Tables
from ldmill.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = components.linked_pairs(table(spark, sf_dir, "el"), 0.5)
    return components.marker_groups(pairs, components.spelling(table(spark, sf_dir, "map_snp")))


QS = [0.05, 0.25, 0.5, 0.75, 0.95]
PARAMETERS = ["c", "a", "b", "rho_slide_raw", "a_pred", "c_pred"]
#: All that is estimated of a chromosome's decay.
ALL_PARAMETERS = [*PARAMETERS, "rho_slide_pred", "bp_per_snp", "slide_bp", "slide_snp"]


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of r2 by first chromosome and of the decay parameters by chromosome, selected for all groups at once."""
    r2 = percentiles.unit_values(table(spark, sf_dir, "el")).select("chr", F.lit("r2").alias("field"), "value")
    decay = percentiles.long_parameters(table(spark, sf_dir, "decay_sum"), PARAMETERS).select("chr", "field", "value")
    return percentiles.percentiles(r2.unionByName(decay), ["chr", "field"], "value", QS)


def _all_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chr, field, value, computed_at`` of r2 and of all decay parameters."""
    r2 = percentiles.unit_values(table(spark, sf_dir, "el")).select("chr", F.lit("r2").alias("field"), "value", "computed_at")
    return r2.unionByName(percentiles.long_parameters(table(spark, sf_dir, "decay_sum"), ALL_PARAMETERS))


def p2_percentiles_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``p2_percentiles``, of all decay parameters."""
    return percentiles.percentiles(_all_values(spark, sf_dir), ["chr", "field"], "value", QS)


def p2_combined_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of r2 and of all decay parameters by chromosome from separate summaries of each day of ``computed_at``, combined; rank error at most 1 %."""
    days = percentiles.day_summaries(_all_values(spark, sf_dir), ["chr", "field"], "value", "computed_at")
    return percentiles.combined(days, ["chr", "field"], QS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n(topn.latest_valid(table(spark, sf_dir, "map_snp")), "grp", "median_ld", "is_core", "marker", 3)


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items they contain, wholly, partly or in another order, with tiles and coverage."""
    docs = table(spark, sf_dir, "documents")
    return contamination.leaks(docs, table(spark, sf_dir, "test_items"), encoding.fit(docs))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those with at least 12 consecutive words of the passage, or all of a shorter one, in one tile."""
    return p6_leaks(spark, sf_dir).where(F.col("longest") >= F.least(F.lit(12), F.col("n_words"))).select("doc_id", "item_id")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, "tokens").cut(mixture.token_counts(table(spark, sf_dir, "documents")))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mix(_counts(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn and repeated to the target shares of as many tokens as all sources hold, in their interleaved order (slot)."""
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.reached_shares(*_mixed(spark, sf_dir))


def p7_within_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, within``: whether each source of the targets is less than a block from its share at every slot of the schedule."""
    targets = table(spark, sf_dir, "mix_targets")
    tables = Tables(spark, "deviation")
    plan = tables.cut(mixture.supplies(_counts(spark, sf_dir), targets))
    off = mixture.deviations(mixture.schedule(spark, mixture.budgets(plan), 64, rows=5000), plan)  # many small blocks, written by many tasks
    return targets.select("source").join(off, "source", "left").select("source", (F.coalesce("deviation", F.lit(0.0)) < 1).alias("within"))


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents with their original text where the states have an inverse, and the states found in them."""
    docs = table(spark, sf_dir, "documents")
    return encoding.restore_documents(docs, encoding.fit(docs))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_restored(spark, sf_dir).select("doc_id").distinct()


def queries() -> dict:
    return {"p1_found": p1_found, "p2_percentiles": p2_percentiles, "p2_combined_days": p2_combined_days, "p2_percentiles_all": p2_percentiles_all, "p3_found": p3_found, "p6_found": p6_found, "p6_leaks": p6_leaks, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_within_block": p7_within_block, "p8_found": p8_found, "p8_restored": p8_restored}


def oracle_sql() -> dict[str, str]:
    sql = {
        "p1_found": """
            WITH RECURSIVE rows AS (
                SELECT upper(trim(snp1)) AS x, upper(trim(snp2)) AS y, r2, computed_at FROM el WHERE isfinite(r2) AND r2 BETWEEN 0 AND 1 AND upper(trim(snp1)) <> upper(trim(snp2))),
            pairs AS (SELECT least(x, y) AS a, greatest(x, y) AS b, arg_max(r2, (computed_at, r2)) AS r2 FROM rows GROUP BY 1, 2),
            spelled AS (SELECT upper(marker) AS k, min(marker) AS m FROM map_snp GROUP BY 1),
            linked AS (SELECT coalesce(s.m, a) AS a, coalesce(t.m, b) AS b FROM pairs LEFT JOIN spelled s ON s.k = a LEFT JOIN spelled t ON t.k = b WHERE r2 >= 0.5),
            e AS (SELECT a AS u, b AS v FROM linked UNION SELECT b, a FROM linked),
            cc(snp, grp_snp) USING KEY (snp) AS (
                SELECT DISTINCT u, u FROM e
                UNION
                SELECT e.v, min(cc.grp_snp) FROM cc JOIN e ON e.u = cc.snp JOIN recurring.cc AS old ON old.snp = e.v GROUP BY e.v HAVING min(cc.grp_snp) < min(old.grp_snp))
            SELECT grp_snp, snp FROM cc""",
        "p2_percentiles": f"""
            WITH v AS (SELECT chr1 AS chr, 'r2' AS field, r2 AS value FROM el WHERE isfinite(r2) AND r2 BETWEEN 0 AND 1
                       {" ".join(f"UNION ALL SELECT chr, '{p}', CAST({p} AS DOUBLE) FROM decay_sum WHERE isfinite({p})" for p in PARAMETERS)}),
            r AS (SELECT *, row_number() OVER (PARTITION BY chr, field ORDER BY value) AS k, count(*) OVER (PARTITION BY chr, field) AS n FROM v)
            SELECT chr, field, q, value, n FROM r, (SELECT unnest([{", ".join(f"CAST({q} AS DOUBLE)" for q in QS)}]) AS q) WHERE k = greatest(1, CAST(ceil(q * n) AS BIGINT))""",
        "p7_within_block": "SELECT source, true AS within FROM mix_targets",
        "p3_found": """
            WITH ok AS (SELECT * FROM map_snp WHERE grp IS NOT NULL AND median_ld IS NOT NULL AND isfinite(median_ld) AND median_ld BETWEEN 0 AND 1),
            last AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY marker ORDER BY loaded_at DESC) = 1)
            SELECT grp, marker FROM last
            QUALIFY row_number() OVER (PARTITION BY grp ORDER BY median_ld DESC, coalesce(is_core, false) DESC, marker) <= 3""",
    }
    more = " ".join(f"UNION ALL SELECT chr, '{p}', CAST({p} AS DOUBLE) FROM decay_sum WHERE isfinite(CAST({p} AS DOUBLE))" for p in ALL_PARAMETERS[len(PARAMETERS) :])
    days = f"""
            WITH v AS (SELECT chr1 AS chr, 'r2' AS field, r2 AS value, CAST(computed_at AS DATE) AS day FROM el WHERE isfinite(r2) AND r2 BETWEEN 0 AND 1
                       {" ".join(f"UNION ALL SELECT chr, '{p}', CAST({p} AS DOUBLE), CAST(computed_at AS DATE) FROM decay_sum WHERE isfinite(CAST({p} AS DOUBLE))" for p in ALL_PARAMETERS)}),
            r AS (SELECT *, row_number() OVER (PARTITION BY chr, field, day ORDER BY value) AS k, count(*) OVER (PARTITION BY chr, field, day) AS n FROM v),
            s AS (SELECT *, unnest(range(1, least(100, n) + 1)) AS j, least(100, n) AS m FROM (SELECT DISTINCT chr, field, day, n FROM r)),
            t AS (SELECT *, CAST(ceil(j * n / m) AS BIGINT) AS k, CAST(ceil(j * n / m) AS BIGINT) - CAST(ceil((j - 1) * n / m) AS BIGINT) AS w FROM s),
            p AS (SELECT t.chr, t.field, r.value, t.w FROM t JOIN r ON r.chr IS NOT DISTINCT FROM t.chr AND r.field = t.field AND r.day IS NOT DISTINCT FROM t.day AND r.k = t.k),
            c AS (SELECT *, CAST(sum(w) OVER (PARTITION BY chr, field ORDER BY value, w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(w) OVER (PARTITION BY chr, field) AS BIGINT) AS n FROM p)
            SELECT chr, field, q, value, n FROM c, (SELECT unnest([{", ".join(f"CAST({q} AS DOUBLE)" for q in QS)}]) AS q)
            WHERE upto >= greatest(1, CAST(ceil(q * n) AS BIGINT)) AND upto - w < greatest(1, CAST(ceil(q * n) AS BIGINT))"""
    return sql | {"p2_percentiles_all": sql["p2_percentiles"].replace("WHERE isfinite(c_pred)", f"WHERE isfinite(c_pred) {more}"), "p2_combined_days": days}
