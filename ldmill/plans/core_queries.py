"""Queries of the general problems 4 and 5, with SQL where it can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ldmill.operators.fill_missing import fill_missing
from ldmill.operators.heavy_keys import heavy_keys, key_figures
from ldmill.sources.tables import table

FILLED = ["n_filled", "n_resid_na", "best_marker"]
KEY_FIELDS = {"map_snp": (["chr", "cl_id"], "median_ld"), "ld_groups": (["n_loci"], "score")}


def filled_best_snp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``best_snp`` with its unusable counts and marker names filled from the group, then the run, then all rows.

    A name is usable if it is a member of the row's group; only the group itself can lend one, so names back off to the group's representative.
    """
    stats = table(spark, sf_dir, "best_snp")
    groups = table(spark, sf_dir, "ld_groups")
    members = groups.select("group_id", F.explode("members").alias("best_marker")).distinct().withColumn("_is_member_", F.lit(True))
    rows = stats.join(members, ["group_id", "best_marker"], "left")
    heads = groups.select("group_id", F.col("representative").alias("_group_head_"))
    rows = rows.join(heads, "group_id", "left")
    usable = {f: (F.col(f) >= 0) & (F.col(f) <= F.col("n_ind")) for f in FILLED[:2]} | {"best_marker": F.col("_is_member_")}
    numeric = [["group_id"], ["run_no"], []]
    out = fill_missing(rows, usable, {f: numeric for f in FILLED[:2]} | {"best_marker": [["group_id"]]}, {f: "median" for f in FILLED[:2]} | {"best_marker": "mode"}, last_resort={"best_marker": F.col("_group_head_")})
    # a count from elsewhere can't exceed the row's own number of individuals
    return out.withColumns({f"{f}_filled": F.least(f"{f}_filled", "n_ind") for f in FILLED[:2]}).drop("_is_member_", "_group_head_")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per cell that the fill operator had to fill."""
    out = filled_best_snp(spark, sf_dir)
    cells = F.array(*[F.when(F.col(f"{f}_level").isNotNull() | F.col(f"{f}_filled").isNull(), F.lit(f)) for f in FILLED])
    return out.select("stat_id", F.explode(F.array_compact(cells)).alias("field_name"))


def p4_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``best_snp`` with the filled values, the flags and the levels they came from."""
    out = filled_best_snp(spark, sf_dir)
    return out.select("stat_id", "group_id", "run_no", "n_ind", *[f"{f}_{x}" for f in FILLED for x in ("filled", "is_filled", "level")])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [heavy_keys(table(spark, sf_dir, t), fields, 0.04).select(F.lit(t).alias("table_name"), "field_name", "key_value") for t, (fields, _) in KEY_FIELDS.items()]
    return reduce(DataFrame.unionByName, parts)


def p5_key_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [key_figures(table(spark, sf_dir, t), fields, value).withColumn("table_name", F.lit(t)) for t, (fields, value) in KEY_FIELDS.items()]
    return reduce(DataFrame.unionByName, parts).select("table_name", "field_name", "key_value", "n_rows", "n_total", "n_value", F.round("sum_value", 6).alias("sum_value"), "min_value", "max_value")


def queries() -> dict:
    return {"p4_found": p4_found, "p4_filled": p4_filled, "p5_found": p5_found, "p5_key_figures": p5_key_figures}


_KEYS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{f}' AS field_name, CAST({f} AS VARCHAR) AS key_value, CAST({v} AS DOUBLE) AS v0, count(*) OVER () AS n_total FROM {t}" for t, (fields, v) in KEY_FIELDS.items() for f in fields
)


def _median_sql(f: str) -> str:
    ok = f"{f} BETWEEN 0 AND n_ind"
    return f"""
        {f}_g AS (SELECT group_id, quantile_disc({f}, 0.5) AS v FROM r WHERE {ok} GROUP BY group_id HAVING count(*) >= 2),
        {f}_r AS (SELECT run_no, quantile_disc({f}, 0.5) AS v FROM r WHERE {ok} AND run_no IS NOT NULL GROUP BY run_no HAVING count(*) >= 2),
        {f}_a AS (SELECT quantile_disc({f}, 0.5) AS v FROM r WHERE {ok}),
        {f}_x AS (SELECT stat_id, CASE WHEN {ok} THEN {f} ELSE least(coalesce(g.v, n.v, a.v), n_ind) END AS {f}_filled, NOT coalesce({ok}, false) AND coalesce(g.v, n.v, a.v) IS NOT NULL AS {f}_is_filled,
            CASE WHEN coalesce({ok}, false) THEN NULL WHEN g.v IS NOT NULL THEN 0 WHEN n.v IS NOT NULL THEN 1 WHEN a.v IS NOT NULL THEN 2 END AS {f}_level
            FROM r LEFT JOIN {f}_g g USING (group_id) LEFT JOIN {f}_r n USING (run_no), {f}_a a)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_filled": f"""
            WITH m AS (SELECT DISTINCT group_id, unnest(members) AS marker FROM ld_groups),
            r AS (SELECT b.*, m.marker IS NOT NULL AS named, h.representative AS head FROM best_snp b LEFT JOIN m ON m.group_id = b.group_id AND m.marker = b.best_marker LEFT JOIN ld_groups h ON h.group_id = b.group_id),
            {_median_sql("n_filled")}, {_median_sql("n_resid_na")},
            c AS (SELECT group_id, best_marker, count(*) AS n FROM r WHERE named GROUP BY 1, 2),
            o AS (SELECT group_id, min(best_marker) AS v FROM (SELECT *, max(n) OVER (PARTITION BY group_id) AS top, sum(n) OVER (PARTITION BY group_id) AS s FROM c) WHERE n = top AND s >= 2 GROUP BY group_id)
            SELECT r.stat_id, r.group_id, r.run_no, r.n_ind, n_filled_filled, n_filled_is_filled, n_filled_level, n_resid_na_filled, n_resid_na_is_filled, n_resid_na_level,
                CASE WHEN named THEN best_marker ELSE coalesce(o.v, head) END AS best_marker_filled, NOT named AND coalesce(o.v, head) IS NOT NULL AS best_marker_is_filled,
                CASE WHEN named THEN NULL WHEN o.v IS NOT NULL THEN 0 WHEN head IS NOT NULL THEN 1 END AS best_marker_level
            FROM r JOIN n_filled_x USING (stat_id) JOIN n_resid_na_x USING (stat_id) LEFT JOIN o ON o.group_id = r.group_id""",
        "p4_found": """
            WITH m AS (SELECT DISTINCT group_id, unnest(members) AS marker FROM ld_groups)
            SELECT stat_id, 'n_filled' AS field_name FROM best_snp WHERE n_filled IS NULL OR NOT (n_filled BETWEEN 0 AND n_ind)
            UNION ALL SELECT stat_id, 'n_resid_na' FROM best_snp WHERE n_resid_na IS NULL OR NOT (n_resid_na BETWEEN 0 AND n_ind)
            UNION ALL SELECT b.stat_id, 'best_marker' FROM best_snp b LEFT JOIN m ON m.group_id = b.group_id AND m.marker = b.best_marker WHERE m.marker IS NULL""",
        "p5_found": f"SELECT table_name, field_name, key_value FROM ({_KEYS}) WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.04 * max(n_total)",
        "p5_key_figures": f"""
            SELECT table_name, field_name, key_value, count(*) AS n_rows, max(n_total) AS n_total, count(v) AS n_value,
                   round(sum(v), 6) AS sum_value, min(v) AS min_value, max(v) AS max_value
            FROM (SELECT *, CASE WHEN isfinite(v0) THEN v0 END AS v FROM ({_KEYS})) GROUP BY table_name, field_name, key_value""",
    }
