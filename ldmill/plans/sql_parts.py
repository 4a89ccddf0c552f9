"""SQL for the derived tables that the reference's queries start from, shared by their oracles."""

GENO_FIXTURE = """
    x AS (SELECT vec_id AS ind_id, label AS pop, unnest(range(0, 64)) AS dim, unnest(embedding) AS e FROM embeddings),
    y AS (SELECT ind_id, pop, dim, CASE WHEN dim < 32 THEN 0 ELSE 1 END AS ch, CAST(round(CAST(e AS DOUBLE) * 1000000) AS BIGINT) AS q FROM x),
    s AS (SELECT ind_id, pop, dim, ch,
            CAST(sum(q) OVER (PARTITION BY ind_id, ch ORDER BY dim ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS BIGINT) AS s4,
            CAST(sum(q) OVER (PARTITION BY ind_id, ch ORDER BY dim ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS BIGINT) AS s8,
            CAST(sum(q) OVER (PARTITION BY ind_id, ch ORDER BY dim ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS BIGINT) AS s12 FROM y),
    z AS (SELECT ind_id, pop, dim, ch, unnest([0, 1, 2]) AS v, unnest([s4, s8, s12]) AS s FROM s),
    g AS (SELECT ind_id, pop, 'Chr' || (ch + 1) AS chr, CAST(dim * 3 + v AS BIGINT) AS snp_idx, CAST(dim * 1000 + v * 330 + (dim * dim * 37) % 250 AS BIGINT) AS pos,
            CAST(CASE WHEN (dim * 7 + v) % 13 = 0 AND ind_id % 29 = 3 THEN NULL WHEN s < -120000 THEN 0 WHEN s < 120000 THEN 1 ELSE 2 END AS BIGINT) AS dosage FROM z)"""

GENO_TABLE = """
    h AS (SELECT ind_id, upper(trim(marker)) AS marker, max(pop) AS pop, max(chr) AS chr, max(pos) AS pos, CAST(max(CASE WHEN dosage BETWEEN 0 AND 2 THEN dosage END) AS BIGINT) AS dosage
          FROM geno WHERE ind_id IS NOT NULL AND marker IS NOT NULL GROUP BY 1, 2)"""

EDGES = """
    e0 AS (SELECT upper(trim(snp1)) AS a, upper(trim(snp2)) AS b, chr1, chr2, pos1, pos2, r2, coalesce(epoch_us(computed_at), -1) AS t FROM el
           WHERE isfinite(r2) AND r2 BETWEEN 0 AND 1 AND pos1 IS NOT NULL AND pos2 IS NOT NULL AND upper(trim(snp1)) <> upper(trim(snp2))),
    e1 AS (SELECT CASE WHEN (pos1, a) > (pos2, b) THEN a ELSE b END AS snp1, CASE WHEN (pos1, a) > (pos2, b) THEN b ELSE a END AS snp2,
                  CASE WHEN (pos1, a) > (pos2, b) THEN chr1 ELSE chr2 END AS chr1, CASE WHEN (pos1, a) > (pos2, b) THEN chr2 ELSE chr1 END AS chr2,
                  greatest(pos1, pos2) AS pos1, least(pos1, pos2) AS pos2, r2, t FROM e0),
    edges AS (SELECT snp1, snp2, chr1, chr2, pos1, pos2, r2, CASE WHEN chr1 = chr2 THEN pos1 - pos2 END AS d FROM e1
              QUALIFY row_number() OVER (PARTITION BY snp1, snp2 ORDER BY t DESC, r2 DESC, pos1 DESC, pos2 DESC) = 1)"""

MAP = """
    mq AS (SELECT upper(trim(marker)) AS marker, chr, pos, CASE WHEN isfinite(maf) AND maf BETWEEN 0 AND 0.5 THEN maf END AS maf,
                  CASE WHEN isfinite(ld_w) AND ld_w BETWEEN 0 AND 1 THEN ld_w END AS ld_w, cl_id, n_loci, is_core,
                  CASE WHEN isfinite(median_ld) AND median_ld BETWEEN 0 AND 1 THEN median_ld END AS median_ld, grp, loaded_at FROM map_snp WHERE marker IS NOT NULL),
    mp AS (SELECT * EXCLUDE (loaded_at) FROM mq QUALIFY row_number() OVER (PARTITION BY marker ORDER BY loaded_at DESC NULLS LAST, chr DESC NULLS LAST, pos DESC NULLS LAST, maf DESC NULLS LAST,
           ld_w DESC NULLS LAST, cl_id DESC NULLS LAST, n_loci DESC NULLS LAST, is_core DESC NULLS LAST, median_ld DESC NULLS LAST, grp DESC NULLS LAST) = 1)"""

PARAMS = """
    params AS (SELECT chr, quantile_cont(a, 0.5) AS a, quantile_cont(b, 0.5) AS b, quantile_cont(c, 0.5) AS c FROM decay_sum
               WHERE chr IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND isfinite(a) AND a > 0 AND NOT isnan(b) AND NOT isnan(c) GROUP BY chr)"""

#: A stand-in for association p-values: strong median LD gives small ones.
PVALUES = f"""
    {MAP},
    pv AS (SELECT marker, chr, pos, round((1 - median_ld) * (1 - median_ld) * (1 - median_ld) * (1 - median_ld), 12) AS pval, ld_w FROM mp)"""

R2_SUMS = "count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(x * x) AS BIGINT) AS sxx, CAST(sum(y * y) AS BIGINT) AS syy, CAST(sum(x * y) AS BIGINT) AS sxy"
R2 = "CASE WHEN (n * sxx - sx * sx) * (n * syy - sy * sy) > 0 THEN CAST((n * sxy - sx * sy) * (n * sxy - sx * sy) AS DOUBLE) / CAST((n * sxx - sx * sx) * (n * syy - sy * sy) AS DOUBLE) END"


def dbl(values: list[float]) -> str:
    return ", ".join(f"CAST({v!r} AS DOUBLE)" for v in values)
