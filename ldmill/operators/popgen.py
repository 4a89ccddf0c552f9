"""Population structure of one and two loci: R2 by population, Fst, Ohta's components of linkage disequilibrium."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ldmill.session import Tables


def population_means(geno: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., pop, n, s, q``: calls, their sum and sum of squares per population; calls without a population are left out."""
    x = F.col("dosage").cast("double")
    return geno.where("dosage IS NOT NULL AND pop IS NOT NULL").groupBy(*keys, "pop").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.min(x).alias("lo"), F.max(x).alias("hi"))


def population_stats(geno: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., n_obs, n_pops, r2_pop, fst`` per locus from one pass: the between-population share of the dosage's variance, and (Ht - Hs) / Ht weighted by
    population size, within 0..1. Both null with fewer than three calls, one value or one population."""
    p = F.col("s") / (2 * F.col("n"))
    per = population_means(geno, keys)
    t = per.groupBy(*keys).agg(F.sum("n").alias("n_obs"), F.count(F.lit(1)).alias("n_pops"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum(F.col("n") * 2 * p * (1 - p)).alias("within"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ok = (F.col("n_obs") >= 3) & (F.col("n_pops") >= 2) & (F.col("lo") < F.col("hi"))
    mean2 = F.col("s") * F.col("s") / F.col("n_obs")
    pt = F.col("s") / (2 * F.col("n_obs"))
    ht = 2 * pt * (1 - pt)
    fst = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ht - F.col("within") / F.col("n_obs")) / ht))
    return t.select(*keys, "n_obs", "n_pops", F.when(ok & (F.col("q") > mean2), (F.col("between") - mean2) / (F.col("q") - mean2)).alias("r2_pop"), F.when(ok & (ht > 0), fst).alias("fst"))


def prepare(geno: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean dosage per marker and population, and per marker. A marker with two calls for one individual is an error of the input."""
    if not geno.groupBy("marker", "ind_id").count().where("count > 1").isEmpty():
        raise ValueError("more than one call for a marker and individual")
    per = population_means(geno, ["marker"])
    return per.select("marker", "pop", (F.col("s") / F.col("n")).alias("mean")), per.groupBy("marker").agg((F.sum("s") / F.sum("n")).alias("mean"))


STATES = [(0, 0), (0, 2), (2, 0), (2, 2)]  # both loci's first or second allele


def _by_population(geno: DataFrame) -> DataFrame:
    """``marker, pop, n, s, q, lo, hi, carry0 .. carry2``: sums of a marker's calls in a population, and who carries 0, 1 and 2 of the counted allele there."""
    x = F.col("dosage").cast("double")
    carriers = [F.collect_list(F.when(x == i, F.col("ind_id"))).alias(f"carry{i}") for i in range(3)]
    sums = [F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.min(x).alias("lo"), F.max(x).alias("hi")]
    return geno.where("dosage IS NOT NULL AND pop IS NOT NULL").groupBy("marker", "pop").agg(*sums, *carriers)


def _locus(side: int) -> list[Column]:
    """Sums over a pair's kept populations from which one of its loci has its R2 by population and Fst."""
    n, s, q = (F.col(f"{c}{side}") for c in ("n", "s", "q"))
    p = s / (2 * n)
    return [F.sum(n).alias(f"N{side}"), F.sum(s).alias(f"S{side}"), F.sum(q).alias(f"Q{side}"), F.sum(s * s / n).alias(f"B{side}"), F.sum(n * 2 * p * (1 - p)).alias(f"W{side}"), F.min(f"lo{side}").alias(f"LO{side}"), F.max(f"hi{side}").alias(f"HI{side}"), F.count(F.lit(1)).alias(f"K{side}")]


def _locus_stats(side: int) -> tuple[Column, Column]:
    n, s, q, b, w = (F.col(f"{c}{side}") for c in "NSQBW")
    ok = (n >= 3) & (F.col(f"K{side}") >= 2) & (F.col(f"LO{side}") < F.col(f"HI{side}"))
    pt = s / (2 * n)
    ht = 2 * pt * (1 - pt)
    return F.when(ok, (b - s * s / n) / (q - s * s / n)), F.when(ok & (ht > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ht - w / n) / ht)))


def ohta_scan(pairs: DataFrame, geno: DataFrame, tot_maf: float = 0.1, pop_maf: float = 0.05, variant: str = "fast") -> DataFrame:
    """Ohta's statistics, r2, mean R2 by population and mean Fst for every row of ``pairs (snp1, snp2)``, rounded to 6 places; null where undefined.

    ``geno`` has hard calls, one a marker and individual. Populations in which both loci vary enough count; all is null if either locus is too rare or no population is left.
    ``variant='original'`` scales the two primed components by four (sums over the four states instead of their means).

    A marker and population is one row with its carriers, so a pair moves two short lists a population; counts of common carriers give every sum, in one aggregate by pair.
    """
    if variant not in ("fast", "original"):
        raise ValueError(f"unknown variant {variant}")
    v = Tables(geno.sparkSession, "populations").cut(_by_population(geno))
    mean = v.groupBy("marker").agg((F.sum("s") / F.sum("n")).alias("m")).where(F.col("m").between(2 * tot_maf, 2 - 2 * tot_maf)).select("marker")
    common = v.join(mean, "marker", "left_semi").where((F.col("s") / F.col("n")).between(2 * pop_maf, 2 - 2 * pop_maf))
    one = common.select(F.col("marker").alias("snp1"), "pop", *[F.col(c).alias(f"{c}1") for c in v.columns if c not in ("marker", "pop")])
    two = common.select(F.col("marker").alias("snp2"), "pop", *[F.col(c).alias(f"{c}2") for c in v.columns if c not in ("marker", "pop")])
    both = pairs.select("snp1", "snp2").distinct().join(one, "snp1").join(two, ["snp2", "pop"])
    n = [[F.col(f"n{i}{j}") for j in range(3)] for i in range(3)]
    counted = both.withColumns({f"n{i}{j}": F.size(F.array_intersect(f"carry{i}1", f"carry{j}2")).cast("double") for i in range(3) for j in range(3)})
    per = counted.withColumn("n", sum((n[i][j] for i in range(3) for j in range(3)), F.lit(0.0)))
    x = [sum((n[i][j] for j in range(3)), F.lit(0.0)) for i in range(3)]
    y = [sum((n[i][j] for i in range(3)), F.lit(0.0)) for j in range(3)]
    # second alleles of both loci, and for each state the gametes that show it and the product of its frequencies
    per = per.withColumns({"x1": x[1] + 2 * x[2], "xx": x[1] + 4 * x[2], "y1": y[1] + 2 * y[2], "yy": y[1] + 4 * y[2], "xy": n[1][1] + 2 * n[1][2] + 2 * n[2][1] + 4 * n[2][2]})
    there = per.withColumn("has", F.col("n") > 0)
    p2, q2 = F.col("x1") / (2 * F.col("n")), F.col("y1") / (2 * F.col("n"))
    f, g = {0: 1 - p2, 2: p2}, {0: 1 - q2, 2: q2}
    values = {f"t{a}{b}": (2 * n[a][b] + n[a][1] + n[1][b] + n[1][1] / 2) / F.col("n") for a, b in STATES} | {f"e{a}{b}": 2 * f[a] * g[b] for a, b in STATES} | {"fx": p2, "fy": q2}
    there = there.withColumns({k: F.when(F.col("has"), c) for k, c in values.items()})
    sums = [F.sum(c).alias(f"S_{c}") for c in ("n", "x1", "xx", "y1", "yy", "xy", "fx", "fy")] + [F.count_if("has").alias("k")]
    for a, b in STATES:
        t, e = F.col(f"t{a}{b}"), F.col(f"e{a}{b}")
        sums += [F.sum(t).alias(f"T{a}{b}"), F.sum(t * t).alias(f"TT{a}{b}"), F.sum(e).alias(f"E{a}{b}"), F.sum(e * e).alias(f"EE{a}{b}"), F.sum((t - e) * (t - e)).alias(f"TE{a}{b}")]
    s = there.groupBy("snp1", "snp2").agg(*sums, *_locus(1), *_locus(2)).where("k > 0")
    k = F.col("k")
    pm, qm = F.col("S_fx") / k, F.col("S_fy") / k
    pf, qf = {0: 1 - pm, 2: pm}, {0: 1 - qm, 2: qm}
    total = lambda term: sum((term(f"{a}{b}", 2 * pf[a] * qf[b]) for a, b in STATES), F.lit(0.0))
    scale = 1 if variant == "original" else 4
    d2it = total(lambda c, pool: F.col(f"TT{c}") - 2 * pool * F.col(f"T{c}") + k * pool * pool) / k
    d2st = total(lambda c, pool: F.col(f"EE{c}") - 2 * pool * F.col(f"E{c}") + k * pool * pool) / k / 4
    dp2st = total(lambda c, pool: (F.col(f"T{c}") / k - pool) * (F.col(f"T{c}") / k - pool)) / scale
    dp2is = total(lambda c, pool: F.col(f"TT{c}") - F.col(f"T{c}") * F.col(f"T{c}") / k) / k / scale
    d2is = total(lambda c, pool: F.col(f"TE{c}")) / k
    vx, vy = F.expr("S_n * S_xx - S_x1 * S_x1"), F.expr("S_n * S_yy - S_y1 * S_y1")
    r2 = F.when((F.col("S_n") >= 3) & (vx > 0) & (vy > 0), F.pow(F.expr("S_n * S_xy - S_x1 * S_y1"), 2) / vx / vy)
    (ra, fa), (rb, fb) = _locus_stats(1), _locus_stats(2)
    mean_of = lambda a, b: F.coalesce((a + b) / 2, a, b)
    out = s.select("snp1", "snp2", k.cast("double").alias("n_pops"), r2.alias("r2"), mean_of(ra, rb).alias("r2_pop_mean"), mean_of(fa, fb).alias("fst_mean"), d2it.alias("d2it"), d2is.alias("d2is"), d2st.alias("d2st"), dp2st.alias("dp2st"), dp2is.alias("dp2is"))
    names = [c for c in out.columns if c not in ("snp1", "snp2")]
    return pairs.select("snp1", "snp2").join(out.select("snp1", "snp2", *[F.round(c, 6).alias(c) for c in names]), ["snp1", "snp2"], "left")


def joint_counts(pairs: DataFrame, geno: DataFrame) -> DataFrame:
    """``snp1, snp2, n, n00 .. n22``: how many individuals carry each combination of hard calls, over those with both."""
    x = geno.where("dosage IS NOT NULL").select("marker", "ind_id", F.col("dosage").alias("g"))
    rows = pairs.select("snp1", "snp2").join(x.select(F.col("marker").alias("snp1"), "ind_id", F.col("g").alias("x")), "snp1").join(x.select(F.col("marker").alias("snp2"), "ind_id", F.col("g").alias("y")), ["snp2", "ind_id"])
    return rows.groupBy("snp1", "snp2").agg(F.count(F.lit(1)).alias("n"), *[F.count_if((F.col("x") == i) & (F.col("y") == j)).alias(f"n{i}{j}") for i in range(3) for j in range(3)])
