"""Mixed-model association of markers with a phenotype.

The cohort's n x n work (kinship eigen pairs) happens once on the driver; markers stay distributed and are tested in batches, and null phenotypes get their variance
components in tasks. One kinship may serve all chromosomes, or each has that of all others, so that a marker doesn't stand against its own signal; these models, as many as
there are chromosomes and scaffolds, are fitted in tasks and never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ldmill.functions.numerics import centred_eigen, f_tail, normalized_kinship, reml
from ldmill.functions.ordered import running_max
from ldmill.operators.genotypes import packed
from ldmill.operators.pairs import matrix
from ldmill.session import Tables, broadcast_if_small, figure

MAX_COHORT = 20_000  # individuals whose n x n matrix the driver and every task can hold
BLOCK = 1_000  # markers that a task takes at once, at least


def simple_association(geno: DataFrame, pheno: DataFrame) -> DataFrame:
    """``chr, snp_idx, n, r2, f``: regression of the phenotype on each marker, all in sums; what the mixed model becomes for unrelated individuals.

    ``pheno (ind_id, y)``. Markers that are constant, or fewer than three complete rows, have null.
    """
    rows = geno.where("dosage IS NOT NULL").join(pheno.where("y IS NOT NULL"), "ind_id").select("chr", "snp_idx", F.col("dosage").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    s = rows.groupBy("chr", "snp_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.expr("x * x")).alias("sxx"), F.sum(F.expr("y * y")).alias("syy"), F.sum(F.expr("x * y")).alias("sxy"))
    vx, vy = F.expr("n * sxx - sx * sx"), F.expr("n * syy - sy * sy")
    r2 = F.when((F.col("n") >= 3) & (vx > 0) & (vy > 0), F.pow(F.expr("n * sxy - sx * sy"), 2) / vx / vy)
    return s.select("chr", "snp_idx", "n", r2.alias("r2")).withColumn("f", F.when(F.col("r2") < 1, F.col("r2") / (1 - F.col("r2")) * (F.col("n") - 2)))


def cohort(pheno: DataFrame) -> pd.DataFrame:
    """The individuals with a phenotype, in order; the cohort must fit the driver."""
    rows = pheno.where("ind_id IS NOT NULL AND y IS NOT NULL").select("ind_id", F.col("y").cast("double").alias("y")).sort("ind_id").limit(MAX_COHORT + 1).toPandas()
    if len(rows) > MAX_COHORT:
        raise ValueError(f"more than {MAX_COHORT} individuals")
    return rows.drop_duplicates("ind_id", ignore_index=True)


def _calls(pdf: pd.DataFrame, inds: np.ndarray) -> np.ndarray:
    """Markers x individuals with a marker's missing calls at its mean; only individuals of the cohort."""
    own = pd.DataFrame({"inds": [np.asarray(i)[np.isin(i, inds)] for i in pdf["inds"]], "calls": [np.asarray(g)[np.isin(i, inds)] for i, g in zip(pdf["inds"], pdf["calls"], strict=True)]})
    x, m = matrix(own, inds)
    n = m.sum(axis=1, keepdims=True)
    return np.where(m > 0, x, x.sum(axis=1, keepdims=True) / np.maximum(n, 1))


_SUMS = "key string, i int, row array<double>"


def _products(x: np.ndarray) -> np.ndarray:
    x = x - x.mean(axis=1, keepdims=True)
    return x.T @ x


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row a task, added up."""
    return pd.DataFrame({"key": pdf["key"].iloc[:1], "i": pdf["i"].iloc[:1], "row": [np.sum(np.stack(pdf["row"].to_list()), axis=0)]})


def _square(rows: pd.DataFrame, n: int) -> np.ndarray:
    m = np.zeros((n, n))
    m[rows["i"]] = np.stack(rows["row"].to_list())
    return m


def kinship_sums(geno: DataFrame, inds: np.ndarray, by_chr: bool = False) -> dict[str | None, np.ndarray]:
    """Centred products X'X over the markers, of all of them (key null) or of each chromosome. Tasks add up their markers, then rows are added; the driver gets n rows a key."""
    key = F.coalesce("chr", F.lit("")) if by_chr else F.lit("")
    out = _key_sums(packed(geno).select(key.alias("key"), "inds", "calls"), inds)
    return out if by_chr and out else {None: out.get("", np.zeros((len(inds), len(inds))))}


def _key_sums(vectors: DataFrame, inds: np.ndarray) -> dict[str, np.ndarray]:
    shared = vectors.sparkSession.sparkContext.broadcast(inds)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            for key, own in b.groupby("key", dropna=False):
                total[key] = total.get(key, 0) + _products(_calls(own, shared.value))
        for key, k in total.items():
            yield pd.DataFrame({"key": key, "i": np.arange(len(k)), "row": list(k)})

    sums = vectors.mapInPandas(part, _SUMS).groupBy("key", "i").applyInPandas(_add, _SUMS).toPandas()
    return {k: _square(own, len(inds)) for k, own in sums.groupby("key")}


def _scaled(k: np.ndarray) -> np.ndarray:
    return k / max(np.mean(np.diag(k)), 1e-300)


def kinship(geno: DataFrame, inds: np.ndarray) -> np.ndarray:
    """Centred relationship matrix over all markers, scaled to a mean diagonal of 1."""
    return _scaled(kinship_sums(geno, inds)[None])


def _others(total: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Relationship by all markers but a chromosome's own; where these leave nothing but rounding, nobody is related."""
    k = total - own
    return _scaled(k) if np.trace(k) > 1e-12 * np.trace(total) else np.eye(len(k))


def kinship_by_chromosome(geno: DataFrame, inds: np.ndarray) -> dict[str, np.ndarray]:
    """For each chromosome the relationship matrix over the markers of all others, each scaled to a mean diagonal of 1. The driver gets all of them: for a few chromosomes."""
    own = kinship_sums(geno, inds, by_chr=True)
    total = sum(own.values())
    return {c: _others(total, k) for c, k in own.items() if c is not None}


def residuals(y: np.ndarray, covariate: np.ndarray | None) -> np.ndarray:
    if covariate is None or len(np.unique(covariate)) < 2:
        return y
    x = np.column_stack([np.ones(len(y)), covariate])
    return y - x @ np.linalg.lstsq(x, y, rcond=None)[0]


@dataclass
class NullModel:
    """The rotation that makes the cohort's individuals independent, and the phenotype in it."""

    inds: np.ndarray
    basis: np.ndarray  # eigenvectors of the kinship
    eigen: np.ndarray
    centred: tuple[np.ndarray, np.ndarray]  # eigen pairs without the constant direction, for variance components
    vg: float
    ve: float
    y: np.ndarray

    def whitened(self, y: np.ndarray, vg: float, ve: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = 1 / np.sqrt(vg * self.eigen + ve)
        return (self.basis.T @ y) * w, self.basis.sum(axis=0) * w, w


def null_model(inds: np.ndarray, y: np.ndarray, k: np.ndarray, covariate: np.ndarray | None = None) -> NullModel:
    if k.shape != (len(y), len(y)):
        raise ValueError("kinship and phenotype differ in size")
    y = residuals(np.asarray(y, dtype=float), covariate)
    k = normalized_kinship(k)
    centred = centred_eigen(k)
    vg, ve = reml(y, *centred)
    eigen, basis = np.linalg.eigh(k)
    return NullModel(np.asarray(inds), basis, np.maximum(eigen, 0), centred, vg, ve, y)


def f_statistics(rotated: np.ndarray, y: np.ndarray, one: np.ndarray, w: np.ndarray) -> np.ndarray:
    """F of every marker (rows of ``rotated``) beyond the intercept; nan for constant markers."""
    x = rotated * w
    a = one @ one
    ry = y - one * ((one @ y) / a)
    rx = x - np.outer(x @ one / a, one)
    rss0, q = ry @ ry, (rx * rx).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        rss = rss0 - (rx @ ry) ** 2 / np.where(q > 1e-10 * np.maximum((x * x).sum(axis=1), 1e-300), q, np.nan)
        return (rss0 / np.maximum(rss, 1e-300) - 1) * (len(y) - 2)


def null_models(inds: np.ndarray, y: np.ndarray, kinships: dict[str, np.ndarray], covariate: np.ndarray | None = None) -> dict[str, NullModel]:
    """A null model for each chromosome, on the driver: for a few chromosomes, as ``null_statistics`` takes them; ``emmax_by_chromosome`` takes any number."""
    return {c: null_model(inds, y, k, covariate) for c, k in kinships.items()}


def _by_model(geno: DataFrame, model: NullModel | dict[str, NullModel], f: Callable[[DataFrame, NullModel], DataFrame]) -> DataFrame:
    """``f`` of all markers under one model, or of each chromosome's under its own; chromosomes without one are left out."""
    if isinstance(model, NullModel):
        return f(geno, model)
    return reduce(DataFrame.unionByName, [f(geno.where(F.coalesce("chr", F.lit("")) == c), m) for c, m in model.items()])


def _tested(b: pd.DataFrame, rotated: np.ndarray, y: np.ndarray, ones: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    f = f_statistics(rotated, y, ones, w)
    return pd.DataFrame({"chr": b["chr"], "snp_idx": b["snp_idx"], "f": f, "p": f_tail(f, 1, len(y) - 2), "r2": f / (f + len(y) - 2)})


def _without_nan(tested: DataFrame) -> DataFrame:
    return tested.select("chr", "snp_idx", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("f", "p", "r2")])


def emmax(geno: DataFrame, model: NullModel | dict[str, NullModel]) -> DataFrame:
    """``chr, snp_idx, f, p, r2`` per marker under a null model, or under its chromosome's. One marker gives one row; constant markers have null."""
    kind = geno.schema["snp_idx"].dataType.simpleString()

    def one(g: DataFrame, m: NullModel) -> DataFrame:
        shared = g.sparkSession.sparkContext.broadcast((m.inds, m.basis, *m.whitened(m.y, m.vg, m.ve)))

        def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            inds, basis, y, ones, w = shared.value
            for b in batches:
                yield _tested(b, _calls(b, inds) @ basis, y, ones, w)

        return packed(g).select("chr", "snp_idx", "inds", "calls").mapInPandas(test, f"chr string, snp_idx {kind}, f double, p double, r2 double")

    return _without_nan(_by_model(geno, model, one))


def emmax_by_chromosome(geno: DataFrame, inds: np.ndarray, y: np.ndarray, covariate: np.ndarray | None = None, block: int | None = None) -> DataFrame:
    """As ``emmax``, each chromosome's markers under a null model with the kinship of all others. The driver gets n rows, the products over all markers, whatever the number of chromosomes.

    A chromosome of up to ``block`` markers is one group: it takes its own products off the shared ones, gets its model and is tested. A longer one adds up its products by blocks,
    gets its model in one task, and its blocks are tested against that. A block has as many markers as individuals at least, so models sent to blocks are no more than the calls.
    """
    spark, n = geno.sparkSession, len(inds)
    block = block or max(BLOCK, n)
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # models take time, not bytes, so adaptive execution would join their tasks
    tables, result = Tables(spark, "emmax"), f"chr string, snp_idx {geno.schema['snp_idx'].dataType.simpleString()}, f double, p double, r2 double"
    vectors = tables.cut(packed(geno).select(F.coalesce("chr", F.lit("")).alias("key"), "chr", "snp_idx", "inds", "calls"))
    sizes = tables.cut(vectors.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), most=F.max("blocks"))
    total = _key_sums(vectors.select(F.lit("").alias("key"), "inds", "calls"), inds).get("", np.zeros((n, n)))
    shared = spark.sparkContext.broadcast((inds, y, covariate, total))

    def fitted(own: np.ndarray) -> NullModel:
        inds, y, covariate, total = shared.value
        return null_model(inds, y, _others(total, own), covariate)

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _calls(pdf, shared.value[0])
        m = fitted(_products(x))
        return _tested(pdf, x @ m.basis, *m.whitened(m.y, m.vg, m.ve))

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        k = _products(_calls(pdf, shared.value[0]))
        return pd.DataFrame({"key": pdf["key"].iloc[0], "i": np.arange(len(k)), "row": list(k)})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = fitted(_square(pdf, len(shared.value[0])))
        y, ones, w = m.whitened(m.y, m.vg, m.ve)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "i": np.arange(len(w)), "row": list(m.basis), "y": y, "one": ones, "w": w})

    def test(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        model = model.sort_values("i")
        return _tested(pdf, _calls(pdf, shared.value[0]) @ np.stack(model["row"].to_list()), *[model[c].to_numpy() for c in ("y", "one", "w")])

    rows = vectors.join(broadcast_if_small(sizes), "key")
    out = rows.where("blocks = 1").select(vectors.columns).repartition(tasks, "key").groupBy("key").applyInPandas(alone, result)
    if (figure(sizes, "most") or 1) > 1:
        long = rows.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("snp_idx"), F.col("blocks")).cast("int")).drop("blocks")
        own = long.repartition(tasks, "key", "block").groupBy("key", "block").applyInPandas(part, _SUMS).groupBy("key", "i").applyInPandas(_add, _SUMS)
        models = own.repartition(tasks, "key").groupBy("key").applyInPandas(fit, f"{_SUMS}, y double, one double, w double")
        models = models.join(broadcast_if_small(tables.cut(long.select("key", "block").distinct())), "key")  # of the blocks that have markers
        out = out.unionByName(long.groupBy("key", "block").cogroup(models.groupBy("key", "block")).applyInPandas(test, result))
    return _without_nan(out)


def null_draws(spark: SparkSession, model: NullModel, b: int, seed: int = 0, how: str = "permute", binary: bool = False) -> pd.DataFrame:
    """``draw, vg, ve, y``: ``b`` phenotypes under the null in the model's rotation, with their own variance components, each draw from its own seed, in tasks: permuted, or
    drawn from the model (cut to the rarer class's count if binary). Permutations of one seed are the same under every model. The driver gets b x n numbers."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            rows = []
            for k in batch["id"]:
                rng = np.random.default_rng([seed, int(k)])
                if how == "permute":
                    y = rng.permutation(m.y)
                else:
                    y = m.basis @ (rng.standard_normal(len(m.y)) * np.sqrt(m.vg * m.eigen + m.ve))
                    if binary:
                        few = min(np.unique(m.y, return_counts=True)[1])
                        y = (np.argsort(np.argsort(y)) < few).astype(float)
                rows.append((k, *reml(y, *m.centred), m.basis.T @ y))
            yield pd.DataFrame(rows, columns=["draw", "vg", "ve", "y"])

    tasks = min(b, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, b, 1, tasks).mapInPandas(run, "draw int, vg double, ve double, y array<double>").toPandas()


def null_statistics(geno: DataFrame, model: NullModel | dict[str, NullModel], b: int, seed: int = 0, how: str = "permute", binary: bool = False) -> DataFrame:
    """``chr, snp_idx, draw, f`` for every marker and null phenotype of ``null_draws``; markers stay distributed, the draws (b x n numbers a model) are shared."""
    kind = geno.schema["snp_idx"].dataType.simpleString()

    def one(g: DataFrame, m: NullModel) -> DataFrame:
        draws = null_draws(g.sparkSession, m, b, seed, how, binary)
        shared = g.sparkSession.sparkContext.broadcast((m.inds, m.basis, m.eigen, draws))

        def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            inds, basis, eigen, draws = shared.value
            ones = basis.sum(axis=0)
            for batch in batches:
                x = _calls(batch, inds) @ basis
                for k, vg, ve, y in draws.itertuples(index=False):
                    w = 1 / np.sqrt(vg * eigen + ve)
                    yield pd.DataFrame({"chr": batch["chr"], "snp_idx": batch["snp_idx"], "draw": k, "f": f_statistics(x, np.asarray(y) * w, ones * w, w)})

        return packed(g).select("chr", "snp_idx", "inds", "calls").mapInPandas(test, f"chr string, snp_idx {kind}, draw int, f double")

    return _by_model(geno, model, one)


def stepdown_p(observed: DataFrame, nulls: DataFrame, b: int) -> DataFrame:
    """``chr, snp_idx, p_corr``: family-wise p by step-down: markers in ascending order of observed F, each draw's running maximum up to the marker
    against its F; the share of draws that reach it, plus one, not falling along the order."""
    rows = observed.where("f IS NOT NULL").select("chr", "snp_idx", F.col("f").alias("fo")).join(nulls.where("NOT isnan(f)"), ["chr", "snp_idx"])
    hit = running_max(rows, ["draw"], "fo", ["chr", "snp_idx"], "f", "m").groupBy("chr", "snp_idx").agg((F.count_if(F.col("m") >= F.col("fo")) + 1).alias("k"))
    return hit.select("chr", "snp_idx", (F.col("k") / (b + 1)).alias("p_corr"))
