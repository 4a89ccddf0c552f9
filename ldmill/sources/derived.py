"""Genotype tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def moving_sum_genotypes(embeddings: DataFrame) -> DataFrame:
    """``ind_id, pop, chr, snp_idx, pos, dosage``: hard calls with real decay of correlation, from moving sums of neighbouring vector parts in
    integer arithmetic; 192 markers on two chromosomes, one individual a vector. Null vectors give no calls."""
    x = embeddings.where("embedding IS NOT NULL").select("vec_id", "label", F.posexplode("embedding").alias("dim", "e"))
    x = x.select(F.col("vec_id").alias("ind_id"), F.col("label").alias("pop"), "dim", F.when(F.col("dim") < 32, 0).otherwise(1).alias("ch"), F.round(F.col("e").cast("double") * 1000000).cast("bigint").alias("q"))
    w = Window.partitionBy("ind_id", "ch").orderBy("dim")
    sums = x.withColumn("sums", F.array(*[F.sum("q").over(w.rowsBetween(0, k)) for k in (3, 7, 11)]))
    sums = sums.select("ind_id", "pop", "dim", "ch", F.posexplode("sums").alias("v", "s"))
    dosage = F.when(((F.col("dim") * 7 + F.col("v")) % 13 == 0) & (F.col("ind_id") % 29 == 3), None).when(F.col("s") < -120000, 0).when(F.col("s") < 120000, 1).otherwise(2)
    return sums.select("ind_id", "pop", F.concat(F.lit("Chr"), F.col("ch") + 1).alias("chr"), (F.col("dim") * 3 + F.col("v")).alias("snp_idx"), (F.col("dim") * 1000 + F.col("v") * 330 + (F.col("dim") * F.col("dim") * 37) % 250).alias("pos"), dosage.cast("int").alias("dosage"))


def clean_genotypes(geno: DataFrame) -> DataFrame:
    """``ind_id, pop, marker, chr, pos, dosage``: one call an individual and marker. Names are trimmed and compared in upper case; of repeated calls the
    highest usable one counts; a dosage outside 0..2 is missing. Rows without individual or marker are left out."""
    call = F.when(F.col("dosage").between(0, 2), F.col("dosage"))
    rows = geno.where("ind_id IS NOT NULL AND marker IS NOT NULL").select("ind_id", "pop", F.upper(F.trim("marker")).alias("marker"), "chr", "pos", call.alias("dosage"))
    return rows.groupBy("ind_id", "marker").agg(F.max("pop").alias("pop"), F.max("chr").alias("chr"), F.max("pos").alias("pos"), F.max("dosage").alias("dosage"))


def clean_edges(el: DataFrame) -> DataFrame:
    """``snp1, snp2, chr1, chr2, pos1, pos2, r2, d``: each unordered marker pair once, with its latest usable r2 (finite, 0..1; the highest of equal times).

    Names in upper case without outer blanks; snp1 is the one with the higher (position, name), as the later marker of an edge; d is the distance within a
    chromosome, null across chromosomes."""
    name = lambda c: F.upper(F.trim(F.col(c)))
    end = lambda i: F.struct(F.col(f"pos{i}").alias("pos"), name(f"snp{i}").alias("snp"), F.col(f"chr{i}").alias("chr"))
    rows = el.where(F.col("r2").between(0.0, 1.0) & F.col("pos1").isNotNull() & F.col("pos2").isNotNull() & (name("snp1") != name("snp2")))
    rows = rows.select(F.greatest(end(1), end(2)).alias("hi"), F.least(end(1), end(2)).alias("lo"), "r2", F.unix_micros("computed_at").alias("t"))
    last = rows.groupBy(F.col("hi.snp").alias("snp1"), F.col("lo.snp").alias("snp2")).agg(F.max(F.struct("t", "r2", "hi", "lo")).alias("m"))
    same = F.col("m.hi.chr") == F.col("m.lo.chr")
    return last.select("snp1", "snp2", F.col("m.hi.chr").alias("chr1"), F.col("m.lo.chr").alias("chr2"), F.col("m.hi.pos").alias("pos1"), F.col("m.lo.pos").alias("pos2"), F.col("m.r2").alias("r2"), F.when(same, F.col("m.hi.pos") - F.col("m.lo.pos")).alias("d"))


MAP_COLUMNS = ["chr", "pos", "maf", "ld_w", "cl_id", "n_loci", "is_core", "median_ld", "grp"]


def clean_map(map_snp: DataFrame, *columns: str) -> DataFrame:
    """``marker`` and ``columns`` (all of ``MAP_COLUMNS`` if none are named) with the latest load of each marker, unusable numbers null, names in upper case.

    Loads of one time are told apart by their values in the order of ``MAP_COLUMNS``; what lies beyond the last column asked for is not read.
    """
    num = lambda c, lo, hi: F.when(F.col(c).between(lo, hi), F.col(c)).alias(c)
    values = {c: F.col(c) for c in MAP_COLUMNS} | {"maf": num("maf", 0.0, 0.5), "ld_w": num("ld_w", 0.0, 1.0), "median_ld": num("median_ld", 0.0, 1.0)}
    wanted = list(columns) or MAP_COLUMNS
    read = MAP_COLUMNS[: 1 + max(MAP_COLUMNS.index(c) for c in wanted)]
    rows = map_snp.where("marker IS NOT NULL").select(F.upper(F.trim("marker")).alias("marker"), F.struct(F.unix_micros("loaded_at").alias("t"), *[values[c] for c in read]).alias("m"))
    return rows.groupBy("marker").agg(F.max("m").alias("m")).select("marker", *[f"m.{c}" for c in wanted])


def chromosome_parameters(decay_sum: DataFrame) -> DataFrame:
    """``chr, a, b, c``: the medians over replicates of usable fits (a and c present, a > 0 and finite)."""
    ok = decay_sum.where("chr IS NOT NULL AND a IS NOT NULL AND c IS NOT NULL AND b IS NOT NULL").where((F.col("a") > 0) & ~F.isnan("a") & (F.col("a") < float("inf")) & ~F.isnan("c") & ~F.isnan("b"))
    return ok.groupBy("chr").agg(*[F.percentile(F.col(p), 0.5).alias(p) for p in ("a", "b", "c")])
