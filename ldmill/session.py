"""Session helpers: the shared folder, tables that cut lineage, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where it is unset, a temporary one of this machine, which only a local master may use."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


def _width(df: DataFrame) -> Column:
    """About the bytes of a row in memory: its strings and arrays by their length."""
    parts, fixed = [], 16
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(f.dataType, (ArrayType, MapType)):
            parts.append(F.coalesce(F.size(c), F.lit(0)) * 16)
        elif isinstance(f.dataType, StructType):
            fixed += 16 * len(f.dataType.fields)
        fixed += 8
    return sum((p.cast("long") for p in parts), F.lit(fixed).cast("long"))


class Tables:
    """Intermediate tables of one operator call, written to the shared folder so that lineage ends there and a lost executor costs nothing."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}", 0
        _WRITTEN.append(self.root)

    def cut(self, df: DataFrame, **figures: Column) -> DataFrame:
        """``df`` as a table. Its rows and bytes, and any further aggregates, are taken as it is written, for ``figure`` and ``broadcast_if_small``."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_width(df)), F.lit(0)).alias("bytes"), *[c.alias(k) for k, c in figures.items()]).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._table_path, out._figures = path, seen.get
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._table_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def figure(table: DataFrame, name: str = "rows"):
    """The number of rows, or another aggregate taken, of a table that ``Tables.cut`` wrote, without a job."""
    return table._figures[name]


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 32_000_000, within: DataFrame | None = None) -> DataFrame:
    """``df`` with a broadcast hint where its rows and bytes are proven small, unchanged (any join strategy) otherwise.

    A table that was cut knows its size; ``within`` names a cut table that has at least the rows and columns of ``df``. Anything else is counted by a job."""
    known = getattr(df if within is None else within, "_figures", None)
    if known is None:
        some = df.limit(max_rows + 1)
        r = some.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_width(df)), F.lit(0)).alias("bytes")).first()
        known = r.asDict()
    return F.broadcast(df) if known["rows"] <= max_rows and known["bytes"] <= max_bytes else df


def clean_tables(spark: SparkSession) -> None:
    """Delete every table the operators of this process wrote to the shared folder; results not yet stored elsewhere can't be read any more."""
    jvm = spark._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
