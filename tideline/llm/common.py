"""Shared folders, written intermediates and row helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.scratch import fresh


#: Settings that bound memory and disk, whatever the texts: bytes of one batch handed to Python, and shuffle files, which go as soon as a query ends.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": ("false", "true")}


def bound(spark: SparkSession) -> None:
    """Applies ``SETTINGS`` where the session has Spark's own defaults."""
    for key, (default, value) in SETTINGS.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)


class Scratch:
    """Tables of one operator run in the shared folder; ``drop`` deletes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        bound(spark)
        self.spark, self.root, self.n = spark, fresh(spark, name), 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def save(self, df: DataFrame, **options) -> DataFrame:
        """Writes ``df`` and reads it back: lineage is cut and survives lost executors."""
        path = self.path()
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all of this run's tables but these, which a result still reads."""
        kept = {t.scratch_path for t in tables}
        self._delete(*(f"{self.root}/{k}" for k in range(1, self.n + 1) if f"{self.root}/{k}" not in kept))

    def drop(self, *tables: DataFrame) -> None:
        self._delete(*(t.scratch_path for t in tables))

    def _delete(self, *paths: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: numbers of buckets and groups follow it."""
    return docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def buckets_for(size: int, each: int, least: int = 24, most: int = 1 << 16) -> int:
    return int(min(most, max(least, -(-size // each))))
