"""Tables on disk: built once for a version of their source, and changed by the buckets that a change touches.

A bucketed table is a folder of Parquet with a folder for each bucket of a key. A change reads the buckets of its keys and overwrites those;
all other files stay as they are. The writer moves a finished bucket into its place, so a change that fails midway leaves each bucket old or new, and
running it again gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import fresh_path, shared_dir

#: Buckets of a table, unless it says otherwise.
BUCKETS = 64
#: Keys that are sent to the tasks together.
KEYS = 500_000
_DONE = "_BUILT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def files(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Name to (bytes, time of change) of every data file below a path."""
    where, fs = _fs(spark, path)
    found, out = fs.listFiles(where, True), {}
    while found.hasNext():
        f = found.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out[f.getPath().toString()] = (f.getLen(), f.getModificationTime())
    return out


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _fs(spark, path)
    fs.delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Gives a folder another name, unless that is taken."""
    where, fs = _fs(spark, path)
    target = _fs(spark, to)[0]
    fs.mkdirs(target.getParent())
    return not fs.exists(target) and fs.rename(where, target)


def version(spark: SparkSession, *paths: str) -> str:
    """A digest of the files below the paths: names, sizes and times of change."""
    return hashlib.md5(repr([sorted(files(spark, p).items()) for p in paths]).encode()).hexdigest()


def once(spark: SparkSession, name: str, of: str, build: Callable[[str], object]) -> str:
    """The path of what ``build(path)`` wrote for a version of its source; built by whoever asks first, then only read."""
    path = f"{shared_dir(spark)}/siltstone-stored-{name}-{of}"
    if not exists(spark, f"{path}/{_DONE}"):
        made = fresh_path(spark, name)
        build(made)
        where, fs = _fs(spark, f"{made}/{_DONE}")
        fs.create(where).close()
        if not fs.rename(_fs(spark, made)[0], _fs(spark, path)[0]):  # another was first, or left a folder without its mark
            return made
    return path


@dataclass(frozen=True)
class Bucketed:
    """A table in buckets of ``key``."""

    spark: SparkSession
    path: str
    key: str
    buckets: int = BUCKETS

    def _of(self, df: DataFrame) -> Column:
        return F.pmod(F.xxhash64(df[self.key]), F.lit(self.buckets)).cast("int")

    def _rows(self, touched: list[int] | None = None) -> DataFrame:
        """The rows and bucket_, of some buckets or all; the schema is kept beside them, for a table may have no rows."""
        kind = self.spark.read.parquet(f"{self.path}/schema").schema
        rows = self.spark.read.schema(kind).parquet(f"{self.path}/rows")
        return rows if touched is None else rows.filter(F.col("bucket_").isin(touched))

    def read(self) -> DataFrame:
        return self._rows().drop("bucket_")

    def create(self, rows: DataFrame) -> Bucketed:
        dealt = rows.withColumn("bucket_", self._of(rows))
        dealt.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/schema")
        self._write(self._dealt(dealt), "static")
        return self

    @staticmethod
    def _dealt(rows: DataFrame) -> DataFrame:
        return rows.hint("rebalance", "bucket_")  # one hot key makes one large bucket: rebalancing cuts it into files of a bounded size

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", mode).partitionBy("bucket_").parquet(f"{self.path}/rows")

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self._of(keys).alias("b")).distinct().collect())  # at most ``buckets`` numbers

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """The rows with those keys, read from their buckets alone."""
        return self._rows(self._touched(keys)).drop("bucket_").join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _without(self, keys: DataFrame) -> DataFrame:
        """The rows with other keys, of the keys' buckets. Rows stay in the files' order and are not exchanged: the keys are sent to them, those of some buckets at a time."""
        gone = keys.distinct().withColumn("bucket_", self._of(keys))
        parts: list[tuple[list[int], int]] = []
        for bucket, n in sorted(gone.groupBy("bucket_").count().collect()):  # at most ``buckets`` rows
            if parts and parts[-1][1] + n <= KEYS:
                parts[-1] = ([*parts[-1][0], bucket], parts[-1][1] + n)
            else:
                parts.append(([bucket], n))
        out = self._rows([]) if not parts else None
        for own, n in parts:
            held = gone.filter(F.col("bucket_").isin(own)).select(self.key)
            part = self._rows(own).join(F.broadcast(held) if n <= KEYS else held, self.key, "left_anti")
            out = part if out is None else out.unionByName(part)
        return out

    def replace(self, rows: DataFrame, gone: DataFrame | None = None) -> list[int]:
        """All rows of the keys in ``rows``, and in ``gone``, make way for ``rows``. Gives the buckets that were written."""
        keys = rows.select(self.key) if gone is None else rows.select(self.key).unionByName(gone.select(self.key))
        touched = self._touched(keys)
        stay = self._without(keys)
        columns = [c for c in stay.columns if c != "bucket_"]
        after = stay.select(*columns, "bucket_").unionByName(self._dealt(rows.select(*columns, self._of(rows).alias("bucket_"))))
        filled = {r[0] for r in after.select("bucket_").distinct().collect()}
        self._write(after, "dynamic")
        for b in sorted(set(touched) - filled):  # a bucket without rows is not overwritten
            delete(self.spark, f"{self.path}/rows/bucket_={b}")
        return touched

    def remove(self, keys: DataFrame) -> list[int]:
        """Rows whose key is not among ``keys`` stay."""
        return self.replace(self.read().limit(0), keys)
