"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch: texts may be long, so batches are bounded by what they weigh, not by their rows.
ARROW_BYTES = "2m"
#: Columns of a text's two 64-bit marks.
MARKS = ("_siltstone_mark_a", "_siltstone_mark_b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table under ``sf_dir`` (any path that Spark's readers open). Registered queries bound their Arrow batches here."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def marks(text: Column) -> dict[str, Column]:
    """128 bits of the text by column name: with the id they tell rows apart where ids repeat or are null."""
    return dict(zip(MARKS, (F.xxhash64(text), F.xxhash64(F.lit(1), text)), strict=True))


@functools.cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="siltstone-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset: it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors. It goes by ``forget``, or at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    atexit.register(_delete, spark, path)
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    _delete(df.sparkSession, df._siltstone_path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder is then the cluster's to clean
        pass
