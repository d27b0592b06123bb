"""Shared working folder of the training-data operators.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``: every executor sees it, so a lost executor costs a
re-read and no lineage has to be replayed. Only where that setting is absent in a
session on one machine (tests, notebooks) a temporary local folder takes its
place; on a cluster its absence is an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder, ship_package

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound Arrow batches to 8 MB, unless the session sets a bound below Spark's 64 MB.

    Texts differ in length by orders of magnitude; batches of ten thousand rows
    would differ as much in the memory that a Python worker needs.
    """
    ship_package(spark)
    held = str(spark.conf.get(_BATCH, "67108864b")).rstrip("bB")
    if not held.isdigit() or int(held) >= 64 << 20:
        spark.conf.set(_BATCH, "8388608b")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return the table read back.

    It cuts lineage, gives the optimizer a measured size (so that it broadcasts
    only what is small) and is computed once however often it is read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
