"""Report and data set sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder of the session.

    Where none is set a local folder does on one machine; on a cluster the executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and read it back, for plans that pass over it several times.

    The copy lives in the shared folder, so a lost executor costs a re-read and not the
    lineage behind it. It is deleted when the driver ends.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    drop_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_report(df: DataFrame, path: str, *, fmt: str = "json", partition_by: Sequence[str] = ()) -> None:
    """Write a report table as json, csv or parquet; csv flattens nested columns to JSON text."""
    if fmt == "csv":
        flat = [
            F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c)
            for c in df.columns
        ]
        df.select(*flat).write.mode("overwrite").csv(path, header=True)
        return
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Train, validation and test sets, one folder each, so a reader of one never lists the others."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)
