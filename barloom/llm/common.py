"""Shared helpers: table reading, scratch tables, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python workers hold this many texts at a time; whole texts pass, however long.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a local one only when running on one machine without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    The copy is deleted when the driver ends.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    drop_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch of texts holds."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _settled(edges: DataFrame) -> bool:
    """Every source has one target, and no target is a source."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("s"), F.lit(1).alias("t"))
    )
    seen = ends.groupBy("n").agg(F.sum("s").alias("s"), F.max("t").alias("t"))
    return seen.where((F.col("s") > 1) | ((F.col("s") > 0) & (F.col("t") > 0))).isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches; nodes without links have no row.

    Alternates two star steps: each node passes its smallest neighbour on to its larger neighbours, then to
    its smaller ones. Minima are combined before the shuffle and joined back, so a node with very many links
    is never gathered in one task (a skewed join partition is split). Rounds grow with the logarithm of the
    longest chain; each is written to the shared folder.
    """
    edges = stored(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        after = (
            large.join(small, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u > v")
            .distinct()
        )
        before, edges = edges, stored(after, "links")
        drop_stored(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def give_back() -> None:
    """Hand memory that earlier tasks of a reused worker have freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def python_batches(batches: Iterator, rows: int = BATCH_ROWS) -> Iterator:
    """Arrow record batches cut to at most ``rows`` rows."""
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Encoded:
    """A bounded memo from pieces of text to their ids as little-endian 32-bit bytes; new pieces are encoded in batches."""

    def __init__(self, encode, limit: int = 400_000):
        self.encode, self.limit, self.known = encode, limit, {}

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        new = list({piece for pieces in texts for piece in pieces if piece not in known})
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            known.update(zip(part, self.encode(part)))
        get = known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in texts]
