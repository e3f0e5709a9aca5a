"""What the operators share: the shared scratch folder, row keys and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: few, since one document can be very long.
ARROW_ROWS = 1000
#: With this, Spark removes a query's shuffle files when it ends; else they stay until the driver collects its garbage.
NO_SHUFFLES_LEFT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Powers of two of a bitmap's bits: in one of its rows, and in all at most (16 MB, which are broadcast).
ROW_BITS, MOST_BITS = 15, 27


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset a new local one for a local
    session, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: later steps survive lost executors and recompute nothing.

    The shuffles behind ``df`` are not needed again, and their files go.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(NO_SHUFFLES_LEFT, "false")
    spark.conf.set(NO_SHUFFLES_LEFT, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(NO_SHUFFLES_LEFT, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of text small, so that long documents don't meet in one batch by thousands.

    Spark bounds a batch's bytes by itself (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB).
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def remainder(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """``df.mapInArrow`` of a function on single batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)


def list_array(offsets: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def marked(rows: DataFrame, wanted: DataFrame, key: str, name: str) -> DataFrame:
    """Adds _may: whether a row's ``key`` may be among those of ``wanted``, by a bitmap of their hashes.

    The bitmap has 16 bits a key, up to a bound; a fuller one marks more rows, and the join that follows drops them.
    """
    bits = min(MOST_BITS, max(ROW_BITS, int(16 * wanted.count()).bit_length()))
    place = F.xxhash64(key).bitwiseAND((1 << bits) - 1)
    row, bit = F.shiftright(place, ROW_BITS).alias("_row_of_bits"), place.bitwiseAND((1 << ROW_BITS) - 1)
    marks = scratch(wanted.select(row, bit.alias("_bit")).groupBy("_row_of_bits").agg(F.bitmap_construct_agg("_bit").alias("_bits")), name)
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.call_function("shiftright", byte, bit.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    return rows.withColumn("_row_of_bits", row).join(F.broadcast(marks), "_row_of_bits", "left").withColumn("_may", may).select(*rows.columns, "_may")
