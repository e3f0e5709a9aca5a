"""Structured Streaming: curation as files come in, counts, caps, windows and quotas."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessel.operators.selection import class_top


def read_stream(spark: SparkSession, path: str, schema: str, form: str = "parquet", files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(path)


def curate(stream: DataFrame, clean: dict[str, Column], reason: Column) -> DataFrame:
    """Cleaned columns, and accepted or the reason against it."""
    return stream.withColumns(clean).withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull())


def class_counts(stream: DataFrame, key: str, target: int) -> DataFrame:
    """Running counts of accepted rows by class, what is missing to the target, and whether it is complete."""
    counts = stream.groupBy(key).agg(F.count_if("accepted").alias("n"))
    return counts.withColumns({"missing": F.greatest(F.lit(0), F.lit(target) - F.col("n")), "complete": F.col("n") >= target})


def capped(stream: DataFrame, key: str, row: str, cap: int) -> DataFrame:
    """The first ``cap`` rows of each key, as batches come and by ``row`` within one; the state holds one number a key."""

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        first = None  # of a key's chunks in this batch, at most ``cap`` rows
        for chunk in batches:
            first = (chunk if first is None else pd.concat([first, chunk])).sort_values(row).head(max(cap - n, 0))
        if first is not None and len(first):
            state.update((n + len(first),))
            yield first

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return stream.groupBy(key).applyInPandasWithState(keep, kinds, "n long", "append", "NoTimeout")


def once(stream: DataFrame, row: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each id once; with a time, ids are forgotten after the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([row]) if time else stream.dropDuplicates([row])


def windowed(stream: DataFrame, time: str, key: str, value: str, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and means by key in windows; late rows wait for ``delay``."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = stream.withWatermark(time, delay).groupBy(span, key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return grouped.select(F.col("window.start").alias("start"), key, "n", "mean")


def sessions(stream: DataFrame, time: str, user: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    grouped = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("s"), user).agg(F.count("*").alias("n"))
    return grouped.select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def merge_quota(stream: DataFrame, path: str, key: str, order: Sequence[str | Column], n: int, columns: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Keeps the best ``n`` rows of each class of all batches: the table below ``path``/<batch>, at most classes x n rows.

    A batch that runs again starts from the batch before it, so it writes the same rows.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        both = batch.select(*columns)
        if number:
            both = both.unionByName(spark.read.schema(both.schema).parquet(f"{path}/{number - 1}"))
        marked = both.withColumns({"_in": F.lit(True), "_why": F.lit("")})
        class_top(marked, key, "_in", "_why", order, n, "overflow").where("_in").drop("_in", "_why").write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", write: Callable | None = None) -> None:
    """Runs a stream over all that is there, into Parquet (or ``write`` for each batch)."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (writer.foreachBatch(write).start() if write else writer.format("parquet").start(path)).awaitTermination()
