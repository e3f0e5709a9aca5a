"""What is there against what should be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators.ordering import global_number


def classify(name: Column, rules: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """The label of the first pattern that a name holds."""
    found = F.lit(other)
    for pattern, label in reversed(rules):
        found = F.when(name.rlike(pattern), label).otherwise(found)
    return found


def compare(expected: DataFrame, actual: DataFrame, key: str, forbidden: str | None = None) -> DataFrame:
    """key and state: missing, unexpected, forbidden (matches the pattern) or present."""
    e, a = expected.select(F.col(key).alias("_e")).distinct(), actual.select(F.col(key).alias("_a")).distinct()
    both = e.join(a, e["_e"] == a["_a"], "full_outer")
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_a").rlike(forbidden) if forbidden else F.lit(False), "forbidden").when(F.col("_e").isNull(), "unexpected").otherwise("present")
    return both.select(F.coalesce("_e", "_a").alias(key), state.alias("state"))


def verify_checksums(actual: DataFrame, expected: DataFrame, name: str, content: str) -> DataFrame:
    """name and state of each content: ok, mismatch, or unlisted, which passes. ``expected`` has name and digest."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    both = actual.select(name, digest.alias("_d")).join(expected.select(F.col("name").alias("_n"), "digest"), F.col(name) == F.col("_n"), "left")
    return both.select(name, F.when(F.col("digest").isNull(), "unlisted").when(F.col("digest") == F.col("_d"), "ok").otherwise("mismatch").alias("state"))


def golden(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """metric, actual, expected and ok for long tables of (metric, value) and (metric, value, tolerance)."""
    both = expected.alias("e").join(actual.alias("a"), "metric", "left")
    return both.select("metric", F.col("a.value").alias("actual"), F.col("e.value").alias("expected"), F.coalesce(F.abs(F.col("a.value") - F.col("e.value")) <= F.col("e.tolerance"), F.lit(False)).alias("ok"))


def compare_ordered(expected: DataFrame, actual: DataFrame, name: str, part: str, forbidden: str | None = None, last: int = 10_000) -> DataFrame:
    """pos, expected, actual and state of two lists: same, differs, missing, unexpected, or forbidden by the pattern.

    ``expected`` has pos and the name; the actual names are ordered by the number that the pattern ``part`` finds in them
    (``last`` without one), then by themselves. The lists are equal if every state is same.
    """
    number = F.coalesce(F.nullif(F.regexp_extract(name, part, 1), F.lit("")).try_cast("long"), F.lit(last).cast("long"))
    placed = global_number(actual.select(name).distinct().withColumn("_part", number), ["_part", name], "_pos").select(F.col(name).alias("actual"), F.col("_pos"))
    both = expected.select(F.col("pos").cast("long").alias("pos"), F.col(name).alias("expected")).join(placed, F.col("pos") == F.col("_pos"), "full_outer")
    bad = F.col("actual").rlike(forbidden) if forbidden else F.lit(False)
    state = F.when(F.col("actual").isNull(), "missing").when(bad, "forbidden").when(F.col("expected").isNull(), "unexpected").when(F.col("expected") == F.col("actual"), "same").otherwise("differs")
    return both.select(F.coalesce("pos", "_pos").cast("long").alias("pos"), "expected", "actual", state.alias("state"))


def tier(size: Column, tiny: float, ok: float) -> Column:
    """tiny, ok or heavy by two limits, which belong to the lower tier."""
    return F.when(size <= tiny, "tiny").when(size <= ok, "ok").otherwise("heavy")


def rollup(artifacts: DataFrame, name: str, size: str, rules: Sequence[tuple[str, str]], tiny: float, ok: float) -> DataFrame:
    """component, tier, n and mb: artifacts counted and their sizes summed by what the name says and by tier."""
    return artifacts.groupBy(classify(F.col(name), rules).alias("component"), tier(F.col(size), tiny, ok).alias("tier")).agg(F.count("*").alias("n"), F.sum(size).alias("mb"))
