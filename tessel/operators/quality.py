"""Thresholds, reject reasons, counters and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators.ordering import global_number
from tessel.operators.scoring import first_reason, reasons

#: Fractions of the nearest-rank summaries.
RANKS = {"p50": 0.50, "p90": 0.90, "p95": 0.95}


def within(limits: Sequence[tuple[Column, float, bool]]) -> Column:
    """Whether statistics keep to limits (statistic, limit, True for an upper one); limits of 0 are off, nulls pass."""
    passes = F.lit(True)
    for value, limit, upper in limits:
        if limit > 0:
            passes = passes & F.coalesce(value <= limit if upper else value >= limit, F.lit(True))
    return passes


def image_reject_reason(s: Column, size: int, least_range: int, least_std: float, border_std: float, edge_density: float, components: int, ratio: float) -> Column:
    """The first flaw of an image's statistics with its figures, or null; limits of 0 are off."""
    rules: list[tuple[Column, Column]] = [
        ((s["width"] != size) | (s["height"] != size), F.format_string(f"bad_size:[%d, %d]!=[{size},{size}]", s["width"], s["height"])),
        (s["max"] - s["min"] < least_range, F.format_string(f"low_dynamic_range:%d<min_range:{least_range}", s["max"] - s["min"])),
        (s["std"] < least_std, F.format_string(f"low_std:%.4f<min_std:{least_std:.4f}", s["std"])),
    ]
    if border_std > 0:
        rules.append((s["border_std"] > border_std, F.format_string(f"high_border_std:%.4f>max_border_std:{border_std:.4f}", s["border_std"])))
    if edge_density > 0:
        rules.append((s["border_edge_density"] > edge_density, F.format_string(f"high_border_edge_density:%.4f>max_border_edge_density:{edge_density:.4f}", s["border_edge_density"])))
    if components > 0:
        rules.append((s["foreground_component_count"] > components, F.format_string(f"too_many_foreground_components:%d>max_foreground_components:{components}", s["foreground_component_count"])))
    if ratio > 0:
        rules.append((s["largest_foreground_component_ratio"] < ratio, F.format_string(f"low_largest_foreground_component_ratio:%.4f<min_largest_foreground_component_ratio:{ratio:.4f}", s["largest_foreground_component_ratio"])))
    return first_reason(*rules)


def metric_flags(brightness: Column, contrast: Column, clipped: Column, edge_energy: Column) -> Column:
    return reasons((contrast < 0.045, "low_contrast"), (brightness < 0.12, "very_dark"), (brightness > 0.88, "very_light"), (clipped > 0.02, "high_clip"), (edge_energy < 0.010, "very_soft"))


def counters(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, value, n): counts by each column on its own; null and '' count as unknown."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")).alias("value")) for c in columns)))
    return df.select(values.alias("x")).groupBy("x.name", "x.value").agg(F.count("*").alias("n"))


def reason_counts(df: DataFrame, reason: str) -> DataFrame:
    """(reason, n) over comma-joined reasons; blanks are unknown."""
    one = F.explode(F.split(F.coalesce(reason, F.lit("")), ","))
    return df.select(one.alias("_r")).select(F.coalesce(F.nullif(F.trim("_r"), F.lit("")), F.lit("unknown")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def nearest_rank(df: DataFrame, value: str, tie: str) -> DataFrame:
    """One row: min, p50, p90, p95 and max of the non-null values, the ranks rounded half to even. No task sorts all rows."""
    some = df.where(F.col(value).isNotNull())
    numbered = global_number(some.select(value, tie), [value, tie], "_n")
    n = some.agg(F.count("*").alias("_size"))
    at = {name: F.bround((F.col("_size") - 1) * f).cast("long") + 1 for name, f in RANKS.items()}
    return numbered.join(F.broadcast(n)).agg(F.min(value).alias("min"), *(F.max(F.when(F.col("_n") == i, F.col(value))).alias(name) for name, i in at.items()), F.max(value).alias("max"))


def summary(df: DataFrame, keys: Sequence[str], elapsed: str, flags: str) -> DataFrame:
    """Count, total and mean time, and rows with a flag, for each key and in all (keys null)."""
    return df.rollup(*keys).agg(F.count("*").alias("n"), F.sum(elapsed).alias("elapsed"), F.avg(elapsed).alias("elapsed_mean"), F.count_if(F.col(flags) != "").alias("flagged"))


def per_class(dims: DataFrame, scored: DataFrame, key: str, means: Sequence[str], target: int | None = None) -> DataFrame:
    """Count, means and extremes of the score for each class, empty ones included; missing counts up to ``target``."""
    grouped = scored.groupBy(key).agg(F.count("*").alias("n"), *(F.avg(m).alias(f"{m}_mean") for m in means), F.min("score").alias("score_min"), F.max("score").alias("score_max"))
    both = dims.select(key).distinct().join(grouped, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return both.withColumn("missing", F.greatest(F.lit(0), F.lit(target) - F.col("n")).cast("long")) if target is not None else both


def tensor_stats(v: Column) -> Column:
    """min, max, mean and rms of an array's finite values, NaN without any; and how many lie outside [-1, 1]. Null for null."""
    finite = F.filter(F.transform(v, lambda x: x.cast("double")), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    total = F.aggregate(finite, F.lit(0.0), lambda s, x: s + x)
    squares = F.aggregate(finite, F.lit(0.0), lambda s, x: s + x * x)
    n = F.nullif(F.size(finite), F.lit(0))
    or_nan = lambda c, name: F.when(v.isNotNull(), F.coalesce(c, F.lit(float("nan")))).alias(name)
    return F.struct(or_nan(F.array_min(finite), "min"), or_nan(F.array_max(finite), "max"), or_nan(total / n, "mean"), or_nan(F.sqrt(squares / n), "rms"), F.size(F.filter(finite, lambda x: F.abs(x) > 1)).alias("clipped"))


def mse(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))


def psnr(error: Column) -> Column:
    return F.when(error <= 0, 99.0).otherwise(-10 * F.log10(error))


def caption_summary(rows: DataFrame) -> DataFrame:
    """One row on mined captions: counts, and scores, mean quality, mean highest negative and captions of accepted rows.

    ``rows`` has accepted, score, quality, negative and caption; a null ``accepted`` counts as rejected.
    """
    good = F.coalesce("accepted", F.lit(False))
    of = lambda c: F.when(good, F.col(c))
    return rows.agg(
        F.count("*").alias("total"), F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"), F.avg(of("score")).alias("score_mean"), F.min(of("score")).alias("score_min"), F.max(of("score")).alias("score_max"),
        F.avg(of("quality")).alias("quality_mean"), F.avg(of("negative")).alias("negative_mean"), F.count_distinct(of("caption")).alias("captions"),
    )


def most_common(rows: DataFrame, value: str, pos: str, most: int = 40) -> DataFrame:
    """The ``most`` commonest values with their counts; of equally common ones those that come first."""
    counted = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(pos).alias("_first"))
    return counted.orderBy(F.desc("n"), "_first", value).limit(most).select(value, "n")


def quality_report(rows: DataFrame, errors: DataFrame | None, values: Sequence[str], tie: str) -> DataFrame:
    """One row on a validated dataset: counts of metadata, errors, accepted, missing, invalid and valid images, and of each
    of ``values`` its nearest-rank summary over valid images (value_min, value_p50, ...).

    ``rows`` has accepted (null counts as true), there (its image exists) and reason (why it is invalid, else null).
    """
    accepted = F.coalesce("accepted", F.lit(True))
    valid = accepted & F.col("there") & F.col("reason").isNull()
    report = rows.agg(
        F.count("*").alias("metadata_rows"), F.count_if(accepted).alias("accepted_rows"), F.count_if(~accepted).alias("rejected_rows"), F.count_if(accepted & ~F.col("there")).alias("missing_images"),
        F.count_if(accepted & F.col("there") & F.col("reason").isNotNull()).alias("invalid_images"), F.count_if(valid).alias("valid_images"),
    )
    counted = errors.agg(F.count("*").alias("json_errors")) if errors is not None else report.select(F.lit(0).cast("long").alias("json_errors"))
    out = report.join(counted)
    for value in values:
        ranks = nearest_rank(rows.where(valid), value, tie)
        out = out.join(ranks.select(*(F.col(c).alias(f"{value}_{c}") for c in ranks.columns)))
    return out


def invalid_images(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The accepted rows whose image is there and has a flaw, with the reason."""
    return rows.where(F.coalesce("accepted", F.lit(True)) & F.col("there") & F.col("reason").isNotNull()).select(*columns, "reason")


def key_coverage(rows: DataFrame, key: str) -> DataFrame:
    """One row: the fewest and the most rows of any key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.min("n").alias("trained_seed_count"), F.max("n").alias("most"))


def chunk_timing(rows: DataFrame, step: str, load: str, predict: str, chunk: str) -> DataFrame:
    """Sums of each step's times, and its slowest chunk (the last among equals)."""
    return rows.groupBy(F.col(step).alias("step")).agg(F.sum(load).alias("load"), F.sum(predict).alias("predict"), F.max(predict).alias("most"), F.max_by(chunk, F.struct(predict, chunk)).alias("most_chunk"))


def paired_means(pairs: DataFrame, raw: str, processed: str) -> DataFrame:
    """One row: means of both sides of pairs, the mean difference, and how many pairs there are."""
    return pairs.agg(F.avg(raw).alias("raw_mean"), F.avg(processed).alias("processed_mean"), F.avg(F.col(processed) - F.col(raw)).alias("delta"), F.count("*").alias("n"))
