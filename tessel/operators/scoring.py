"""Boxes, class scores, margins and rejections of scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.operators.shared import kept


def object_candidates(boxes: DataFrame, keys: Sequence[str], label: str, least_area: float) -> DataFrame:
    """Largest box of each label of a row, by area; group boxes, invalid corners and small areas are left out.

    ``boxes`` has pos, xmin, xmax, ymin, ymax, is_group_of; rank counts a row's labels from the largest box.
    """
    corners = {c: F.col(c).try_cast("double") for c in ("xmin", "xmax", "ymin", "ymax")}
    area = F.greatest(F.lit(0.0), F.col("xmax") - F.col("xmin")) * F.greatest(F.lit(0.0), F.col("ymax") - F.col("ymin"))
    valid = boxes.where(~F.coalesce("is_group_of", F.lit(False))).withColumns(corners).dropna(subset=list(corners)).withColumn("area", area).where(F.col("area") >= least_area)
    by_area = [F.desc("area"), "pos"]
    best = valid.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, label).orderBy(*by_area))).where("_n = 1").drop("_n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by_area)).cast("long"))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays, in doubles, first to last."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scored(items: DataFrame, prompts: DataFrame, vector: str, prompt_key: str, prompt_vector: str, name: str = "scores") -> DataFrame:
    """Adds an array of (key, score), by key: the largest product with any of a class's prompts.

    ``prompts`` is a list of class prompts, a few rows a class: it comes to each row as one array, so no product is a
    shuffled row. The array is worked out once and written; Spark broadcasts its one row if that is small enough.
    """
    packed = prompts.groupBy(F.col(prompt_key).alias("_key")).agg(F.collect_list(prompt_vector).alias("_vs")).agg(F.sort_array(F.collect_list(F.struct("_key", "_vs"))).alias("_classes"))
    best = F.transform("_classes", lambda c: F.struct(c["_key"].alias("key"), F.array_max(F.transform(c["_vs"], lambda v: dot(F.col(vector), v))).alias("score")))
    return items.join(kept(packed, "prompts")).withColumn(name, best).drop("_classes")


def class_scores(items: DataFrame, prompts: DataFrame, item_id: str, vector: str, prompt_key: str, prompt_vector: str) -> DataFrame:
    """(item, key, score) for each class; see ``scored``."""
    return scored(items, prompts, vector, prompt_key, prompt_vector, "_s").select(*items.columns, F.explode("_s").alias("_x")).select(*items.columns, "_x.key", "_x.score")


def top_two(rows: DataFrame, scores: str = "scores") -> DataFrame:
    """Replaces the array of (key, score) by top1_key, top1_score, top2_key, top2_score (-1 if there is one class) and
    margin; ties go to the smaller key."""
    ranked = F.sort_array(F.transform(scores, lambda x: F.struct((-x["score"]).alias("s"), x["key"].alias("key"))))
    two = rows.withColumn("_r", ranked).drop(scores)
    first, second = F.get("_r", 0), F.get("_r", 1)
    low = F.coalesce(-second["s"], F.lit(-1.0))
    return two.withColumns({"top1_key": first["key"], "top1_score": -first["s"], "top2_key": second["key"], "top2_score": low, "margin": -first["s"] - low}).drop("_r")


def reasons(*rules: tuple[Column, str]) -> Column:
    """All reasons that hold, comma-joined; '' for none."""
    return F.concat_ws(",", *(F.when(c, text) for c, text in rules))


def first_reason(*rules: tuple[Column, str | Column]) -> Column:
    """The first reason that holds; null for none."""
    return F.coalesce(*(F.when(c, F.lit(text) if isinstance(text, str) else text) for c, text in rules))


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, strict: bool = True) -> DataFrame:
    """Left rows with the right row of equal keys, the last by ``order`` where there are several.

    A left row without a partner is an error, or, if not ``strict``, is kept with nulls and ``missing`` set. Columns of
    both sides must differ, but for the keys.
    """
    values = [c for c in right.columns if c not in keys]
    last = right.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_last"))
    both = left.join(last, list(keys), "left")
    if strict:
        lacking = both.where("_last IS NULL").select(*keys).limit(5).collect()
        if lacking:
            raise ValueError(f"no partner for {[tuple(r) for r in lacking]}")
    flag = [] if strict else [F.col("_last").isNull().alias("missing")]
    return both.select(*left.columns, *(F.col(f"_last.`{c}`").alias(c) for c in values if c != order), *flag)


def own_scores(rows: DataFrame, captions: DataFrame, key: str, vector: str, other: str) -> DataFrame:
    """key and the product of each row's vector with its own caption's."""
    return rows.join(captions, key).select(key, dot(F.col(vector), F.col(other)).alias("score"))
