"""Caps, quotas and picks for each key, with the order among equals fixed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.operators.ordering import global_number, global_sum

Order = Sequence[str | Column]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Order, n: int) -> DataFrame:
    """The first ``n`` rows of each key; tasks trim keys before the shuffle, so a hot key is no large group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def number_in_key(df: DataFrame, keys: Sequence[str], order: Order, name: str = "n") -> DataFrame:
    """Adds each row's number within its key, from 1: the number over all rows by key and order, less the key's first.

    No key has to fit one task; null keys are a key of their own. ``order`` has to tell a key's rows apart.
    """
    numbered = global_number(df, [*keys, *order], "_all")
    first = numbered.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min("_all").alias("_first"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return numbered.join(first, same).withColumn(name, F.col("_all") - F.col("_first") + 1).drop("_all", "_first", *(f"_k{i}" for i in range(len(keys))))


def even_pick(df: DataFrame, keys: Sequence[str], order: Order, n: int) -> DataFrame:
    """``n`` rows of each key, spread evenly over its order: numbers from 0 at i (size - 1) / (n - 1), rounded half to even."""
    numbered = number_in_key(df, keys, order, "_n")
    sized = numbered.join(numbered.groupBy(*keys).agg(F.count("*").alias("_size")), list(keys))
    step = (F.col("_size") - 1) / F.lit(max(n - 1, 1))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * step).cast("long"))
    picked = (F.col("_size") <= n) | (F.col("_n") == 1 if n == 1 else F.array_contains(at, F.col("_n") - 1))
    return sized.where(picked).drop("_n", "_size")


def quality_score(border_std: Column, edge_density: Column, components: Column, ratio: Column) -> Column:
    """Fewer and smaller flaws score higher; zeros for components and ratio count as missing, hence as 1."""
    z = lambda c, other: F.coalesce(F.nullif(c.cast("double"), F.lit(0.0)), F.lit(other))
    return (
        F.lit(0.0) - z(border_std, 0.0) / 50.0 - z(edge_density, 0.0) * 20.0
        - F.greatest(F.lit(0.0), z(components, 1.0) - 1.0) * 0.15 - F.greatest(F.lit(0.0), 0.95 - z(ratio, 1.0)) * 2.0
    )


def diverse_pick(df: DataFrame, key: str, group: str, score: str, pos: str, n: int) -> DataFrame:
    """``n`` rows of each key in turns over its groups: all groups' best rows in order of score, then all second best, ...

    Of a group only the first ``n`` rows matter, and of groups the best ``n``, so both windows are trimmed.
    """
    best = Window.partitionBy(key, group).orderBy(F.desc(score), pos)
    ranked = df.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n)
    firsts = df.groupBy(key, group).agg(F.max(score).alias("_top"), F.min(pos).alias("_seen"))
    joined = ranked.join(firsts, [key, group])
    turn = Window.partitionBy(key).orderBy("_r", F.desc("_top"), "_seen")
    return joined.withColumn("_n", F.row_number().over(turn)).where(F.col("_n") <= n).drop("_r", "_top", "_seen", "_n")


def class_top(df: DataFrame, key: str, accepted: str, reason: str, order: Order, n: int, text: str) -> DataFrame:
    """Accepted rows beyond the first ``n`` of their class are rejected; ``text`` is added to their reasons."""
    numbered = number_in_key(df, [key, accepted], order, "_n")
    return numbered.withColumn("_over", F.col(accepted) & (F.col("_n") > n)).drop("_n").withColumns({accepted: F.col(accepted) & ~F.col("_over"), reason: F.when(F.col("_over"), F.concat_ws(",", F.nullif(F.col(reason), F.lit("")), F.lit(text))).otherwise(F.col(reason))}).drop("_over")


def unique_ids(df: DataFrame, base: str, order: Order, name: str) -> DataFrame:
    """Repeated ids get the suffix _1, _2, ... in order."""
    numbered = number_in_key(df, [base], order, "_n").withColumn("_n", F.col("_n") - 1)
    return numbered.withColumn(name, F.when(F.col("_n") == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), F.col("_n").cast("string")))).drop("_n")


def admit(df: DataFrame, pos: str, caption: str, reasons: str, cap: int, target: int, batch: int) -> DataFrame:
    """Admission in order: each caption at most ``cap`` times, ``target`` rows in all, a run that ends with the batch that
    reaches it. Adds accepted and replaces ``reasons``; rows after that batch are left out.

    A row without reasons is eligible; the first ``cap`` eligible of a caption are admitted until the target is reached. A
    row whose caption has been admitted ``cap`` times before it overflows, whatever else it fails.
    """
    eligible = F.coalesce(F.col(reasons), F.lit("")) == ""
    firsts = first_per_key(df.where(eligible), [caption], [pos], cap).select(F.col(pos).alias("_p"), F.lit(1).alias("_in"))
    marked = df.join(firsts, F.col(pos) == F.col("_p"), "left").withColumn("_in", F.coalesce("_in", F.lit(0))).drop("_p")
    counted = global_sum(marked, [pos], F.col("_in"), "_sum")
    counted = global_number(counted, [pos], "_row")
    end = counted.where(F.col("_sum") >= target).agg(F.min("_row").alias("_r")).select(F.coalesce(F.ceil(F.col("_r") / batch) * batch, F.lit(1 << 62)).alias("_end"))
    full = counted.where((F.col("_in") == 1) & (F.col("_sum") <= target)).groupBy(F.col(caption).alias("_c")).agg(F.count("*").alias("_k"), F.max(pos).alias("_last")).where(F.col("_k") >= cap)
    run = counted.join(F.broadcast(end)).where(F.col("_row") <= F.col("_end")).join(full, F.col(caption) == F.col("_c"), "left")
    accepted = (F.col("_in") == 1) & (F.col("_sum") <= target)
    overflow = F.coalesce(F.col(pos) > F.col("_last"), F.lit(False))
    text = F.when(accepted, "").when(eligible & ~overflow, "target_count_reached").otherwise(F.concat_ws(",", F.nullif(F.col(reasons), F.lit("")), F.when(overflow, "caption_overflow")))
    return run.withColumns({"accepted": accepted, reasons: text}).drop("_in", "_sum", "_row", "_end", "_c", "_k", "_last")


def until(df: DataFrame, pos: str, reason: str, n: int) -> DataFrame:
    """The rows up to the ``n``-th without a reason, in order; all rows if there are fewer."""
    summed = global_sum(df, [pos], F.col(reason).isNull().cast("long"), "_sum")
    return summed.where((F.col("_sum") < n) | ((F.col("_sum") == n) & F.col(reason).isNull())).drop("_sum")


def rolling_mean(df: DataFrame, keys: Sequence[str], order: Order, value: str, width: int, name: str = "mean", chunk: int = 100_000) -> DataFrame:
    """Adds the mean of ``value`` over the last ``width`` rows of a key, the row itself included.

    A key's rows are dealt into chunks; the last rows of one stand before the next as well, so no key has to fit one task.
    """
    at = F.col("_n") - 1
    own = F.struct(F.floor(at / chunk).alias("c"), F.lit(False).alias("before"))
    again = F.when(at % chunk > chunk - width, F.struct((F.floor(at / chunk) + 1).alias("c"), F.lit(True).alias("before")))
    dealt = number_in_key(df, keys, order, "_n").withColumn("_x", F.explode(F.array_compact(F.array(own, again)))).withColumn("_c", F.col("_x.c"))
    last = Window.partitionBy(*keys, "_c").orderBy("_n").rowsBetween(1 - width, 0)
    return dealt.withColumn(name, F.avg(value).over(last)).where(~F.col("_x.before")).drop("_n", "_x", "_c")


def contact_sheet(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """``n`` rows of each key, evenly picked, with their place on a sheet: sheet_row by key, sheet_col by order, from 0.

    What is picked is few rows a key, so the window of a key holds few; keys are numbered by ranges.
    """
    picked = even_pick(df, [key], order, n)
    rows = global_number(picked.select(key).distinct(), [key], "_row").select(key, (F.col("_row") - 1).cast("long").alias("sheet_row"))
    column = (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long")
    return picked.withColumn("sheet_col", column).join(rows, key)
