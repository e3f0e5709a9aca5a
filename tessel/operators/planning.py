"""Plans of generation jobs: slot combinations, seeds, grids, resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators.ordering import global_number
from tessel.operators.selection import number_in_key


def product(df: DataFrame, lists: Sequence[str], most: int) -> DataFrame:
    """One row for each combination of the lists' values, the last list turning fastest, at most ``most`` a row; adds idx.

    Combination i is worked out from i itself, so those beyond ``most`` are never made; an empty list gives no rows.
    """
    size = F.lit(1).cast("long")
    for c in lists:
        size = size * F.size(c)
    rows = df.withColumn("_size", F.least(size, F.lit(most).cast("long"))).where("_size > 0").withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_size") - 1)))
    stride, values = F.lit(1).cast("long"), {}
    for c in reversed(list(lists)):
        values[c] = F.get(c, ((F.col("idx") / stride).cast("long") % F.size(c)).cast("int"))
        stride = stride * F.size(c)
    return rows.withColumns(values).drop("_size")


def zip_cycle(df: DataFrame, lists: Sequence[str], most: int | None = None) -> DataFrame:
    """Row i takes value i of each list, starting over in short ones; as many rows as the longest list, or ``most``."""
    rows = F.lit(most) if most else F.greatest(*(F.size(c) for c in lists), F.lit(0))
    some = df.where(" AND ".join(f"size({c}) > 0" for c in lists)).withColumn("idx", F.explode(F.sequence(F.lit(0), rows - 1)))
    return some.withColumns({c: F.get(c, F.col("idx") % F.size(c)) for c in lists})


def slot_values(*sources: Column) -> Column:
    """The first of the sources that is a list with values."""
    return F.coalesce(*(F.when(F.size(s) > 0, s) for s in sources))


def variant_ids(df: DataFrame, keys: Sequence[str], base: str, order: Sequence[str]) -> DataFrame:
    """Repeated ids of a preset get _02, _03, ... in order."""
    return number_in_key(df, [*keys, base], order, "_n").withColumn(base, F.when(F.col("_n") > 1, F.concat(F.col(base), F.format_string("_%02d", "_n"))).otherwise(F.col(base))).drop("_n")


def focus(presets: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The presets of the ``wanted`` keys (key, idx) with idx, their place in the order asked for; a key that no preset
    has is an error."""
    asked = wanted.select(F.col(key).alias("_key"), F.col("idx"))
    missing = asked.join(presets.select(key), F.col("_key") == F.col(key), "left_anti").select("_key").limit(5).collect()
    if missing:
        raise ValueError(f"missing presets: {[r['_key'] for r in missing]}")
    return presets.join(asked, F.col(key) == F.col("_key")).drop("_key")


def padded(suffixes: Column, n: int) -> Column:
    """A list of n suffixes, the last one repeated."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(suffixes, F.least(i, F.size(suffixes) - 1)))


def jobs(variants: DataFrame, seeds: Sequence[int], order: Sequence[str]) -> DataFrame:
    """Every variant with every seed, and a running job_index; the seeds are a literal, so no join is needed."""
    each = variants.withColumn("seed", F.explode(F.array(*(F.lit(s).cast("long") for s in seeds))))
    position = F.array_position(F.array(*(F.lit(s).cast("long") for s in seeds)), F.col("seed"))
    return global_number(each, [*order, position], "_n").withColumn("job_index", F.col("_n") - 1).drop("_n")


def resume(plan: DataFrame, rows: DataFrame, job: str, accepted: str, complete: str) -> DataFrame:
    """The planned jobs without an accepted row whose outputs are all there."""
    return plan.join(rows.where(F.col(accepted) & F.col(complete)).select(job).distinct(), job, "left_anti")


def status(rows: DataFrame, run: str) -> DataFrame:
    """planned, completed, accepted, rejected and a state for each run; ``rows`` has done and accepted."""
    counted = rows.groupBy(run).agg(F.count("*").alias("planned"), F.count_if("done").alias("completed"), F.count_if(F.col("done") & F.col("accepted")).alias("accepted"), F.count_if(F.col("done") & ~F.col("accepted")).alias("rejected"))
    return counted.withColumn("state", F.when(F.col("completed") == F.col("planned"), "complete").when(F.col("completed") == 0, "stopped").otherwise("paused"))


def merged_list(*lists: Column, most: int) -> Column:
    """All values in order, each once by its lower case without hyphens, at most ``most``."""
    plain = lambda x: F.lower(F.replace(x, F.lit("-"), F.lit(" ")))
    step = lambda done, x: F.when(F.exists(done, lambda d: plain(d) == plain(x)), done).otherwise(F.array_append(done, x))
    return F.slice(F.aggregate(F.concat(*lists), F.array().cast("array<string>"), step), 1, most)


def grid(presets: DataFrame, order: str, seeds: Sequence[int], scales: Sequence[float]) -> DataFrame:
    """Scales x presets x seeds in this order, with idx."""
    scale = F.posexplode(F.array(*map(F.lit, scales))).alias("_g", "scale")
    seed = F.posexplode(F.array(*(F.lit(s).cast("long") for s in seeds))).alias("_s", "seed")
    each = presets.select("*", scale).select("*", seed)
    return global_number(each, ["_g", order, "_s"], "_n").withColumn("idx", F.col("_n") - 1).drop("_g", "_s", "_n")


def app_plan(keys: DataFrame, variants: int, seeds: int) -> DataFrame:
    """Each key with each variant v and seed s, both counted from 0."""
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return keys.distinct().withColumn("v", numbers(variants)).withColumn("s", numbers(seeds))


def variant_count(presets: DataFrame, products: Sequence[Sequence[str]], most: int) -> DataFrame:
    """One row: how many variants all presets have, each product of lists giving ``most`` at most."""
    n = F.lit(0).cast("long")
    for lists in products:
        size = F.lit(1).cast("long")
        for c in lists:
            size = size * F.size(c)
        n = n + F.least(F.lit(most).cast("long"), size)
    return presets.agg(F.sum(n).alias("variants"))


def named_values(text: Column, names: Sequence[str], fillers: Sequence[str], most: int) -> Column:
    """The names that a text holds, in their order, filled up with others to ``most``, each once."""
    found = F.filter(F.array(*map(F.lit, names)), lambda c: F.contains(text, c))
    return F.slice(F.array_distinct(F.concat(found, F.array(*map(F.lit, fillers)))), 1, most)


def probe_grid(probes: DataFrame, usable: Column, sizes: Sequence[int], steps: Sequence[int], multiple: int = 8) -> DataFrame:
    """Each probe with each size and number of steps; valid if it is usable and its size a multiple, and its output's size."""
    each = probes.withColumn("_usable", usable).withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("steps", F.explode(F.array(*map(F.lit, steps))))
    return each.withColumns({"valid": (F.col("size") % multiple == 0) & F.col("_usable"), "output": F.col("size") * multiple}).drop("_usable")


def pairs(text: Column) -> Column:
    """key:seed items of a comma list, split at the last colon."""
    return F.transform(F.split(text, ","), lambda x: F.struct(F.regexp_extract(x, "^(.*):[^:]*$", 1).alias("key"), F.regexp_extract(x, ":([^:]*)$", 1).try_cast("long").alias("seed")))


def sampled_slot(values: Column, empties: int, *seed: Column) -> Column:
    """A value by hash, or '' with the weight of ``empties`` values; the same for the same seed."""
    number = F.conv(F.substr(F.md5(F.concat_ws(":", *(s.cast("string") for s in seed))), F.lit(1), F.lit(8)), 16, 10).cast("long")
    i = (number % (F.size(values) + empties)).cast("int")
    return F.coalesce(F.get(values, i), F.lit(""))
