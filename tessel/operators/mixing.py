"""Several sources made one training table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.operators.selection import first_per_key


def union_roots(roots: Sequence[tuple[DataFrame, int, int]], key: str, pos: str) -> DataFrame:
    """All roots' rows: of each (table, cap, repeat) the first ``cap`` rows a key, ``repeat`` times; adds root and rep."""
    parts = []
    for i, (df, cap, repeat) in enumerate(roots):
        capped = first_per_key(df, [key], [pos], cap) if cap > 0 else df
        parts.append(capped.withColumns({"root": F.lit(i), "rep": F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct keys of one table that another lacks."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def hashed(seed: int, row: str) -> Column:
    """What rows are ordered by to be shuffled: the same at every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row).cast("string")))


def sample(df: DataFrame, row: str, key: str, seed: int, per_key: int, most: int) -> DataFrame:
    """``most`` rows in an order by hash, at most ``per_key`` a key."""
    shuffled = df.withColumn("_h", hashed(seed, row))
    return first_per_key(shuffled, [key], ["_h", row], per_key).orderBy("_h", row).limit(most).drop("_h")


def ratio_mix(df: DataFrame, source: str, row: str, ratios: Mapping[str, float], total: int, seed: int) -> DataFrame:
    """ratio x total rows of each source, chosen by hash; sources without a ratio are left out."""
    quota = F.lit(0)
    for name, ratio in ratios.items():
        quota = F.when(F.col(source) == name, round(ratio * total)).otherwise(quota)
    most = max((round(r * total) for r in ratios.values()), default=0)
    shuffled = df.where(F.col(source).isin(list(ratios))).withColumn("_h", hashed(seed, row))
    n = F.row_number().over(Window.partitionBy(source).orderBy("_h", row))
    return shuffled.withColumn("_n", n).where(F.col("_n") <= most).where(F.col("_n") <= quota).drop("_h", "_n")
