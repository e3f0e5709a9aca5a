"""URL filters: host-suffix and path-prefix expressions looked up by short hash prefixes."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that the lookup joins on.
PREFIX = 8


class Rule(NamedTuple):
    """Fits its host and all subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both are empty where the url is null or has no ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(text, r"^[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract(text, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1),
    })


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    Each url is expanded into the expressions that a rule can have: as many last labels of its host, and as many first
    characters of its path, as some rule has. These meet the rules by the first digits of their SHA-256; the full digest
    then confirms the match. The longest rule wins, and block among equal ones; without any, rule is null and the verdict
    is ``default``. Null urls have empty hosts and fit no rule; equal rows get equal results; a null page_id stays.
    The rules come as a list, so their number is that of a configuration, and Spark decides by size whether to broadcast.
    """
    rows = parts(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url")), "_url").drop("_url")
    if not rules:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    table = pages.sparkSession.createDataFrame([(r.host + r.path, r.verdict) for r in rules], "rule string, verdict string")
    table = table.groupBy("rule").agg(F.max("verdict").alias("verdict")).withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, PREFIX))
    labels = F.size(F.split("host", r"\."))
    found = [F.when((F.col("host") != "") & (labels >= n) & (F.length("path") >= k), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, k))) for n, k in shapes]
    asked = (
        rows.distinct().withColumn("expression", F.explode(F.array_compact(F.array(*found))))
        .withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, PREFIX))
    )
    hits = asked.join(table, "short").where(asked.digest == table.digest)
    best = hits.groupBy("page_id", "host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    both = rows.alias("a").join(best.alias("b"), F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.host") == F.col("b.host")) & (F.col("a.path") == F.col("b.path")), "left")
    return both.select("a.page_id", "a.host", "a.path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
