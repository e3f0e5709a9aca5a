"""Secret scans: a ledger of blobs, so that each content is scanned once for each version of a rule."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm._common import fresh_path, marked, scratch, text_or_empty


class Rule(NamedTuple):
    """A kind of secret. ``group`` of a match must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


#: The kinds of the query's contract, in its order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: White space between the lines of a key, also as the escapes of a quoted string.
_GAP = r"(?:[\x09-\x0D\x20]|\\[nrt])*+"
#: A private key with its headers and body, through the END line or, where that is missing, to the end of the base64 run.
#: Groups are repeated possessively: Java then loops over lines instead of calling itself for each.
PEM = (
    rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_GAP}[A-Za-z0-9-]+:[^\n\\]*+)*+"
    rf"(?:[^-]*+-----END [A-Z ]*PRIVATE KEY-----|(?:{_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+(?:{_GAP}[A-Za-z0-9+/]{{1,15}}={{1,2}})?)"
)
#: Further kinds that this operator finds by itself.
MORE = (
    Rule("pem", PEM, version=3),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE
#: A ledger's row: a blob, the kinds and versions of rules that it was scanned for, and what these found.
LEDGER = "blob string, scanned array<struct<kind:string,version:int>>, found array<struct<kind:string,version:int,start:int,end:int>>"
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: Cuts up to which a text is taken apart by substrings; each of these walks the text from its start.
FEW_CUTS = 64


def _pair(rule: Rule) -> Column:
    return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"))


def _pairs(rules: Sequence[Rule]) -> Column:
    return F.array(*map(_pair, rules))


def addressed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each content (blob, text) once, null texts being empty; equal contents meet in the tasks, before the shuffle."""
    body = text_or_empty(text)
    return docs.select(F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """A rule's matches in a text, leftmost first and without overlap: characters since the last one, and their own."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    all_ = F.filter(F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit"), parts.alias("part")), lambda x: x["hit"].isNotNull())
    return F.transform(all_, lambda x: F.struct(F.lit(rank).alias("rank"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), (F.length(x["part"]) >= rule.least).alias("enough")))


def scan(blobs: DataFrame, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows for the (blob, text) rows, one a blob, that lack a pair of blob and rule version in the ledger.

    A pair that the ledger has is not scanned again. Every pair that is scanned gets an entry, with no spans where nothing
    was found. Matches are placed by running sums of lengths, so that many of them in one text cost no more than sorting.
    """
    todo = blobs.select("blob", "text", _pairs(rules).alias("todo"))
    if ledger is not None:
        seen = ledger.select("blob", F.explode("scanned").alias("pair")).groupBy("blob").agg(F.collect_set("pair").alias("seen"))
        todo = todo.join(seen, "blob", "left").select("blob", "text", F.coalesce(F.array_except("todo", "seen"), "todo").alias("todo")).where(F.size("todo") > 0)
    none = F.array().cast("array<struct<rank:int,gap:int,size:int,enough:boolean>>")
    body = F.col("text")
    wanted = [F.when(F.array_contains("todo", _pair(r)) & body.rlike(r.pattern), _matches(body, r, k)).otherwise(none) for k, r in enumerate(rules)]
    each = todo.select("blob", "todo", F.posexplode_outer(F.flatten(F.array(*wanted))).alias("pos", "x"))
    ends = F.sum(F.col("x.gap") + F.col("x.size")).over(Window.partitionBy("blob", "x.rank").orderBy("pos")).cast("int")
    placed = each.select("blob", "todo", "x", ends.alias("end"))
    pair = F.element_at(_pairs(rules), F.col("x.rank") + 1)
    span = F.struct(pair["kind"].alias("kind"), pair["version"].alias("version"), (F.col("end") - F.col("x.size")).alias("start"), "end")
    return placed.groupBy("blob").agg(F.first("todo").alias("scanned"), F.collect_list(F.when(F.col("x.enough"), span)).alias("found"))


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The ledger kept at ``path``, an empty one where there is none yet."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def brought_up(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The ledger at ``path`` with entries for all contents of ``docs``; only what it lacks is scanned and appended."""
    spark = docs.sparkSession
    blobs = addressed(docs, text)
    known = opened(spark, path)
    scan(blobs, rules, None if known.isEmpty() else known).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """blob and its spans (start, rank, kind, end; by start, then in the order of the rules) for contents with any.

    Only entries of these rules' versions count; one that stands twice counts once.
    """
    known = F.array_contains(_pairs(rules), F.struct("x.kind", "x.version"))
    rank = (F.array_position(F.array(*(F.lit(r.kind) for r in rules)), F.col("x.kind")) - 1).cast("int").alias("rank")
    each = ledger.select("blob", F.explode("found").alias("x")).where(known).select("blob", "x.start", rank, "x.kind", "x.end").distinct()
    return each.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))


def _found(docs: DataFrame, rules: Sequence[Rule], ledger: str | None, text: str) -> DataFrame:
    """Written findings: the join with all paths then knows how large they are."""
    path = ledger or fresh_path(docs.sparkSession, "secrets-ledger")
    return scratch(findings(brought_up(docs, path, rules, text), rules), "secrets-findings")


def secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, ledger: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, blob and spans of every row: findings of each content, joined back to all rows that have it.

    ``ledger`` is the path of a ledger that is kept from run to run, in a folder that all machines share; without one, a
    new ledger is written below the shared folder. Null texts are empty. Rows without secrets have an empty list; equal
    rows get equal lists; empty tables give none.
    """
    paths = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(text_or_empty(text).cast("binary"), 256).alias("blob"))
    return paths.join(_found(docs, rules, ledger, text), "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _cuts(found: DataFrame) -> DataFrame:
    """blob and cuts (start, end) in order, from its spans: overlapping ones are one cut."""
    each = found.select("blob", F.explode("spans").alias("x")).select("blob", "x.start", "x.end")
    order = Window.partitionBy("blob").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("new", F.when(F.col("start") < before, 0).otherwise(1)).withColumn("cut", F.sum("new").over(order))
    merged = each.groupBy("blob", "cut").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "[SECRET]", ledger: str | None = None, text: str = "text") -> DataFrame:
    """The same rows and columns, with every secret in the text replaced by ``mark``; overlapping ones become one mark.

    Rows without secrets stay as they are, null texts too, and are not shuffled; equal rows get equal texts; empty tables
    give none. ``ledger`` as in ``secrets``.
    """
    column = lambda c: F.col(f"`{c}`")
    held = docs.select(F.struct(*map(column, docs.columns)).alias("_row"), F.sha2(text_or_empty(column(text)).cast("binary"), 256).alias("blob"))
    cuts = scratch(_cuts(_found(docs, rules, ledger, text)), "secrets-cuts")
    held = marked(held, cuts, "blob", "secrets-marks")
    both = held.where("_may").join(cuts, "blob", "left").select("_row", "cuts")
    old = F.col(f"_row.`{text}`")

    def kept(taken):
        """What stands before each cut, and after the last."""
        n = F.size("cuts")
        end = lambda i: F.coalesce(F.get("cuts", i - 1)["end"], F.lit(0))
        start = lambda i: F.coalesce(F.get("cuts", i)["start"], F.length(old))
        return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: taken(end(i), start(i) - end(i))), mark)

    few = kept(lambda at, n: old.substr(at + 1, n))
    many = F.get(F.transform(F.array(F.split(old, "")), lambda letters: kept(lambda at, n: F.array_join(F.slice(letters, at + 1, n), ""))), 0)
    new = F.when(F.col("cuts").isNull(), old).when(F.size("cuts") <= FEW_CUTS, few).otherwise(many)
    changed = both.select(*(new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
    return held.where("NOT _may").select("_row.*").unionByName(changed)
