"""Queries on scored rows, joins and inventories."""

from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import inventory, quality, scoring
from tessel.operators import slots as S
from tessel.plans._registry import query, strings, table
from tessel.plans.prompts import CANONICAL, names, slotted

DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
#: Each label's three first vectors stand for its class prompts.
PROMPTS = "p AS (SELECT label AS key, embedding AS pv FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 3)"
SCORES = f"{PROMPTS}, s AS (SELECT vec_id, key, max({DOT.format(a='embedding', b='pv')}) AS score FROM embeddings, p GROUP BY ALL)"
TOP = f"{SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, key) AS n FROM s), t AS (SELECT a.vec_id, a.key AS top1_key, a.score AS top1_score, b.key AS top2_key, coalesce(b.score, -1) AS top2_score, a.score - coalesce(b.score, -1) AS margin FROM r a LEFT JOIN r b ON a.vec_id = b.vec_id AND b.n = 2 WHERE a.n = 1)"


def prompts(spark, sf_dir):
    from tessel.operators.selection import first_per_key

    return first_per_key(table(spark, sf_dir, "embeddings"), ["label"], ["vec_id"], 3).select(F.col("label").alias("key"), F.col("embedding").alias("pv"))


def scores(spark, sf_dir, part=None):
    items = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v") if part is None else part.alias("v"))
    return scoring.class_scores(items, prompts(spark, sf_dir), "vec_id", "v", "key", "pv").drop("v")


def best(spark, sf_dir, half=False):
    """Each vector's two best classes; the first half of vectors and prompts stands for the view of the center."""
    view = lambda c: F.slice(c, 1, 32) if half else F.col(c)
    items = table(spark, sf_dir, "embeddings").select("vec_id", "label", view("embedding").alias("v"))
    return scoring.top_two(scoring.scored(items, prompts(spark, sf_dir).withColumn("pv", view("pv")), "v", "key", "pv")).drop("v")


@query(f"WITH {SCORES} SELECT vec_id, key, score FROM s")
def j02_w02_image_class_scores(spark, sf_dir):
    return scores(spark, sf_dir)


@query(f"WITH {TOP} SELECT * FROM t")
def w01_top_two_margin(spark, sf_dir):
    return best(spark, sf_dir).drop("label")


HALF = TOP.replace("s AS (SELECT vec_id", "s AS (SELECT vec_id").replace("list_zip(embedding, pv)", "list_zip(embedding[1:32], pv[1:32])")


@query(f"WITH {TOP}, c AS (SELECT vec_id, top1_key AS center_key FROM (WITH {HALF} SELECT * FROM t)) SELECT t.vec_id, top1_key, center_key, top1_key = center_key AS agrees FROM t JOIN c ON t.vec_id = c.vec_id")
def w03_center_agreement(spark, sf_dir):
    """The first half of a vector stands for the view of the center."""
    whole = best(spark, sf_dir).select("vec_id", "top1_key")
    center = best(spark, sf_dir, half=True).select("vec_id", F.col("top1_key").alias("center_key"))
    return whole.join(center, "vec_id").withColumn("agrees", F.col("top1_key") == F.col("center_key"))


@query(f"WITH {SCORES} SELECT vec_id, key, score + CASE WHEN contains('label ' || vec_id, key::VARCHAR) THEN 0.05::DOUBLE ELSE 0 END AS score FROM s")
def w04_metadata_bonus(spark, sf_dir):
    blob = F.concat(F.lit("label "), F.col("vec_id").cast("string"))
    return scores(spark, sf_dir).select("vec_id", "key", (F.col("score") + F.when(F.contains(blob, F.col("key").cast("string")), 0.05).otherwise(0.0)).alias("score"))


@query(f"SELECT a.vec_id, {DOT.format(a='a.embedding', b='b.embedding')} AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def j03_own_caption_score(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    captions = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("caption"))
    return scoring.own_scores(e, captions, "vec_id", "embedding", "caption")


@query(f"""WITH {TOP} SELECT vec_id, concat_ws(',', CASE WHEN vec_id % 5 = 0 THEN 'missing_license' END, CASE WHEN top1_score < 0.3 THEN 'low_caption_score' END, CASE WHEN top2_score > 0.25 THEN 'high_negative_score' END) AS reasons FROM t""")
def f06_caption_reject_reasons(spark, sf_dir):
    t = best(spark, sf_dir)
    return t.select("vec_id", scoring.reasons((t.vec_id % 5 == 0, "missing_license"), (t.top1_score < 0.3, "low_caption_score"), (t.top2_score > 0.25, "high_negative_score")).alias("reasons"))


@query(f"""WITH {TOP} SELECT vec_id, concat_ws(',', CASE WHEN top1_score < 0.3 THEN 'low_top1_score' END, CASE WHEN margin < 0.02 THEN 'low_score_margin' END, CASE WHEN top1_key <> label THEN 'center_class_mismatch' END) AS reasons FROM t JOIN embeddings USING (vec_id)""")
def f07_class_reject_reasons(spark, sf_dir):
    t = best(spark, sf_dir)
    return t.select("vec_id", scoring.reasons((t.top1_score < 0.3, "low_top1_score"), (t.margin < 0.02, "low_score_margin"), (t.top1_key != t.label, "center_class_mismatch")).alias("reasons"))


WORDS = ["cat", "the", "eau", "sch"]


BLOB = r"trim(regexp_replace(replace(lower(text), '+', ' '), '[\s\p{Z}]+', ' ', 'g'))"


@query("SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains({BLOB}, '{w}')" for w in WORDS))
def f01_metadata_prefilter(spark, sf_dir):
    blob = T.normalize_text(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", blob.alias("blob"))
    return docs.where(F.exists(F.array(*map(F.lit, WORDS)), lambda w: F.contains(F.col("blob"), w))).select("doc_id")


@query(f"""WITH {slotted()}, c AS (SELECT prompt, {CANONICAL} AS canonical FROM s) SELECT prompt FROM c WHERE canonical IN ('bird', 'cat', 'penguin')""")
def f12_key_filter(spark, sf_dir):
    """Wanted keys are made canonical: a flying bird, kittens and ペンギン."""
    return S.key_filter(names(spark, sf_dir).distinct(), "prompt", " flying bird, kitten , ペンギン,", S.alias_table(spark)).select("prompt")


@query("SELECT count(*) AS everything FROM (SELECT DISTINCT p_name FROM part)")
def f12_no_key_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_name").distinct()
    for everything in ("all", " * ", "", None):
        rows = S.key_filter(rows, "p_name", everything, S.alias_table(spark))
    return rows.agg(F.count("*").alias("everything"))


@query("""WITH a AS (SELECT user_id, event_type, arg_max(value, event_id) AS raw FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT user_id, event_type, arg_max(value, event_id) AS processed FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT a.user_id, a.event_type, raw, processed, b.user_id IS NULL AS missing FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def j01_paired_ab_join(spark, sf_dir):
    """The last row of a repeated key counts; rows without a partner are marked."""
    e, keys = table(spark, sf_dir, "events"), ["user_id", "event_type"]
    left = e.where("event_id % 2 = 0").groupBy(*keys).agg(F.max_by("value", "event_id").alias("raw"))
    right = e.where("event_id % 2 = 1").select(*keys, "event_id", F.col("value").alias("processed"))
    return scoring.paired(left, right, keys, "event_id", strict=False)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS raw, 2 * o_totalprice AS processed FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j01_paired_strict(spark, sf_dir):
    """Every line has its order, of which the second of two versions counts; a line without one would be an error."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("raw"))
    versions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", F.explode(F.array(F.lit(2), F.lit(1))).alias("version"))
    return scoring.paired(lines, versions.select("l_orderkey", (F.col("o_totalprice") * F.col("version")).alias("processed"), "version"), ["l_orderkey"], "version")


@query("""SELECT coalesce(e, a) AS p_name, CASE WHEN a IS NULL THEN 'missing' WHEN regexp_matches(a, 'box$') THEN 'forbidden' WHEN e IS NULL THEN 'unexpected' ELSE 'present' END AS state
FROM (SELECT DISTINCT p_brand || ' ' || p_name AS e FROM part WHERE p_partkey % 2 = 0) FULL JOIN (SELECT DISTINCT p_brand || ' ' || p_name AS a FROM part WHERE p_partkey % 2 = 1) ON e = a""")
def j04_expected_inventory(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("p_name"))
    return inventory.compare(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "p_name", "box$")


@query("""WITH a AS (SELECT n, row_number() OVER (ORDER BY coalesce(try_cast(nullif(regexp_extract(n, '_part([0-9]+)[.]', 1), '') AS BIGINT), 10000), n) AS pos FROM (SELECT DISTINCT CASE WHEN p_size % 11 = 0 THEN 'old_' || p_size ELSE 'unet_part' || p_size || '.bundle' END AS n FROM part)),
e AS (SELECT i AS pos, 'unet_part' || i || '.bundle' AS n FROM (SELECT unnest(range(1, max(p_size) + 1)) AS i FROM part))
SELECT coalesce(e.pos, a.pos) AS pos, e.n AS expected, a.n AS actual, CASE WHEN a.n IS NULL THEN 'missing' WHEN regexp_matches(a.n, '^old_') THEN 'forbidden' WHEN e.n IS NULL THEN 'unexpected' WHEN e.n = a.n THEN 'same' ELSE 'differs' END AS state FROM e FULL JOIN a ON e.pos = a.pos""")
def j04_ordered_inventory(spark, sf_dir):
    """Parts by number against those that are there, some of them old ones."""
    part = table(spark, sf_dir, "part")
    number = F.col("p_size").cast("string")
    there = part.select(F.when(F.col("p_size") % 11 == 0, F.concat(F.lit("old_"), number)).otherwise(F.concat(F.lit("unet_part"), number, F.lit(".bundle"))).alias("name"))
    wanted = part.agg(F.max("p_size").alias("m")).select(F.explode(F.sequence(F.lit(1), "m")).alias("pos")).withColumn("name", F.concat(F.lit("unet_part"), F.col("pos").cast("string"), F.lit(".bundle")))
    return inventory.compare_ordered(wanted, there, "name", "_part([0-9]+)[.]", "^old_")


@query("SELECT doc_id::VARCHAR AS name, CASE WHEN doc_id % 3 = 0 THEN 'unlisted' WHEN doc_id % 3 = 1 THEN 'ok' ELSE 'mismatch' END AS state FROM documents")
def j05_checksum_verify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "doc_id", "text")
    listed = docs.where("doc_id % 3 > 0").select("name", F.when(F.col("doc_id") % 3 == 1, F.sha2(F.col("text").cast("binary"), 256)).otherwise("0").alias("digest"))
    return inventory.verify_checksums(docs.select("name", "text"), listed, "name", "text")


@query("""WITH a AS (SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM lineitem UNION ALL SELECT 'rms', sqrt(avg(l_quantity * l_quantity)) FROM lineitem), e AS (SELECT * FROM (VALUES ('rows', 60000.0::DOUBLE, 0.0::DOUBLE), ('rms', 29.0, 0.5), ('std', 1.0, 0.0)) v(metric, value, tolerance))
SELECT e.metric, a.value AS actual, e.value AS expected, coalesce(abs(a.value - e.value) <= tolerance, false) AS ok FROM e LEFT JOIN a ON a.metric = e.metric""")
def j06_golden_metrics(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").agg(F.count("*").cast("double").alias("rows"), F.sqrt(F.avg(F.col("l_quantity") * F.col("l_quantity"))).alias("rms"))
    actual = line.selectExpr("stack(2, 'rows', rows, 'rms', rms) AS (metric, value)")
    expected = spark.createDataFrame([("rows", 60000.0, 0.0), ("rms", 29.0, 0.5), ("std", 1.0, 0.0)], "metric string, value double, tolerance double")
    return inventory.golden(actual, expected)


@query("""SELECT a.vec_id, sqrt(list_sum(list_transform(d, lambda x: x * x)) / len(d)) AS rms, list_max(list_transform(d, lambda x: abs(x))) AS most FROM (
SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE - z[2]::DOUBLE) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a""")
def j07_vector_compare(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    d = F.zip_with("embedding", "other", lambda x, y: x.cast("double") - y.cast("double"))
    rms = T.let(d, lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / F.size(v)))
    return pairs.select("vec_id", rms.alias("rms"), T.let(d, lambda v: F.array_max(F.transform(v, lambda x: F.abs(x)))).alias("most"))


@query(f"SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), {strings(['red', 'scarlet', '赤', '赤い'])})")
def j08_alias_semi_join(spark, sf_dir):
    aliases = S.alias_table(spark).where("slot = 'color' AND key = 'red'")
    return S.has_alias(table(spark, sf_dir, "part"), aliases, "color", "p_name").select("p_partkey")


REPORT = """r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS border_std, l_tax AS edge, CASE l_returnflag WHEN 'R' THEN false WHEN 'A' THEN true END AS accepted, l_linenumber <> 7 AS there, CASE WHEN l_tax > 0.07 THEN 'high_border_edge_density' WHEN l_quantity > 48 THEN 'high_border_std' END AS reason FROM lineitem)"""


def ranked(v):
    at = lambda f: f"(SELECT {v} FROM v ORDER BY {v} LIMIT 1 OFFSET (SELECT round_even((count(*) - 1) * {f}::DOUBLE, 0)::BIGINT FROM v))"
    return f"(SELECT min({v}) FROM v) AS {v}_min, {at(0.5)} AS {v}_p50, {at(0.9)} AS {v}_p90, {at(0.95)} AS {v}_p95, (SELECT max({v}) FROM v) AS {v}_max"


def validated(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("border_std"), F.col("l_tax").alias("edge"), F.when(F.col("l_returnflag") == "R", False).when(F.col("l_returnflag") == "A", True).alias("accepted"),
        (F.col("l_linenumber") != 7).alias("there"), F.when(F.col("l_tax") > 0.07, "high_border_edge_density").when(F.col("l_quantity") > 48, "high_border_std").alias("reason"),
    )


@query(f"""WITH {REPORT}, v AS (SELECT * FROM r WHERE coalesce(accepted, true) AND there AND reason IS NULL)
SELECT count(*) AS metadata_rows, count(*) FILTER (WHERE coalesce(accepted, true)) AS accepted_rows, count(*) FILTER (WHERE NOT accepted) AS rejected_rows, count(*) FILTER (WHERE coalesce(accepted, true) AND NOT there) AS missing_images,
count(*) FILTER (WHERE coalesce(accepted, true) AND there AND reason IS NOT NULL) AS invalid_images, (SELECT count(*) FROM v) AS valid_images, (SELECT count(*) FROM events WHERE event_id % 7 = 0) AS json_errors, {ranked("border_std")}, {ranked("edge")} FROM r""")
def a07_quality_report(spark, sf_dir):
    from tessel.plans.sources import lines
    from tessel.sources.readers import parse_tolerant

    errors = parse_tolerant(lines(spark, sf_dir), "line", "k string")[1]
    rows = validated(spark, sf_dir).withColumn("row", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey"))
    return quality.quality_report(rows, errors, ["border_std", "edge"], "row")


@query(f"WITH {REPORT} SELECT l_orderkey, l_linenumber, l_partkey, reason FROM r WHERE coalesce(accepted, true) AND there AND reason IS NOT NULL")
def a07_invalid_images(spark, sf_dir):
    return quality.invalid_images(validated(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_partkey"])
