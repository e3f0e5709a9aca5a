"""Queries on filters, caps, quotas and summaries."""

from pyspark.sql import functions as F

from tessel.operators import inventory, ordering, quality, scoring, selection
from tessel.plans._registry import query, table

ORDERS = "o AS (SELECT *, o_orderpriority AS key, (o_custkey % 40)::VARCHAR AS prompt, round(-o_totalprice / 1000, 3) AS score FROM orders)"


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumns({"key": F.col("o_orderpriority"), "prompt": (F.col("o_custkey") % 40).cast("string"), "score": F.round(-F.col("o_totalprice") / 1000, 3)})


STATS = "s AS (SELECT *, l_quantity AS border_std, l_tax AS edge, l_linenumber AS components, l_discount * 10 AS ratio FROM lineitem)"


def stats(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumns({"border_std": F.col("l_quantity"), "edge": F.col("l_tax"), "components": F.col("l_linenumber"), "ratio": F.col("l_discount") * 10})


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders")
def w06_output_order(spark, sf_dir):
    return ordering.global_number(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [-F.col("o_totalprice"), "o_orderkey"]).select("o_orderkey", F.col("n").cast("long").alias("n"))


@query(f"WITH {ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o_orderkey) AS n FROM o) SELECT key, o_orderkey FROM r WHERE n <= 24")
def w09_first_per_key(spark, sf_dir):
    return selection.first_per_key(orders(spark, sf_dir), ["key"], ["o_orderkey"], 24).select("key", "o_orderkey")


@query(f"""WITH {ORDERS}, r AS (SELECT key, o_orderkey, row_number() OVER (PARTITION BY key ORDER BY o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY key) AS size FROM o)
SELECT key, o_orderkey FROM r WHERE size <= 17 OR list_contains(list_transform(range(17), lambda i: round_even(i * (size - 1) / 16.0::DOUBLE, 0)::BIGINT), n)""")
def w08_even_pick(spark, sf_dir):
    return selection.even_pick(orders(spark, sf_dir).select("key", "o_orderkey"), ["key"], ["o_orderkey"], 17).select("key", "o_orderkey")


QUALITY = "-coalesce(border_std, 0) / 50.0 - coalesce(edge, 0) * 20.0 - greatest(0, coalesce(nullif(components, 0), 1) - 1) * 0.15::DOUBLE - greatest(0, 0.95::DOUBLE - coalesce(nullif(ratio, 0), 1)) * 2.0"


@query(f"WITH {STATS}, q AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, round({QUALITY}, 6) AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM q) SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, score FROM r WHERE n <= 50")
def w10_quality_pick(spark, sf_dir):
    s = stats(spark, sf_dir)
    row = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    scored = s.select("l_returnflag", *row, F.round(selection.quality_score(s.border_std, s.edge, s.components, s.ratio), 6).alias("score"))
    return selection.first_per_key(scored, ["l_returnflag"], [F.desc("score"), *row], 50)


@query(f"""WITH {ORDERS}, a AS (SELECT *, row_number() OVER (PARTITION BY key, prompt ORDER BY score DESC, o_orderkey) AS r, max(score) OVER (PARTITION BY key, prompt) AS top, min(o_orderkey) OVER (PARTITION BY key, prompt) AS seen FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r, top DESC, seen) AS n FROM a) SELECT key, prompt, o_orderkey FROM b WHERE n <= 100""")
def w11_quality_diverse(spark, sf_dir):
    return selection.diverse_pick(orders(spark, sf_dir), "key", "prompt", "score", "o_orderkey", 100).select("key", "prompt", "o_orderkey")


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT user_id, event_id FROM r WHERE n = 1")
def w12_dedupe_keep_first(spark, sf_dir):
    return selection.first_per_key(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 1)


@query("""SELECT event_id, CASE WHEN n = 0 THEN base ELSE base || '_' || n END AS id FROM (SELECT event_id, base, row_number() OVER (PARTITION BY base ORDER BY event_id) - 1 AS n FROM (SELECT event_id, 'shard_' || event_type || '_' || user_id AS base FROM events))""")
def w13_aggregate_ids(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.concat_ws("_", F.lit("shard"), "event_type", F.col("user_id").cast("string")).alias("base"))
    return selection.unique_ids(events, "base", ["event_id"], "id").select("event_id", "id")


QUOTA = """WITH o AS (SELECT o_orderkey, o_orderpriority AS key, o_orderstatus <> 'P' AS accepted, CASE WHEN o_orderstatus = 'P' THEN 'low_score' ELSE '' END AS reason, o_totalprice AS score FROM orders),
r AS (SELECT *, accepted AND row_number() OVER (PARTITION BY key, accepted ORDER BY score DESC, o_orderkey) > {n} AS over FROM o)
SELECT o_orderkey, key, accepted AND NOT over AS accepted, CASE WHEN over THEN concat_ws(',', nullif(reason, ''), '{text}') ELSE reason END AS reason FROM r"""


def scored_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col("o_orderpriority").alias("key"), (o.o_orderstatus != "P").alias("accepted"), F.when(o.o_orderstatus == "P", "low_score").otherwise("").alias("reason"), F.col("o_totalprice").alias("score"))


@query(QUOTA.format(n=200, text="class_topk_overflow"))
def w05_class_top_k(spark, sf_dir):
    return selection.class_top(scored_orders(spark, sf_dir), "key", "accepted", "reason", [F.desc("score"), "o_orderkey"], 200, "class_topk_overflow").drop("score")


@query(QUOTA.format(n=50, text="aggregate_class_target_overflow"))
def w14_quota_reselection(spark, sf_dir):
    return selection.class_top(scored_orders(spark, sf_dir), "key", "accepted", "reason", [F.desc("score"), "o_orderkey"], 50, "aggregate_class_target_overflow").drop("score")


@query("SELECT key, o_orderkey, n AS seed FROM (SELECT o_orderpriority AS key, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n < 64")
def w15_cap_and_ordinal_seed(spark, sf_dir):
    firsts = selection.first_per_key(orders(spark, sf_dir), ["key"], ["o_orderkey"], 64)
    return selection.number_in_key(firsts.select("key", "o_orderkey"), ["key"], ["o_orderkey"]).select("key", "o_orderkey", (F.col("n") - 1).alias("seed"))


@query("""WITH a AS (SELECT o_orderpriority AS key, o_orderkey, o_orderstatus = 'F' AS fixed, o_custkey AS seed FROM orders)
SELECT key, o_orderkey, CASE WHEN fixed THEN seed ELSE row_number() OVER (PARTITION BY key, fixed ORDER BY o_orderkey) - 1 END AS seed FROM a""")
def w16_seed_renormalise(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("fixed"), F.col("o_custkey").alias("seed"))
    return selection.number_in_key(o, ["key", "fixed"], ["o_orderkey"]).select("key", "o_orderkey", F.when(F.col("fixed"), F.col("seed")).otherwise(F.col("n") - 1).alias("seed"))


@query(f"""WITH {ORDERS}, r AS (SELECT key, o_orderkey, row_number() OVER (PARTITION BY key ORDER BY o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY key) AS size FROM o WHERE o_orderstatus = 'O'),
p AS (SELECT * FROM r WHERE size <= 8 OR list_contains(list_transform(range(8), lambda i: round_even(i * (size - 1) / 7.0::DOUBLE, 0)::BIGINT), n))
SELECT key, o_orderkey, dense_rank() OVER (ORDER BY key) - 1 AS sheet_row, row_number() OVER (PARTITION BY key ORDER BY o_orderkey) - 1 AS sheet_col FROM p""")
def w17_contact_sheet_plan(spark, sf_dir):
    some = orders(spark, sf_dir).where("o_orderstatus = 'O'").select("key", "o_orderkey")
    return selection.contact_sheet(some, "key", ["o_orderkey"], 8).select("key", "o_orderkey", "sheet_row", "sheet_col")


@query("SELECT word, n FROM (SELECT word, count(*) AS n, min(p_partkey) AS pos FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word) ORDER BY n DESC, pos, word LIMIT 40")
def w18_most_common(spark, sf_dir):
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return quality.most_common(words, "word", "p_partkey")


@query("""WITH e AS (SELECT event_id, event_type || (user_id % 50)::VARCHAR AS caption, CASE WHEN value < 20 THEN 'low_caption_score' ELSE '' END AS reasons FROM events),
f AS (SELECT *, CASE WHEN reasons = '' AND row_number() OVER (PARTITION BY caption, reasons = '' ORDER BY event_id) <= 8 THEN 1 ELSE 0 END AS i FROM e),
g AS (SELECT *, sum(i) OVER (ORDER BY event_id) AS s, row_number() OVER (ORDER BY event_id) AS r FROM f),
z AS (SELECT coalesce(ceil(min(r) / 16) * 16, 4611686018427387904) AS last FROM g WHERE s >= 600),
full_ AS (SELECT caption AS c, max(event_id) AS last_id FROM g WHERE i = 1 AND s <= 600 GROUP BY 1 HAVING count(*) >= 8)
SELECT event_id, i = 1 AND s <= 600 AS accepted, CASE WHEN i = 1 AND s <= 600 THEN '' WHEN reasons = '' AND NOT coalesce(event_id > last_id, false) THEN 'target_count_reached'
ELSE concat_ws(',', nullif(reasons, ''), CASE WHEN event_id > last_id THEN 'caption_overflow' END) END AS reasons FROM g LEFT JOIN full_ ON caption = c, z WHERE r <= last""")
def w07_cap_and_target(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", (F.col("user_id") % 50).cast("string")).alias("caption"), F.when(F.col("value") < 20, "low_caption_score").otherwise("").alias("reasons"))
    return selection.admit(e, "event_id", "caption", "reasons", 8, 600, 16).select("event_id", "accepted", "reasons")


@query("""WITH d AS (SELECT doc_id, CASE WHEN n_chars < 200 THEN 'missing_caption' WHEN lang <> 'en' THEN 'low_quality_score' END AS reason FROM documents), s AS (SELECT *, sum((reason IS NULL)::INT) OVER (ORDER BY doc_id) AS s FROM d)
SELECT doc_id, reason FROM s WHERE s < 100 OR (s = 100 AND reason IS NULL)""")
def f05_max_count_stop(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") < 200, "missing_caption").when(F.col("lang") != "en", "low_quality_score").alias("reason"))
    return selection.until(docs, "doc_id", "reason", 100)


@query(f"WITH {STATS} SELECT count(*) AS kept, sum(l_extendedprice) AS price FROM s WHERE (l_returnflag <> 'R') AND l_linenumber NOT IN (7) AND (border_std <= 45) AND (edge <= 0.07) AND (ratio >= 0.1)")
def f02_f03_filters(spark, sf_dir):
    s = stats(spark, sf_dir)
    kept = s.where((s.l_returnflag != "R") & ~s.l_linenumber.isin(7) & quality.within([(s.border_std, 45, True), (s.edge, 0.07, True), (s.components, 0, True), (s.ratio, 0.1, False)]))
    return kept.agg(F.count("*").alias("kept"), F.sum("l_extendedprice").alias("price"))


@query("""SELECT doc_id, CASE WHEN quality = 0 THEN 'source_rejected' WHEN trim(text) = '' THEN 'missing_caption' WHEN contains(lower(text), 'password') THEN 'excluded_caption_fragment' WHEN n_chars < 300 THEN 'low_caption_score'
WHEN toxic = 1 THEN 'high_negative_score' END AS reason FROM documents LEFT JOIN labels USING (doc_id)""")
def f04_first_reason(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    rules = ((no(d.quality == 0), "source_rejected"), (F.trim("text") == "", "missing_caption"), (F.lower("text").contains("password"), "excluded_caption_fragment"), (d.n_chars < 300, "low_caption_score"), (no(d.toxic == 1), "high_negative_score"))
    return d.select("doc_id", scoring.first_reason(*rules).alias("reason"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN printf('bad_size:[%d, %d]!=[128,128]', p_size, 128) WHEN p_size < 20 THEN printf('low_dynamic_range:%d<min_range:20', p_size)
WHEN p_retailprice < 1000 THEN printf('low_std:%.4f<min_std:1000.0000', p_retailprice) END AS reason FROM part""")
def f08_image_reject_reason(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    s = F.struct(F.when(p.p_size < 10, p.p_size).otherwise(128).alias("width"), F.lit(128).alias("height"), F.lit(0).alias("min"), p.p_size.alias("max"), p.p_retailprice.alias("std"), F.lit(0.0).alias("border_std"), F.lit(0.0).alias("border_edge_density"), F.lit(1).alias("foreground_component_count"), F.lit(1.0).alias("largest_foreground_component_ratio"))
    return p.select("p_partkey", quality.image_reject_reason(s, 128, 20, 1000.0, 0, 0, 0, 0).alias("reason"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderstatus <> 'P'")
def f09_missing_images(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'a64' END, CASE WHEN o_orderkey % 3 = 0 THEN 'b128' END, 'img' || o_orderkey) AS path FROM orders")
def f10_path_precedence(spark, sf_dir):
    saved = F.map_filter(F.create_map(F.lit("64"), F.when(F.col("o_orderkey") % 2 == 0, "a64"), F.lit("128"), F.when(F.col("o_orderkey") % 3 == 0, "b128")), lambda _, v: v.isNotNull())
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.try_element_at(saved, F.lit("64")), F.try_element_at(saved, F.lit("128")), F.try_element_at(saved, F.lit("256")), F.concat(F.lit("img"), "o_orderkey")).alias("path"))


@query("""SELECT vec_id, concat_ws(',', CASE WHEN c < 0.045 THEN 'low_contrast' END, CASE WHEN b < 0.12 THEN 'very_dark' END, CASE WHEN b > 0.88 THEN 'very_light' END, CASE WHEN k > 0.02 THEN 'high_clip' END, CASE WHEN e < 0.010 THEN 'very_soft' END) AS flags
FROM (SELECT vec_id, abs(embedding[1]) AS b, abs(embedding[2]) AS c, abs(embedding[3]) AS k, abs(embedding[4]) AS e FROM embeddings)""")
def f11_metric_flags(spark, sf_dir):
    at = lambda i: F.abs(F.col("embedding")[i])
    return table(spark, sf_dir, "embeddings").select("vec_id", quality.metric_flags(at(0), at(1), at(2), at(3)).alias("flags"))


@query("SELECT name, value, count(*) AS n FROM (SELECT unnest([{'name': 'l_returnflag', 'value': l_returnflag}, {'name': 'l_linestatus', 'value': l_linestatus}, {'name': 'l_linenumber', 'value': l_linenumber::VARCHAR}], recursive := true) FROM lineitem) GROUP BY ALL")
def a01_counters(spark, sf_dir):
    return quality.counters(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("""SELECT coalesce(nullif(trim(r), ''), 'unknown') AS reason, count(*) AS n FROM (SELECT unnest(string_split(coalesce(CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag || ', ' || l_linestatus WHEN l_linenumber % 3 = 1 THEN l_returnflag || ',' END, ''), ',')) AS r FROM lineitem) GROUP BY 1""")
def a02_reason_histogram(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    reason = F.when(k == 0, F.concat_ws(", ", "l_returnflag", "l_linestatus")).when(k == 1, F.concat("l_returnflag", F.lit(",")))
    return quality.reason_counts(table(spark, sf_dir, "lineitem").select(reason.alias("r")), "r")


MINED = "m AS (SELECT event_id, value >= 50 AS accepted, value AS score, value / 2 AS quality, 100 - value AS negative, event_type || user_id % 50 AS caption FROM events)"


def mined(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (e.value >= 50).alias("accepted"), e.value.alias("score"), (e.value / 2).alias("quality"), (100 - e.value).alias("negative"), F.concat("event_type", (e.user_id % 50).cast("string")).alias("caption"))


@query(f"""WITH {MINED}, a AS (SELECT * FROM m WHERE accepted) SELECT (SELECT count(*) FROM m) AS total, count(*) AS accepted, (SELECT count(*) FROM m WHERE NOT accepted) AS rejected,
avg(score) AS score_mean, min(score) AS score_min, max(score) AS score_max, avg(quality) AS quality_mean, avg(negative) AS negative_mean, count(DISTINCT caption) AS captions FROM a""")
def a03_caption_summary(spark, sf_dir):
    return quality.caption_summary(mined(spark, sf_dir))


@query(f"WITH {MINED} SELECT caption, count(*) AS n FROM m WHERE accepted GROUP BY caption ORDER BY n DESC, min(event_id) LIMIT 40")
def a03_top_captions(spark, sf_dir):
    return quality.most_common(mined(spark, sf_dir).where("accepted"), "caption", "event_id")


@query("""SELECT d.key, coalesce(n, 0) AS n, score_mean, score_min, score_max, greatest(0, 3000 - coalesce(n, 0)) AS missing FROM (SELECT DISTINCT o_orderpriority AS key FROM orders UNION SELECT 'none') d
LEFT JOIN (SELECT o_orderpriority AS key, count(*) AS n, avg(o_totalprice) AS score_mean, min(o_totalprice) AS score_min, max(o_totalprice) AS score_max FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) s ON d.key = s.key""")
def a04_a05_class_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderpriority": "key", "o_totalprice": "score"})
    dims = o.select("key").unionByName(spark.createDataFrame([("none",)], "key string"))
    return quality.per_class(dims, o.where("o_orderstatus = 'O'"), "key", ["score"], 3000)


@query("""WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT min(v) AS min, max(v) FILTER (WHERE i = round_even((n - 1) * 0.5::DOUBLE, 0)) AS p50, max(v) FILTER (WHERE i = round_even((n - 1) * 0.9::DOUBLE, 0)) AS p90, max(v) FILTER (WHERE i = round_even((n - 1) * 0.95::DOUBLE, 0)) AS p95, max(v) AS max FROM r""")
def a06_nearest_rank(spark, sf_dir):
    return quality.nearest_rank(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")


@query("SELECT event_type, count(*) AS n, sum(value) AS elapsed, avg(value) AS elapsed_mean, count(*) FILTER (WHERE value > 90) AS flagged FROM events GROUP BY ROLLUP (event_type)")
def a08_eval_summary(spark, sf_dir):
    return quality.summary(table(spark, sf_dir, "events").withColumn("flags", F.when(F.col("value") > 90, "slow").otherwise("")), ["event_type"], "value", "flags")


@query("SELECT avg(a.value) AS raw_mean, avg(b.value) AS processed_mean, avg(b.value - a.value) AS delta, count(*) AS n FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0")
def a09_ab_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    a, b = e.where("event_id % 2 = 0"), e.select((F.col("event_id") - 1).alias("event_id"), F.col("value").alias("other"))
    return quality.paired_means(a.join(b, "event_id"), "value", "other")


@query("SELECT l_linenumber AS step, sum(l_quantity) AS load, sum(l_extendedprice) AS predict, max(l_extendedprice) AS most, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS most_chunk FROM lineitem GROUP BY 1")
def a10_chunk_timing(spark, sf_dir):
    return quality.chunk_timing(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_quantity", "l_extendedprice", "l_orderkey")


@query("SELECT min(n) AS trained_seed_count, max(n) AS most FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)")
def a11_a17_key_coverage(spark, sf_dir):
    return quality.key_coverage(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query("""SELECT CASE WHEN contains(p_name, 'small') THEN 'text_encoder' WHEN regexp_matches(p_name, 'red|blue') THEN 'unet' ELSE 'other' END AS component, CASE WHEN p_size <= 10 THEN 'tiny' WHEN p_size <= 30 THEN 'ok' ELSE 'heavy' END AS tier, count(*) AS n, sum(p_size) AS mb FROM part GROUP BY 1, 2""")
def a12_artifact_rollup(spark, sf_dir):
    return inventory.rollup(table(spark, sf_dir, "part"), "p_name", "p_size", [("small", "text_encoder"), ("red|blue", "unet")], 10, 30)


@query("""SELECT vec_id, list_min(v) AS min, list_max(v) AS max, list_sum(v) / len(v) AS mean, sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v)) AS rms, len(list_filter(v, lambda x: abs(x) > 1))::INTEGER AS clipped
FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)""")
def a13_a14_tensor_stats(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", quality.tensor_stats(F.col("embedding")).alias("s")).select("vec_id", "s.*")


@query("""SELECT a.vec_id, e AS mse, CASE WHEN e <= 0 THEN 99 ELSE -10 * log10(e) END AS psnr FROM (SELECT a.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) / len(a.embedding) AS e FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a""")
def a15_mse_psnr(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return pairs.select("vec_id", quality.mse(F.col("embedding"), F.col("other")).alias("mse")).select("vec_id", "mse", quality.psnr(F.col("mse")).alias("psnr"))


@query("SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean FROM events")
def a16_rolling_mean(spark, sf_dir):
    return selection.rolling_mean(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value", 20).select("event_id", "mean")
