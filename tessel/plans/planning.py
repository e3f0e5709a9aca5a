"""Queries on plans, hashes and mixes."""

from pyspark.sql import functions as F

from tessel.functions import hashing as H
from tessel.operators import mixing, planning, selection
from tessel.operators import slots as S
from tessel.plans._registry import query, table
from tessel.plans.prompts import CANONICAL, names, slotted

LISTS = "p AS (SELECT p_partkey, string_split(p_name, ' ') AS colors, CASE WHEN p_size % 7 = 0 THEN [] ELSE [p_brand, p_type] END AS styles, ['front', 'side', 'top'] AS views FROM part)"


def lists(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("colors"), F.when(F.col("p_size") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_type")).alias("styles"), F.array(*map(F.lit, ["front", "side", "top"])).alias("views"))


@query(f"""WITH {LISTS}, a AS (SELECT p_partkey, c, s, v, row_number() OVER (PARTITION BY p_partkey ORDER BY i, j, k) - 1 AS idx FROM p, LATERAL (SELECT unnest(colors) AS c, unnest(range(len(colors))) AS i), LATERAL (SELECT unnest(styles) AS s, unnest(range(len(styles))) AS j), LATERAL (SELECT unnest(views) AS v, unnest(range(len(views))) AS k))
SELECT p_partkey, idx, c AS colors, s AS styles, v AS views FROM a WHERE idx < 9""")
def g01_product_expansion(spark, sf_dir):
    return planning.product(lists(spark, sf_dir), ["colors", "styles", "views"], 9).select("p_partkey", "idx", "colors", "styles", "views")


@query(f"WITH {LISTS} SELECT p_partkey, i::INTEGER AS idx, colors[i % len(colors) + 1] AS colors, views[i % 3 + 1] AS views FROM p, LATERAL (SELECT unnest(range(greatest(len(colors), 3))) AS i)")
def g02_zip_cycle(spark, sf_dir):
    return planning.zip_cycle(lists(spark, sf_dir), ["colors", "views"]).select("p_partkey", "idx", "colors", "views")


@query(f"WITH {LISTS} SELECT p_partkey, array_to_string(CASE WHEN len(styles) > 0 THEN styles WHEN len(colors) > 1 THEN colors ELSE views END, '|') AS used FROM p")
def g03_slot_fallback(spark, sf_dir):
    p = lists(spark, sf_dir)
    some = F.when(F.size("colors") > 1, F.col("colors"))
    return p.select("p_partkey", F.array_join(planning.slot_values(F.col("styles"), some, F.col("views")), "|").alias("used"))


@query("SELECT p_partkey, CASE WHEN n > 1 THEN v || printf('_%02d', n) ELSE v END AS variant FROM (SELECT p_partkey, p_name AS v, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)")
def g04_variant_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_name").alias("variant"))
    return planning.variant_ids(p, ["p_brand"], "variant", ["p_partkey"]).select("p_partkey", "variant")


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n <= 5")
def g05_per_preset_limit(spark, sf_dir):
    return selection.first_per_key(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], 5).select("p_brand", "p_partkey")


@query("SELECT p_partkey, i::INTEGER AS i, (string_split(p_name, ' '))[least(i + 1, len(string_split(p_name, ' ')))] AS suffix FROM part, LATERAL (SELECT unnest(range(4)) AS i)")
def g06_legacy_expansion(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(planning.padded(F.split("p_name", " "), 4)).alias("i", "suffix"))


@query("""SELECT p_partkey, seed, p_brand || '_seed' || seed AS id, row_number() OVER (ORDER BY p_partkey, k) - 1 AS job_index FROM part, (VALUES (7::BIGINT, 1), (1, 2), (42, 3)) AS s(seed, k)""")
def g07_seed_product(spark, sf_dir):
    j = planning.jobs(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), [7, 1, 42], ["p_partkey"])
    return j.select("p_partkey", "seed", F.concat("p_brand", F.lit("_seed"), F.col("seed").cast("string")).alias("id"), F.col("job_index").cast("long").alias("job_index"))


@query("SELECT p_brand, v::INTEGER AS v, s::INTEGER AS s FROM (SELECT DISTINCT p_brand FROM part), range(8) a(v), range(32) b(s)")
def g08_app_plan(spark, sf_dir):
    return planning.app_plan(table(spark, sf_dir, "part").select("p_brand"), 8, 32)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O')")
def g09_resume(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") == "N").alias("accepted"), (F.col("l_linestatus") == "O").alias("complete"))
    return planning.resume(table(spark, sf_dir, "orders").select("o_orderkey"), rows, "o_orderkey", "accepted", "complete")


@query("""SELECT run, planned, completed, accepted, completed - accepted AS rejected, CASE WHEN completed = planned THEN 'complete' WHEN completed = 0 THEN 'stopped' ELSE 'paused' END AS state FROM (
SELECT o_custkey AS run, count(*) AS planned, count(*) FILTER (WHERE o_orderstatus <> 'O') AS completed, count(*) FILTER (WHERE o_orderstatus = 'F') AS accepted FROM orders GROUP BY 1)""")
def g10_status(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), (F.col("o_orderstatus") != "O").alias("done"), (F.col("o_orderstatus") == "F").alias("accepted"))
    return planning.status(rows, "run")


@query("""SELECT p_partkey, array_to_string(list_transform(list_filter(list_transform(x, lambda v, i: {'v': v, 'first': list_position(list_transform(x, lambda w: lower(replace(w, '-', ' '))), lower(replace(v, '-', ' '))) = i}), lambda z: z.first), lambda z: z.v)[1:3], '|') AS merged
FROM (SELECT p_partkey, list_concat([p_brand, 'Close-Up'], string_split(p_name, ' '), ['close up', p_type]) AS x FROM part)""")
def g11_preset_list_merge(spark, sf_dir):
    merged = planning.merged_list(F.array("p_brand", F.lit("Close-Up")), F.split("p_name", " "), F.array(F.lit("close up"), "p_type"), most=3)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(merged, "|").alias("merged"))


@query("SELECT p_partkey, p_name, idx FROM part JOIN (SELECT DISTINCT ON (l_partkey) l_partkey, l_partkey AS idx FROM lineitem WHERE l_quantity = 50) f ON p_partkey = l_partkey")
def g12_focus_keys(spark, sf_dir):
    focus = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"), F.col("l_partkey").alias("idx")).distinct()
    return planning.focus(table(spark, sf_dir, "part"), "p_partkey", focus).select("p_partkey", "p_name", "idx")


@query(f"WITH {LISTS} SELECT sum(least(7, len(colors) * len(styles)) + least(7, len(colors) * len(views)))::BIGINT AS variants FROM p")
def g13_variant_count(spark, sf_dir):
    return planning.variant_count(lists(spark, sf_dir), [["colors", "styles"], ["colors", "views"]], 7)


@query("SELECT p_partkey, scale, seed, row_number() OVER (ORDER BY scale, p_partkey, seed) - 1 AS idx FROM part, (VALUES (4.5::DOUBLE), (6.0)) g(scale), (VALUES (1::BIGINT), (2)) s(seed)")
def g14_sweep_grid(spark, sf_dir):
    g = planning.grid(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", [1, 2], [4.5, 6.0])
    return g.select("p_partkey", "scale", "seed", F.col("idx").cast("long").alias("idx"))


@query("SELECT p_partkey, array_to_string(list_concat(list_filter(['red', 'green', 'blue', 'small'], lambda c: contains(p_name, c)), list_filter(['red', 'white', 'black', 'gray'], lambda c: NOT (c = 'red' AND contains(p_name, 'red'))))[1:4], '|') AS colors FROM part")
def g15_color_extraction(spark, sf_dir):
    colors = planning.named_values(F.col("p_name"), ["red", "green", "blue", "small"], ["red", "white", "black", "gray"], 4)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(colors, "|").alias("colors"))


@query("""SELECT p_partkey, coalesce(c[(('0x' || substr(md5('7:' || p_partkey || ':color'), 1, 8))::BIGINT % (len(c) + 4) + 1)], '') AS color FROM (SELECT p_partkey, string_split(p_name, ' ') AS c FROM part)""")
def g16_random_slots(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", planning.sampled_slot(F.split("p_name", " "), 4, F.lit(7), F.col("p_partkey"), F.lit("color")).alias("color"))


@query("""SELECT p_partkey, size, steps, size % 8 = 0 AND p_size > 0 AS valid, size * 8 AS output FROM part, (VALUES (32), (36), (64)) a(size), (VALUES (1), (4)) b(steps)""")
def g17_probe_grid(spark, sf_dir):
    return planning.probe_grid(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_size") > 0, [32, 36, 64], [1, 4]).drop("p_size")


FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, strlen(x) + 1), lambda i: ('0x' || substr(hex(x), (2 * i - 1)::INTEGER, 2))::INTEGER::UHUGEINT)), lambda s, b: (xor(s, b) * 1099511628211) % 18446744073709551616)"
SIGNED = "CASE WHEN h >= 9223372036854775808 THEN (h::HUGEINT - 18446744073709551616)::BIGINT ELSE h::BIGINT END"


@query(f"SELECT x AS name, {SIGNED} AS hash FROM (SELECT x, {FNV} AS h FROM (SELECT DISTINCT p_name AS x FROM part))")
def h01_fnv1a(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("hash", H.fnv1a_64(F.col("name")))


def xorshift(x):
    """An unsigned number's successor in SQL; each step names its input once."""
    step = lambda v, f: f"list_transform([{v}], lambda s: xor(s, {f}))[1]"
    return step(step(step(x, "(s * 8192) % 18446744073709551616"), "s // 128"), "(s * 131072) % 18446744073709551616")


def noise_sql(source, key, seed, text, count):
    """(key, i, value) of ``count`` numbers from a seed and a text: states s0 to s<count>, one column each."""
    start = f"CASE WHEN h = 0 THEN 11400714819323198485::UHUGEINT ELSE h END AS s0"
    states = ", ".join(f"{xorshift(f's{i}')} AS s{i + 1}" for i in range(count))
    values = ", ".join(f"(s{i} % 65536)::DOUBLE / 32767.5 - 1" for i in range(1, count + 1))
    return f"""n0 AS (SELECT {key} AS k, xor({seed}::UHUGEINT, {FNV}) AS h FROM (SELECT *, {text} AS x FROM {source})), n1 AS (SELECT k, {start} FROM n0), n2 AS (SELECT k, {states} FROM n1),
n3 AS (SELECT k, unnest(range({count}))::INTEGER AS i, unnest([{values}]) AS value FROM n2)"""


def each_value(df, key, vector):
    return df.select(key, F.posexplode(vector).alias("i", "value"))


@query(f"WITH {slotted()}, c AS (SELECT prompt, {CANONICAL} AS canonical FROM s), {noise_sql('c', 'prompt', 7, 'canonical', 16)} SELECT k AS prompt, i, value FROM n3")
def h02_h03_hash_latent(spark, sf_dir):
    prompts = names(spark, sf_dir)
    canonical = S.canonical(S.slots(prompts, S.alias_table(spark)))
    return each_value(canonical.select("prompt", H.noise(F.lit(7), F.col("canonical"), 16).alias("latent")), "prompt", "latent")


@query()
def h04_compositional_latent(spark, sf_dir):
    return S.compositional_latents(names(spark, sf_dir), S.alias_table(spark), 7, 64)


@query(f"SELECT event_id, ({SIGNED}) & 2147483647 AS seed FROM (SELECT event_id, {FNV} AS h FROM (SELECT event_id, event_type || '-' || event_id AS x FROM events))")
def h05_row_seed(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", H.row_seed(F.concat_ws("-", "event_type", F.col("event_id").cast("string"))).alias("seed"))


M64 = 18446744073709551616
MIX = f"list_transform([list_transform([list_transform([z], lambda s: (xor(s, s // 1073741824) * 13787848793156543929) % {M64})[1]], lambda s: (xor(s, s // 134217728) * 10723151780598845931) % {M64})[1]], lambda s: xor(s, s // 2147483648))[1]"


@query(f"""WITH a AS (SELECT o_orderkey, xor(o_custkey::UHUGEINT, {FNV}) AS s FROM (SELECT *, o_orderkey::VARCHAR AS x FROM orders)), b AS (SELECT o_orderkey, i, (s + i::UHUGEINT * 11400714819323198485) % {M64} AS z FROM a, LATERAL (SELECT unnest(range(1, 9)) AS i)),
u AS (SELECT o_orderkey, i, (({MIX}) // 2048)::DOUBLE / 9007199254740992 + 0.5::DOUBLE / 9007199254740992 AS u FROM b), p AS (SELECT o_orderkey, (i - 1) // 2 AS k, max(u) FILTER (WHERE i % 2 = 1) AS u, max(u) FILTER (WHERE i % 2 = 0) AS w FROM u GROUP BY ALL)
SELECT o_orderkey, (2 * k + j)::INTEGER AS i, round(greatest(-6, least(6, sqrt(-2 * ln(u)) * CASE j WHEN 0 THEN cos(2 * pi() * w) ELSE sin(2 * pi() * w) END)), 9) AS value FROM p, (VALUES (0), (1)) t(j)""")
def h06_gaussian_vectors(spark, sf_dir):
    drawn = each_value(H.gaussian_vectors(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", 8), "o_orderkey", "v")
    return drawn.withColumn("value", F.round("value", 9))


@query("""SELECT l_linenumber, i::INTEGER AS i, sum(CASE WHEN i < 4 THEN sin(a) ELSE cos(a) END) AS s FROM (SELECT l_linenumber, i, l_quantity * exp(-ln(10000.0::DOUBLE) * (i % 4) / 3.0) AS a FROM lineitem, (SELECT unnest(range(8)) AS i)) GROUP BY ALL""")
def h07_guidance_embedding(spark, sf_dir):
    v = each_value(table(spark, sf_dir, "lineitem").select("l_linenumber", H.sinusoid(F.col("l_quantity"), 8).alias("v")), "l_linenumber", "v")
    return v.groupBy("l_linenumber", "i").agg(F.sum("value").alias("s"))


@query("""SELECT root, rep::INTEGER AS rep, key, pos FROM (SELECT 0 AS root, o_orderpriority AS key, o_orderkey AS pos, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders) , range(2) r(rep) WHERE n <= 30
UNION ALL SELECT 1, 0, event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 10""")
def m01_multi_root_union(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("pos"))
    b = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("pos"))
    return mixing.union_roots([(a, 30, 2), (b, 10, 1)], "key", "pos").select("root", "rep", "key", "pos")


@query("""WITH e AS (SELECT event_id, event_type AS key, md5('7:' || event_id) AS h FROM events WHERE value >= 20), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY h, event_id) AS n FROM e) SELECT event_id, key FROM r WHERE n <= 100 ORDER BY h, event_id LIMIT 300""")
def m02_open_sampling(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value >= 20").select("event_id", F.col("event_type").alias("key"))
    return mixing.sample(e, "event_id", "key", seed=7, per_key=100, most=300)


@query("SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN o_orderstatus END, ''), nullif(o_orderpriority, ''), 'image') AS prompt FROM orders")
def m03_prompt_fallback(spark, sf_dir):
    from tessel.functions.text import first_present

    given = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", first_present(given, F.col("o_orderpriority"), F.lit("image")).alias("prompt"))


RATIOS = {"click": 0.7, "view": 0.2, "purchase": 0.1}


@query(f"""WITH r AS (SELECT event_id, event_type AS source, row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || event_id), event_id) AS n FROM events)
SELECT event_id, source FROM r WHERE n <= CASE source {" ".join(f"WHEN '{k}' THEN {round(v * 500)}" for k, v in RATIOS.items())} ELSE 0 END""")
def m04_ratio_mix(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source"))
    return mixing.ratio_mix(e, "source", "event_id", RATIOS, 500, seed=7)


@query(f"WITH {noise_sql('part', 'p_partkey', 'p_size', 'p_name', 8)} SELECT k AS p_partkey, i, value FROM n3")
def m05_feature_table(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return each_value(p.select("p_partkey", H.noise(F.col("p_size"), F.col("p_name"), 8).alias("latent")), "p_partkey", "latent")


@query("SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def m06_set_difference(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    side = lambda flag: line.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("key"))
    return mixing.set_difference(side("A"), side("R"), "key")
