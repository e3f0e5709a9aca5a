"""Queries on sources and sinks over the given tables."""

from pyspark.sql import functions as F

from tessel.operators import images
from tessel.operators.shared import fresh
from tessel.plans._registry import query, table
from tessel.sources import readers, writers

BROKEN = "CASE WHEN event_id % 7 = 0 THEN substr(props, 1, length(props) - 2) WHEN event_id % 11 = 0 THEN '' ELSE props END"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr(BROKEN).alias("line"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")
def s02_tolerant_rows(spark, sf_dir):
    return readers.parse_tolerant(lines(spark, sf_dir), "line", "k string")[0]


@query(f"SELECT event_id, {BROKEN} AS line FROM events WHERE event_id % 7 = 0")
def s02_tolerant_errors(spark, sf_dir):
    return readers.parse_tolerant(lines(spark, sf_dir), "line", "k string")[1]


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN source END, ''), 'docs-train-' || doc_id) AS id FROM documents")
def s05_source_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("image_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    return docs.select("doc_id", readers.source_ids(docs, ["image_id", "photoid"], "docs", "train", "doc_id").alias("id"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50 OFFSET 20")
def s06_row_window(spark, sf_dir):
    return readers.row_window(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], 20, 50)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS position FROM documents")
def s07_shuffle(spark, sf_dir):
    return readers.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7).withColumn("position", F.col("position").cast("long"))


@query("SELECT conv_id, turn - first AS index, text AS prompt FROM conversations JOIN (SELECT conv_id, min(turn) AS first FROM conversations GROUP BY 1) USING (conv_id) WHERE turn - first < 3")
def s09_eval_suite(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("prompts"))
    return readers.suite_rows(turns, "prompts", 3).select("conv_id", F.col("index").cast("long").alias("index"), "prompt")


@query("SELECT p_partkey, p_name FROM part WHERE p_brand IN ('Brand#11', 'Brand#23') AND p_size IN (11, 12, 13, 40)")
def s10_quality_suite(spark, sf_dir):
    return readers.quality_suite(table(spark, sf_dir, "part"), [11, 12, 13, 40], ["Brand#11", "Brand#23"], "p_size", "p_brand").select("p_partkey", "p_name")


META = "SELECT 'job_' || o_orderkey AS id, o_orderstatus <> 'P' AS accepted, CASE WHEN o_orderstatus = 'P' THEN 'low_std' END AS reject_reason, o_orderpriority AS key, o_custkey AS seed, o_totalprice AS guidance_scale, 'images_64/' || o_orderkey || '.png' AS image_64, o_orderstatus AS flag FROM orders"


def metadata(spark, sf_dir):
    """The orders as metadata of generated images."""
    o = table(spark, sf_dir, "orders")
    number = F.col("o_orderkey").cast("string")
    return o.select(
        F.concat(F.lit("job_"), number).alias("id"), (F.col("o_orderstatus") != "P").alias("accepted"), F.when(F.col("o_orderstatus") == "P", "low_std").alias("reject_reason"), F.col("o_orderpriority").alias("key"),
        F.col("o_custkey").alias("seed"), F.col("o_totalprice").alias("guidance_scale"), F.create_map(F.lit("64"), F.concat(F.lit("images_64/"), number, F.lit(".png"))).alias("saved_images"), F.array("o_orderstatus").alias("qc_flags"),
    )


def plain(rows):
    return rows.select("id", "accepted", "reject_reason", "key", "seed", "guidance_scale", F.col("saved_images")["64"].alias("image_64"), F.col("qc_flags")[0].alias("flag"))


@query(META)
def s01_metadata(spark, sf_dir):
    """Written as JSON lines below the shared folder, and read again."""
    path = fresh(spark, "metadata")
    writers.write_metadata(metadata(spark, sf_dir), path)
    return plain(readers.read_metadata(spark, path))


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE o_orderstatus <> 'P') AS null_reasons FROM orders")
def k01_write_metadata(spark, sf_dir):
    """Nulls are written, too."""
    path = fresh(spark, "metadata")
    writers.write_metadata(metadata(spark, sf_dir), path)
    return spark.read.text(path).agg(F.count("*").alias("lines"), F.count_if(F.col("value").contains('"reject_reason":null')).alias("null_reasons"))


@query("SELECT count(*) AS images, sum(o_custkey)::BIGINT AS seeds, true AS stamped FROM orders")
def k02_manifest(spark, sf_dir):
    path = fresh(spark, "manifest")
    writers.write_manifest(table(spark, sf_dir, "orders").agg(F.count("*").alias("images"), F.sum("o_custkey").alias("seeds")), path)
    return spark.read.schema("images long, seeds long, created_at_unix long").json(path).select("images", "seeds", (F.col("created_at_unix") > 0).alias("stamped"))


@query("SELECT 'shard_' || (o_orderkey % 4) AS shard, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'P') AS accepted, sum(o_custkey)::BIGINT AS seeds FROM orders GROUP BY 1")
def s12_shards(spark, sf_dir):
    """Four shards of metadata, each in a folder of its own, read together."""
    root, rows = fresh(spark, "shards"), metadata(spark, sf_dir)
    number = F.substring_index("id", "_", -1).cast("long") % 4
    for k in range(4):
        writers.write_metadata(rows.where(number == k), f"{root}/shard_{k}/metadata.jsonl")
    return readers.read_shards(spark, root).groupBy("shard").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"), F.sum("seed").alias("seeds"))


@query("""SELECT p_brand AS key, 'target' AS role, CASE WHEN p_brand LIKE '%1' THEN p_brand ELSE p_name END AS prompt FROM part GROUP BY ALL
UNION ALL SELECT p_type, 'negative', p_type FROM part GROUP BY p_type""")
def s08_prompt_specs(spark, sf_dir):
    """A brand's names are its prompts; a third of brands have none and stand for themselves."""
    path, part = fresh(spark, "specs"), table(spark, sf_dir, "part")
    names = part.groupBy("p_brand").agg(F.sort_array(F.collect_set("p_name")).alias("names"))
    spec = lambda key, prompts: F.struct(F.col(key).alias("key"), F.col(key).alias("prompt"), prompts.alias("prompts"))
    targets = names.agg(F.collect_list(spec("p_brand", F.when(~F.col("p_brand").endswith("1"), F.col("names")))).alias("targets"))
    negatives = part.select("p_type").distinct().agg(F.collect_list(spec("p_type", F.lit(None).cast("array<string>"))).alias("negatives"))
    targets.join(negatives).write.json(path)
    return readers.prompt_specs(spark, path).select("key", "role", "prompt")


@query("""WITH p AS (SELECT p_brand AS key, min(p_name) AS subject, string_agg(DISTINCT split_part(p_name, ' ', 1), '|' ORDER BY split_part(p_name, ' ', 1)) AS colors FROM part GROUP BY 1)
SELECT 'plan' AS form, key, CASE WHEN key LIKE '%2' THEN key ELSE 'T ' || key END AS title, subject, v.variant, v.conditioning_prompt, v.prompt, colors, 'front|side' AS views FROM p, LATERAL (
  SELECT unnest(CASE WHEN key LIKE '%3' THEN [{'variant': 'v00', 'conditioning_prompt': '{key}', 'prompt': '{subject} own'}] ELSE [{'variant': 'a', 'conditioning_prompt': '{key} x', 'prompt': '{subject} y'}, {'variant': 'v01', 'conditioning_prompt': '{key}', 'prompt': '{subject}'}] END) AS v)
UNION ALL SELECT 'legacy', key, CASE WHEN key LIKE '%2' THEN key ELSE 'T ' || key END, subject, 'v00', '{key}', '{subject}', NULL, NULL FROM p""")
def s11_presets(spark, sf_dir):
    """Presets of the brands as a plan with variants and defaults, and as a plain list."""
    key = F.col("p_brand").alias("key")
    title = F.when(~F.col("p_brand").endswith("2"), F.concat(F.lit("T "), "p_brand")).alias("title")
    some = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_name").alias("subject"), F.sort_array(F.collect_set(F.split("p_name", " ")[0])).alias("colors_v2"))
    variant = lambda name, text, prompt: F.struct(F.lit(name).cast("string").alias("variant"), F.lit(text).cast("string").alias("conditioning_prompt"), F.lit(prompt).cast("string").alias("prompt"))
    own = F.when(F.col("p_brand").endswith("3"), F.array(variant(None, None, "{subject} own"))).alias("variants")
    plan, legacy = fresh(spark, "plan"), fresh(spark, "legacy")
    whole = some.agg(F.collect_list(F.struct(key, title, "subject", "colors_v2", own)).alias("presets"))
    whole.select("presets", F.array(variant("a", "{key} x", "{subject} y"), variant(None, None, None)).alias("variants"), F.create_map(F.lit("views"), F.array(F.lit("front"), F.lit("side"))).alias("defaults")).write.json(plan)
    some.agg(F.to_json(F.collect_list(F.struct(key, title, "subject"))).alias("value")).write.text(legacy)
    both = readers.preset_variants(readers.presets(spark, plan)).unionByName(readers.preset_variants(readers.presets(spark, legacy)))
    listed = lambda c, name: F.when(c.getItem(name).isNotNull(), F.array_join(c.getItem(name), "|"))
    return both.select("form", "key", "title", "subject", "variant", "conditioning_prompt", "prompt", listed(F.col("slots"), "colors").alias("colors"), listed(F.col("defaults"), "views").alias("views"))


SUFFIXES = ["png", "jpg", "jpeg", "webp", "bmp", "PNG", "gif"]
FILES = f"""f AS (SELECT vec_id, label, 'img ' || vec_id AS stem, {SUFFIXES}[vec_id % 7 + 1] AS suffix FROM embeddings WHERE len(embedding) >= 64)"""


def pictures(spark, sf_dir, root):
    """Each vector's picture as a file of one of seven suffixes, five of which are images', in a folder for its label."""
    made = images.from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("id") % 7 + 1).cast("int"))
    path = F.concat_ws("", F.lit("label"), F.col("label").cast("string"), F.lit("/img "), F.col("id").cast("string"), F.lit("."), suffix)
    named = made.join(labels, "id").select("id", "label", path.alias("path"), F.concat(F.encode(F.lit("P6\n8 8\n255\n"), "UTF-8"), "pixels").alias("content"))
    writers.write_files(named, root)
    return named


def shared_uri(spark, name):
    """A new folder below the shared one, as a URI."""
    path = fresh(spark, name)
    return path if "://" in path or path.startswith("file:") else "file://" + path


@query(f"""WITH {FILES}, r AS (SELECT *, list_position(['png', 'jpg', 'jpeg', 'webp', 'bmp'], suffix) AS k FROM f WHERE list_contains(['png', 'jpg', 'jpeg', 'webp', 'bmp'], suffix))
SELECT stem, 203::BIGINT AS length, 'cc0' AS license, row_number() OVER (ORDER BY k, 'label' || label || '/' || stem || '.' || suffix) - 1 AS position FROM r""")
def s03_image_dir(spark, sf_dir):
    root = shared_uri(spark, "images")
    pictures(spark, sf_dir, root)
    found = readers.image_files(spark, root, "cc0")
    return found.select(F.replace("stem", F.lit("%20"), F.lit(" ")).alias("stem"), "length", "license", F.col("position").cast("long").alias("position"))


@query(f"""WITH {FILES} SELECT stem, CASE vec_id % 4 WHEN 0 THEN 'red cat' WHEN 1 THEN 'blue dog ' || vec_id % 3 WHEN 2 THEN 'green bird' ELSE stem END AS raw_caption,
CASE vec_id % 4 WHEN 0 THEN 'red cat' WHEN 1 THEN 'blue dog' WHEN 2 THEN 'green bird' ELSE stem END AS caption FROM (SELECT vec_id, 'p' || vec_id AS stem, suffix FROM f) WHERE list_contains(['png', 'jpg', 'jpeg', 'webp', 'bmp'], suffix)""")
def s04_sidecar_captions(spark, sf_dir):
    """Captions beside images: in a .caption, in a .txt after a .caption that is no caption, in JSON; others have their names."""
    root = shared_uri(spark, "sidecars")
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 64).select("vec_id", F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("stem"), F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("vec_id") % 7 + 1).cast("int")).alias("suffix"))
    k = F.col("vec_id") % 4
    part = lambda when, suffix, text: F.when(when, F.struct(F.concat("stem", F.lit("."), suffix).alias("path"), F.encode(text, "UTF-8").alias("content")))
    files = F.array_compact(F.array(
        part(F.lit(True), F.col("suffix"), F.lit("x")), part(k == 0, F.lit("caption"), F.lit("red cat\nsecond line")), part(k == 1, F.lit("caption"), F.lit("untitled")),
        part(k == 1, F.lit("txt"), F.concat(F.lit("blue dog "), (F.col("vec_id") % 3).cast("string"))), part(k == 2, F.lit("json"), F.lit('{"caption": "img 1", "prompt": "", "title": "green bird"}')), part(k == 3, F.lit("txt"), F.lit("copyright\n")),
    ))
    writers.write_files(e.select(F.explode(files).alias("x")).select("x.*"), root)
    return readers.sidecar_captions(spark, root, "cc0").select("stem", "raw_caption", "caption")


@query(f"""WITH {FILES} SELECT 'label' || label || '.bundle' AS bundle, (count(*) * 203)::BIGINT AS size_bytes, count(*) AS files FROM f GROUP BY 1""")
def s13_bundle_sizes(spark, sf_dir):
    """Folders named .bundle and the files below them, at two depths."""
    root = shared_uri(spark, "bundles")
    made = pictures(spark, sf_dir, shared_uri(spark, "pictures"))
    deep = F.when(F.col("id") % 2 == 0, "weights/").otherwise("")
    writers.write_files(made.select(F.concat(F.lit("label"), F.col("label").cast("string"), F.lit(".bundle/"), deep, F.col("id").cast("string")).alias("path"), "content"), root)
    found = readers.file_inventory(spark, root, ".bundle")
    return found.select(F.regexp_extract("bundle", "([^/]*)$", 1).alias("bundle"), "size_bytes", "files")


@query(f"""WITH {FILES} SELECT count(*) FILTER (WHERE vec_id % 3 <> 0) AS copied, count(*) AS there, (count(*) * 203)::BIGINT AS size_bytes FROM f""")
def k04_copy_files(spark, sf_dir):
    """A third of the files is there already with the same size; the others are copied, and a second time none."""
    source, target = shared_uri(spark, "source"), shared_uri(spark, "target")
    made = pictures(spark, sf_dir, source)
    writers.write_files(made.where("id % 3 = 0"), target)
    listed = lambda root: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace(F.regexp_extract("path", "(label[^/]*/[^/]*)$", 1), "%20", " ").alias("path"), "length")
    copied = writers.copy_files(writers.to_copy(listed(source), listed(target)), source, target)
    again = writers.copy_files(writers.to_copy(listed(source), listed(target)), source, target)
    if again:
        raise RuntimeError("files were copied twice")
    return listed(target).agg(F.count("*").alias("there"), F.sum("length").alias("size_bytes")).select(F.lit(copied).cast("long").alias("copied"), "there", "size_bytes")


@query("SELECT sha256(text) AS digest, 'doc ' || doc_id AS name FROM documents")
def s14_checksum_lines(spark, sf_dir):
    line = table(spark, sf_dir, "documents").select(F.concat(F.sha2(F.col("text").cast("binary"), 256), F.lit("  doc "), F.col("doc_id").cast("string")).alias("value"))
    return readers.checksums(line)


@query(r"""SELECT DISTINCT unnest(list_concat([url], regexp_extract_all(html, 'href="([^"]+)"', 1))) AS path FROM pages""")
def k03_referenced_paths(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    named = pages.select("url", F.map_from_arrays(F.array_distinct(links), F.array_distinct(links)).alias("saved"))
    return writers.referenced_paths(named, ["url"], "saved")


@query("SELECT o_orderkey AS path, o_custkey AS length FROM orders EXCEPT SELECT l_orderkey, l_suppkey FROM lineitem")
def k04_to_copy(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("length")).distinct()
    return writers.to_copy(wanted, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_suppkey").alias("length")))


@query("SELECT event_id, event_type, 'slow' AS error FROM events WHERE value > 95")
def k05_failures(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return writers.split_failures(e, F.when(F.col("value") > 95, "slow"))[1].select("event_id", "event_type", "error")


@query("SELECT printf('| %s | %d |', event_type, count(*)) AS value FROM events GROUP BY event_type")
def k06_report_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return writers.report_lines(e, "| %s | %d |", ["event_type", "n"])
