"""Queries on captions, names and texts."""

from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.plans._registry import query, strings, table

CLEAN = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(coalesce({0}, ''), '<[^>]+>', ' ', 'g'),
  'https?://\S+', ' ', 'g'), '_+|', '   '), '(?i)\.(jpg|jpeg|png|webp|gif|bmp|tiff)\b', ' ', 'g'), '[^A-Za-z0-9'' -]+', ' ', 'g'), '\s+', ' ', 'g')))"""


@query(f"SELECT doc_id, {CLEAN.format('text')} AS caption FROM documents")
def t01_clean_caption_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_caption(F.col("text")).alias("caption"))


@query(f"SELECT page_id, {CLEAN.format('html')} AS caption FROM pages")
def t01_clean_caption_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_caption(F.col("html")).alias("caption"))


def shorten_sql(source: str, keys: str, least: int, most: int, preserve: bool = False) -> str:
    """CTEs that end in ``short`` (keys, pos, raw, caption), caption null where rejected, from ``source`` (keys, pos, raw)."""
    prefix = "CASE " + " ".join(f"WHEN starts_with(text, '{p}') THEN trim(substr(text, {len(p) + 1}))" for p in T.PREFIXES) + " ELSE text END"
    bad = " OR ".join(f"contains(text || ' ', '{b}')" for b in T.BAD_FRAGMENTS)
    cut = "body" if preserve else f"list_reduce({strings(T.TRIM_MARKERS)}, lambda t, m: CASE WHEN instr(t, m) > 1 THEN trim(substr(t, 1, instr(t, m) - 1)) ELSE t END, body)"
    words = r"regexp_extract_all(trim(regexp_replace(regexp_replace(regexp_replace(body, '\b\d{2,}\b', ' ', 'g'), '\b[a-z]\b', ' ', 'g'), '\s+', ' ', 'g'), ' -'''), '[a-z][a-z0-9''-]*')"
    kept = "words" if preserve else f"words[1:coalesce(list_max(list_transform(words, lambda w, i: CASE WHEN list_contains({strings(T.TRAILING_WORDS)}, w) THEN 0 ELSE i END)), 0)]"
    return rf"""a AS (SELECT {keys}, pos, raw, {CLEAN.format("raw")} AS text FROM {source}),
b AS (SELECT {keys}, pos, raw, {prefix} AS body FROM a WHERE text <> '' AND NOT ({bad})),
c AS (SELECT {keys}, pos, raw, {cut} AS body FROM b), d AS (SELECT {keys}, pos, raw, {words} AS words FROM c), e AS (SELECT {keys}, pos, raw, {kept} AS w FROM d),
short AS (SELECT {keys}, pos, raw, array_to_string(w, ' ') AS caption FROM e WHERE len(w) BETWEEN {least} AND {most} AND len(w) > 0
  AND NOT list_contains({strings(T.MULTI_SUBJECT_STARTERS)}, w[1]) AND NOT (len(w) > 2 AND len(list_distinct(w)) = 1))"""


LINES = "lines AS (SELECT doc_id, u.pos - 1 AS pos, u.raw FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'raw': x, 'pos': i})) AS u FROM documents))"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))


@query(f"WITH {LINES}, {shorten_sql('lines', 'doc_id', 1, 12)} SELECT doc_id, pos::BIGINT AS pos, caption FROM short")
def t02_shorten_caption(spark, sf_dir):
    """Every line of every document is a caption."""
    return T.shortened(lines(spark, sf_dir), "raw", "caption", 1, 12).select("doc_id", F.col("pos").cast("long").alias("pos"), "caption")


@query(f"WITH {LINES}, {shorten_sql('lines', 'doc_id', 2, 20, True)} SELECT doc_id, pos::BIGINT AS pos, caption FROM short")
def t02_shorten_caption_preserving(spark, sf_dir):
    return T.shortened(lines(spark, sf_dir), "raw", "caption", 2, 20, True).select("doc_id", F.col("pos").cast("long").alias("pos"), "caption")


BOXES = """boxes AS (SELECT l_orderkey, l_linenumber AS pos, l_shipinstruct AS raw FROM lineitem)"""


@query(rf"""WITH x AS (SELECT conv_id, turn, u.raw, u.pos FROM (SELECT conv_id, turn, unnest(list_transform(regexp_split_to_array(text, '[,;]'), lambda x, i: {{'raw': x, 'pos': i}})) AS u FROM conversations WHERE text <> '')),
{shorten_sql("x", "conv_id, turn", 1, 6)}, k AS (SELECT conv_id, turn, caption, min(pos) AS pos FROM short GROUP BY ALL)
SELECT conv_id, turn, string_agg(caption, '|' ORDER BY pos) AS captions, arg_min(caption, pos) AS chosen FROM k GROUP BY ALL""")
def t04_candidate_captions(spark, sf_dir):
    """A turn's text is a list of tags; candidates in order, each once; the first is chosen."""
    found = T.candidate_captions([(F.col("text"), True)])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("c")).where("size(c) > 0").select("conv_id", "turn", F.array_join("c", "|").alias("captions"), F.col("c")[0].alias("chosen"))


@query("SELECT o_orderkey, coalesce(nullif(o_clerk, ''), nullif(o_orderpriority, ''), o_orderstatus) AS found FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN o_orderstatus END AS o_clerk FROM orders)")
def t05_detect_value(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("o_clerk", F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, F.col("o_orderstatus")))
    return orders.select("o_orderkey", T.first_present("o_clerk", "o_orderpriority", "o_orderstatus").alias("found"))


@query("""SELECT page_id, CASE WHEN name <> '' AND link <> '' THEN name || ' (' || link || ')' ELSE coalesce(nullif(name, ''), nullif(link, ''), 'unlicensed') END AS license
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'CC BY 4.0' WHEN 1 THEN '' END AS name, CASE WHEN page_id % 2 = 0 THEN url END AS link FROM pages)""")
def t06_license_from_row(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    name = F.when(F.col("page_id") % 3 == 0, "CC BY 4.0").when(F.col("page_id") % 3 == 1, "")
    return pages.select("page_id", T.license_text(name, F.when(F.col("page_id") % 2 == 0, F.col("url")), F.lit("unlicensed")).alias("license"))


@query(f"SELECT page_id, regexp_matches(lower(url), '^https?://') AND ({' OR '.join(f'''contains(lower(url), '{t}')''' for t in T.IMAGE_URL_TOKENS)}) AS is_image FROM pages")
def t07_looks_like_image_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.looks_like_image_url(F.col("url")).alias("is_image"))


@query(r"SELECT doc_id, trim(regexp_replace(replace(lower(text), '+', ' '), '[\s\p{Z}]+', ' ', 'g')) AS blob FROM documents")
def t08_normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("blob"))


@query("SELECT c_custkey, list_filter([c_name, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END], lambda x: x <> '')[1] AS first_label, len(list_filter([c_name, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END], lambda x: x <> ''))::INTEGER AS n FROM customer")
def t09_extract_object_labels(spark, sf_dir):
    label = lambda c: F.struct(c.alias("label"))
    objects = F.array(label(F.col("c_name")), label(F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment"))))
    return table(spark, sf_dir, "customer").select("c_custkey", T.object_labels(objects).alias("x")).select("c_custkey", F.col("x")[0].alias("first_label"), F.size("x").alias("n"))


@query(r"SELECT page_id, trim(regexp_replace(replace(lower(concat_ws(' ', nullif(url, ''), nullif(html, ''))), '+', ' '), '[\s\p{Z}]+', ' ', 'g')) AS blob FROM pages")
def t10_row_text_blob(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.text_blob(F.col("url"), F.col("html")).alias("blob"))


@query(r"SELECT p_partkey, coalesce(nullif(trim(regexp_replace(p_name || '/' || p_type, '[^\p{L}\p{N}_-]', '_', 'g'), '_'), ''), 'sample') AS token FROM part")
def t11_sanitize_id(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.sanitize(F.concat_ws("/", "p_name", "p_type")).alias("token"))


@query(r"""WITH s AS (SELECT doc_id, coalesce(nullif(trim(regexp_replace(concat_ws('_', text, doc_id::VARCHAR), '[^\p{L}\p{N}_-]', '_', 'g'), '_'), ''), 'sample') AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) > 80 THEN substr(s, 1, 68) || '_' || substr(sha1(s), 1, 10) ELSE s END || printf('_%06d', doc_id) AS id FROM s""")
def t12_row_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.row_id(F.col("text"), F.col("doc_id").cast("string"), F.col("doc_id")).alias("id"))


@query(r"""SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'item') AS slug,
coalesce(nullif(replace(trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', ' ', 'g')), ' ', '_'), ''), 'prompt') AS run_key,
substr(trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS ascii_slug FROM part""")
def t13_slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slugify(F.col("p_type")).alias("slug"), T.run_key(F.col("p_name")).alias("run_key"), T.ascii_slug(F.concat_ws(" ", "p_name", "p_brand")).alias("ascii_slug"))


SEARCH = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))"


@query(f"SELECT doc_id, s AS search, len(list_distinct(list_filter(string_split(s, ' '), lambda t: length(t) > 1)))::INTEGER AS n_tokens FROM (SELECT doc_id, {SEARCH} AS s FROM documents)")
def t14_search_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.search_text(F.col("text")).alias("search"))
    return docs.select("doc_id", "search", F.size(T.search_tokens(F.col("search"))).alias("n_tokens"))


def any_sql(terms):
    single = [t for t in terms if " " not in t]
    return "(" + " OR ".join([f"list_has_any(string_split(s, ' '), {strings(single)})", *(f"contains(s, '{t}')" for t in terms if " " in t)]) + ")"


@query(f"SELECT doc_id, {any_sql(['the', 'la', 'and the', 'of'])} AS found FROM (SELECT doc_id, {SEARCH} AS s FROM documents)")
def t15_contains_any_term(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.contains_any(T.search_text(F.col("text")), ["the", "la", "and the", "of"]).alias("found"))


EXPAND = f"""CASE WHEN p = '' THEN '{T.EMPTY_PROMPT}' ELSE concat_ws(', ', p,
CASE WHEN NOT {any_sql(T.PLURAL_TERMS)} AND NOT {any_sql(["single", "one", "solo"])} THEN CASE WHEN {any_sql(T.RELATION_TERMS)} OR {any_sql(T.SCENE_TERMS)} THEN 'centered composition' ELSE 'single subject' END END,
CASE WHEN NOT {any_sql(["center", "centered"])} THEN 'centered' END,
CASE WHEN NOT {any_sql(T.CLOSEUP_TERMS)} AND NOT {any_sql(T.SCENE_TERMS)} AND NOT {any_sql(["full", "visible", "body"])} THEN 'full object visible' END,
CASE WHEN NOT {any_sql(T.STYLE_TERMS)} THEN 'clean anime illustration' WHEN NOT {any_sql(["clean", "simple"])} THEN 'clean illustration' END,
CASE WHEN NOT {any_sql(["background", "scene", "landscape"])} THEN 'simple background' END) END"""


@query(f"SELECT p_partkey, {EXPAND} AS prompt FROM (SELECT p_partkey, trim(p_name) AS p, {SEARCH.replace('text', 'trim(p_name)')} AS s FROM part)")
def t16_expand_prompt(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.expand_prompt(F.col("p_name")).alias("prompt"))


@query(f"SELECT conv_id, turn, {EXPAND} AS prompt FROM (SELECT conv_id, turn, trim(text) AS p, {SEARCH.replace('text', 'trim(text)')} AS s FROM conversations)")
def t16_expand_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.expand_prompt(F.col("text")).alias("prompt"))


PROMPT = r"regexp_replace(translate(lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '_-', '  '), '[\s\p{{Z}}]+', ' ', 'g')"


@query(f"SELECT doc_id, {PROMPT.format('text')} AS prompt FROM documents")
def t17_normalize_prompt_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_prompt(F.col("text")).alias("prompt"))


@query(f"SELECT doc_id, array_to_string(regexp_extract_all({PROMPT.format('text')}, '{T.TOKEN}'), ' ') AS tokens FROM documents")
def t18_tokenize_prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.prompt_tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT p_partkey, 'a ' || p_name || ' of ' || p_brand || CASE WHEN p_size > 25 THEN ', large' ELSE '' END AS prompt FROM part")
def t19_render_template(spark, sf_dir):
    slots = F.create_map(F.lit("title"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("guard_clause"), F.when(F.col("p_size") > 25, ", large").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", T.render(F.lit("a  {title} of {brand}{guard_clause}"), slots).alias("prompt"))


@query("SELECT o_orderkey, o_orderstatus || '_v' || (o_custkey % 7)::VARCHAR || '_seed' || CASE WHEN s < 0 THEN printf('neg%06d', abs(s)) ELSE printf('%06d', s) END AS stem FROM (SELECT *, o_custkey - 100 AS s FROM orders)")
def t20_stem(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.concat("o_orderstatus", F.lit("_v"), (F.col("o_custkey") % 7).cast("string"), F.lit("_seed"), T.seed_token(F.col("o_custkey") - 100)).alias("stem"))


@query("SELECT o_orderkey, 'images_64/' || o_orderkey || '.png' AS small, 'images_256/' || o_orderkey || '.png' AS large FROM orders")
def t21_output_relpaths(spark, sf_dir):
    paths = T.output_paths(F.col("o_orderkey").cast("string"), [64, 256])
    return table(spark, sf_dir, "orders").select("o_orderkey", paths.alias("m")).select("o_orderkey", F.col("m")["64"].alias("small"), F.col("m")["256"].alias("large"))


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM documents""")
def t22_parse_lists(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.parse_list(F.col("text")), "|").alias("items"))


@query("""WITH b AS (SELECT l_orderkey, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS pos, l_shipmode AS label, round(l_discount * 100) AS x0, l_quantity AS x1, round(l_tax * 100) AS y0, l_linenumber * 3 AS y1, l_linestatus = 'O' AND l_linenumber % 5 = 0 AS grouped FROM lineitem),
a AS (SELECT *, greatest(0, x1 - x0) * greatest(0, y1 - y0) AS area FROM b WHERE NOT grouped),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, label ORDER BY area DESC, pos) AS n FROM a WHERE area >= 0.03)
SELECT l_orderkey, label, pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY area DESC, pos) AS rank FROM r WHERE n = 1""".replace("l_shipmode", "l_returnflag"))
def t03_object_caption_candidates(spark, sf_dir):
    from tessel.operators.scoring import object_candidates

    boxes = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_returnflag").alias("label"), F.round(F.col("l_discount") * 100).alias("xmin"), F.col("l_quantity").alias("xmax"),
        F.round(F.col("l_tax") * 100).alias("ymin"), (F.col("l_linenumber") * 3).alias("ymax"), ((F.col("l_linestatus") == "O") & (F.col("l_linenumber") % 5 == 0)).alias("is_group_of"),
    )
    return object_candidates(boxes, ["l_orderkey"], "label", 0.03).select("l_orderkey", "label", "pos", "rank")
