"""Queries on prompt slots."""

from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import slots as S
from tessel.plans._registry import query, strings, table
from tessel.plans.captions import PROMPT, SEARCH


def alias_sql(vocabulary=S.VOCABULARY):
    rows = ", ".join(f"('{slot}', {i}, '{key}', '{alias}')" for slot, aliases in vocabulary.items() for i, (key, words) in enumerate(aliases.items()) for alias in dict.fromkeys([key, *words]))
    return f"""alias AS (SELECT *, regexp_extract_all({PROMPT.format('alias')}, '{T.TOKEN}') AS terms, CASE WHEN NOT regexp_matches(alias, '^[\\x00-\\x7F]*$') THEN replace({PROMPT.format('alias')}, ' ', '') END AS compact
FROM (VALUES {rows}) AS t(slot, priority, key, alias))"""


TAILS = [" close-up", " painting", " flying bird", " アップ", " 赤い鳥", " kitten with butterflies", " ペンギンの写真", " ice-cream"]
NAMES = "SELECT DISTINCT p_name || CASE p_size % 9 " + " ".join(f"WHEN {i} THEN '{tail}'" for i, tail in enumerate(TAILS)) + " ELSE '' END AS prompt FROM part"
TURNS = "SELECT DISTINCT text AS prompt FROM conversations WHERE text IS NOT NULL"


def matched(source=NAMES):
    return f"""p AS ({source}), t AS (SELECT prompt, regexp_extract_all({PROMPT.format('prompt')}, '{T.TOKEN}') AS tokens FROM p), {alias_sql()},
m AS (SELECT DISTINCT prompt, slot, priority, key FROM t, alias WHERE (len(terms) > 0 AND list_has_all(tokens, terms)) OR (compact IS NOT NULL AND contains(array_to_string(tokens, ''), compact)))"""


def slotted(source=NAMES):
    each = ", ".join(f"coalesce(list(key ORDER BY priority) FILTER (WHERE slot = '{s}'), []) AS {s}s" for s in S.SLOTS)
    none = ", ".join(f"coalesce({s}s, []) AS {s}s" for s in S.SLOTS)
    return f"""{matched(source)}, g AS (SELECT prompt, {each} FROM m GROUP BY prompt),
s AS (SELECT prompt, tokens, {none}, CASE WHEN subjects IS NULL THEN list_filter(tokens, lambda x: NOT list_contains({strings(S.STOPWORDS)}, x)) ELSE [] END AS unknown FROM t LEFT JOIN g USING (prompt))"""


def names(spark, sf_dir):
    """Part names with a word of another slot behind."""
    tail = F.lit("")
    for i, text in enumerate(TAILS):
        tail = F.when(F.col("p_size") % 9 == i, text).otherwise(tail)
    return table(spark, sf_dir, "part").select(F.concat("p_name", tail).alias("prompt"))


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("text").alias("prompt"))


def joined(prefix=""):
    return [F.array_join(f"{s}s", "|").alias(f"{s}s") for s in S.SLOTS]


JOINED = ", ".join(f"array_to_string({s}s, '|') AS {s}s" for s in S.SLOTS)


@query(f"WITH {matched()} SELECT prompt, slot, key FROM m")
def p01_alias_match(spark, sf_dir):
    return S.matches(names(spark, sf_dir), S.alias_table(spark)).select("prompt", "slot", "key").distinct()


@query(f"WITH {matched(TURNS)} SELECT md5(prompt) AS prompt, slot, key FROM m")
def p01_alias_match_turns(spark, sf_dir):
    return S.matches(turns(spark, sf_dir), S.alias_table(spark)).select(F.md5("prompt").alias("prompt"), "slot", "key").distinct()


@query(f"WITH {slotted()} SELECT prompt, array_to_string(colors, '|') AS keys FROM s")
def p02_matched_alias_keys(spark, sf_dir):
    return S.slots(names(spark, sf_dir), S.alias_table(spark)).select("prompt", F.array_join("colors", "|").alias("keys"))


CANONICAL = f"""CASE WHEN {PROMPT.format("prompt")} = '' THEN '' WHEN list_has_all(subjects, ['astronaut', 'horse']) THEN 'astronaut horse'
ELSE coalesce(subjects[1], nullif(array_to_string(tokens, ' '), ''), {PROMPT.format("prompt")}) END"""


@query(f"WITH {slotted()} SELECT prompt, {CANONICAL} AS canonical FROM s")
def p03_canonicalize_prompt(spark, sf_dir):
    return S.canonical(S.slots(names(spark, sf_dir), S.alias_table(spark)))


@query(f"WITH {slotted()} SELECT prompt, {JOINED}, array_to_string(unknown, '|') AS unknown FROM s")
def p04_normalize_prompt_slots(spark, sf_dir):
    return S.slots(names(spark, sf_dir), S.alias_table(spark)).select("prompt", *joined(), F.array_join("unknown", "|").alias("unknown"))


@query(f"WITH {slotted(TURNS)} SELECT md5(prompt) AS prompt, {JOINED}, array_to_string(unknown, '|') AS unknown FROM s")
def p04_normalize_turn_slots(spark, sf_dir):
    return S.slots(turns(spark, sf_dir), S.alias_table(spark)).select(F.md5("prompt").alias("prompt"), *joined(), F.array_join("unknown", "|").alias("unknown"))


@query(f"""WITH {slotted()} SELECT prompt, array_to_string(list_concat(styles, colors, modifiers, subjects, actions,
flatten(list_transform(views, lambda v: CASE WHEN v = 'closeup' THEN [v] ELSE [v, 'view'] END)), unknown), ' ') AS phrase FROM s""")
def p05_phrase_tokens(spark, sf_dir):
    return S.slots(names(spark, sf_dir), S.alias_table(spark)).select("prompt", F.array_join(S.phrase_tokens(), " ").alias("phrase"))


@query(f"WITH {matched(TURNS)} SELECT conv_id, turn FROM conversations WHERE text IN (SELECT prompt FROM m WHERE slot = 'color')")
def p06_has_alias(spark, sf_dir):
    return S.has_alias(table(spark, sf_dir, "conversations"), S.alias_table(spark), "color", "text").select("conv_id", "turn")


@query(f"WITH {slotted(TURNS)} SELECT count(*) AS prompts, count(*) FILTER (WHERE len(subjects) = 0) AS without_subject, count(*) FILTER (WHERE len(unknown) > 0) AS with_unknown FROM s")
def p07_coverage_audit(spark, sf_dir):
    return S.coverage(S.slots(turns(spark, sf_dir), S.alias_table(spark)))


HREF = r"""SELECT DISTINCT unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS key FROM pages"""
NAME_WORDS = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS key FROM part"


@query(f"WITH a AS ({HREF}), b AS ({NAME_WORDS}) SELECT key, 'only_a' AS side FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'only_b' FROM b WHERE key NOT IN (SELECT key FROM a)")
def p07_key_difference(spark, sf_dir):
    return S.key_difference(p08_ui_keys(spark, sf_dir), table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("key")))


@query(HREF)
def p08_ui_keys(spark, sf_dir):
    """Keys that links in the pages name."""
    return S.linked_keys(table(spark, sf_dir, "pages"), "html")


@query("""WITH v AS (SELECT DISTINCT p_brand AS key, unnest(string_split(p_name, ' ')) AS alias, p_partkey % 2 AS side FROM part WHERE p_size > 5 OR p_partkey % 2 = 0),
a AS (SELECT key, string_agg(DISTINCT alias, ',' ORDER BY alias) AS words FROM v WHERE side = 0 GROUP BY 1), b AS (SELECT key, string_agg(DISTINCT alias, ',' ORDER BY alias) AS words FROM v WHERE side = 1 GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'missing_a' WHEN b.key IS NULL THEN 'missing_b' WHEN a.words <> b.words THEN 'differs' ELSE 'same' END AS state FROM a FULL JOIN b ON a.key = b.key""")
def p09_vocabulary_parity(spark, sf_dir):
    """Two copies of a vocabulary (the words of each brand's names, in even and in odd parts) have to agree."""
    part = table(spark, sf_dir, "part").where("p_size > 5 OR p_partkey % 2 = 0")
    words = part.select(F.col("p_brand").alias("key"), (F.col("p_partkey") % 2).alias("side"), F.explode(F.split("p_name", " ")).alias("alias"))
    return S.vocabulary_parity(words.where("side = 0"), words.where("side = 1"))


@query(rf"""WITH p AS (SELECT DISTINCT prompt, p, list_distinct(list_filter(string_split(p, ' '), lambda t: length(t) > 1)) AS words FROM (SELECT prompt, {SEARCH.replace("text", "prompt")} AS p FROM ({NAMES}))),
k AS (SELECT preset, idx, c, list_distinct(list_filter(string_split(c, ' '), lambda t: length(t) > 1)) AS terms FROM (SELECT preset, idx, {SEARCH.replace("text", "candidate")} AS c FROM (
  SELECT min(p_partkey) AS idx, p_type AS preset, p_type AS candidate FROM part GROUP BY p_type UNION ALL SELECT min(p_partkey), any_value(p_type), p_name FROM (SELECT p_name, min(p_type) AS p_type, min(p_partkey) AS p_partkey FROM part GROUP BY p_name) GROUP BY p_name))),
x AS (SELECT prompt, preset, idx, CASE WHEN p = c THEN 1000 + length(c) WHEN contains(' ' || p || ' ', ' ' || c || ' ') OR contains(' ' || c || ' ', ' ' || p || ' ') THEN 700 + length(c) ELSE 100 * len(list_intersect(words, terms)) + len(terms) END AS score FROM p, k WHERE list_has_any(words, terms)),
b AS (SELECT prompt, score, preset, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, idx, preset DESC) AS n FROM x)
SELECT p.prompt, CASE WHEN score >= 200 THEN preset END AS preset, coalesce(score, 0)::INTEGER AS score FROM p LEFT JOIN b ON p.prompt = b.prompt AND n = 1""")
def p10_preset_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    types = part.groupBy("p_type").agg(F.min("p_partkey").alias("idx")).select("idx", F.col("p_type").alias("preset"), F.col("p_type").alias("candidate"))
    titles = part.groupBy("p_name").agg(F.min("p_partkey").alias("idx"), F.min("p_type").alias("preset")).select("idx", "preset", F.col("p_name").alias("candidate"))
    return S.preset_match(names(spark, sf_dir), types.unionByName(titles)).select("prompt", "preset", F.col("score").cast("int").alias("score"))


SINGLE = ", ".join(f"arg_max(key, (length(key), -priority)) FILTER (WHERE slot = '{s}') AS {s}" for s in S.SLOTS)


@query(f"""WITH {matched()}, g AS (SELECT prompt, {SINGLE} FROM m GROUP BY prompt), e AS (SELECT DISTINCT key FROM alias WHERE slot = 'subject')
SELECT t.prompt, coalesce(e.key, subject) AS subject, {", ".join(f"CASE WHEN e.key IS NULL THEN {s} END AS {s}" for s in S.SLOTS[1:])} FROM t LEFT JOIN g ON t.prompt = g.prompt LEFT JOIN e ON {PROMPT.format("t.prompt")} = e.key""")
def p11_single_slots(spark, sf_dir):
    return S.single_slots(names(spark, sf_dir), S.alias_table(spark))


@query(f"""WITH {matched()}, g AS (SELECT prompt, {SINGLE} FROM m GROUP BY prompt) SELECT prompt, coalesce(nullif(concat_ws(' ', style, color, subject, action, view), ''), subject) AS composed FROM g""")
def p12_compose_slots(spark, sf_dir):
    found = S.single_slots(names(spark, sf_dir), S.alias_table(spark)).where("coalesce(subject, color, action, view, modifier, style) IS NOT NULL")
    return found.select("prompt", S.compose("style", "color", "subject", "action", "view").alias("composed"))
