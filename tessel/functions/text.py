"""Captions, prompts and names as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values of the caption rules ---
TRAILING_WORDS = [
    "is", "are", "was", "were", "sitting", "standing", "lying", "laying", "holding", "wearing", "eating", "drinking", "walking",
    "running", "flying", "parked", "painting", "crossing",
]
MULTI_SUBJECT_STARTERS = ["two", "three", "four", "five", "six", "several", "many", "multiple", "group", "crowd"]
BAD_FRAGMENTS = [
    "all rights reserved", "copyright", "creative commons", "uploaded by", "screenshot", "screen shot", "untitled",
    "unknown", "img", "dsc", "sam ", "whatsapp", "once again",
]
TRIM_MARKERS = [
    " with ", " and ", " or ", " in front of ", " next to ", " near ", " beside ", " sitting ", " standing ", " lying ",
    " laying ", " holding ", " wearing ", " eating ", " drinking ", " walking ", " running ", " flying ", " parked ",
    " painting ", " crossing ",
]
PREFIXES = [
    "a photo of ", "a photograph of ", "a picture of ", "an image of ", "a close up of ", "a close-up of ",
    "close up of ", "close-up of ", "a blurry photo of ", "there is ", "there are ",
]
IMAGE_URL_TOKENS = [".jpg", ".jpeg", ".png", ".webp", ".bmp", "staticflickr", "images.cocodataset"]
# --- fixed values of the prompt expansion ---
PLURAL_TERMS = ["two", "three", "multiple", "many", "group", "crowd", "pair"]
RELATION_TERMS = ["in", "on", "with", "riding", "holding", "wearing", "inside", "under", "over", "near"]
CLOSEUP_TERMS = ["face", "head", "portrait", "closeup", "close"]
SCENE_TERMS = ["landscape", "scene", "mountain", "snowy", "forest", "ocean", "sky", "city", "desert"]
STYLE_TERMS = ["anime", "illustration", "illustrated", "icon", "logo", "sticker", "photo", "photograph", "photorealistic", "pixel", "3d"]
EMPTY_PROMPT = "cat mascot, single subject, clean anime illustration, simple background"

#: Spaces as every engine sees them.
SPACE = r"[\s\p{Z}]+"
TOKEN = r"[a-z0-9]+|[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it stands in it."""
    return F.get(F.transform(F.array(value), body), 0)


def present(c: Column | str) -> Column:
    """Null for empty strings, as ``a or b`` chains see them."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def first_present(*columns: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(present(c) for c in columns))


def clean_caption(text: Column) -> Column:
    """Strips tags, links, image suffixes and all but letters, digits, ``'``, ``-`` and single spaces; lower case; null becomes ''."""
    raw = F.coalesce(text, F.lit(""))
    # most captions hold no tag and no link, and are spared the search
    text = F.when(raw.contains("<"), F.regexp_replace(raw, "<[^>]+>", " ")).otherwise(raw)
    text = F.when(raw.contains("http"), F.regexp_replace(text, r"https?://\S+", " ")).otherwise(text)
    text = F.translate(text, "_+|", "   ")
    text = F.when(raw.contains("."), F.regexp_replace(text, r"(?i)\.(jpg|jpeg|png|webp|gif|bmp|tiff)\b", " ")).otherwise(text)
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9' -]+", " "), r"\s+", " ")))


def _bad(text: Column) -> Column:
    """Whether the text and a space behind it hold a bad fragment."""
    found = F.lit(False)
    for fragment in BAD_FRAGMENTS:
        found = found | text.contains(fragment)
        if fragment.endswith(" "):
            found = found | text.endswith(fragment[:-1])
    return found


def _cut(text: Column, preserve: bool) -> Column:
    """A clean caption without its prefix, what follows a marker, numbers and single letters."""
    body = text
    for prefix in reversed(PREFIXES):
        body = F.when(text.startswith(prefix), F.trim(F.substr(text, F.lit(len(prefix) + 1)))).otherwise(body)
    if not preserve:
        for marker in TRIM_MARKERS:  # a trimmed text does not begin with one, and is left whole where there is none
            body = F.trim(F.substring_index(body, marker, 1))
    body = F.regexp_replace(F.regexp_replace(body, r"\b\d{2,}\b", " "), r"\b[a-z]\b", " ")
    return F.btrim(F.regexp_replace(body, r"\s+", " "), F.lit(" -'"))


def _phrase(words: Column, least: int, most: int, preserve: bool) -> Column:
    """The words, without verbs at the end, as a phrase, or null where the rules reject them."""
    trailing = lambda w: w.isin(TRAILING_WORDS)

    def judged(w: Column) -> Column:
        good = (F.size(w) >= least) & (F.size(w) <= most) & ~F.coalesce(F.get(w, 0).isin(MULTI_SUBJECT_STARTERS), F.lit(False)) & ~((F.size(w) > 2) & (F.size(F.array_distinct(w)) == 1))
        return F.when(good, F.array_join(w, " "))

    if preserve:
        return F.when(F.size(words) <= most, judged(words))
    # more words than allowed only pass if all those beyond are to be dropped, so few are looked at
    fits = F.forall(F.slice(words, most + 1, F.greatest(F.size(words) - most, F.lit(0))), trailing)
    ends = lambda w: F.coalesce(F.array_max(F.transform(F.slice(w, 1, most), lambda x, i: F.when(trailing(x), 0).otherwise(i + 1))), F.lit(0))
    return F.when(fits, let(F.slice(words, 1, ends(words)), judged))


def shorten_caption(value: Column, least: int = 1, most: int = 6, preserve: bool = False) -> Column:
    """A short noun phrase from a caption, or null where the rules reject it."""

    def whole(text: Column) -> Column:
        words = F.regexp_extract_all(_cut(text, preserve), F.lit("[a-z][a-z0-9'-]*"), F.lit(0))
        return F.when((text != "") & ~_bad(text), let(words, lambda w: _phrase(w, least, most, preserve)))

    return let(clean_caption(value), whole)


def shortened(df: DataFrame, caption: str, out: str, least: int = 1, most: int = 6, preserve: bool = False) -> DataFrame:
    """The rows whose caption is not rejected, with its short form: ``shorten_caption`` in steps, which Spark compiles.

    An explode leaves the others out, since a filter would have the whole expression worked out twice.
    """
    clean = df.withColumn("_clean", clean_caption(F.col(caption)))
    good = (F.col("_clean") != "") & ~_bad(F.col("_clean"))
    cut = clean.withColumn("_words", F.when(good, F.regexp_extract_all(_cut(F.col("_clean"), preserve), F.lit("[a-z][a-z0-9'-]*"), F.lit(0))))
    return cut.withColumn(out, F.explode(F.array_compact(F.array(_phrase(F.col("_words"), least, most, preserve))))).drop("_clean", "_words")


def candidate_captions(fields: Sequence[tuple[Column, bool]], least: int = 1, most: int = 6) -> Column:
    """Shortened captions of all fields in order, each once; a field marked True is a list of tags split at , and ;."""
    lists = [F.when(present(c).isNull(), F.array().cast("array<string>")).otherwise(F.split(c, "[,;]") if tags else F.array(c)) for c, tags in fields]
    return F.array_distinct(F.filter(F.transform(F.flatten(F.array(*lists)), lambda x: shorten_caption(x, least, most)), lambda x: x.isNotNull()))


def license_text(name: Column, url: Column, fallback: Column) -> Column:
    name, url = present(name), present(url)
    return F.when(name.isNotNull() & url.isNotNull(), F.concat(name, F.lit(" ("), url, F.lit(")"))).otherwise(F.coalesce(name, url, present(fallback)))


def looks_like_image_url(url: Column) -> Column:
    low = F.lower(url)
    some = F.lit(False)
    for token in IMAGE_URL_TOKENS:
        some = some | low.contains(token)
    return F.coalesce((low.startswith("http://") | low.startswith("https://")) & some, F.lit(False))


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "+", " "), SPACE, " "))


def object_labels(objects: Column) -> Column:
    """Labels that are there, in order."""
    return F.filter(F.transform(objects, lambda o: present(o["label"])), lambda x: x.isNotNull())


def text_blob(*fields: Column) -> Column:
    return normalize_text(F.concat_ws(" ", *(present(f) for f in fields)))


def sanitize(text: Column, fallback: str = "sample") -> Column:
    return F.coalesce(present(F.btrim(F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_"), F.lit("_"))), F.lit(fallback))


def row_id(caption: Column, source_id: Column, index: Column) -> Column:
    return let(sanitize(F.concat_ws("_", caption, source_id)), lambda s: F.concat(F.when(F.length(s) > 80, F.concat(F.substr(s, F.lit(1), F.lit(68)), F.lit("_"), F.substr(F.sha1(s), F.lit(1), F.lit(10)))).otherwise(s), F.format_string("_%06d", index)))


def slugify(text: Column) -> Column:
    return F.coalesce(present(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))), F.lit("item"))


def ascii_slug(text: Column, most: int = 60) -> Column:
    return F.substr(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(1), F.lit(most))


def search_text(text: Column) -> Column:
    """Lower case; runs of anything but letters and numbers become one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def search_tokens(search: Column) -> Column:
    return F.array_distinct(F.filter(F.split(search, " "), lambda t: F.length(t) > 1))


def run_key(prompt: Column) -> Column:
    return F.coalesce(present(F.translate(search_text(prompt), " ", "_")), F.lit("prompt"))


def contains_any(search: Column, terms: Sequence[str]) -> Column:
    """Whether a normalised text has any term: terms of several words as substrings, others as tokens of two letters or more."""
    single = [t for t in terms if " " not in t]
    found = F.arrays_overlap(search_tokens(search), F.array(*map(F.lit, single))) if single else F.lit(False)
    for term in terms:
        if " " in term:
            found = found | search.contains(term)
    return found


def expand_prompt(prompt: Column) -> Column:
    """Adds clauses on composition, visibility, style and background that a prompt lacks."""
    prompt = F.trim(prompt)

    def clauses(s: Column) -> Column:
        has = lambda terms: contains_any(s, terms)
        scene = has(SCENE_TERMS)
        return F.concat_ws(
            ", ", prompt,
            F.when(~has(PLURAL_TERMS) & ~has(["single", "one", "solo"]), F.when(has(RELATION_TERMS) | scene, "centered composition").otherwise("single subject")),
            F.when(~has(["center", "centered"]), "centered"),
            F.when(~has(CLOSEUP_TERMS) & ~scene & ~has(["full", "visible", "body"]), "full object visible"),
            F.when(~has(STYLE_TERMS), "clean anime illustration").when(~has(["clean", "simple"]), "clean illustration"),
            F.when(~has(["background", "scene", "landscape"]), "simple background"),
        )

    return F.when(prompt == "", EMPTY_PROMPT).otherwise(let(search_text(prompt), clauses))


def normalize_prompt(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")), "_-", "  "), SPACE, " ")


def prompt_tokens(text: Column) -> Column:
    return F.regexp_extract_all(normalize_prompt(text), F.lit(TOKEN), F.lit(0))


def render(template: Column, slots: Column) -> Column:
    """Fills ``{name}`` from a map and collapses spaces."""
    filled = F.aggregate(F.map_entries(slots), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
    return F.trim(F.regexp_replace(filled, r"\s+", " "))


def seed_token(seed: Column) -> Column:
    return F.when(seed < 0, F.format_string("neg%06d", F.abs(seed))).otherwise(F.format_string("%06d", seed))


def output_paths(stem: Column, sizes: Sequence[int]) -> Column:
    return F.create_map(*(x for s in sizes for x in (F.lit(str(s)), F.concat(F.lit(f"images_{s}/"), stem, F.lit(".png")))))


def parse_list(text: Column, separator: str = ",") -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def size_list(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(parse_list(text), lambda x: x.try_cast("int")), lambda x: x > 0))
