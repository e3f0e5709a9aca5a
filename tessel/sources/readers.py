"""Readers of metadata, suites, shards and files, with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.text import first_present, present, shorten_caption
from tessel.operators.ordering import global_number

#: The metadata of a generated image.
METADATA = (
    "id string, accepted boolean, reject_reason string, key string, title string, subject string, prompt string, conditioning_prompt string, "
    "teacher_prompt string, negative_prompt string, variant string, variant_index int, seed bigint, model_family string, scheduler string, steps int, "
    "guidance_scale double, source_width int, source_height int, target_sizes array<int>, image string, saved_images map<string,string>, "
    "source_image string, prompt_set_version string, qc_flags array<string>, elapsed_seconds double, job_index int"
)
#: Suffixes of image files, in the order in which folders are read.
IMAGE_SUFFIXES = ["png", "jpg", "jpeg", "webp", "bmp"]


def read_metadata(spark: SparkSession, path: str, schema: str = METADATA) -> DataFrame:
    """JSON lines; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def parse_tolerant(lines: DataFrame, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and the others with their text; blank lines are neither."""
    parsed = lines.where(F.trim(text) != "").withColumn("_p", F.from_json(text, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where("_p._bad IS NULL")
    fields = [f.name for f in parsed.schema["_p"].dataType.fields if f.name != "_bad"]
    rest = [c for c in lines.columns if c != text]
    return good.select(*rest, *(F.col(f"_p.`{f}`").alias(f) for f in fields)), parsed.where("_p._bad IS NOT NULL").select(*rest, F.col(text).alias("line"))


STEM = r"([^/]*)\.[^./]*$"


def image_files(spark: SparkSession, root: str, license: str, content: bool = False) -> DataFrame:
    """path, length, stem, license and position of image files below a folder; the bytes only if asked for.

    Files are ordered by suffix, then by path. A folder of images needs a license.
    """
    if not license:
        raise ValueError("a folder of images needs a license")
    suffix = F.regexp_extract("path", r"\.([^./]*)$", 1)
    rank = F.array_position(F.array(*map(F.lit, IMAGE_SUFFIXES)), suffix)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.select("path", "length", F.regexp_extract("path", STEM, 1).alias("stem"), F.lit(license).alias("license"), rank.alias("_rank"), *(["content"] if content else [])).where("_rank > 0")
    return global_number(named, ["_rank", "path"], "position").withColumn("position", F.col("position") - 1).drop("_rank")


def sidecar_captions(spark: SparkSession, root: str, license: str, least: int = 1, most: int = 6, preserve: bool = False) -> DataFrame:
    """path, stem, raw_caption and caption of images: the first source that survives shortening.

    Sources are the first lines of the files .caption and .txt beside an image, the fields caption, prompt and title of its
    .json, and its name. Images without any caption are left out.
    """
    images = image_files(spark, root, license).withColumn("_base", F.regexp_replace("path", r"\.[^./]*$", ""))
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("path").rlike(r"\.(caption|txt|json)$"))
    kind = F.regexp_extract("path", r"\.([^./]*)$", 1)
    body = F.decode("content", "UTF-8")
    of = lambda name: F.max(F.when(kind == name, body))
    sides = texts.groupBy(F.regexp_replace("path", r"\.[^./]*$", "").alias("_base")).agg(of("caption").alias("_caption"), of("txt").alias("_txt"), of("json").alias("_json"))
    first = lambda c: F.split(c, r"\r\n|\n|\r")[0]
    sources = F.array(first("_caption"), first("_txt"), *(F.get_json_object("_json", f"$.{f}") for f in ("caption", "prompt", "title")), F.col("stem"))
    both = images.join(sides, "_base", "left").withColumn("_all", F.transform(sources, lambda raw: F.struct(raw.alias("raw"), present(shorten_caption(raw, least, most, preserve)).alias("short"))))
    return both.withColumn("_one", F.get(F.filter("_all", lambda x: x["short"].isNotNull()), 0)).where("_one IS NOT NULL").select("path", "stem", F.col("_one.raw").alias("raw_caption"), F.col("_one.short").alias("caption"))


def source_ids(df: DataFrame, ids: Sequence[str], dataset: str, split: str, index: str) -> Column:
    """The first id that a row has, or dataset-split-index."""
    return first_present(*(F.col(c).cast("string") for c in ids if c in df.columns), F.concat_ws("-", F.lit(dataset), F.lit(split), F.col(index).cast("string")))


def row_window(df: DataFrame, order: Sequence[str], skip: int = 0, most: int | None = None) -> DataFrame:
    """The rows after the first ``skip``, ``most`` of them, in a total order."""
    out = df.orderBy(*order).offset(skip) if skip else df.orderBy(*order)
    return out.limit(most) if most is not None else out


def shuffled(df: DataFrame, row: str, seed: int) -> DataFrame:
    """All rows in an order by hash of seed and id: the same at every run, unlike a bounded buffer's."""
    return global_number(df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row).cast("string")))), ["_h", row], "position").drop("_h")


def prompt_specs(spark: SparkSession, path: str) -> DataFrame:
    """key, role, prompt: targets and negatives of a JSON file; one without prompts has its own prompt."""
    schema = "targets array<struct<key:string,prompt:string,prompts:array<string>>>, negatives array<struct<key:string,prompt:string,prompts:array<string>>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    one = lambda c, role: raw.select(F.explode(c).alias("x")).select("x.key", F.lit(role).alias("role"), F.explode(F.coalesce("x.prompts", F.array("x.prompt"))).alias("prompt"))
    return one("targets", "target").unionByName(one("negatives", "negative"))


def suite_rows(groups: DataFrame, prompts: str, per_group: int) -> DataFrame:
    """(other columns, index, prompt) of each group's first prompts."""
    rest = [c for c in groups.columns if c != prompts]
    return groups.select(*rest, F.posexplode(F.slice(prompts, 1, per_group)).alias("index", "prompt"))


def quality_suite(prompts: DataFrame, ids: Sequence | None = None, genres: Sequence | None = None, id: str = "id", genre: str = "genre") -> DataFrame:
    """The prompts of the ids and genres asked for; an empty selection is an error."""
    for column, wanted in ((id, ids), (genre, genres)):
        if wanted:
            prompts = prompts.where(F.col(column).isin(list(wanted)))
    if prompts.isEmpty():
        raise ValueError("the selection of prompts is empty")
    return prompts


VARIANT = "variant:string,conditioning_prompt:string,prompt:string,slot_source:map<string,string>,slot_values:map<string,array<string>>,slot_strategy:string,max_expansions:int,qc_flags:array<string>"
#: Slots that a preset lists itself; the lists are named slot_v2.
PRESET_SLOTS = ["colors", "actions", "views", "styles", "modifiers"]
PRESET = "key:string,title:string,subject:string,guard:string,qc_flags:array<string>," + "".join(f"{s}_v2:array<string>," for s in PRESET_SLOTS) + f"variants:array<struct<{VARIANT}>>"


def presets(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """form (legacy: a list; plan: an object), pos, key, title, subject, guard, qc_flags, slots, variants and defaults.

    Title and subject default to the key. ``slots`` maps a slot to the preset's own list. Variants are the preset's own,
    else the plan's, else one that names the key and asks for the subject; unnamed ones are v00, v01, ... by place.
    ``limit`` takes the first presets. A preset without a key fails the read.
    """
    flat = ", ".join(x.replace(":", " ", 1) for x in PRESET.split(",", 5)[:5])
    raw = spark.read.schema(f"{flat}, presets array<struct<{PRESET}>>, variants array<struct<{VARIANT}>>, defaults map<string,array<string>>").option("multiLine", "true").json(path)
    one = F.struct(*(F.col(c) for c in ("key", "title", "subject", "guard", "qc_flags")), *(F.lit(None).cast("array<string>").alias(f"{s}_v2") for s in PRESET_SLOTS), F.lit(None).cast(f"array<struct<{VARIANT}>>").alias("variants"))
    legacy = raw.where("presets IS NULL").select(F.lit("legacy").alias("form"), F.monotonically_increasing_id().alias("pos"), one.alias("p"), F.lit(None).cast(f"array<struct<{VARIANT}>>").alias("common"), F.lit(None).cast("map<string,array<string>>").alias("defaults"))
    plan = raw.where("presets IS NOT NULL").select(F.lit("plan").alias("form"), F.posexplode("presets").alias("pos", "p"), F.col("variants").alias("common"), "defaults")
    rows = legacy.unionByName(plan.withColumn("pos", F.col("pos").cast("long")))
    rows = rows.where(F.col("pos") < limit) if limit else rows
    key = F.when(F.col("p.key").isNull(), F.raise_error(F.lit("a preset has no key"))).otherwise(F.col("p.key"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    single = F.array(F.struct(F.lit("v00").alias("variant"), F.lit("{key}").alias("conditioning_prompt"), F.lit("{subject}").alias("prompt"), *(F.lit(None).cast(k).alias(n) for n, k in (("slot_source", "map<string,string>"), ("slot_values", "map<string,array<string>>"), ("slot_strategy", "string"), ("max_expansions", "int"), ("qc_flags", "array<string>")))))
    chosen = F.coalesce(some("p.variants"), some("common"), single)
    named = F.transform(chosen, lambda v, i: F.struct(
        F.coalesce(present(v["variant"]), F.format_string("v%02d", i)).alias("variant"), F.coalesce(present(v["conditioning_prompt"]), F.lit("{key}")).alias("conditioning_prompt"), F.coalesce(present(v["prompt"]), F.lit("{subject}")).alias("prompt"),
        *(v[n].alias(n) for n in ("slot_source", "slot_values", "slot_strategy", "max_expansions", "qc_flags")),
    ))
    slots = F.map_filter(F.create_map(*(x for s in PRESET_SLOTS for x in (F.lit(s), F.col(f"p.{s}_v2")))), lambda _, v: v.isNotNull())
    return rows.select("form", "pos", key.alias("key"), F.coalesce(present("p.title"), "p.key").alias("title"), F.coalesce(present("p.subject"), "p.key").alias("subject"), "p.guard", "p.qc_flags", slots.alias("slots"), named.alias("variants"), "defaults")


def preset_variants(presets: DataFrame) -> DataFrame:
    """One row for each variant of each preset: key, title, subject, variant_index, the variant's fields, slots, defaults."""
    return presets.select("form", "key", "title", "subject", "guard", "slots", "defaults", F.posexplode("variants").alias("variant_index", "v")).select("form", "key", "title", "subject", "guard", "slots", "defaults", "variant_index", "v.*")


def read_shards(spark: SparkSession, root: str, schema: str = METADATA) -> DataFrame:
    """All shard_*/metadata.jsonl below a folder, with the shard's name."""
    rows = spark.read.schema(schema).json(f"{root.rstrip('/')}/shard_*/metadata.jsonl")
    return rows.withColumn("shard", F.regexp_extract(F.col("_metadata.file_path"), "(shard_[^/]+)/", 1))


def file_inventory(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """bundle and size: the files below each folder whose name ends in ``suffix``, summed; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    bundle = F.regexp_extract("path", rf"^(.*?{suffix.replace('.', '[.]')})(/|$)", 1)
    return files.withColumn("bundle", bundle).where("bundle <> ''").groupBy("bundle").agg(F.sum("length").alias("size_bytes"), F.count("*").alias("files"))


def checksums(lines: DataFrame, text: str = "value") -> DataFrame:
    """digest and name of lines like ``digest  name``."""
    return lines.where(F.trim(text) != "").select(F.regexp_extract(text, r"^\s*(\S+)", 1).alias("digest"), F.trim(F.regexp_extract(text, r"^\s*\S+\s+(.*)$", 1)).alias("name"))
