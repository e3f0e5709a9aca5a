"""Queries on images, token counts and boxes. Images are made of the embeddings' numbers."""

from pyspark.sql import functions as F

from tessel.operators import codec, images
from tessel.plans._registry import query, table

GRAYS = "g AS (SELECT vec_id AS id, list_transform(embedding[1:64], lambda x: greatest(0, least(255, round_even(128 + 400 * x::DOUBLE, 0)))) AS v FROM embeddings WHERE len(embedding) >= 64)"


def pictures(spark, sf_dir):
    return images.from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


@query(f"""WITH {GRAYS}, b AS (SELECT *, list_concat(range(8), range(56, 64), range(0, 64, 8), range(7, 64, 8)) AS ring, list_concat(list_transform(range(7), lambda i: abs(v[i + 2] - v[i + 1])), list_transform(range(56, 63), lambda i: abs(v[i + 2] - v[i + 1])),
list_transform(range(0, 56, 8), lambda i: abs(v[i + 9] - v[i + 1])), list_transform(range(7, 63, 8), lambda i: abs(v[i + 9] - v[i + 1]))) AS jumps FROM g)
SELECT id, list_min(v)::INTEGER AS low, list_max(v)::INTEGER AS high, list_avg(v) AS mean, list_stddev_pop(v) AS std, 1 AS border_margin, list_stddev_pop(list_transform(ring, lambda i: v[i + 1])) AS border_std, list_avg(jumps) AS border_edge_mean, len(list_filter(jumps, lambda x: x > 16)) / 28 AS border_edge_density FROM b""")
def i01_image_stats(spark, sf_dir):
    return images.image_stats(pictures(spark, sf_dir))


@query()
def i02_foreground_stats(spark, sf_dir):
    return images.foreground_stats(pictures(spark, sf_dir), least=2)


@query(f"""WITH {GRAYS}, e AS (SELECT *, list_filter(range(63), lambda i: i % 8 < 7) AS r FROM g)
SELECT id, list_avg(list_transform(v, lambda x: x / 255)) AS brightness_mean, list_stddev_pop(list_transform(v, lambda x: x / 255)) AS contrast_std, 0.0::DOUBLE AS saturation_mean,
(list_avg(list_transform(r, lambda i: abs(v[i + 2] - v[i + 1]) / 255)) + list_avg(list_transform(range(56), lambda i: abs(v[i + 9] - v[i + 1]) / 255))) / 2 AS edge_energy, len(list_filter(v, lambda x: x / 255 < 0.08)) / 64 AS dark_fraction, len(list_filter(v, lambda x: x / 255 > 0.92)) / 64 AS light_fraction FROM e""")
def i03_image_metrics(spark, sf_dir):
    return images.image_metrics(pictures(spark, sf_dir))


@query(f"""WITH {GRAYS}, b AS (SELECT id, v, list_filter(range(64), lambda i: i % 8 < 2 OR i % 8 > 5 OR i // 8 < 2 OR i // 8 > 5) AS ring FROM g),
j AS (SELECT *, list_concat(list_transform(list_filter(ring, lambda i: i % 8 < 7), lambda i: abs(v[i + 2] - v[i + 1])), list_transform(list_filter(ring, lambda i: i < 56), lambda i: abs(v[i + 9] - v[i + 1]))) AS jumps FROM b)
SELECT id, 2 AS border, len(ring) AS n, list_avg(list_transform(ring, lambda i: v[i + 1])) AS mean, list_stddev_pop(list_transform(ring, lambda i: v[i + 1])) AS std, len(list_filter(jumps, lambda x: x >= 16)) / len(jumps) AS edges FROM j""")
def i04_border_stats(spark, sf_dir):
    return images.border_stats(pictures(spark, sf_dir))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount * 100)::INTEGER * 4 AS x, round(l_tax * 100)::INTEGER * 4 AS y, l_quantity::INTEGER AS w, l_linenumber * 8 AS h FROM lineitem),
c AS (SELECT *, greatest(0, trunc(x - w / 8.0))::INTEGER AS l, greatest(0, trunc(y - h / 8.0))::INTEGER AS t, least(128, trunc(x + w + w / 8.0))::INTEGER AS r, least(128, trunc(y + h + h / 8.0))::INTEGER AS d FROM b), s AS (SELECT *, r - l < 16 OR d - t < 16 AS small FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN small THEN 0 ELSE l END AS "left", CASE WHEN small THEN 0 ELSE t END AS top, CASE WHEN small THEN 128 ELSE r END AS "right", CASE WHEN small THEN 128 ELSE d END AS bottom FROM s""")
def i05_bbox_crop(spark, sf_dir):
    px = lambda c: c / F.lit(128.0)
    b = table(spark, sf_dir, "lineitem").withColumns({"x": F.round(F.col("l_discount") * 100).cast("int") * 4, "y": F.round(F.col("l_tax") * 100).cast("int") * 4, "w": F.col("l_quantity").cast("int"), "h": F.col("l_linenumber") * 8})
    size = F.lit(128)
    box = images.bbox(size, size, px(b.x), px(b.y), px(b.x + b.w), px(b.y + b.h), 0.125)
    return b.select("l_orderkey", "l_linenumber", "l_partkey", box.alias("box")).select("l_orderkey", "l_linenumber", "l_partkey", "box.*")


@query("""WITH p AS (SELECT p_partkey, p_size + 7 AS w, p_size * 2 + 4 AS h FROM part), s AS (SELECT *, greatest(16, least(least(w, h), (least(w, h) * 3) // 4)) AS side FROM p)
SELECT p_partkey, floor((w - side) / 2)::INTEGER AS "left", floor((h - side) / 2)::INTEGER AS top, side FROM s""")
def i06_center_crop(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 7).alias("w"), (F.col("p_size") * 2 + 4).alias("h"))
    return p.select("p_partkey", images.center_crop(F.col("w"), F.col("h"), 0.75).alias("x")).select("p_partkey", "x.*")


@query()
def i07_flatten_background(spark, sf_dir):
    return images.flatten_background(pictures(spark, sf_dir)).select("id", F.md5("pixels").alias("digest"))


@query()
def i08_denoise(spark, sf_dir):
    return images.denoise(pictures(spark, sf_dir)).select("id", F.md5("pixels").alias("digest"))


@query(f"""WITH {GRAYS} SELECT id::VARCHAR AS path, 8 AS width, 8 AS height, md5(array_to_string(list_transform(v, lambda x: repeat(printf('%02X', x::INTEGER), 3)), '')) AS digest FROM g""")
def s15_decode_ppm(spark, sf_dir):
    """Each picture written as P6, and read again."""
    files = pictures(spark, sf_dir).select(F.col("id").cast("string").alias("path"), F.concat(F.encode(F.format_string("P6\n%d %d\n255\n", "width", "height"), "UTF-8"), "pixels").alias("content"))
    return images.decode_ppm(files).select("path", "width", "height", F.md5(F.hex("pixels")).alias("digest"))


@query()
def t23_token_count(spark, sf_dir):
    import public_tokenizers

    return codec.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
