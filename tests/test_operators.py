"""Order-dependent selection, hashes and images against plain loops and closed forms."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessel.functions import hashing, text
from tessel.operators import codec, images, mixing, planning, quality, scoring, selection, slots
from tessel.operators.shared import fresh
from tessel.sources import readers


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def xorshift(x):
    x ^= x << 13 & (2**64 - 1)
    x ^= x >> 7
    return x ^ (x << 17 & (2**64 - 1))


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_hashes(spark):
    texts = ["", "a", "red widget", "赤い車", "ü" * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.fnv1a_64(F.col("t")).alias("h"), hashing.xorshift64(hashing.fnv1a_64(F.col("t"))).alias("x"), hashing.unsigned_mod(hashing.fnv1a_64(F.col("t")), 97).alias("m"), hashing.noise(F.lit(7), F.col("t"), 5).alias("n")).collect()
    for r in rows:
        h = fnv(r.t)
        assert (r.h, r.x, r.m) == (signed(h), signed(xorshift(h)), h % 97)
        state, expected = 7 ^ h, []
        for _ in range(5):
            state = xorshift(state)
            expected.append((state & 0xFFFF) / 32767.5 - 1)
        assert np.allclose(r.n, expected, atol=1e-12)


def test_admission_equals_a_loop(spark):
    rng = random.Random(5)
    for _ in range(4):
        cap, target, batch = rng.randint(1, 4), rng.randint(1, 12), rng.randint(1, 6)
        rows = [(i, rng.choice("abc"), rng.choice(["", "", "low"])) for i in range(40)]
        expected, seen, accepted = [], {}, 0
        for start in range(0, len(rows), batch):
            if accepted >= target:
                break
            for i, caption, reason in rows[start : start + batch]:
                reasons = [reason] if reason else []
                if seen.get(caption, 0) >= cap:
                    reasons.append("caption_overflow")
                good = not reasons
                if good and accepted >= target:
                    good, reasons = False, ["target_count_reached"]
                if good:
                    seen[caption] = seen.get(caption, 0) + 1
                    accepted += 1
                expected.append((i, good, ",".join(reasons)))
        df = spark.createDataFrame(rows, "pos long, caption string, reasons string")
        got = selection.admit(df, "pos", "caption", "reasons", cap, target, batch).select("pos", "accepted", "reasons").collect()
        assert sorted(map(tuple, got)) == expected


def test_diverse_pick_equals_a_loop(spark):
    rng = random.Random(6)
    rows = [(i, "k", rng.choice("abcd"), float(rng.randint(0, 5))) for i in range(60)]
    for n in (1, 7, 100):
        groups = {}
        for r in rows:
            groups.setdefault(r[2], []).append(r)
        ordered = sorted((sorted(g, key=lambda r: -r[3]) for g in groups.values()), key=lambda g: -g[0][3])
        picked = []
        while ordered and len(picked) < n:
            for g in ordered:
                if len(picked) < n:
                    picked.append(g.pop(0)[0])
            ordered = [g for g in ordered if g]
        df = spark.createDataFrame(rows, "pos long, key string, grp string, score double")
        assert sorted(r.pos for r in selection.diverse_pick(df, "key", "grp", "score", "pos", n).collect()) == sorted(picked)


def test_image_statistics(spark):
    flat = np.full((20, 30, 3), 50, np.uint8)
    step = np.zeros((32, 32, 3), np.uint8)
    step[8:12, 8:12] = 255
    step[20:26, 20:26] = 255
    rows = [(1, 30, 20, flat.tobytes()), (2, 32, 32, step.tobytes()), (3, 5, 5, b"x"), (4, None, 3, None)]
    df = spark.createDataFrame(rows, "id long, width int, height int, pixels binary")
    a = {r.id: r for r in images.image_stats(df).collect()}
    assert (a[1].low, a[1].high, a[1].std, a[1].border_std, a[1].border_edge_density) == (50, 50, 0.0, 0.0, 0.0) and a[3].low is None and a[4].low is None
    b = {r.id: r for r in images.foreground_stats(df).collect()}
    assert (b[1].components, b[1].ratio) == (0, 1.0) and (b[2].components, b[2].area, b[2].largest) == (2, 52, 36)
    c = {r.id: r for r in images.image_metrics(df).collect()}
    assert abs(c[1].brightness_mean - 50 / 255) < 1e-9 and abs(c[2].light_fraction - 52 / 1024) < 1e-9
    assert {r.id: r.n for r in images.border_stats(df).collect()}[2] == 32 * 32 - 28 * 28
    assert {r.id: r.pixels for r in images.flatten_background(df).collect()}[1] == flat.tobytes()
    assert {r.id: r.pixels for r in images.denoise(df).collect()}[1] == flat.tobytes()


def test_crops_equal_plain_arithmetic(spark):
    rng = random.Random(9)
    boxes = [(i, rng.randint(5, 200), rng.randint(5, 200), *(rng.random() * 1.2 - 0.1 for _ in range(4))) for i in range(300)]
    df = spark.createDataFrame(boxes, "id long, w int, h int, a double, b double, c double, d double")
    got = {r.id: (tuple(r.box), tuple(r.square)) for r in df.select("id", images.bbox(F.col("w"), F.col("h"), F.col("a"), F.col("b"), F.col("c"), F.col("d"), 0.1).alias("box"), images.center_crop(F.col("w"), F.col("h"), 0.6).alias("square")).collect()}
    for i, w, h, a, b, c, d in boxes:
        x, y = (c - a) * 0.1, (d - b) * 0.1
        box = (max(0, int((a - x) * w)), max(0, int((b - y) * h)), min(w, int((c + x) * w)), min(h, int((d + y) * h)))
        side = max(16, min(int(min(w, h) * 0.6), min(w, h)))
        assert got[i] == (box if box[2] - box[0] >= 16 and box[3] - box[1] >= 16 else (0, 0, w, h), ((w - side) // 2, (h - side) // 2, side))


def test_statistics_without_finite_values_are_nan(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1, [nan, inf]), (2, []), (3, None), (4, [1.0, nan, -3.0])], "id long, v array<double>").select("id", quality.tensor_stats(F.col("v")).alias("s")).collect()
    s = {r.id: r.s for r in rows}
    assert all(np.isnan([s[i].min, s[i].max, s[i].mean, s[i].rms]).all() for i in (1, 2)) and s[3].min is None
    assert (s[4].min, s[4].max, s[4].mean, s[4].clipped) == (-3.0, 1.0, -1.0, 1)


def test_what_is_missing_is_an_error(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "k int, y string, at int")
    assert [tuple(r) for r in scoring.paired(left.where("k = 1"), right, ["k"], "at").collect()] == [(1, "a", "new")]
    with pytest.raises(ValueError, match="no partner"):
        scoring.paired(left, right, ["k"], "at")
    wanted = spark.createDataFrame([("b", 0), ("a", 1)], "x string, idx int")
    assert [(r.x, r.idx) for r in planning.focus(left, "x", wanted).orderBy("idx").collect()] == [("b", 0), ("a", 1)]
    with pytest.raises(ValueError, match="missing presets"):
        planning.focus(left.where("k = 1"), "x", wanted)
    with pytest.raises(ValueError, match="empty"):
        readers.quality_suite(left, ["c"], id="x")
    with pytest.raises(ValueError, match="license"):
        readers.image_files(spark, "/tmp", "")
    path = fresh(spark, "presets")
    spark.createDataFrame([("t",)], "title string").selectExpr("array(named_struct('title', title)) AS presets").write.json(path)
    with pytest.raises(PySparkException):
        readers.presets(spark, path).collect()


def test_hot_and_null_keys_are_numbered_as_by_a_loop(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.random() < 0.7, float(rng.randint(0, 9))) for i in range(200)]
    df = spark.createDataFrame(rows, "pos long, key string, accepted boolean, score double").withColumn("reason", F.lit(""))
    best = {}
    for i, key, good, score in sorted(rows, key=lambda r: (-r[3], r[0])):
        if good:
            best.setdefault(key, []).append(i)
    kept = {i for ids in best.values() for i in ids[:5]}
    got = selection.class_top(df, "key", "accepted", "reason", [F.desc("score"), "pos"], 5, "over").collect()
    assert {r.pos for r in got if r.accepted} == kept and {r.pos for r in got if r.reason == "over"} == {i for i, _, good, _ in rows if good} - kept
    seen, ids = {}, {}
    for i, key, *_ in rows:
        seen[key] = seen.get(key, -1) + 1
        ids[i] = key if not seen[key] or key is None else f"{key}_{seen[key]}"
    assert {r.pos: r.id for r in selection.unique_ids(df, "key", ["pos"], "id").collect()} == ids


def test_key_filter_and_vocabulary(spark):
    aliases = slots.alias_table(spark)
    rows = spark.createDataFrame([("red kitten",), ("ICE-CREAM",), ("deer",), ("赤い車",), ("butterflies",), (None,)], "key string")
    assert sorted(r.key for r in slots.key_filter(rows, "key", "cat, アイス,", aliases).collect()) == ["ICE-CREAM", "red kitten"]
    assert all(slots.key_filter(rows, "key", w, aliases).count() == 6 for w in ("*", "all", "", " , ", None))
    found = {r.prompt: (r.subjects, r.colors) for r in slots.slots(rows, aliases, "key").collect()}
    assert found == {"red kitten": (["cat"], ["red"]), "ICE-CREAM": (["icecream"], []), "deer": (["deer"], []), "赤い車": (["car"], ["red"]), "butterflies": (["butterfly"], [])}
    assert len(slots.SUBJECTS) == 73 and sum(len(w) + 1 for w in slots.SUBJECTS.values()) == 296
    one = aliases.select("key", "alias")
    assert {r.state for r in slots.vocabulary_parity(one, one).collect()} == {"same"}
    assert {(r.key, r.state) for r in slots.vocabulary_parity(one.where("alias <> 'pony'"), one.where("key <> 'deer'")).where("state <> 'same'").collect()} == {("horse", "differs"), ("deer", "missing_b")}


def test_steps_shorten_as_the_expression_does(spark):
    rows = ["A photo of a red cat sitting and with x", "there are two dogs", "a cat and with dogs", "cat cat cat", "the dog is running", "one sam ", "", "a b c 123", "big red fox eating walking is are was were", None, "x" * 50, "green bird  near   a tree"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    for args in ((1, 6, False), (2, 20, True), (1, 2, False)):
        one = {r.i: r.s for r in df.select("i", text.shorten_caption(F.col("raw"), *args).alias("s")).where("s IS NOT NULL").collect()}
        assert one == {r.i: r.s for r in text.shortened(df, "raw", "s", *args).collect()}
    assert {r.i: r.s for r in text.shortened(df, "raw", "s").collect()}[2] == "cat and"  # markers cut in their order


def test_token_counts_equal_a_library(spark):
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path).model
    rows = [(1, "the other thing 12"), (2, None), (3, "station " * 60), (4, "ünïcode, the! 赤い車"), (5, "x" * 30_000), (6, "Q7&&  --don't 1/2")]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id > 100").limit(40).collect()]
    got = {r.i: (r.tokens, r.clipped) for r in codec.token_counts(spark.createDataFrame(rows, "i long, t string"), "i", "t", path).collect()}
    for i, t in rows:
        words = regex.findall(codec.WORD, (t or "").lower())
        n = 2 + sum(len(library.tokenize("".join(codec.byte_letters()[b] for b in w.encode()))) for w in words)
        assert got[i] == (n, min(n, 77))
    merges = codec.read_merges(path)
    assert codec.merged(codec.symbols("stations"), merges) == [x.value for x in library.tokenize("stations")]


def test_foreground_equals_a_flood(spark):
    rng = np.random.default_rng(3)
    pictures = [(i, 12, 12, (rng.random((12, 12, 1)) < 0.35).repeat(3, axis=2).astype(np.uint8) * 200) for i in range(20)]
    df = spark.createDataFrame([(i, w, h, a.tobytes()) for i, w, h, a in pictures], "id long, width int, height int, pixels binary")
    got = {r.id: r for r in images.foreground_stats(df, least=2).collect()}
    for i, _, _, a in pictures:
        edge = np.concatenate([a[0], a[-1], a[:, 0], a[:, -1]])
        mask = np.abs(a[:, :, 0] - float(np.median(edge[:, 0]))) > 36 / np.sqrt(3)
        left, sizes = {tuple(p) for p in np.argwhere(mask)}, []
        while left:
            todo, n = [left.pop()], 0
            while todo:
                y, x = todo.pop()
                n += 1
                near = {(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)} & left
                left -= near
                todo += near
            sizes += [n] * (n >= 2)
        assert (got[i].components, got[i].area, got[i].largest) == (len(sizes), sum(sizes), max(sizes, default=0))


def test_blurs_keep_what_they_should(spark):
    a = np.full((24, 24, 3), 60, np.uint8)
    a[6:18, 6:18] = (200, 40, 40)
    noisy = a.copy()
    noisy[2, 2] = 70
    df = spark.createDataFrame([(1, 24, 24, noisy.tobytes())], "id long, width int, height int, pixels binary")
    image = lambda x: np.frombuffer(x.first().pixels, np.uint8).reshape(24, 24, 3).astype(int)
    flat, smooth = image(images.flatten_background(df, sigma=0.5)), image(images.denoise(df))
    assert (flat[:4, :4] == 60).all() and (np.abs(flat[8:16, 8:16] - a[8:16, 8:16]) <= 1).all()  # noise goes, the object stays
    assert abs(smooth[2, 2, 0] - 60) < 6 and (smooth[10:14, 10:14] == a[10:14, 10:14]).all()


def test_samples_keep_to_their_quotas(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, key string")
    got = mixing.ratio_mix(df, "key", "id", {"a": 0.5, "b": 0.25}, 100, seed=3).groupBy("key").count().collect()
    assert {r.key: r["count"] for r in got} == {"a": 50, "b": 25}
    assert mixing.sample(df, "id", "key", 3, 20, 30).count() == 30


def test_rolling_means_go_on_over_chunks(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice("aaab"), float(rng.randint(0, 99))) for i in range(120)]
    got = {r.id: r["mean"] for r in selection.rolling_mean(spark.createDataFrame(rows, "id long, key string, value double"), ["key"], ["id"], "value", 5, chunk=7).collect()}
    seen = {}
    for i, key, value in rows:
        seen.setdefault(key, []).append(value)
        last = seen[key][-5:]
        assert abs(got[i] - sum(last) / len(last)) < 1e-9


def latent(prompt, seed, count, version):
    """Features and noise of a prompt with a plain loop, over the library's own slots for single prompts."""
    import re

    token = lambda t: re.findall(r"[a-z0-9]+|[\u3040-\u30ff\u3400-\u9fff]+", re.sub(r"\s+", " ", t.strip().lower().replace("_", " ").replace("-", " ")))

    def fits(tokens, alias):
        compact = re.sub(r"[\s_-]+", "", alias.lower())
        return bool(token(alias)) and set(token(alias)) <= set(tokens) or not alias.isascii() and compact in "".join(tokens)

    vocabulary = {s: a for s, a in slots.VOCABULARY.items() if s != "view" or version >= 2}
    tokens = token(prompt)
    found = {s: [k for k, more in a.items() if any(fits(tokens, x) for x in (k, *more))] for s, a in vocabulary.items()}
    found.setdefault("view", [])
    unknown = [] if any(found.values()) else [t for t in tokens if t not in slots.STOPWORDS]
    about = "astronaut horse" if {"astronaut", "horse"} <= set(found["subject"]) else (found["subject"] or [" ".join(tokens)])[0]
    views = [w for v in found["view"] for w in ([v] if v == "closeup" else [v, "view"])]
    row = found["style"] + found["color"] + found["modifier"] + found["subject"] + found["action"] + views + unknown or tokens
    known = {t for a in vocabulary.values() for k, more in a.items() for x in (k, *more) if fits(token(" ".join(row)), x) for t in token(x)}
    m, n = (4, 3) if version >= 2 else (2, 2)
    parts = [(f"subject:{k}", 0.95 if version >= 2 else 0.75, m) for k in found["subject"]] or [(f"subject:{about}", 0.45, n)]
    for slot, weight in (("color", 0.6), ("action", 0.65), ("view", 0.6), ("modifier", 0.42), ("style", 0.38)):
        parts += [(f"{slot}:{k}", weight, n) for k in found[slot]]
    plain = [t for t in row if t not in slots.STOPWORDS and t not in known and (t.isascii() or not any(not p.isascii() and p in t for p in known))]
    parts += [(f"token:{t}", 0.18, 2) for t in plain[:8]] + [(f"bigram:{a}_{b}", 0.12, 2) for a, b in zip(row, row[1:]) if not {a, b} & set(slots.STOPWORDS)] + [(f"full:{' '.join(row)}", 0.1, 2)]
    state, values = seed ^ fnv(f"seed:{about}"), []
    for _ in range(count):
        state = xorshift(state)
        values.append(((state & 0xFFFF) / 32767.5 - 1) * (0.22 if version >= 2 else 0.35))
    for name, weight, rounds in parts:
        state = fnv(name)
        for _ in range(rounds):
            state = xorshift(state)
            at = state % count
            state = xorshift(state)
            values[at] += weight if state & 1 else -weight
    return np.clip(values, -1, 1)


@pytest.mark.parametrize("version", [1, 2])
def test_latents_equal_a_loop(spark, version):
    prompts = ["red cat sitting close-up", "astronaut riding a horse in the snow", "猫の写真", "赤い車 front view", "strange unnamed gadget of nine curious parts and more beyond that", "watercolor of a kitten with butterflies"]
    rows = slots.compositional_latents(spark.createDataFrame([(p,) for p in prompts], "prompt string"), slots.alias_table(spark), 7, 48, version).collect()
    got = {}
    for r in rows:
        got.setdefault(r.prompt, {})[r["index"]] = r.value
    for p in prompts:
        assert np.allclose([got[p][i] for i in range(48)], latent(p, 7, 48, version), atol=1e-9), p


def plain_ground(a):
    """Background of one image, pixel by pixel."""
    h, w = len(a), len(a[0])
    p, m = max(2, min(12, min(h, w) // 8)), max(2, min(8, min(h, w) // 16))
    mean = lambda rows: [sum(c) / len(rows) for c in zip(*rows)]
    apart = lambda x, y: math.sqrt(sum((i - j) ** 2 for i, j in zip(x, y)) / 3)
    corners = []
    for y0 in (0, h - p):
        for x0 in (0, w - p):
            rows = [a[y0 + i][x0 + j] for i in range(p) for j in range(p)]
            mid = mean(rows)
            corners.append((mid, sum(apart(r, mid) ** 2 for r in rows) / len(rows)))
    pairs = [(apart(s[0], t[0]) + 0.15 * math.sqrt(s[1] + t[1]), i, j) for i, s in enumerate(corners) for j, t in enumerate(corners) if i < j]
    _, i, j = min(pairs)
    first = mean([corners[i][0], corners[j][0]])
    edge = [a[y][x] for y in range(h) for x in range(w) if y < m or x < m or y >= h - m or x >= w - m]
    far = [apart(r, first) for r in edge]
    mid = sum(far) / len(far)
    most = max(14, mid + 0.85 * math.sqrt(sum((d - mid) ** 2 for d in far) / len(far)))
    kept = [r for r, d in zip(edge, far) if d <= most]
    return first if len(kept) < max(8, 0.12 * len(edge)) else mean(kept)


def plain_denoised(a):
    """One image, pixel by pixel, unrounded."""
    h, w = len(a), len(a[0])
    if min(h, w) < 3:
        return a
    gray = lambda r: 0.299 * r[0] + 0.587 * r[1] + 0.114 * r[2]
    at = lambda v, y, x: v[min(h - 1, max(0, y))][min(w - 1, max(0, x))]
    around = lambda v, y, x, r: [at(v, y + i, x + j) for i in range(-r, r + 1) for j in range(-r, r + 1)]
    mean = lambda v: sum(v) / len(v)

    def step(low, high, v):
        t = max(0, min(1, (v - low) / (high - low)))
        return t * t * (3 - 2 * t)

    ground = plain_ground(a)
    g = gray(ground)
    luma = [[gray(r) for r in row] for row in a]
    chroma = {k: [[r[k] - gray(r) for r in row] for row in a] for k in (0, 2)}
    differs = [[step(18, 56, 0.68 * abs(luma[y][x] - g) + 0.62 * sum(abs(chroma[k][y][x] - (ground[k] - g)) for k in (0, 2)) / 2) for x in range(w)] for y in range(h)]
    out = []
    for y in range(h):
        for x in range(w):
            near = around(differs, y, x, 1)
            beside = max(mean(near), 0.72 * max(near))
            slope = sum(abs(luma[y][x] - at(luma, y + i, x + j)) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0)))
            edge = min(1, slope / 128)
            thing = min(1, max(differs[y][x], beside, step(34, 120, slope) * min(1, beside + 0.18)))
            clean, calm = ((1 - thing) * (1 - 0.55 * edge)) ** 2, thing * (1 - edge)
            light = luma[y][x] + (mean(around(luma, y, x, 1)) - luma[y][x]) * (0.04 * calm + 0.64 * clean)
            light += (g - light) * 0.3 * clean
            made = {}
            for k in (0, 2):
                c = chroma[k][y][x] + (mean(around(chroma[k], y, x, 2)) - chroma[k][y][x]) * (0.08 * calm + 0.84 * clean)
                made[k] = light + c + (ground[k] - g - c) * 0.52 * clean
            out.append((made[0], (light - 0.299 * made[0] - 0.114 * made[2]) / 0.587, made[2]))
    return [out[y * w : y * w + w] for y in range(h)]


def test_denoise_and_flatten_equal_loops(spark):
    rng = np.random.default_rng(8)
    shapes = [(8, 8), (8, 8), (3, 3), (2, 9), (1, 1), (5, 20), (40, 33)]
    pictures = [rng.integers(0, 256, (*s, 3)).astype(np.uint8) for s in shapes] + [np.full((9, 9, 3), 77, np.uint8)]
    for noise in (4, 30):  # an object on a noisy ground
        a = np.full((24, 30, 3), (90, 120, 60)) + rng.integers(-noise, noise + 1, (24, 30, 3))
        a[8:16, 9:20] = (220, 30, 40)
        pictures.append(a.astype(np.uint8))
    rows = [(i, a.shape[1], a.shape[0], a.tobytes()) for i, a in enumerate(pictures)] + [(90, 5, 5, b"x"), (91, None, 3, None), (92, 0, 0, b"")]
    df = spark.createDataFrame(rows, "id long, width int, height int, pixels binary")
    smooth, flat = ({r.id: r.pixels for r in f(df).collect()} for f in (images.denoise, images.flatten_background))
    assert len(smooth) == len(flat) == len(rows) and all(x[i] is None for x in (smooth, flat) for i in (90, 91, 92))
    for i, a in enumerate(pictures):
        h, w = a.shape[:2]
        want = np.clip(np.array(plain_denoised(a.astype(float).tolist())), 0, 255)
        assert np.abs(np.frombuffer(smooth[i], np.uint8).reshape(h, w, 3) - want).max() <= 0.5 + 1e-6
        m = max(2, int(min(h, w) * 0.12))
        edge = [a[y, x] for s in range(4) for y in range(h) for x in range(w) if (y < m, y >= h - m, x < m, x >= w - m)[s]]
        color = np.median(np.array(edge), axis=0)
        mask = np.rint(255 * np.clip((np.sqrt(((a - color) ** 2).sum(axis=2)) - images.THRESHOLD) / images.THRESHOLD, 0, 1))
        k = np.exp(-(np.arange(-8, 9) ** 2) / 8)
        kernel = np.outer(k, k) / k.sum() ** 2
        wide = np.pad(mask, 8, mode="edge")
        blurred = np.array([[(wide[y : y + 17, x : x + 17] * kernel).sum() for x in range(w)] for y in range(h)])
        want = (a * np.rint(blurred)[..., None] + np.rint(color) * (255 - np.rint(blurred)[..., None])) / 255
        assert np.abs(np.frombuffer(flat[i], np.uint8).reshape(h, w, 3) - want).max() <= 1.5


def test_stacks_stay_small(spark):
    """Many small images come a few at a time, so that a worker's memory doesn't grow with the batch."""
    df = spark.range(3000, numPartitions=1).select("id", F.lit(16).alias("width"), F.lit(16).alias("height"), F.lit(bytes(768)).alias("pixels"))
    sizes = [r.pixels[0] for r in images.each_stack(df, lambda x: np.full(x.shape, len(x))).collect()]
    assert len(sizes) == 3000 and 8 <= max(sizes) <= 128


def test_token_counts_shuffle_no_words(spark, monkeypatch, capsys):
    """Rows that share an id, null ids, few words at a time and none remembered; what is shuffled holds no words."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["", None, "one two, two", "Stationary stations 12", " \n ", "x" * 300, "the the the"] * 3
    rows = [(i % 8 if i != 5 else None, t) for i, t in enumerate(texts)]
    merges = codec.read_merges(path)
    size = lambda t: sum(len(codec.merged(codec.symbols(w), merges)) for w in re.findall(r"[a-z]+|\d+|,", (t or "").lower()))
    want = sorted((str(i), 2 + sum(size(t) for j, t in rows if j == i and i is not None)) for i, _ in rows)
    df = spark.createDataFrame(rows, "i long, t string")
    for together in (1 << 17, 2):
        monkeypatch.setattr(codec, "TOGETHER", together)
        assert sorted((str(r.i), r.tokens) for r in codec.token_counts(df, "i", "t", path).collect()) == want
    assert codec.token_counts(df.limit(0), "i", "t", path).count() == 0
    capsys.readouterr()
    codec.token_counts(df, "i", "t", path).explain()
    assert "Generate" not in (plan := capsys.readouterr().out) and "MapInArrow" in plan
    monkeypatch.setattr(codec, "WORDS", 3)
    known = {}
    for some in (["one", "two"], ["one", "x" * 300, "one"], ["station", "two"]):
        assert codec.word_sizes(pa.array(some), merges, known).tolist() == list(map(size, some)) and len(known) <= 3 and max(map(len, known)) < 300
