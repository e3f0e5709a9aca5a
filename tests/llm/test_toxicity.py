"""FTRL against a plain loop, hashed features against a plain list, held-out accuracy, and odd inputs."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessel.llm import _bytes as B
from tessel.llm import queries
from tessel.llm import toxicity as T


def coordinates(text, bits):
    """Coordinates of one text, feature by feature."""
    words = [w for w in re.split(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(B.LOWER[np.frombuffer(text.encode(), np.uint8)])) if w]
    one = lambda w: int(B.hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    mixed = lambda x: int(B.mix(np.array([x % 2**64], np.uint64))[0])
    keys = [one(w) for w in words] + [mixed(one(w[:s]) + s) for w in words for s in T.STEMS if len(w) > s]
    keys += [mixed(one(words[i]) * (2 * gap + 1) + one(words[i + gap])) for gap in (1, 2, 3) for i in range(len(words) - gap)]
    return sorted({k >> (64 - bits) for k in keys})


def test_features_equal_a_plain_list():
    texts = ["", "One", "the STUPID, stupid-thing é1 Überraschung\n\nof of it", " \t", "a b c d e f g", "x" * 5000 + " y"]
    for first, data, offsets in B.chunks(pa.array(texts), 40):
        of, keys = T.features(data, offsets, 30)
        for k in range(len(offsets) - 1):
            assert sorted(set(keys[of == k].tolist())) == coordinates(texts[first + k], 30)


def plain(rows, bits, alpha, beta, l1, l2, passes):
    z, n = [0.0] * 2**bits, [0.0] * 2**bits
    ones = sum(y for _, y in rows)
    start, bz, bn, bias = math.log((ones + 1) / (len(rows) - ones + 1)), 0.0, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(passes):
        for at, y in rows:
            g = 1 / (1 + math.exp(-(start + bias + sum(weight(i) for i in at)))) - y
            for i in at:
                w, more = weight(i), n[i] + g * g
                z[i] += g - (math.sqrt(more) - math.sqrt(n[i])) / alpha * w
                n[i] = more
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * bias
            bn += g * g
            bias = -bz * alpha / (beta + math.sqrt(bn))
    return start + bias, {i: weight(i) for i in range(2**bits) if weight(i)}


def test_fit_equals_a_plain_loop():
    random.seed(5)
    rows = [(np.array(sorted(random.sample(range(64), random.randint(0, 20))), np.int64), float(random.random() < 0.3)) for _ in range(300)]
    for at, y in rows:
        at[: len(at) // 4 * int(y)] //= 8
    rows = [(np.unique(at), y) for at, y in rows]
    got = T.fit(rows, 6, 0.3, 1.0, 0.5, 0.1, 3)
    start, weights = plain(rows, 6, 0.3, 1.0, 0.5, 0.1, 3)
    assert abs(got.start - start) < 1e-9 and got.at.tolist() == sorted(weights) and 0 < len(weights) < 64
    assert np.allclose(got.value, [weights[i] for i in got.at])


def test_scores_count_each_coordinate_once():
    w = T.Weights(-1.0, np.array(coordinates("bad bad thing", 20)), np.arange(1.0, 1 + len(coordinates("bad bad thing", 20))), 20)
    data = np.frombuffer(b"bad bad thing bad bad thingnothing", np.uint8)
    scores = w.scores(data, np.array([0, 13, 27, 34]))
    some = [sum(v for i, v in zip(w.at, w.value) if i in coordinates(t, 20)) for t in ("bad bad thing", " bad bad thing", "nothing")]
    assert np.allclose(scores, [1 / (1 + math.exp(1 - s)) for s in some])


def test_one_label_or_none():
    assert T.fit([]).start == 0
    assert T.fit([(np.array([1]), 0.0)] * 9).start < -2


def test_held_out_toxicity(spark):
    rows = queries.op13_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert len(rows) == 10_000 and (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all() and (rows.predicted == (rows.score >= 0.3)).all()
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert both.predicted[both.toxic == 1].mean() > 0.9 and both.predicted[both.toxic == 0].mean() < 0.01


def test_bound_on_features_and_labels(spark):
    docs = spark.createDataFrame([(i, "good fine words" if i % 2 else "vile nasty words") for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", ((F.col("doc_id") + 1) % 2).cast("int").alias("toxic"))
    for sample, most in ((400, 1 << 25), (100, 1 << 25), (400, 1500)):
        w = T.train(docs, labels, F.lit(True), sample=sample, most=most)
        scores = {r.doc_id: r.score for r in T.score(docs, w).collect()}
        assert scores[0] > 0.5 > scores[1] and len(set(scores.values())) == 2
    assert T.train(docs, labels, F.lit(True), most=0).start == 0


def test_odd_rows(spark, monkeypatch):
    rows = [(1, None, 0), (2, "", 0), (None, "x", 0), (4, "vile thing! " * 90_000, 0), (4, "vile thing! " * 90_000, 0), (5, " \n\n", 0), (6, "kind", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 0), (4, 0, 1), (4, 1, 0), (6, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    for d, known in ((docs, labels), (docs.limit(0), labels), (docs, labels.limit(0))):
        monkeypatch.setattr(queries, "table", lambda _s, _d, name, d=d, known=known: known if name == "labels" else d)
        got = queries.op13_toxicity(spark, "").collect()
        assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)
        assert all(len({r.score for r in got if r.doc_id in ids}) <= 1 for ids in ((1, 2, 5), (4,)))
