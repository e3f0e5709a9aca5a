"""Trees: held-out accuracy, traversal node by node, and odd inputs."""

import zlib

import numpy as np

from tessel.llm import classifier as C
from tessel.llm import queries


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = C.fit(x[:3000], y[:3000])
    assert (((trees.scores(x[3000:]) > 0.5) == y[3000:]).mean()) > 0.95
    for row, got in zip(x[:50], trees.scores(x[:50])):
        total = trees.start
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12


def test_no_rows_or_one_label():
    assert C.fit(np.zeros((0, 3)), np.zeros(0)).scores(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (C.fit(np.zeros((9, 3)), np.ones(9)).scores(np.zeros((1, 3))) > 0.8).all()
    assert C.fit(np.zeros((9, 3)), np.array([0.0, 1] * 4 + [1])).scores(np.zeros((1, 3))).shape == (1,)


def test_held_out_quality(spark):
    rows = queries.op10_classifier(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all() and (rows.predicted == (rows.score >= 0.7)).all()
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert ((both.predicted == both.quality).mean()) > 0.97


def test_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x", 0), (4, "MIT! | #" * 50_000, 0), (4, "MIT! | #" * 50_000, 0), (5, " \n\n", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (4, 0, 1), (4, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    for d in (docs, docs.limit(0)):
        monkeypatch.setattr(queries, "table", lambda _s, _d, name, d=d: labels if name == "labels" else d)
        got = queries.op10_classifier(spark, "").collect()
        assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)
