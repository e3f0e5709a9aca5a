"""Nearest neighbours against all products."""

import numpy as np

from tessel.llm import ann, queries


def exact(rows, k):
    """For (id, vector) rows: each query's nearest, with ids divisible by 20 as queries."""
    kept = {(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids, x = np.array([i for i, _ in kept]), np.array([v for _, v in kept], dtype=float)
    found = {}
    for i, v in kept:
        if i % 20 == 0:
            s = x @ np.array(v)
            order = [j for j in np.lexsort((ids, -np.round(s, 9))) if ids[j] != i][:k]
            found[i] = [(int(ids[j]), round(float(s[j]), 6)) for j in order]
    return found


def test_small_tables_are_searched_whole(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] * 8), (2080, [1.0]), (None, rows[3][1]), rows[20], (2100, [float("inf")] + [1.0] * 7)]
    docs = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = {}
    for r in queries.op4_ann(spark, "").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
        assert r.rank == len(got[r.query_id])
    assert got == exact(rows, 20)
    for few in (docs.limit(0), docs.where("vec_id = 40"), docs.where("vec_id = 2000")):
        monkeypatch.setattr(queries, "table", lambda *_, few=few: few)
        assert queries.op4_ann(spark, "").count() == 0


def recall(rows, got, query):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    hits = asked = 0
    for q in ids[query(ids)]:
        s = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        hits += len(got[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        asked += 20
    return hits / asked


def test_recall_over_thousands_of_lists(spark, monkeypatch):
    """Clusters of unequal spread, and vectors without any structure: lists are chosen as the data need it."""
    monkeypatch.setattr(ann, "LIST_SIZE", 8)
    monkeypatch.setattr(ann, "FEW_POINTS", 1024)
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(200, 24))
    clustered = centers[rng.integers(0, 200, 20_000)] + rng.normal(size=(20_000, 24)) * rng.choice([0.1, 0.4], (20_000, 1))
    for name, x in (("clusters", clustered), ("none", rng.normal(size=(20_000, 24)))):
        rows = list(zip(range(len(x)), x.tolist()))
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {}
        for r in ann.search(table, queries.F.col("vec_id") % 400 == 0).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
            assert r.score == float(np.dot(x[r.query_id], x[r.vec_id])) or abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-12
        assert recall(rows, got, lambda ids: ids % 400 == 0) >= 0.9, name


def test_whole_search_is_exact(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(table, queries.F.col("vec_id") % 100 == 0, target=1.0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert recall(rows, got, lambda ids: ids % 100 == 0) == 1.0


def test_few_lists_suffice_for_clusters():
    rng = np.random.default_rng(13)
    centers = rng.normal(size=(64, 16)) * 4
    x = np.repeat(centers, 256, axis=0) + rng.normal(size=(64 * 256, 16)) * 0.2
    points, spread = ann.balanced_centroids(x, 1024)
    q = x[::500]
    floor = np.partition(q @ x[::4].T, -21, axis=1)[:, -21]
    row, _ = ann.searched(ann.graph(points, spread), q, floor, ann.TARGET)
    assert np.bincount(row).max() < 256 and np.bincount(row).min() >= ann.LEAST_PROBES


def test_recall(spark):
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = data.select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)
    got = ann.search(data, queries.F.col("vec_id") % 20 == 0).toPandas().groupby("query_id")["vec_id"].agg(set)
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        hits += len(got[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_graph_finds_what_all_distances_find():
    rng = np.random.default_rng(5)
    g = ann.graph(rng.normal(size=(512, 16)))
    x = rng.normal(size=(100, 16))
    ids, far = g.nearest(x, 32)
    true = np.argsort(((x[:, None] - g.points[None]) ** 2).sum(axis=2), axis=1)[:, :32]
    assert np.mean([len(set(a) & set(b)) / 32 for a, b in zip(ids.tolist(), true.tolist())]) > 0.9
    assert (np.diff(far, axis=1) >= 0).all()
