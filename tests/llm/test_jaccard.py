"""The Jaccard join against all pairs."""

import glob
import random
import time
from fractions import Fraction

import brute
import numpy as np
import pytest

from tessel.llm import _common, _graph, jaccard


def near_copies(seed, families, size):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "One two", "one  TWO", "one two three", "a", "a"]
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 11, 20, 21, 40, 150, 400]))]
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return list(enumerate(texts, 5))


@pytest.mark.parametrize("width,p,q", [(3, 9, 10), (5, 8, 10)])
def test_all_links_are_found(spark, width, p, q):
    docs = near_copies(width, 60, 12) + [(10_000 + i, t) for i, t in near_copies(99, 1, 500)]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS component", "'x' AS node")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(table, width, Fraction(p, q)).collect()}
    assert got == brute.components(docs, width, p, q)


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(docs, 3, Fraction(9, 10)).collect()}
    assert got == brute.components([(r.doc_id, r.text) for r in docs.collect()], 3, 9, 10)
    assert jaccard.linked(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (3, "x y z")], "doc_id long, text string")
    assert sorted(map(str, jaccard.linked(docs, 3).collect())) == sorted(str(r) for r in [jaccard_row(1, 1, 1), jaccard_row(1, 1, 1), jaccard_row(None, 1, 1), jaccard_row(3, 1, 3)])


def test_all_links_between_different_texts(spark):
    docs = near_copies(4, 30, 12) + [(10_000 + i, t) for i, t in near_copies(98, 1, 300)]
    pairs, member = jaccard.links(spark.createDataFrame(docs, "doc_id long, text string"), 3, Fraction(9, 10))
    sets = {i: brute.shingles(t, 3) for i, t in docs}
    low = {}
    for i in sorted(sets):
        low.setdefault(frozenset(sets[i]), i)
    ids = sorted(i for s, i in low.items() if s)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])}
    got = [tuple(sorted((r.a, r.b))) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r.doc_id: r["class"] for r in member.collect()} == {i: low[frozenset(s)] if s else None for i, s in sets.items()}


def test_one_of_each_group_stays_and_nothing_else_goes(spark):
    long = lambda k: " ".join(f"w{k * 100 + i}" for i in range(30))
    rows = [(1, long(1)), (1, long(2)), (1, long(2)), (2, long(2) + " x"), (3, long(3)), (None, long(3)), (None, long(4)), (None, long(4)), (5, None), (6, ""), (6, "")]
    docs = spark.createDataFrame([(i, t, 0, "h", "r") for i, t in rows], "doc_id long, text string, id int, hash string, `_row` string")
    left = jaccard.keep_one(docs)
    assert left.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in left.collect())
    assert got == sorted((str(i), str(t)) for i, t in [(1, long(1)), (1, long(2)), (3, long(3)), (None, long(4)), (5, None), (6, ""), (6, "")])
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_very_long_and_equal_sketches(spark):
    """A text of some MB, its near copy, and a family of many blocks whose chain of links spans them."""
    base = [f"w{i}" for i in range(200_000)]
    chain = [(100 + i, " ".join(f"c{j}" for j in range(i, i + 60))) for i in range(0, 600)]
    docs = [(1, " ".join(base)), (2, " ".join(base[:-200])), *chain]
    got = {r.doc_id: r.component_id for r in jaccard.linked(spark.createDataFrame(docs, "doc_id long, text string"), 3, Fraction(9, 10)).collect()}
    assert got == {1: 1, 2: 1} | {i: 100 for i, _ in chain}


def test_distances_of_sketches():
    rng = np.random.default_rng(8)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (3, 50, 5000, 40_000)]
    folds = [jaccard.folded(s) for s in sets]
    a, b = zip(*[(x, y) for x in folds for y in folds])
    got = jaccard.apart(jaccard.pa.array(a, jaccard.pa.binary()), jaccard.pa.array(b, jaccard.pa.binary()))
    bits = lambda x: np.unpackbits(np.frombuffer(x, np.uint8))
    for x, y, d in zip(a, b, got):
        n = 8 * min(len(x), len(y))
        assert d == (bits(x).reshape(-1, n).sum(axis=0) % 2 != bits(y).reshape(-1, n).sum(axis=0) % 2).sum()


def jaccard_row(*values):
    from pyspark.sql import Row

    return Row("doc_id", "n_shingles", "component_id")(*values)


def test_similar_sets_share_a_segment():
    rng = np.random.default_rng(3)
    for p, q in ((9, 10), (8, 10)):
        least = Fraction(p, q)
        for n in (1, 2, 5, 9, 10, 11, 19, 20, 50, 333):
            for _ in range(20):
                a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
                most = jaccard.threshold(p, q).differences(2 * n)
                b = np.concatenate([a[int(rng.integers(0, most // 2 + 1)) :], rng.integers(0, 1 << 63, int(rng.integers(0, most // 2 + 1)), dtype=np.uint64)])
                both = len(np.intersect1d(a, b))
                if not len(b) or q * both < p * (len(a) + len(b) - both):
                    continue
                values, begin, _ = jaccard.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, n, n + len(b)]), least)
                assert set(values[: begin[1]].tolist()) & set(values[begin[1] :].tolist())


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (500, 499)]
    got = {r.node: r.component for r in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {499: 499, 500: 499}
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_segments_are_packed_and_meet_in_pieces(spark, monkeypatch):
    """A segment takes few bytes of a shuffle, and the same sets meet, however little a task takes up at a time."""
    least, docs = Fraction(8, 10), [(i, t) for i, t in near_copies(7, 40, 30) if t and t.strip()]
    sets = [jaccard.shingle_sets(np.frombuffer(t.lower().encode(), np.uint8), np.array([0, len(t)]), 5)[0] for _, t in docs]
    at = np.append(0, np.cumsum([len(s) for s in sets]))
    values, begin, _ = jaccard.signatures(np.concatenate(sets), at, least)
    holders = {}
    for i, k in enumerate(jaccard.set_keys(np.concatenate(sets), at).tolist()):
        for v in values[begin[i] : begin[i + 1]].tolist():
            holders.setdefault(v, set()).add(k)
    few, many = [[sorted(h) for h in holders.values() if (len(h) > jaccard.FEW) == big] for big in (False, True)]
    pairs, crowds = {(a, b) for h in few for n, a in enumerate(h) for b in h[n + 1 :]}, sorted((len(h), k) for h in many for k in h)
    table, n = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), sum(map(len, holders.values()))
    in_band = jaccard._sets_by_band(spark.createDataFrame([(len(s),) for s in sets], "n_shingles int"), least)
    for meeting in (jaccard.MEETING, 16):
        monkeypatch.setattr(jaccard, "MEETING", meeting)
        parts = jaccard.segments(table, 5, least, "doc_id", "text", in_band)
        rows = parts.collect()
        assert sum(len(r.segments) for r in rows) == 4 * n and (meeting == 16 or sum(sum(map(len, r[1:])) for r in rows) < 6.5 * n)
        met = jaccard.meetings(parts).collect()
        assert {(r.a, r.b) for r in met if r.spare == jaccard.PAIR} == pairs
        told = [(r.size, r.b) for r in met if r.spare != jaccard.PAIR]
        assert sorted(told) == crowds if meeting > 16 else {k for _, k in told} == {k for _, k in crowds}


def test_crowds_without_links_make_no_families(spark):
    """Sets of one half that all share, and one half of their own, are crowded but far apart; links among them are found."""
    shared = " ".join(f"s{i}" for i in range(60))
    docs = [(i, f"{shared} " + " ".join(f"d{i}x{j}" for j in range(60))) for i in range(400)]
    docs += [(1000 + i, docs[i][1] + " more") for i in range(0, 400, 50)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = jaccard._found(table, 5, Fraction(8, 10), "doc_id", "text", True)
    key = {r.doc_id: r.key for r in found.rows.collect()}
    want = {tuple(sorted((key[i], key[1000 + i]))) for i in range(0, 400, 50)}
    assert {tuple(sorted((r.a, r.b))) for r in found.links.collect()} == want
    least, rows = Fraction(8, 10), jaccard.sketched(table, 5, "doc_id", "text")
    met = jaccard.meetings(jaccard.segments(table, 5, least, "doc_id", "text", jaccard._sets_by_band(rows, least)))
    families = jaccard._families(met, found.classes, least).collect()
    assert {r.node for r in families} == {k for pair in want for k in pair}


def test_only_texts_that_may_go_are_shuffled(spark, monkeypatch):
    """The last join takes the two copies, and of the texts without copies hardly any."""
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(200)] + [(900, "a b c d e f"), (901, "a b c d e f"), (902, " ")]
    taken, marked = [], jaccard.marked
    monkeypatch.setattr(jaccard, "marked", lambda rows, wanted, key, name: taken.append(marked(rows, wanted, key, name)) or taken[-1])
    kept = jaccard.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(200), 900, 902]
    assert {901} <= {r.id for r in taken[-1].where("_may").collect()} and taken[-1].where("_may").count() < 10


def test_written_tables_leave_no_shuffle_files(spark):
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    old, before = files(), spark.conf.get(_common.NO_SHUFFLES_LEFT, "false")
    table = _common.scratch(spark.range(1000).repartition("id"), "test")
    end = time.time() + 20
    while files() - old and time.time() < end:
        time.sleep(0.2)
    assert not files() - old and spark.conf.get(_common.NO_SHUFFLES_LEFT) == before and table.count() == 1000
