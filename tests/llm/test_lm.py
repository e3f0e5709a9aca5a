"""LM scoring against a plain PPM and a plain unigram model."""

import math
import re
import zlib
from collections import Counter

import brute
import pytest

from tessel.llm import lm, queries

TEXTS = [(0, "abracadabra"), (1, "Héllo abra"), (2, "the cat sat on the mat"), (3, ""), (4, None), (5, "aaaa"), (6, "xyz"), (6, "xyz"), (7, "the abra cat"), (8, "é 一"), (9, " \t"), (None, "abra"), (11, "a" * 5000), (12, "zz the THE")]


def ppm(train, text, order):
    counts = {}
    edge = b"\xff"
    for t in train:
        b = edge * order + t + edge
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts.setdefault(b[i - k : i], Counter())[b[i]] += 1
    b, total = edge * order + text + edge, 0.0
    for i in range(order, len(b)):
        gone, log = set(), None
        total_here = 0.0
        for k in range(order, -1, -1):
            left = {s: n for s, n in counts.get(b[i - k : i], {}).items() if s not in gone}
            if left:
                whole = sum(left.values())
                if b[i] in left:
                    log = math.log10((left[b[i]] - lm.DISCOUNT) / whole)
                    break
                total_here += math.log10(lm.DISCOUNT * len(left) / whole)
                gone |= set(left)
        total += total_here + (log if log is not None else -math.log10(256 - len(gone)))
    return total


def learned(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


@pytest.mark.parametrize("head", [0.2, lm.HEAD])
def test_scores(spark, head, monkeypatch):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, score string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    monkeypatch.setattr(lm, "HEAD", head)
    rows = lm.score(docs, queries.remainder("doc_id", 5) != 1, head=head).collect()
    clean = lambda t: (t or "").translate(brute.LOW)
    train = [clean(t).encode() for i, t in TEXTS if learned(i)]
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", clean(t)), None]
    counts = Counter(w for i, t in TEXTS if learned(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(i), not learned(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 6), round(ppm(train, clean(t).encode(), lm.ORDER), 6)) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows) == expected
    nothing = lm.score(docs, queries.F.lit(False)).collect()
    assert {round(r.score / (len(clean(r.doc_id and dict(TEXTS)[r.doc_id] or "abra" if r.doc_id is None else dict(TEXTS)[r.doc_id]).encode()) + 1), 6) for r in nothing} == {round(-math.log10(256), 6)}
    assert lm.score(docs.limit(0), queries.F.lit(True)).count() == 0


def test_probabilities_add_up(spark):
    import numpy as np

    docs = spark.createDataFrame([(t,) for _, t in TEXTS], "text string")
    counted = lm.corpus_counts(docs, 2, "text")
    tree = lm.trie(counted, order=2)
    for context in (b"ab", b"\xff\xff", b"he", b"qq", b"a\xff"):
        runs = np.array([context[0] << 16 | context[1] << 8 | s for s in range(256)], dtype=np.uint64)
        assert math.isclose((10.0 ** tree.score(runs)).sum(), 1.0, rel_tol=1e-9)


@pytest.mark.parametrize("share", [2.0, 0.002, 0.0])
def test_rare_runs_count(spark, share):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    clean = lambda t: (t or "").translate(brute.LOW).encode()
    train = [clean(t) for i, t in TEXTS if learned(i)]
    rows = lm.score(docs, queries.remainder("doc_id", 5) != 1, share=share).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in rows) == sorted((str(i), round(ppm(train, clean(t), lm.ORDER), 6)) for i, t in TEXTS)
