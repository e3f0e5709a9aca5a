"""BPE and packing against the tokenizers library and the packing's own rules."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessel.llm import bpe, packing, queries

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORDS, BYTES)}
ODD = [None, "", " \n", "It's we'll 'S x'y ''s", "<|endoftext|>a <|startoftext|>'s", "ÀÉß½²µÿ\x85\xa0\x1c", "İıΣσς 一二 🎉 é", "a" * 3000, "ab12 " * 900, "don'tre've", "  ​ x", "The quick brown fox, 12 of 7! " * 30_000, "end"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdestrvml' \n-09é<|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text_encodes_as_the_library_does(text):
    ids = list(bpe.coder(WORDS).encode([text]))[0].tolist()
    assert ids == LIBRARY[WORDS].encode(text, add_special_tokens=False).ids
    assert bpe.coder(WORDS).bpe.decode(ids).decode() == LIBRARY[WORDS].decode(ids, skip_special_tokens=False)
    assert packing.byte_bpe(BYTES).encode(text).tolist() == LIBRARY[BYTES].encode(text, add_special_tokens=False).ids


def table(spark):
    rows = [(r.doc_id, r.text, 1) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000 + i, t, 1) for i, t in enumerate(ODD)] + [(None, "null id", 1), (10_003, ODD[3], 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int")


def test_bpe_query(spark, monkeypatch):
    docs = table(spark)
    monkeypatch.setattr(queries, "table", lambda *_: docs)

    def row(i, text):
        ids = LIBRARY[WORDS].encode(text or "", add_special_tokens=False).ids
        return str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY[WORDS].decode(ids, skip_special_tokens=False).encode()).hexdigest()

    expected = sorted(row(r.doc_id, r.text) for r in docs.collect())
    assert sorted((str(r[0]), *r[1:]) for r in queries.op3_bpe(spark, "").collect()) == expected
    assert bpe.digests(docs.limit(0), WORDS).count() == 0
    full = bpe.encode(docs, WORDS).where("doc_id = 10003").first()
    assert full.decoded == LIBRARY[WORDS].decode(list(full.ids), skip_special_tokens=False)


def test_packing_query(spark, monkeypatch):
    docs = table(spark)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    rows = queries.op6_packing(spark, "").collect()
    expected = []
    for r in docs.collect():
        ids = [*LIBRARY[BYTES].encode(r.text or "", add_special_tokens=False).ids, 2]
        at, first = 0, len(ids) % 1024 or 1024
        for k, n in enumerate([first] + [1024] * ((len(ids) - first) // 1024)):
            expected.append((str(r.doc_id), k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(packing.pieces(docs.limit(0), BYTES)).count() == 0


def test_best_fit_with_few_bins():
    rng = random.Random(4)
    for most in (1, 3, 64):
        bins, used = packing.Bins(100, most), defaultdict(int)
        open_bins = {}
        for _ in range(3000):
            n = rng.randint(1, 100)
            fits = [(free, b) for b, free in open_bins.items() if free >= n]
            number, offset = bins.put(n)
            if fits:
                assert open_bins[number] == min(fits)[0]
            else:
                assert number not in used
                if len(open_bins) >= most:
                    fullest = min(open_bins.values())
                    gone = next(b for b in reversed(open_bins) if open_bins[b] == fullest)
                    assert bins.open <= most
                    open_bins.pop(gone)
            assert offset == used[number]
            used[number] += n
            open_bins.pop(number, None)
            if used[number] < 100:
                open_bins[number] = 100 - used[number]
