"""Cross-tokenizer alignment against the libraries and plain loops over all pairs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessel.llm import alignment as A
from tessel.llm import queries
from tessel.llm.bpe import byte_names

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a  b   c ", "<|endoftext|>x <s></s> <0x41> <unk>", "one▁two", "é一🎉\x00\t\n  x", "ﬁ½ İıΣσς", "a" * 700, "  lead and trail  ", "it's we'll don't 12345 67", "\n\n\n", "the same text", "the same text"]


def plain(docs):
    """The contract, from the libraries' own ids and a loop over pairs of tokens."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    back = byte_names()
    found = []
    for i, text in docs:
        want = (" " + (text or "")).encode()
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(back[c] for c in a.id_to_token(t)) for t in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in ids_b]
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links = [(ids_a[p], ids_b[q]) for p in range(len(ids_a)) for q in range(len(ids_b)) if max(ends_a[p] - len(bytes_a[p]), ends_b[q] - len(bytes_b[q])) < min(ends_a[p], ends_b[q])]
        groups, low = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append("|".join(",".join(str(t) for t, e in zip(ids, ends) if low < e <= cut) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
            low = cut
        found.append((i, ids_a, ids_b, groups, links))
    counts = Counter(pair for *_, links in found for pair in set(links))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return [
        (i, len(x), len(y), len(g), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for i, x, y, g, links in found
    ]


@pytest.mark.parametrize("frequent, chunk", [(1 << 20, 1 << 19), (300, 500), (1, 1 << 12)])
def test_alignment_equals_plain_python(spark, monkeypatch, frequent, chunk):
    monkeypatch.setattr(A, "FREQUENT", frequent)
    monkeypatch.setattr(A, "CHUNK", chunk)
    real = [(r.doc_id, r.text[:600]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows = real + list(enumerate(ODD, 10_000)) + [(None, "no id"), (10_003, ODD[3])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, pair int, a string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = queries.op11_alignment(spark, "")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows), key=str)
    assert A.digests(docs.limit(0), A_PATH, B_PATH).count() == 0


def test_long_text_and_words(spark):
    a, b, len_a, len_b = A.both(A_PATH, B_PATH)
    text = "The quick  brown fox, 12 of 7!\n é🎉 " * 4000
    ids_a, ids_b = A.tokens(text, a, b)
    assert ids_b == b.model.encode(text) and ids_a == a.exact.encode(" " + text, add_special_tokens=False).ids


def test_divide_finds_all_shared_ends():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 60)
        x, y = (np.array(sorted({*rng.sample(range(n), rng.randint(0, n)), n})) for _ in range(2))
        assert A.divide(x, y, np.array([0]), np.array([len(x) - 1])).tolist() == np.flatnonzero(np.isin(x, y)).tolist()


def test_words_equal_whole_texts(monkeypatch):
    """Spaces of all sorts beside all sorts of characters; the words remembered are few."""
    a, b, *_ = A.both(A_PATH, B_PATH)
    random.seed(11)
    parts = [" ", " ", " ", "\n", "\t", "\xa0", "\u3000", "\x1c", "\x85", "the", "Cat", "'s", "12", ",", "...", "é", "ß", "ﬁ", "一二", "\u0301", "½", "<|endoftext|>", "</s>", "x" * 40, "🎉", "\u200b", "▁"]
    texts = ["".join(random.choices(parts, k=random.randint(1, 12))) for _ in range(4000)]
    texts += [" ".join(random.choices(parts[9:-1], k=8)) for _ in range(1000)] + ["a\n \nb", "a\n b", "a \nb", "a\n  b", "\n a", "a\n"]
    for few, letters in ((500_000, 1 << 23), (3, 1 << 23), (500_000, 5)):
        monkeypatch.setattr(A, "WORDS", few)
        monkeypatch.setattr(A, "LETTERS", letters)
        words, by_words = A.Words(a, b), 0
        library = Tokenizer.from_file(A_PATH)
        library.encode_special_tokens = True
        model = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        for text in texts if few > 3 else texts[:500]:
            got = [np.frombuffer(x, "<u4").tolist() for x in words.encode(text)]
            assert got == list(map(list, A.tokens(text, a, b))), text
            assert got in ([[], []], [library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)]), text
            by_words += text[0] != " " and all(w in words.of_a for w in text.split(" "))
        assert few == 3 or letters == 5 or by_words > 1000


def test_new_words_are_encoded_together(monkeypatch):
    """Many texts' new words take few calls, and those that are not given back leave the others right."""
    a, b, *_ = A.both(A_PATH, B_PATH)
    texts = [" ".join(f"w{i * j}é {'ﬁ' if i % 9 == 3 else 'x'}{j}" for j in range(20)) for i in range(40)] + ODD
    want = [A.tokens(text, a, b) for text in texts]
    calls = []
    monkeypatch.setattr(A.Bytes, "encode", lambda self, text, encode=A.Bytes.encode: (calls.append(text), encode(self, text))[1])
    words = A.Words(a, b)
    got = words.encode_all(texts)
    assert [tuple(np.frombuffer(x, "<u4").tolist() for x in pair) for pair in got] == [tuple(map(list, pair)) for pair in want]
    assert len(words.of_a) > 300 > len(calls)
    # where a text of words is not given back, it is halved
    monkeypatch.setattr(A.Pieces, "together", lambda self, text, together=A.Pieces.together: together(self, text)[:: -1 if "x7" in text.split(" ") else 1])
    halved = A.Words(a, b)
    assert halved.encode_all(texts) == got and set(halved.of_a) == set(words.of_a)
