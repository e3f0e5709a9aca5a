"""BPE encoding and decoding: the last token of every prefix of a word, found from automaton matches and pair tests."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessel.llm import _bytes as B
from tessel.llm._common import arrow_map, small_batches

#: Words whose ids a task remembers; beyond that it starts anew.
REMEMBERED = 1_000_000
MARK = "</w>"
#: What begins a token of its own after an apostrophe; fixed by the tokenizer's pattern.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
END = 256  # added to the symbol of a word's last byte


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and that byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """A BPE vocabulary with word ends: a word's ids, and the text of ids.

    ``last[i]`` is the last token of the first i symbols' encoding. A token that ends at i is that token if it is
    compatible with ``last`` at its start, and just one is; ids follow from the back-pointers that the lengths are.
    """

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, names = spec["model"]["vocab"], byte_names()
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        self.size, self.rank = [0] * len(self.tokens), [-1] * len(self.tokens)
        self.halves: list[tuple[int, int] | None] = [None] * len(self.tokens)
        self.pairs: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            ends = text.endswith(MARK)
            symbols = [names[c] for c in text.removesuffix(MARK)] if text not in self.special else []
            if symbols:
                symbols[-1] += END * ends
                self.automaton.add_word("".join(map(chr, symbols)), i)
            self.tokens[i], self.size[i] = text.encode(), len(symbols)
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pairs[left << 32 | right] = rank
            self.rank[whole], self.halves[whole] = rank, (left, right)
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay apart: no pair at their border would have been merged before the two were whole.

        Merges are undone from the last backwards, the right one first among equals. A pair at the border is an
        objection if it comes before the merge just undone, or with it where that was further right.
        """
        key = left << 32 | right
        if (known := self.known.get(key)) is not None:
            return known
        fits, before = True, 1 << 30
        while True:
            if self.pairs.get(left << 32 | right, 1 << 30) < before:
                fits = False
                break
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                break
            if b >= a:
                right, before = self.halves[right][0], b + 1
            else:
                left, before = self.halves[left][1], a
        if len(self.known) < 1 << 21:
            self.known[key] = fits
        return fits

    def word(self, symbols: str) -> list[int]:
        last = [-1] * (len(symbols) + 1)
        for at, token in self.automaton.iter(symbols):
            if last[at + 1] < 0:
                start = at + 1 - self.size[token]
                if start == 0 or self.compatible(last[start], token):
                    last[at + 1] = token
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at])
            at -= self.size[last[at]]
        return ids[::-1]

    @staticmethod
    def symbols(word: bytes) -> str:
        return word[:-1].decode("latin-1") + chr(word[-1] + END)

    def parts(self, text: str) -> Iterator[int | bytes]:
        """Ids of special tokens and UTF-8 words of any text, split by the library's own normalizer and pattern."""
        names = byte_names()
        for piece in self.special_at.split(text):
            if piece in self.special:
                yield self.special[piece]
            elif piece:
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece)):
                    yield bytes(names[c] for c in word)

    def decode(self, ids: Iterable[int]) -> bytes:
        """The text of ids in UTF-8: the vocabulary has no decoder, so tokens stand apart by spaces."""
        return b" ".join(map(self.tokens.__getitem__, ids))


@cache
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


#: 0 space, 1 letter, 2 number, 3 other, of each Latin-1 character.
KIND = np.array([0 if c in (*range(9, 14), 32, 133, 160) else {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(256)], dtype=np.uint8)
#: Latin-1 lower case stays in Latin-1.
LOWER = np.array([ord(chr(c).lower()) for c in range(256)], dtype=np.uint8)


def latin_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pattern's words in lower-cased Latin-1 texts, and the words before each text."""
    n = len(data)
    kind = np.zeros(n + 1, dtype=np.uint8)
    kind[:-1] = KIND[data]
    before = np.zeros(n + 1, dtype=np.uint8)
    before[1:] = kind[:-1]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    edge = cut | (kind != before) | (kind == 2)
    marks = np.flatnonzero((data == 0x27) & edge[:-1])
    if len(marks):
        stop = offsets[np.searchsorted(offsets, marks, side="right")]
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        free = np.ones(len(marks), dtype=bool)
        for tail in CONTRACTIONS:
            fits = free & (marks + len(tail) < stop)
            for k, c in enumerate(tail):
                fits &= padded[marks + 1 + k] == c
            free &= ~fits
            edge[marks[fits] + 1] = False
            after = marks[fits] + 1 + len(tail)
            edge[after] |= kind[after] == 1
    starts = np.flatnonzero(edge & (kind != 0))
    # a word ends where the next edge is: edges of spaces count as well
    edges = np.append(np.flatnonzero(edge | (kind == 0)), n)
    ends = edges[np.searchsorted(edges, starts, side="right")]
    return starts, ends, np.searchsorted(starts, offsets)


class Coder:
    """Encodes texts by batches; a word's ids are worked out once and then kept by hash."""

    def __init__(self, path: str):
        self.bpe = loaded(path)
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.count = [], []

    def add(self, key: int, word: bytes) -> int:
        ids = self.bpe.word(self.bpe.symbols(word))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.first.append(self.used)
        self.count.append(len(ids))
        self.used += len(ids)
        self.place[key] = len(self.first) - 1
        return len(self.first) - 1

    def slow(self, text: str) -> np.ndarray:
        found: list[int] = []
        for part in self.bpe.parts(text):
            found += [part] if isinstance(part, int) else self.bpe.word(self.bpe.symbols(part))
        return np.array(found, dtype=np.uint32)

    def fast(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of lower-cased Latin-1 texts."""
        if len(self.place) > REMEMBERED:
            self.forget()
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        starts, ends, per_text = latin_words(data, offsets)
        if not len(starts):
            return [np.zeros(0, np.uint32)] * len(texts)
        keys, one, inverse = np.unique(B.hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw, codes = data.tobytes(), np.empty(len(keys), np.int64)
        for k, (key, i) in enumerate(zip(keys.tolist(), one.tolist())):
            code = self.place.get(key)
            codes[k] = code if code is not None else self.add(key, raw[starts[i] : ends[i]].decode("latin-1").encode())
        codes = codes[inverse]
        counts = np.array(self.count, dtype=np.int64)[codes]
        done = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.repeat(np.array(self.first, dtype=np.int64)[codes] - done[:-1], counts) + np.arange(done[-1])]
        return np.split(ids, done[per_text[1:-1]])

    def encode(self, texts: list[str], size: int = B.CHUNK) -> Iterator[np.ndarray]:
        """Ids of each text in turn."""
        run: list[bytes] = []
        held = 0
        for text in texts:
            try:
                latin = text.encode("latin-1") if "<|" not in text else None
            except UnicodeEncodeError:
                latin = None
            if latin is None or held + len(latin) > size and run:
                yield from self.fast(run) if run else ()
                run, held = [], 0
            if latin is None:
                yield self.slow(text)
            else:
                run.append(LOWER[np.frombuffer(latin, np.uint8)].tobytes())
                held += len(latin)
        yield from self.fast(run) if run else ()


@cache
def coder(path: str) -> Coder:
    return Coder(path)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of long) and decoded (the text of these ids) of every row; null texts are empty.

    ``path`` is the vocabulary's file on every machine. Rows are independent of each other: equal rows get equal ids.
    """
    return _mapped(docs, path, doc_id, text, "doc_id long, ids array<long>, decoded string", lambda c, ids: (ids.astype(np.int64), c.bpe.decode(ids.tolist()).decode()))


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, from ``encode``'s ids and decoded texts."""
    return _mapped(docs, path, doc_id, text, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda c, ids: (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(c.bpe.decode(ids.tolist())).hexdigest()))


def _mapped(docs: DataFrame, path: str, doc_id: str, text: str, schema: str, row) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(path)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        rows = [row(c, ids) for ids in c.encode(texts)]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in zip(*rows))], names=[x.split()[0] for x in re.split(r",\s*", schema)])

    return arrow_map(docs.selectExpr(f"CAST(`{doc_id}` AS LONG) AS doc_id", f"`{text}` AS text"), run, schema)
