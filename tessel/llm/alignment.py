"""Alignment of two tokenizers' tokens of the same text: groups between shared cuts, and links of overlapping tokens."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm._common import scratch, small_batches
from tessel.llm.packing import byte_bpe

#: Words and their characters that a task remembers, characters or bytes of tokens worked on at a time, and links that a
#: task counts before it sends them on.
WORDS, LETTERS, CHUNK, COUNTS = 500_000, 1 << 23, 1 << 19, 1 << 21
#: New words that are encoded one by one.
FEW_WORDS = 8
#: Pairs whose counts are broadcast make up 1/FREQUENT of all counts or more, so there are at most that many (18 MB).
FREQUENT = 1 << 20
#: Bits of an id in a pair, and of a text's place in its chunk beside one.
BITS, MOST_TEXTS = 20, 1 << 23


class Pieces:
    """Piece BPE by sentencepiece. No piece has a space after another character, so that a text's pieces are those of its
    runs (spaces, then others; the last with the spaces after it) one by one; each run's are remembered."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.apart = not any("▁" in x.lstrip("▁") for x in names)
        self.seen: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        """Ids of space+text; the model adds the space."""
        if not self.apart or "▁" in text:
            return self.model.encode(text)
        runs = re.findall(r" *[^ ]+(?: +\Z)?| +", " " + text)
        new = list({r for r in runs if r not in self.seen})
        if new:
            if len(self.seen) > WORDS:
                self.seen.clear()
                new = list(set(runs))
            self.seen.update(zip(new, self.model.encode([r[1:] for r in new], num_threads=1)))
        return [i for r in runs for i in self.seen[r]]

    def together(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


class Bytes:
    """Byte-level BPE of space+text; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.coder, self.exact = byte_bpe(path), Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        special = {i: s.encode() for s, i in self.coder.special.items()}
        self.bytes = [special[i] if i in special else self.coder.fast.decode_single_token_bytes(i) for i in range(self.coder.fast.n_vocab)]

    def encode(self, text: str) -> list[int]:
        if not text.isascii() and self.coder.rare.search(text):
            return self.exact.encode(" " + text, add_special_tokens=False).ids
        return self.coder.fast.encode_ordinary(" " + text)

    def together(self, text: str) -> np.ndarray:
        """Of a text without characters on which the libraries may differ."""
        return np.array(self.coder.fast.encode_ordinary(" " + text), np.int64)


@cache
def both(path_a: str, path_b: str) -> tuple[Bytes, Pieces, np.ndarray, np.ndarray]:
    """Both tokenizers and the lengths of their tokens' bytes."""
    a, b = Bytes(path_a), Pieces(path_b)
    return a, b, *(np.array([len(x) for x in t.bytes]) for t in (a, b))


def tokens(text: str | None, a: Bytes, b: Pieces) -> tuple[list[int], list[int]]:
    """Both tokenizers' ids; none if the text is null or empty, or if some tokenizer's bytes are not space+text."""
    if not text:
        return [], []
    ids_a, ids_b, want = a.encode(text), b.encode(text), b" " + text.encode()
    if b"".join([a.bytes[i] for i in ids_a]) != want or b"".join([b.bytes[i] for i in ids_b]) != want:
        return [], []
    return ids_a, ids_b


def packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Words:
    """Both tokenizers' ids of texts, a space and a word at a time; each word's are remembered as bytes.

    A space before a character other than white space starts a token of either tokenizer, so a text in which all spaces
    are such is the row of its words. Other texts, and those with a word that is not given back byte by byte, are encoded
    whole. For the same reason new words are encoded as one text, many texts' together, and told apart by their spaces.
    """

    other = re.compile(r" (?:\s|\Z)")

    def __init__(self, a: Bytes, b: Pieces):
        self.a, self.b, self.held = a, b, 0
        self.spaced = [np.array([x.startswith(b" ") for x in t.bytes]) for t in (a, b)]
        self.of_a: dict[str, bytes] = {}
        self.of_b: dict[str, bytes] = {}
        self.inexact: set[str] = set()

    def _each(self, words: list[str]) -> None:
        for w, ids_b in zip(words, self.b.model.encode(words, num_threads=1)):
            ids_a, want = self.a.encode(w), b" " + w.encode()
            if b"".join([self.a.bytes[i] for i in ids_a]) == want and b"".join([self.b.bytes[i] for i in ids_b]) == want:
                self.of_a[w], self.of_b[w] = packed(ids_a), packed(ids_b)
            else:
                self.inexact.add(w)

    def _together(self, words: list[str]) -> None:
        """Halves ``words`` where some word is not given back; few are left to ``_each``."""
        if len(words) < FEW_WORDS:
            return self._each(words)
        text = " ".join(words)
        want, both_ = b" " + text.encode(), []
        for tokenizer, spaced in zip((self.a, self.b), self.spaced):
            ids = tokenizer.together(text)
            starts = np.flatnonzero(spaced[ids])
            # as many tokens begin with a space as there are spaces, so none has one elsewhere
            if len(starts) != len(words) or b"".join(map(tokenizer.bytes.__getitem__, ids.tolist())) != want:
                half = len(words) // 2
                self._together(words[:half]), self._together(words[half:])
                return
            data, cut = ids.astype("<u4").tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            both_.append([data[i:j] for i, j in zip(cut, cut[1:])])
        self.of_a.update(zip(words, both_[0]))
        self.of_b.update(zip(words, both_[1]))

    def _split(self, text: str | None) -> list[str]:
        """The words of a text that is the row of its words, else none."""
        return text.split(" ") if text and self.b.apart and "▁" not in text and not text[0].isspace() and not self.other.search(text) else []

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.of_a) - self.inexact
        if new and (len(self.of_a) + len(self.inexact) > WORDS or self.held > LETTERS):
            self.of_a.clear(), self.of_b.clear(), self.inexact.clear()
            new, self.held = words, 0
        self.held += sum(map(len, new))
        rare = {w for w in new if not w.isascii() and self.a.coder.rare.search(w)}
        self._each(list(rare))
        self._together(list(new - rare))

    def encode_all(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of each text as little-endian 32-bit integers; see ``tokens``."""
        rows = [self._split(text) for text in texts]
        words = set().union(*rows)
        self._learn(words)
        inexact = words & self.inexact
        # only these texts' words: far fewer, and so found faster
        of_a, of_b = ({w: held[w] for w in words - inexact} for held in (self.of_a, self.of_b))
        found = []
        for text, row in zip(texts, rows):
            if row and inexact.isdisjoint(row):
                found.append((b"".join(map(of_a.__getitem__, row)), b"".join(map(of_b.__getitem__, row))))
            else:
                ids_a, ids_b = tokens(text, self.a, self.b)
                found.append((packed(ids_a), packed(ids_b)))
        return found

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        return self.encode_all([text])[0]


@cache
def words_of(path_a: str, path_b: str) -> Words:
    return Words(*both(path_a, path_b)[:2])


def divide(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places in ``ends_a`` of the ends that both have, within intervals whose own last ends are shared.

    ``first`` and ``last`` are each interval's places. A shared end is sought from an interval's middle outwards by
    bisecting ``ends_b``, for all intervals at once; where one is found, both halves are intervals again. An interval
    without one is a leaf.
    """
    cuts = [last]
    tried = np.zeros(len(first), np.int64)
    while len(first):
        some = tried < last - first
        first, last, tried = first[some], last[some], tried[some]
        # from the middle outwards: 0, -1, +1, -2, +2 ... through all inner places, of which there are last - first
        at = first + (last - first) // 2 + np.where(tried % 2, -((tried + 1) // 2), tried // 2)
        found = ends_b[np.searchsorted(ends_b, ends_a[at])] == ends_a[at]
        cuts.append(at[found])
        first, last, tried = (
            np.concatenate([first[~found], first[found], at[found] + 1]),
            np.concatenate([last[~found], at[found], last[found]]),
            np.concatenate([tried[~found] + 1, np.zeros(2 * found.sum(), np.int64)]),
        )
    return np.sort(np.concatenate(cuts))


class Aligned(NamedTuple):
    """What a chunk of texts holds: for each group its text and where its tokens end, for each link its text and ids."""

    group_text: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_text: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> Aligned:
    """Groups and links of texts that have n_a and n_b tokens each, ids lying one text after another."""
    ends_a, ends_b = np.cumsum(len_a[ids_a]), np.cumsum(len_b[ids_b])
    stop = np.cumsum(n_a)
    full = n_a > 0
    cuts = divide(ends_a, ends_b, (stop - n_a)[full], stop[full] - 1)
    text_a = np.repeat(np.arange(len(n_a)), n_a)
    group_b = np.searchsorted(ends_b, ends_a[cuts])
    # within a group, each stretch between neighbouring ends of either kind is one pair of overlapping tokens
    inner = np.ones(len(ends_b), bool)
    inner[group_b] = False
    all_ends = np.sort(np.concatenate([ends_a, ends_b[inner]]))
    at_a, at_b = np.searchsorted(ends_a, all_ends), np.searchsorted(ends_b, all_ends)
    return Aligned(text_a[cuts], cuts + 1, group_b + 1, text_a[at_a], ids_a[at_a], ids_b[at_b])


@cache
def decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of numbers below ``size``, and how many each has."""
    width = len(str(size))
    names = np.array([str(i).encode() for i in range(size)], dtype=f"S{width}").view(np.uint8).reshape(size, width)
    return names, (names > 0).sum(axis=1)


def rendered(x: Aligned, ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, size: int) -> list[bytes]:
    """Each text's ``a1,a2|b1;a3|b2,b3``, where ids are below ``size``."""
    names, digits = decimals(size)
    width = names.shape[1]
    place_a = np.arange(len(ids_a))
    place_b = np.arange(len(ids_b))
    group_of_a = np.repeat(np.arange(len(x.group_a)), np.diff(x.group_a, prepend=0))
    group_of_b = np.repeat(np.arange(len(x.group_b)), np.diff(x.group_b, prepend=0))
    place_a = place_a + np.concatenate([[0], x.group_b])[group_of_a]
    place_b = place_b + x.group_a[group_of_b]
    n = len(ids_a) + len(ids_b)
    ids, after = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    after[place_a[x.group_a - 1]] = ord("|")
    after[place_b[x.group_b - 1]] = ord(";")
    shown = np.zeros((n, width + 1), np.uint8)
    shown[:, :width] = names[ids]
    shown[np.arange(n), digits[ids]] = after
    flat = shown[shown > 0].tobytes()
    ends = np.concatenate([[0], np.cumsum(digits[ids] + 1)])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    return [flat[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:])]


def encoded(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_row, doc_id and both tokenizers' ids, as little-endian 32-bit integers, of every row; whole texts count."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path_a, path_b)
        for batch in batches:
            texts, first = batch.column(2).to_pylist(), 0
            while first < len(texts):
                held, last = len(texts[first] or ""), first + 1
                while last < len(texts) and (held := held + len(texts[last] or "")) <= CHUNK:
                    last += 1
                ids = zip(*words.encode_all(texts[first:last]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first) for k in (0, 1)), *(pa.array(c, pa.binary()) for c in ids)], names=["_row", "doc_id", "a", "b"])
                first = last

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "_row long, doc_id long, a binary, b binary")


def _chunks(batch: pa.RecordBatch, len_a: np.ndarray, len_b: np.ndarray):
    """Runs of an ``encoded`` batch's rows with their ids, counts and alignment."""
    a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
    cut = [0]
    held = 0
    for i in range(len(a)):
        held += len(a[i]) + len(b[i])
        if held > CHUNK or i + 1 == len(a) or i + 1 - cut[-1] >= MOST_TEXTS:
            cut.append(i + 1)
            held = 0
    for first, last in zip(cut, cut[1:]):
        ids = [np.frombuffer(b"".join(x[first:last]), "<u4").astype(np.int64) for x in (a, b)]
        n_a, n_b = (np.array([len(y) // 4 for y in x[first:last]], np.int64) for x in (a, b))
        yield first, last, ids[0], n_a, ids[1], n_b, align(ids[0], n_a, ids[1], n_b, len_a, len_b)


def _pairs(x: Aligned, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, pair and number of links of each distinct pair of a text; ``few`` texts at most."""
    pair = (x.link_a << BITS) | x.link_b
    if few < MOST_TEXTS and BITS * 2 + few.bit_length() < 63:
        both_, n = np.unique((x.link_text << (2 * BITS)) | pair, return_counts=True)
        return both_ >> (2 * BITS), both_ & ((1 << (2 * BITS)) - 1), n
    both_, n = np.unique(np.stack([x.link_text, pair]), axis=1, return_counts=True)
    return both_[0], both_[1], n


def pair_counts(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """pair (A's id times 2**20 plus B's), count (rows that hold it linked) and best (the highest count of A's id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, len_a, len_b = both(path_a, path_b)
        held = [np.zeros(0, np.int64)] * 2
        fresh: list[np.ndarray] = []

        def merge():
            keys, at = np.unique(np.concatenate([held[0], *fresh]), return_inverse=True)
            return [keys, np.bincount(at, np.concatenate([held[1], np.ones(sum(map(len, fresh)), np.int64)]), len(keys)).astype(np.int64)]

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["pair", "count"])

        for batch in batches:
            for first, last, *_, x in _chunks(batch, len_a, len_b):
                fresh.append(_pairs(x, last - first)[1])
                if sum(map(len, fresh)) > COUNTS:
                    held, fresh[:] = merge(), []
                    if len(held[0]) > COUNTS:
                        yield out()
                        held = [np.zeros(0, np.int64)] * 2
        held = merge()
        yield out()

    counts = rows.mapInArrow(run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    # an id of A has no more partners than B has ids
    top = F.max("count").over(Window.partitionBy(F.shiftright("pair", BITS)))
    return counts.withColumn("best", F.col("count") == top)


def digests(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    Null and empty texts, and those that a tokenizer does not give back byte by byte, have no tokens: zeros and ''. A text
    of any length is aligned whole. Rows without doc_id and repeated rows count as documents of their own; other columns,
    of any name, play no part; an empty table gives none. Counts of pairs of a share of 1/FREQUENT or more are broadcast,
    the others are written beside the rows and joined: no such pair is more than that share.
    """
    spark = docs.sparkSession
    rows = scratch(encoded(docs, path_a, path_b, doc_id, text), "alignment-ids")
    counts = scratch(pair_counts(rows, path_a, path_b), "alignment-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    frequent = F.col("count") * FREQUENT >= total
    known = counts.where(frequent).orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("pair", "count", "best")))

    def places(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = shared.value[0]
        at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
        return at, (pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, len_a, len_b = both(path_a, path_b)
        size = max(len(len_a), len(len_b))
        for batch in batches:
            for first, last, ids_a, n_a, ids_b, n_b, x in _chunks(batch, len_a, len_b):
                k = last - first
                text_, pair, n = _pairs(x, k)
                at, seen = places(pair)
                n_best, total_ = np.zeros(k, np.int64), np.zeros(k, np.int64)
                np.add.at(n_best, text_[seen], n[seen] * shared.value[2][at[seen]])
                np.add.at(total_, text_[seen], n[seen] * shared.value[1][at[seen]])
                sha = [hashlib.sha256(s).hexdigest() if s else "" for s in rendered(x, ids_a, n_a, ids_b, n_b, size)]
                rare = ~seen
                cut = pa.array(np.searchsorted(text_[rare], np.arange(k + 1)), pa.int32())
                rest = [pa.ListArray.from_arrays(cut, pa.array(v[rare])) for v in (pair, n)]
                columns = [n_a, n_b, np.bincount(x.group_text, minlength=k), np.bincount(x.link_text, minlength=k), n_best, total_]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, k) for c in (0, 1)), *map(pa.array, columns), pa.array(sha), *rest], names=["_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "_pair", "_n"])

    whole = rows.mapInArrow(run, "_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, _pair array<long>, _n array<long>")
    whole = scratch(whole, "alignment-rows")
    joined = whole.select("_row", F.inline(F.arrays_zip(F.col("_pair").alias("pair"), F.col("_n").alias("n")))).join(counts.where(~frequent), "pair")
    more = joined.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("count")).alias("_sum"))
    add = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
    return whole.join(more, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", add("n_best", "_best"), add("count_sum", "_sum"), "groups_sha256")
