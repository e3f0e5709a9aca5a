"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm._common import arrow_map, small_batches

LENGTH = 1024
#: Open bins of a task.
OPEN = 4096
#: The token after every document: a fixed value of the contract.
LAST = 2
SPECIAL = "<|endoftext|>"
#: Below this code point, every Unicode version agrees on letters, numbers and spaces.
AGREED = 0x250


class ByteBpe:
    """Byte-level BPE by tiktoken, whose ids are those of the tokenizers library; texts with characters on which the two
    may hold different Unicode versions go to the latter."""

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        from tessel.llm.bpe import byte_names

        names = byte_names()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(names[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        # the pattern of byte-level pre-tokenizers
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.exact, self.special = Tokenizer.from_file(path), special
        self.rare = regex.compile(rf"[^\x00-\u{AGREED - 1:04x}‐-‧€]")

    def encode(self, text: str) -> np.ndarray:
        if not text.isascii() and self.rare.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if any(s in text for s in self.special):
            return np.array(self.fast.encode(text, allowed_special=set(self.special)), dtype=np.uint32)
        return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)


@cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens: all full but the first."""
    first = (n - 1) % length + 1
    return [(0, first), *((at, length) for at in range(first, n, length))]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, last: int | None = LAST, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 (and ids, if kept) of every row's tokens; null texts are empty.

    An empty text is its end token, or, without one, has no piece. Repeated rows are cut each; empty tables give none.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int64())] if keep_ids else [])]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, rows = byte_bpe(path), []
        for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = bpe.encode(body or "")
            ids = np.append(ids, np.uint32(last)) if last is not None else ids
            raw = memoryview(ids.astype("<u4").tobytes())
            for k, (at, n) in enumerate(cut(len(ids), length) if len(ids) else ()):
                rows.append((key, k, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), *([ids[at : at + n].tolist()] if keep_ids else [])))
        columns = zip(*rows) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=[x.split()[0] for x in schema.split(", ")])

    return arrow_map(docs.selectExpr(f"CAST(`{doc_id}` AS LONG) AS doc_id", f"`{text}` AS text"), run, schema)


class Bins:
    """Open bins of one task by free space; bit f of the set says that a bin with f free tokens is open."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.opened, self.open = length, most, 0, 0
        self.set, self.free = 0, [[] for _ in range(length + 1)]

    def put(self, n: int) -> tuple[int, int]:
        """Number of the bin in which n tokens fit best, and the place there; the fullest closes if too many are open."""
        if fits := self.set >> n:
            room = n + (fits & -fits).bit_length() - 1
            number = self._take(room)
        else:
            if self.open >= self.most:
                self._take((self.set & -self.set).bit_length() - 1)
            number, room = self.opened, self.length
            self.opened += 1
        if room > n:
            self.free[room - n].append(number)
            self.set |= 1 << (room - n)
            self.open += 1
        return number, self.length - room

    def _take(self, room: int) -> int:
        number = self.free[room].pop()
        self.open -= 1
        if not self.free[room]:
            self.set ^= 1 << room
        return number


def pack(cut_up: DataFrame, length: int = LENGTH, most: int = OPEN) -> DataFrame:
    """Adds sequence_id and offset to pieces: each task packs its share online by best fit.

    Pieces are dealt by the hash of what they hold and come in that order, so a task that runs again packs alike.
    A task holds ``most`` bins at once; sequence ids count up from the task's number times 2**40. Pieces of rows without a
    doc_id, repeated pieces and ties are packed each; an empty table has no sequences; other columns pass, but for the two
    that are added.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_up.schema) + ", sequence_id long, offset long"
    order = F.xxhash64("doc_id", "piece", "length", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = Bins(length, most), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.put(n) for n in batch.column("length").to_pylist()]
            more = [pa.array([first + number for number, _ in placed], pa.int64()), pa.array([at for _, at in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "sequence_id", "offset"])

    dealt = cut_up.withColumn("_order", order).repartition("_order").sortWithinPartitions("_order", "doc_id", "piece", "start")
    return dealt.drop("_order").mapInArrow(run, schema)
