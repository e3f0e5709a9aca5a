"""Counts of BPE tokens of prompts, with the work done once for each distinct word that a worker remembers."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Runs of letters, of digits, and of anything else but spaces.
WORD = r"\p{L}+|\p{Nd}+|[^\p{L}\p{Nd}\s\p{Z}\x1c-\x1f\x85]+"
END = "</w>"
#: Tokens of a prompt at most; longer ones are cut off before their end token.
MOST = 77
#: Words that a worker remembers, the characters of one, and words that are counted together.
WORDS, LETTERS, TOGETHER = 200_000, 64, 1 << 17

Merges = Mapping[tuple[str, str], int]


@cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary: its own if it prints, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


@cache
def read_merges(path: str) -> Merges:
    """The merges of a vocabulary file in the JSON form of the tokenizers library, with their ranks."""
    with open(path, encoding="utf-8") as file:
        listed = json.load(file)["model"]["merges"]
    return {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): rank for rank, m in enumerate(listed)}


def symbols(word: str) -> list[str]:
    """A word's bytes as letters, the last one marked as the word's end."""
    letters = [byte_letters()[b] for b in word.encode("utf-8")]
    return [*letters[:-1], letters[-1] + END] if letters else []


def merged(parts: Sequence[str], merges: Merges) -> list[str]:
    """The tokens of a word: neighbours of the lowest rank are joined, from the left, until none have a rank.

    A heap holds the neighbours that have one, so that a very long word takes little more than its length.
    """
    held: list[str | None] = list(parts)
    n = len(held)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    todo = [(merges[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in merges]
    heapify(todo)
    while todo:
        rank, i = heappop(todo)
        j = after[i]
        if held[i] is None or j >= n or merges.get((held[i], held[j])) != rank:
            continue  # one of the two has been joined since
        held[i], held[j], after[i] = held[i] + held[j], None, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (rank := merges.get((held[k], held[after[k]]))) is not None:
                heappush(todo, (rank, k))
    return [x for x in held if x is not None]


@cache
def remembered(path: str) -> dict[str, int]:
    """A worker's words and their numbers of tokens."""
    return {}


def word_sizes(words: pa.Array, merges: Merges, known: dict[str, int]) -> np.ndarray:
    """The number of tokens of each word, with ``known`` used and added to; it is cleared where it is full."""
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    sizes = [known.get(w) or len(merged(symbols(w), merges)) for w in distinct]
    if len(known) + len(distinct) > WORDS:
        known.clear()
    known.update((w, n) for w, n in zip(distinct, sizes) if len(w) <= LETTERS)
    return np.array(sizes, np.int64)[coded.indices.to_numpy()]


def token_counts(docs: DataFrame, row: str, text: str, path: str, most: int = MOST) -> DataFrame:
    """row, tokens (with start and end) and clipped (at most ``most``) of every row.

    ``path`` is a vocabulary's file on every machine. Texts are lower-cased; null ones have a start and an end. Rows that
    share an id have the tokens of all of them. Words stay in the task that reads them, and only their counts are shuffled.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))

    def run(batches):
        merges, known = read_merges(path), remembered(path)
        for batch in batches:
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy())
            first = 0
            while first < batch.num_rows:
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + TOGETHER, side="right")))
                ids, words = batch.slice(first, last - first).columns
                total = np.concatenate([[0], np.cumsum(word_sizes(words.flatten(), merges, known))])
                cut = np.concatenate([[0], ends[first:last] - before])
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(total[cut]))], names=[row, "k"])
                first = last

    counts = docs.select(row, found.alias("words")).mapInArrow(run, StructType([StructField(row, docs.schema[row].dataType), StructField("k", LongType())]))
    sums = counts.groupBy(row).agg(F.sum("k").alias("k"))
    total = F.coalesce("k", F.lit(0)) + 2
    return docs.select(row).join(sums, row, "left").select(row, total.cast("long").alias("tokens"), F.least(total, F.lit(most)).cast("long").alias("clipped"))
