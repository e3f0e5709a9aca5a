"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm import _bytes as B
from tessel.llm._common import scratch, small_batches

#: Labelled rows that a model is fitted on at most, chosen by hash: enough for trees of this size, and bounded.
SAMPLE = 20_000
ROUNDS, DEPTH, BINS, RATE = 80, 4, 64, 0.15
#: Least sum of second derivatives in a leaf, and what is added to it.
LEAST, RIDGE = 2.0, 1.0

# --- statistics -----------------------------------------------------------------------------------------------------

FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "word_spread", "upper", "digits", "symbols", "points", "stops", "high", "controls", "log_lines", "words_per_line", "short_lines",
    "distinct_words", "distinct_pairs", "distinct_lines", "top_word", "capitalized", "shouted", "odd_ends", "bangs", "bars", "tags",
)


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=np.float64)
    table[[ord(c) for c in chars]] = 1
    return table


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASSES = {
    "upper": _UPPER, "digits": _class("0123456789"), "symbols": _class("#*$%&|<>@^~=+_{}[]\\/"), "points": _class(".,;:?()'\"-"), "stops": _class(".?!"),
    "high": (np.arange(256) >= 128).astype(np.float64), "controls": (np.arange(256) < 32).astype(np.float64), "bangs": _class("!"), "bars": _class("|"), "tags": _class("<>"),
}


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def _distinct(keys: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct keys each text has, and how often its most frequent one stands."""
    order = np.argsort((of.astype(np.uint64) << np.uint64(44)) | (keys >> np.uint64(20)))
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    most = np.zeros(n)
    if len(first):
        np.maximum.at(most, of[first], np.diff(np.append(first, len(keys))))
    return np.bincount(of[first], minlength=n).astype(np.float64), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    some = np.maximum(size, 1)
    share = {}
    for name, table in _CLASSES.items():
        share[name] = _sums(table[data], offsets) / some
    starts, ends, first = B.words(data, offsets)
    words = np.diff(first).astype(np.float64)
    any_word = np.maximum(words, 1)
    of = np.repeat(np.arange(n), np.diff(first))
    length = (ends - starts).astype(np.float64)
    mean = _sums(length, first) / any_word
    spread = np.sqrt(np.maximum(_sums(length**2, first) / any_word - mean**2, 0))
    hashes = B.hashes(B.LOWER[data], starts, ends)
    kinds, most = _distinct(hashes, of, n)
    pairs = np.flatnonzero(of[1:] == of[:-1])
    two, _ = _distinct(B.mix(hashes[pairs] * np.uint64(3) + hashes[pairs + 1]), of[pairs], n)
    # a padded byte stands for what lies beyond a chunk
    upper = np.append(_UPPER[data], 0.0)
    capital = upper[starts]
    ups = np.concatenate([[0.0], np.cumsum(upper)])
    shouted = (ups[ends] - ups[starts] >= 3) & (ups[ends] - ups[starts] >= 0.6 * length)
    last = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(0, np.uint8)
    odd = _CLASSES["symbols"][last]
    newline = np.zeros(256, dtype=bool)
    newline[10] = True
    l_start, l_end, l_first = B.words(data, offsets, newline)
    lines = np.diff(l_first).astype(np.float64)
    any_line = np.maximum(lines, 1)
    l_of = np.repeat(np.arange(n), np.diff(l_first))
    l_kinds, _ = _distinct(B.hashes(data, l_start, l_end), l_of, n)
    return np.stack([
        np.log1p(size), np.log1p(words), mean, spread, *(share[k] for k in ("upper", "digits", "symbols", "points", "stops", "high", "controls")),
        np.log1p(lines), words / any_line, _sums((l_end - l_start < 30).astype(np.float64), l_first) / any_line,
        kinds / any_word, two / np.maximum(words - 1, 1), l_kinds / any_line, most / any_word,
        _sums(capital, first) / any_word, _sums(shouted.astype(np.float64), first) / any_word, _sums(odd, first) / any_word, *(share[k] for k in ("bangs", "bars", "tags")),
    ], axis=1)


def _batch_statistics(texts: pa.Array) -> np.ndarray:
    return np.concatenate([statistics(data, offsets) for _, data, offsets in B.chunks(texts)]).astype(np.float32)


# --- trees ----------------------------------------------------------------------------------------------------------


class Trees(NamedTuple):
    """All trees, flattened: node i of a full binary tree has the children 2 i + 1 and 2 i + 2; a leaf leads on to itself
    by an infinite threshold on its left."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of statistics."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.ndim == 2 else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node[0] < inner:  # all rows are at one depth
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosts trees on the logistic loss; splits are sought in histograms of each feature's quantile bins.

    Without rows, or with one label only, there is no tree and every score is the labels' smoothed share.
    """
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    inner, leaves = 2**depth - 1, 2**depth
    empty = Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y) or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    d = x.shape[1]
    total = np.full(len(y), start)
    features, thresholds, values = [], [], []
    flat = binned + np.arange(d) * bins
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        split_bin = np.full(inner, bins)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            key = ((node - base)[:, None] * (d * bins) + flat).ravel()
            hist = [np.bincount(key, np.repeat(v, d), width * d * bins).reshape(width, d, bins) for v in (g, h)]
            left = [np.cumsum(v, axis=2) for v in hist]
            whole = [v[:, :1, -1:] for v in left]
            right = [w - v for w, v in zip(whole, left)]
            gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - whole[0] ** 2 / (whole[1] + RIDGE)
            gain[(left[1] < LEAST) | (right[1] < LEAST)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[base + k], threshold[base + k], split_bin[base + k] = j, cuts[j][b], b
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split_bin[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(start, np.array(features), np.array(thresholds), np.array(values))


# --- Spark ----------------------------------------------------------------------------------------------------------


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and x (FEATURES as an array of float) of every row; null texts are empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _batch_statistics(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], names=["doc_id", "x"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, x array<float>")


def train(measured: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", doc_id: str = "doc_id", sample: int = SAMPLE) -> Trees:
    """Trees fitted on the rows of ``measured`` that have a label and are usable: ``sample`` of them at most, by hash.

    A document that has several labels learns from each; null labels and ids are left out.
    """
    known = labels.where(F.col(label).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), (F.col(label) > 0).cast("double").alias("_y"))
    rows = measured.where(usable).join(known, "doc_id").select("x", "_y", F.xxhash64("doc_id", F.lit(7)).alias("_h")).orderBy("_h", "_y", "x").limit(sample).toArrow()
    y = rows["_y"].to_numpy()
    x = np.asarray(rows["x"].combine_chunks().flatten() if len(y) else [], dtype=np.float32).reshape(len(y), len(FEATURES))
    return fit(x, y)


def train_on(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Trees:
    """Trees for ``docs`` from at most ``sample`` labels, chosen by hash; only documents with these are measured.

    The chosen ids are broadcast: ``sample`` bounds them.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("_i"), (F.col(label) > 0).cast("int").alias("quality"))
    chosen = scratch(chosen.orderBy(F.xxhash64("_i", F.lit(7)), "quality").limit(sample), "classifier-labels")
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    some = body.join(F.broadcast(chosen.select("_i").distinct()), F.col("doc_id") == F.col("_i"), "left_semi")
    return train(scratch(with_statistics(some), "classifier-statistics"), chosen.withColumnRenamed("_i", "doc_id"), F.lit(True), sample=sample)


def score(measured: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and score (the probability of label 1) of every row of ``with_statistics``."""
    shared = measured.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(x))], names=["doc_id", "score"])

    return measured.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id and score of every row of ``docs``, learned from labelled rows for which ``usable`` (on doc_id) is true.

    Every whole text is measured once; the statistics are written to the shared folder and used for both steps. Null
    texts are empty and get a score as well; repeated rows get equal scores; empty tables give none.
    """
    measured = scratch(with_statistics(docs, doc_id, text), "classifier-statistics")
    return score(measured, train(measured, labels, usable, label, doc_id, sample))


def keep_good(docs: DataFrame, trees: Trees, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with all their columns, of any name.

    Null texts are empty and scored as such; ties stay; repeated rows stay or go together; empty tables give none.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(shared.value.scores(_batch_statistics(batch.column(at))) >= least))

    return docs.mapInArrow(run, docs.schema)
