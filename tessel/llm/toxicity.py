"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm import _bytes as B
from tessel.llm._common import scratch, small_batches, text_or_empty

#: Coordinates that features are hashed to: powers of two.
BITS = 20
#: Labelled rows that a model is fitted on at most, chosen by hash, and the features that these may have in all (128 MB).
SAMPLE, SAMPLE_FEATURES = 8_000, 1 << 25
#: Rates of learning, penalties and passes.
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 4.0, 0.1, 3
#: Bytes of a word's beginnings that are features besides the word: inflected forms then share coordinates.
STEMS = (4, 6)

#: True for the bytes of no word: all ASCII but digits and lower-case letters.
_BLANK = np.ones(256, dtype=bool)
_BLANK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Text and coordinate of every feature of texts given as UTF-8 bytes: words with A-Z lower-cased, their beginnings,
    pairs of neighbours, and pairs with one or two words between."""
    data = B.LOWER[data]
    starts, ends, first = B.words(data, offsets, _BLANK)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    words = B.hashes(data, starts, ends)
    texts, keys = [of], [words]
    for size in STEMS:
        long = np.flatnonzero(ends - starts > size)
        texts.append(of[long])
        keys.append(B.mix(B.hashes(data, starts[long], starts[long] + size) + np.uint64(size)))
    for gap in (1, 2, 3):
        pairs = np.flatnonzero(of[gap:] == of[:-gap])
        texts.append(of[pairs])
        keys.append(B.mix(words[pairs] * np.uint64(2 * gap + 1) + words[pairs + gap]))
    return np.concatenate(texts), (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64)


class Weights(NamedTuple):
    """The coordinates that kept a weight, in order, and these weights."""

    start: float
    at: np.ndarray
    value: np.ndarray
    bits: int = BITS

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: each coordinate that a text has counts once."""
        n = len(offsets) - 1
        total = np.full(n, self.start)
        if len(self.at) and len(data):
            known = np.zeros(1 << self.bits, dtype=bool)
            known[self.at] = True
            texts, keys = features(data, offsets, self.bits)
            some = known[keys]
            both = np.unique((texts[some] << self.bits) | keys[some])
            total += np.bincount(both >> self.bits, self.value[np.searchsorted(self.at, both & ((1 << self.bits) - 1))], n)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(rows: list[tuple[np.ndarray, float]], bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, passes: int = PASSES) -> Weights:
    """Weights from (coordinates, label) rows, one at a time in their order, several times over.

    Each coordinate has a rate of its own, which falls with the gradients that it has seen; it keeps a weight only where
    its gradients add up to more than ``l1``. The start, which all texts share, has no penalty. Without rows, the score is
    one half; with one label only, the labels' smoothed share.
    """
    ones = sum(y for _, y in rows)
    start = float(np.log((ones + 1) / (len(rows) - ones + 1)))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = bias = 0.0
    if not 0 < ones < len(rows):
        return Weights(start, np.zeros(0, np.int64), np.zeros(0), bits)

    def weights(z, n):
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    for _ in range(passes):
        for at, y in rows:
            z_at, n_at = z[at], n[at]
            w = weights(z_at, n_at)
            g = 1 / (1 + np.exp(-np.clip(start + bias + w.sum(), -500, 500))) - y
            more = n_at + g * g
            z[at] = z_at + g - (np.sqrt(more) - np.sqrt(n_at)) / alpha * w
            n[at] = more
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
            bias = -bias_z * alpha / (beta + np.sqrt(bias_n))
    at = np.flatnonzero(np.abs(z) > l1)
    return Weights(start + bias, at, weights(z[at], n[at]), bits)


def _featured(docs: DataFrame, bits: int) -> DataFrame:
    """_i, _at (distinct coordinates as little-endian 32-bit integers) and _n (how many) of (_i, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in B.chunks(batch.column(1)):
                texts, keys = features(data, offsets, bits)
                both = np.unique((texts << bits) | keys)
                cut = np.searchsorted(both >> bits, np.arange(len(offsets)))
                at = (both & ((1 << bits) - 1)).astype("<u4")
                blobs = [at[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(blobs)), pa.array(blobs, pa.binary()), pa.array(np.diff(cut), pa.int64())], names=["_i", "_at", "_n"])

    return docs.mapInArrow(run, "_i long, _at binary, _n long")


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, most: int = SAMPLE_FEATURES, bits: int = BITS) -> Weights:
    """Weights fitted on labelled documents whose doc_id (as ``doc_id``) is ``usable``: at most ``sample`` labels, chosen by
    hash, and of these, in that order, as many as have ``most`` features together.

    The chosen ids are broadcast (``sample`` bounds them), and one task fits on their features (``most`` bounds these); only
    the weights that are left reach the driver. A document that has several labels learns from each, rows that share an id
    learn alike; null labels and ids are left out.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), (F.col(label) > 0).cast("double").alias("_y")).where(usable)
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = scratch(known.orderBy(order, "doc_id", "_y").limit(sample).withColumn("_order", order), "toxicity-labels")
    body = docs.select(F.col(doc_id).cast("long").alias("_i"), text_or_empty(F.col(text)).alias("text"))
    some = body.join(F.broadcast(chosen.select("doc_id").distinct()), F.col("_i") == F.col("doc_id"), "left_semi")
    rows = scratch(_featured(some, bits), "toxicity-features")
    rows = rows.join(F.broadcast(chosen), F.col("_i") == F.col("doc_id"))
    # a repeated id could bring more rows than labels: the bound on features holds for these as well
    few = rows.select("_order", "_i", "_y", "_at", "_n").orderBy("_order", "_i", "_y", F.xxhash64("_at")).limit(sample)
    few = few.withColumn("_sum", F.sum("_n").over(Window.orderBy("_order", "_i", "_y", F.xxhash64("_at")).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else schema.empty_table()
        place = np.lexsort((table["_at_h"].to_numpy(), table["_y"].to_numpy(), table["_order"].to_numpy()))
        blobs, y = table["_at"].to_pylist(), table["_y"].to_numpy()
        w = fit([(np.frombuffer(blobs[k], "<u4").astype(np.int64), float(y[k])) for k in place], bits)
        yield pa.RecordBatch.from_arrays([pa.array([w.start]), pa.array([w.at.tolist()], pa.list_(pa.int64())), pa.array([w.value.tolist()], pa.list_(pa.float64()))], names=["start", "at", "value"])

    schema = pa.schema([("_order", pa.int64()), ("_y", pa.float64()), ("_at", pa.binary()), ("_at_h", pa.int64())])
    got = few.select("_order", "_y", "_at", F.xxhash64("_at").alias("_at_h")).repartition(1).mapInArrow(run, "start double, at array<long>, value array<double>").toArrow().to_pylist()
    if not got:
        return fit([], bits)
    return Weights(got[0]["start"], np.array(got[0]["at"], np.int64), np.array(got[0]["value"], np.float64), bits)


def score(docs: DataFrame, weights: Weights, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (the probability of label 1) of every row; whole texts count, null ones as empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.concatenate([shared.value.scores(data, offsets) for _, data, offsets in B.chunks(batch.column(1))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id and score of every row of ``docs``, learned from labelled rows for which ``usable`` (on doc_id) is true.

    Only texts are inputs of a score. Null and empty texts have no features and get the score that all texts start from;
    equal texts get equal scores, whatever their length; rows without an id are scored, too; other columns, of any name,
    play no part; without labels every score is one half; empty tables give none.
    """
    return score(docs, train(docs, labels, usable, label, doc_id, text, sample), doc_id, text)
