"""LM scoring: prediction by partial matching over byte contexts, and a unigram baseline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm import _bytes as B
from tessel.llm._common import list_array, scratch, small_batches

#: Bytes of context at most.
ORDER = 5
#: Runs of bytes rarer than this share of all are not broadcast but joined; there are at most 1 / SHARE others.
SHARE = 2.0**-21
#: Share of a count that each distinct byte gives to the escape.
DISCOUNT = 0.5
#: Words rarer than this share of all are not broadcast but joined; there are at most 1 / HEAD others.
HEAD = 2.0**-22
#: Stands before each text and ends it; no UTF-8 text holds it.
EDGE = 0xFF
#: Counts that a task gathers before it hands them on.
HELD = 1 << 20
END_WORD = 0x0E0D


# --- counts ---------------------------------------------------------------------------------------------------------


def framed(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with ``order`` edge bytes around each, and the places of their bytes and of one end each."""
    n = len(offsets) - 1
    shift = order * (np.arange(n) + 1)
    out = np.full(len(data) + order * (n + 1), EDGE, dtype=np.uint8)
    lengths = np.diff(offsets)
    out[np.arange(len(data)) + np.repeat(shift, lengths)] = data
    scored = np.ones(len(out), dtype=bool)
    scored[:order] = False
    ends = offsets[1:] + shift
    for k in range(1, order):
        scored[ends + k] = False
    return out, np.flatnonzero(scored)


def grams(framed_data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Each place's byte with its context, as one number."""
    whole = np.zeros(len(framed_data), dtype=np.uint64)
    for k in range(order + 1):
        whole[k:] |= framed_data[: len(framed_data) - k].astype(np.uint64) << np.uint64(8 * k)
    return whole[at]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many words lie before each text."""
    starts, ends, first = B.words(data, offsets)
    return B.hashes(data, starts, ends), first


def corpus_counts(docs: DataFrame, order: int, text: str) -> DataFrame:
    """kind (0: a byte with its context, 1: a word's hash, 2: an end), key and n over all texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        texts = 0

        def out(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

        for batch in batches:
            texts += batch.num_rows
            for _, data, offsets in B.chunks(batch.column(0)):
                data = B.LOWER[data]
                frame, at = framed(data, offsets, order)
                held[0].append(np.unique(grams(frame, at, order), return_counts=True))
                held[1].append(np.unique(text_words(data, offsets)[0], return_counts=True))
                for kind, parts in held.items():
                    if sum(len(keys) for keys, _ in parts) > 2 * HELD:
                        held[kind] = [_merged(parts)]
                        if len(held[kind][0][0]) > HELD:
                            yield out(kind, *held[kind].pop())
        for kind, parts in held.items():
            if parts:
                yield out(kind, *_merged(parts))
        if texts:
            yield out(2, np.zeros(1, np.uint64), np.array([texts]))

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


# --- the trie -------------------------------------------------------------------------------------------------------


class Table:
    """Numbers from 1 by key, 0 for other keys: open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(1.4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
        self.numbers = np.zeros(1 << self.bits, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.numbers[slot] == 0
            self.numbers[slot[free]] = left[free] + 1  # of several for one slot, the last stays
            won = self.numbers[slot] == left + 1
            self.keys[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(B.MULTIPLIER)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        numbers = np.where(self.keys[slot] == keys, self.numbers[slot], 0)
        left = np.flatnonzero((self.keys[slot] != keys) & (self.numbers[slot] != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            here = slot[left]
            match = self.keys[here] == keys[left]
            numbers[left[match]] = self.numbers[here[match]]
            left = left[~match & (self.numbers[here] != 0)]
        return numbers


class Trie:
    """Counts of bytes by context, with what PPM needs of them; escapes by method D and exclusion of symbols.

    A run of k + 1 bytes is a node of length k + 1: its last byte in the context of the k before. Each distinct byte of
    a context gives DISCOUNT of its count to the escape to the context a byte shorter; bytes that a context has are
    excluded from the shorter one's counts. Bytes that no context has share the last escape evenly.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels[k]: keys and counts of the runs of k + 1 bytes. Every run's last k bytes must be a run of the level below.

        Its first k bytes need not be: edge bytes before a text are a context, but no place. They get the count 0.
        """
        self.order = len(levels) - 1
        levels = list(levels)
        for k in range(self.order, 0, -1):
            keys, n = levels[k - 1]
            more = np.setdiff1d(levels[k][0] >> np.uint64(8), keys)
            levels[k - 1] = np.concatenate([keys, more]), np.concatenate([n, np.zeros(len(more), n.dtype)])
        self.index = [Table(keys) for keys, _ in levels]
        size = [len(keys) + 1 for keys, _ in levels]
        counts = [np.concatenate([[0], n]).astype(np.float64) for _, n in levels]
        self.parent: list[np.ndarray] = []  # of a run: the number of its context (a run one shorter; 0 at length 1 is the root)
        total, kinds, gone = [], [], []
        for k, (keys, n) in enumerate(levels):
            context = self.index[k - 1].find(keys >> np.uint64(8)) if k else np.zeros(len(keys), np.int32)
            shorter = self.index[k - 1].find(keys & np.uint64((1 << (8 * k)) - 1)) if k else np.zeros(len(keys), np.int32)
            self.parent.append(context)
            contexts = size[k - 1] if k else 1
            total.append(np.bincount(context, n, contexts))
            kinds.append(np.bincount(context, n > 0, contexts))
            gone.append(np.bincount(context, counts[k - 1][shorter], contexts) if k else np.zeros(1))
        # for a context of length k: log n of bytes, and logs of denominators and escapes, alone or below a longer one
        with np.errstate(divide="ignore", invalid="ignore"):
            self.log_count = [np.log10(np.maximum(c - DISCOUNT, 0)) for c in counts]
            self.whole = [np.log10(t) for t in total]
            self.escape = [np.log10(DISCOUNT * kinds[k]) - self.whole[k] for k in range(len(levels))]
            self.below, self.below_escape = [], []  # by the longer context's number
            for k in range(1, len(levels)):
                shorter = np.zeros(size[k - 1], dtype=np.int64)
                keys = levels[k - 1][0]
                shorter[1:] = self.index[k - 2].find(keys & np.uint64((1 << (8 * (k - 1))) - 1)) if k > 1 else 0
                n, q = total[k - 1][shorter] - gone[k], kinds[k - 1][shorter] - kinds[k]
                self.below.append(np.log10(n))
                self.below_escape.append(np.where(q > 0, np.log10(DISCOUNT * np.maximum(q, 1e-9)) - self.below[-1], 0.0))
        self.known = [t > 0 for t in total]
        whole = self.whole[-1][np.concatenate([[0], self.parent[-1]])]
        self.best = np.where(np.isfinite(whole), self.log_count[-1] - np.where(np.isfinite(whole), whole, 0.0), 0.0)
        self.nothing = -np.log10(np.maximum(256.0 - kinds[0][0], 1.0))

    def score(self, runs: np.ndarray) -> np.ndarray:
        """log10 probability of each run's last byte, given those before."""
        order = self.order
        number = self.index[order].find(runs)
        out = self.best[number]
        left = np.flatnonzero(number == 0)  # the others are seen in the longest context
        runs = runs[left]
        escaped, longer, begun = np.zeros(len(left)), np.zeros(len(left), np.int32), np.zeros(len(left), bool)
        for k in range(order, -1, -1):
            here = self.index[k - 1].find((runs >> np.uint64(8)) & np.uint64((1 << (8 * k)) - 1)) if k else np.zeros(len(left), np.int32)
            known = self.known[k][here]
            whole, escape = self.whole[k][here], self.escape[k][here]
            if k < order:
                whole, escape = np.where(begun, self.below[k][longer], whole), np.where(begun, self.below_escape[k][longer], escape)
                number = self.index[k].find(runs & np.uint64((1 << (8 * (k + 1))) - 1))
                hit = known & (self.log_count[k][number] > -np.inf)
                out[left[hit]] = escaped[hit] + self.log_count[k][number[hit]] - whole[hit]
            else:
                hit = np.zeros(len(left), bool)
            stay = ~hit
            escaped = (escaped + np.where(known, escape, 0.0))[stay]
            begun, longer, left, runs = (begun | known)[stay], here[stay], left[stay], runs[stay]
        out[left] = escaped + self.nothing
        return out


def levels_of(counted: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """From kind-0 counts: key and n of the runs of k + 1 bytes at k; each sums the longer ones without their first byte."""
    levels = [counted.where("kind = 0").select("key", "n")]
    for k in range(order - 1, -1, -1):
        shorter = levels[-1].groupBy(F.col("key").bitwiseAND((1 << (8 * (k + 1))) - 1).alias("key")).agg(F.sum("n").alias("n"))
        levels.append(scratch(shorter, "lm-level"))
    return levels[::-1]


def trie(counted: DataFrame, order: int = ORDER) -> Trie:
    """The whole model of a small corpus in memory; ``score`` works without."""
    levels = []
    for level in levels_of(counted, order):
        kept = level.toArrow()
        keys, n = kept["key"].to_numpy().view(np.uint64), kept["n"].to_numpy()
        by = np.argsort(keys)
        levels.append((keys[by], n[by]))
    return Trie(levels)


# --- runs -----------------------------------------------------------------------------------------------------------


def contexts(level: DataFrame) -> DataFrame:
    """Each context of a level's runs, with the bytes it has and their counts."""
    return level.groupBy(F.shiftright("key", 8).alias("context")).agg(F.collect_list(F.struct(F.col("key").bitwiseAND(255).alias("byte"), "n")).alias("bytes"))


def seen_runs(longest: DataFrame) -> DataFrame:
    """key, n and logp of all runs that the longest contexts have."""
    total = F.aggregate("bytes", F.lit(0).cast("long"), lambda t, x: t + x["n"])
    each = longest.select("context", F.log10(total).alias("whole"), F.explode("bytes").alias("x"))
    return each.select(F.shiftleft("context", 8).bitwiseOR(F.col("x.byte")).alias("key"), "x.n", (F.log10(F.col("x.n") - DISCOUNT) - F.col("whole")).alias("logp"))


def unseen_runs(runs: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """key and logp of runs that the longest context lacks: they escape from context to context, by joins.

    ``tables`` has the contexts by length. Contexts of up to two bytes are 65,793 at most and broadcast: as keys of a
    join, few of them would stand for all runs.
    """
    state = runs.select("key", F.lit(0.0).alias("escaped"), F.array().cast("array<long>").alias("gone"), F.lit(None).cast("double").alias("logp"))
    zero = F.lit(0).cast("long")
    for k in range(len(tables) - 1, -1, -1):
        table = F.broadcast(tables[k]) if k <= 2 else tables[k]
        at = state.withColumn("context", F.shiftright("key", 8).bitwiseAND((1 << (8 * k)) - 1)).join(table, "context", "left")
        sums = F.aggregate(
            "bytes", F.struct(zero.alias("total"), zero.alias("kinds"), zero.alias("own")),
            lambda a, x: F.when(F.array_contains("gone", x["byte"]), a).otherwise(F.struct((a["total"] + x["n"]).alias("total"), (a["kinds"] + 1).alias("kinds"), F.when(x["byte"] == F.col("key").bitwiseAND(255), x["n"]).otherwise(a["own"]).alias("own"))),
        )
        at = at.withColumn("s", F.when(F.col("logp").isNull(), sums))
        whole = F.log10("s.total")
        state = at.select(
            "key", F.when(F.col("s.total") > 0, F.col("escaped") + F.log10(DISCOUNT * F.col("s.kinds")) - whole).otherwise(F.col("escaped")).alias("escaped"),
            F.coalesce(F.col("bytes.byte"), F.col("gone")).alias("gone"),
            F.coalesce(F.col("logp"), F.when(F.col("s.own") > 0, F.col("escaped") + F.log10(F.col("s.own") - DISCOUNT) - whole)).alias("logp"),
        )
    return state.select("key", F.coalesce("logp", F.col("escaped") - F.log10(F.greatest(256.0 - F.size("gone"), F.lit(1.0)))).alias("logp"))


# --- scores ---------------------------------------------------------------------------------------------------------


def score(docs: DataFrame, learn_from: Column, order: int = ORDER, share: float = SHARE, head: float = HEAD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Texts are lower-cased from A to Z. ``score`` is the log10 probability of a text's bytes and its end under a PPM model
    of the bytes of all rows for which ``learn_from`` is true; ``base_score`` the same of its words and its end under a
    smoothed unigram model of these rows. Null texts are empty and have an end only; without rows to learn from, bytes
    are equally likely. Repeated rows are learned from, and scored, each. Words count by 64-bit hashes.

    Counts combine in the tasks before the shuffle. Scores of runs of bytes that make up ``share`` of the corpus or more,
    and the words above ``head``, are broadcast, so that is bounded at any scale. Rarer words meet their counts, and rarer
    runs their scores, in joins; the scores are worked out for each distinct run from the counts of all runs.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(learn_from, F.lit(False)).alias("learn"), F.col(text).alias("text"))
    counted = scratch(corpus_counts(rows.where("learn"), order, "text"), "lm-counts")
    total = counted.where("kind > 0").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, v = total["n"] or 0, total["v"]
    ends = (counted.where("kind = 2").agg(F.sum("n")).first()[0]) or 0
    denominator = float(np.log10(n_all + 0.5 * (v + 1)))
    words = counted.where("kind = 1").select("key", "n")
    frequent = words.where(F.col("n") >= head * n_all).toArrow()
    keys, counts = frequent["key"].to_numpy().view(np.uint64), frequent["n"].to_numpy()
    levels = levels_of(counted, order)
    longest = scratch(contexts(levels[order]), "lm-contexts")
    seen = seen_runs(longest)
    least = share * (levels[0].agg(F.sum("n")).first()[0] or 0)
    common = seen.where(F.col("n") >= least).select("key", "logp").toArrow()
    runs, logps = common["key"].to_numpy().view(np.uint64), common["logp"].to_numpy()
    model = spark.sparkContext.broadcast((Table(runs), np.concatenate([[0.0], logps]), Table(keys), np.concatenate([[0], counts])))
    small_batches(spark)
    end_score = float(np.log10(ends + 0.5)) - denominator
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, common double, rare array<long>, runs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, logp, index, numbers = model.value
        logs = np.log10(numbers + 0.5) - denominator
        for batch in batches:
            if not batch.num_rows:
                continue
            known, base, scores, tokens, rare, others = [], [], [], [], [], []
            for _, data, offsets in B.chunks(batch.column(2)):
                data = B.LOWER[data]
                frame, at = framed(data, offsets, order)
                begin = offsets + np.arange(len(offsets))
                run = grams(frame, at, order)
                place = places.find(run)
                scores.append(np.add.reduceat(logp[place], begin[:-1]))
                before = np.concatenate([[0], np.cumsum(place == 0)])
                others.append(list_array(before[begin], run[place == 0].view(np.int64)))
                hashes, first = text_words(data, offsets)
                found = index.find(hashes)
                sums = np.concatenate([[0.0], np.cumsum(np.where(found > 0, logs[found], 0.0))])
                hits = np.concatenate([[0], np.cumsum(found > 0)])
                base.append(sums[first[1:]] - sums[first[:-1]] + end_score)
                known.append(hits[first[1:]] - hits[first[:-1]] + (ends > 0))
                tokens.append(np.diff(first) + 1)
                misses = np.concatenate([[0], np.cumsum(found == 0)])
                rare.append(list_array(misses[first], hashes[found == 0].view(np.int64)))
            join = np.concatenate
            held_out = pa.compute.invert(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), held_out, *(pa.array(join(x)) for x in (tokens, known, base, scores)), pa.concat_arrays(rare), pa.concat_arrays(others)], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "common", "rare", "runs"])

    scored = rows.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id())
    scored = scratch(scored, "lm-scored")
    tail = scored.select("_row", F.explode("rare").alias("key")).join(words.where(F.col("n") < head * n_all), "key")
    tail = tail.groupBy("_row").agg(F.count("*").alias("found"), F.sum(F.log10(F.col("n") + 0.5)).alias("logs"))
    others = scored.select("_row", F.explode("runs").alias("key"))
    looked_up = scratch(others.select("key").distinct().join(seen.where(F.col("n") < least).select("key", "logp"), "key", "left"), "lm-runs")
    missed = unseen_runs(looked_up.where("logp IS NULL").select("key"), [contexts(x) for x in levels[:order]] + [longest])
    joined = others.join(looked_up.where("logp IS NOT NULL").unionByName(missed), "key").groupBy("_row").agg(F.sum("logp").alias("joined"))
    both = scored.select("*", F.size("rare").alias("n_rare")).drop("rare", "runs").join(tail, "_row", "left").join(joined, "_row", "left")
    found, logs = F.coalesce("found", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + found).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + logs + (F.col("n_rare") - found) * float(np.log10(0.5)) - F.col("n_rare") * denominator).alias("base_score"),
        (F.col("common") + F.coalesce("joined", F.lit(0.0))).alias("score"),
    )
