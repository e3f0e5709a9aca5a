"""License scans: rolling word pairs vote for the diagonals on which a template lies in a text."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm import _bytes as B
from tessel.llm._common import arrow_map, list_array, scratch, small_batches

#: True for bytes that are no part of a word, once A-Z are lower-cased: all ASCII but digits and letters.
BLANK = np.arange(256) < 0x80
BLANK[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
#: Fixed phrases of the contract: every place counts.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages of well-known license notices; part of one suffices for its label.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under the gnu general public license version 3": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under a creative commons attribution international license": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "all rights reserved no part of this may be reproduced": "all-rights-reserved",
}
#: Pairs of only these words cast no vote for a passage: they stand everywhere.
COMMON = frozenset("a all an and are as by for in is it no of on or that the this to under with you".split())
#: Neighbouring diagonals this near are one place, moved by words put in or left out.
GAP = 6
#: Share of a passage's pairs that makes a match.
SHARE = 0.6


def _positions(phrases: Mapping[str, str], templates: Mapping[str, str]) -> list[tuple]:
    """(a, b, t_pos, template, label, fixed, votes_of) for each word pair of each template that may vote."""
    rows = []
    for number, (text, label) in enumerate([*phrases.items(), *templates.items()]):
        words, fixed = text.split(" "), text in phrases
        pairs = [(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:])) if fixed or not (a in COMMON and b in COMMON)]
        rows += [(a, b, i, number, label, fixed, len(pairs)) for i, a, b in pairs]
    return rows


class Pairs:
    """The distinct word pairs of all templates, numbered, and where they stand in texts."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = [(a.encode(), b.encode()) for a, b in pairs]
        found = [self._word_hashes(a + b" " + b) for a, b in self.pairs]
        keys = self._joined(np.array([x[0] for x in found], np.uint64), np.array([x[1] for x in found], np.uint64)) if found else np.zeros(0, np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    @staticmethod
    def _word_hashes(text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = B.words(data, np.array([0, len(data)]), BLANK)
        return B.hashes(data, starts, ends)

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * np.uint64(B.MULTIPLIER) + b

    def stand(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts' numbers of words; text, place (in words) and pair of each hit. Hashes find hits; the words decide."""
        starts, ends, first = B.words(data, offsets, BLANK)
        counts = np.diff(first)
        none = np.zeros(0, np.int64)
        if len(starts) < 2 or not len(self.keys):
            return counts, none, none, none
        h = B.hashes(data, starts, ends)
        rolling = self._joined(h[:-1], h[1:])
        slot = np.minimum(np.searchsorted(self.keys, rolling), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[slot] == rolling)
        text = np.searchsorted(first, at, side="right") - 1
        within = at + 1 < first[text + 1]  # both words in one text
        at, text = at[within], text[within]
        pair = self.order[slot[at]]
        same = np.zeros(len(at), dtype=bool)
        for k in np.unique(pair):
            here = np.flatnonzero(pair == k)
            fits = np.ones(len(here), dtype=bool)
            for word, shift in zip(self.pairs[k], (0, 1)):
                begin, length = starts[at[here] + shift], ends[at[here] + shift] - starts[at[here] + shift]
                fits &= length == len(word)
                inside = np.minimum(begin[:, None] + np.arange(len(word)), len(data) - 1)
                fits &= (data[inside] == np.frombuffer(word, np.uint8)).all(axis=1)
            same[here] = fits
        return counts, text[same], (at - first[text])[same], pair[same]


def _rising(hits: Column) -> Column:
    """The most hits, in order of place, whose positions in the template rise (the longest rising run of a sorted array)."""

    def taken(tails: Column, hit: Column) -> Column:
        lower = F.filter(tails, lambda t: t < hit["t_pos"])
        return F.concat(lower, F.array(hit["t_pos"]), F.slice(tails, F.size(lower) + 2, F.greatest(F.size(tails) - F.size(lower) - 1, F.lit(0))))

    return F.size(F.aggregate(hits, F.array().cast("array<int>"), taken))


def spans(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, share: float = SHARE, gap: int = GAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, base (label, start), spans (label, template, start, end, share) and score of every row.

    The hashes of all rolling word pairs of a text are looked up among those of the templates' pairs, and the words
    confirm a hit; hits are joined with the templates' positions. Pairs of one template on one diagonal (position in the
    text less that in the template) add up to votes. A phrase of the contract stands where all its pairs vote. A passage
    may stand where ``gap`` + 1 neighbouring diagonals together reach ``share`` of its pairs; such a place is verified:
    its hits are sought out again, and of the passage's pairs those count that stand there in the passage's order, each
    once. Of places that overlap the best one is a span, the first among equals. ``start`` and ``end`` are words from 0.
    ``score`` is 1 where a phrase stands, else the largest share of a passage's pairs that stand in order at a place or
    on one diagonal, 0 without any. Phrases and passages have two words or more; they are part of the code, so
    broadcasting them is bounded. A place is no wider than its passage and ``gap`` words.

    Null texts are empty; a text without words has 0 words and no spans; equal rows get equal results; empty tables none.
    """
    spark = docs.sparkSession
    table = _positions(phrases, templates)
    known = sorted({(a, b) for a, b, *_ in table})
    number = {pair: k for k, pair in enumerate(known)}
    pairs = Pairs(known)
    small_batches(spark)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, hits = [], []
        for _, data, offsets in B.chunks(batch.column(1)):
            n, of, at, pair = pairs.stand(B.LOWER[data], offsets)
            counts.append(n)
            both = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(pair.astype(np.int32))], names=["pos", "pair"])
            hits.append(list_array(np.searchsorted(of, np.arange(len(n) + 1)), both))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts)), pa.concat_arrays(hits)], names=["doc_id", "n_words", "hits"])

    rows = arrow_map(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, hits array<struct<pos:int,pair:int>>")
    rows = scratch(rows.withColumn("_row", F.monotonically_increasing_id()), "license-hits")
    positions = spark.createDataFrame([(number[a, b], *rest) for a, b, *rest in table], "pair int, t_pos int, template int, label string, fixed boolean, votes_of int")
    hits = rows.where(F.size("hits") > 0).select("_row", F.explode("hits").alias("x")).select("_row", "x.*").join(F.broadcast(positions), "pair")
    hits = hits.withColumn("diagonal", F.col("pos") - F.col("t_pos"))
    place = ["_row", "template", "label", "votes_of"]
    votes = hits.groupBy(*place, "fixed", "diagonal").agg(F.count("*").alias("votes"))
    near = Window.partitionBy("_row", "template").orderBy("diagonal")
    # the best place among those that overlap is sought after their verification; a place begins at its first diagonal
    bands = votes.where("NOT fixed").withColumn("votes", F.sum("votes").over(near.rangeBetween(0, gap))).where(F.col("votes") >= share * F.col("votes_of"))
    bands = bands.select("_row", "template", F.col("diagonal").alias("band"))
    within = hits.where("NOT fixed").select(*place, "t_pos", "pos", F.explode(F.sequence(F.col("diagonal") - gap, F.col("diagonal"))).alias("band"))
    found = within.join(bands, ["_row", "template", "band"]).groupBy(*place, "band").agg(F.sort_array(F.collect_list(F.struct("pos", (-F.col("t_pos")).alias("back"), "t_pos"))).alias("hits"))
    found = found.select(*place, "band", (_rising(F.col("hits")) / F.col("votes_of")).alias("share"), F.col("hits")[0]["pos"].alias("start"), (F.element_at("hits", -1)["pos"] + 2).alias("end"))
    around = Window.partitionBy("_row", "template").orderBy("band").rangeBetween(-gap, gap)
    verified = found.where(F.col("share") >= share).withColumn("best", F.max(F.struct("share", (-F.col("band")).alias("b"))).over(around))
    span = F.when(F.col("best.b") == -F.col("band"), F.struct("start", "end", "label", "template", "share"))
    passages = verified.groupBy("_row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    base = F.collect_list(F.when(F.expr("fixed AND votes = votes_of"), F.struct(F.col("diagonal").alias("start"), "label")))
    share_of = F.when(F.col("fixed"), F.when(F.col("votes") == F.col("votes_of"), 1.0)).otherwise(F.col("votes") / F.col("votes_of"))
    single = votes.groupBy("_row").agg(F.sort_array(base).alias("base"), F.max(share_of).alias("single"))
    no = lambda kind: F.array().cast(f"array<struct<{kind}>>")
    both = rows.drop("hits").join(single, "_row", "left").join(passages, "_row", "left").withColumns({
        "base": F.coalesce("base", no("start:int,label:string")), "spans": F.coalesce("spans", no("start:int,end:int,label:string,template:int,share:double")),
    })
    best = F.greatest(F.coalesce("single", F.lit(0.0)), F.coalesce(F.array_max(F.col("spans.share")), F.lit(0.0)))
    return both.select("doc_id", "n_words", "base", "spans", best.alias("score"))


def licenses(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, share: float = SHARE, gap: int = GAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row, from ``spans``."""
    found = spans(docs, phrases, templates, share, gap, doc_id, text)
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.col("base.start")).cast("long").alias("first_word"), F.array_max(F.col("base.start")).cast("long").alias("last_word"),
        listed(F.col("base.label")).alias("base_labels"), listed(F.concat(F.col("base.label"), F.col("spans.label"))).alias("labels"), "score",
    )
