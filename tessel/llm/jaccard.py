"""N-gram Jaccard join: parity sketches, joined by segments within bands of size, then verified."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm import _bytes as B
from tessel.llm._common import arrow_map, list_array, marked, scratch, small_batches, text_or_empty
from tessel.llm._graph import components

#: Members of a family that meet in one task are two blocks of about this many, and of about as many shingles in all.
BLOCK, BLOCK_SHINGLES = 100, 1 << 20
#: Blocks of sketches are so many times as large.
SKETCHES = 40
#: Bits of the folded sketch by which candidates are compared before their sets are; larger sets have more.
BITS, MOST_BITS = 1024, 65536
#: Sets that share a segment are compared each with each up to this many; more meet in a family.
FEW = 4
PAIR, UNCOUNTED = -100, (1 << 31) - 1
#: Segments that meet in one step of a task, about, and how many neighbouring ones of a set may go there together. The set's
#: key is written once for these, so that a segment takes 5 to 8 bytes, however many tasks there are.
MEETING, TOGETHER = 1 << 21, 16
#: A filter of documents' numbers has this power of two of bits at most: 32 MB; it is gathered in parts of so many bytes.
SIFT_BITS, SIFT_PART = 28, 1 << 16


class Threshold:
    """Bands of set sizes, and the segments a sketch needs there, for a least similarity given as a fraction."""

    def __init__(self, least: Fraction):
        self.least = least
        self.edges = [1]
        self.most: list[int] = []
        self.segments: list[int] = []

    def grow(self, size: int) -> None:
        """Sets at most one band apart can be similar enough: each band begins at its predecessor's begin / least or later.

        There are bands up to the one above that of ``size``.
        """
        while len(self.edges) < 3 or self.edges[-2] <= size:
            lo = self.edges[-1]
            hi = max(lo + 1, -(-lo * self.least.denominator // self.least.numerator))
            self.edges.append(hi)
            most = self.differences(2 * (hi - 1))
            self.most.append(most)
            self.segments.append(most + (most // 8 + 6 if most else 1))

    def differences(self, sizes: int) -> int:
        """The most elements in which two similar sets of so many together differ."""
        return int(sizes * (1 - self.least) / (1 + self.least))

    def bands(self, sizes: np.ndarray) -> np.ndarray:
        self.grow(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self.edges), sizes, side="right") - 1


@cache
def threshold(numerator: int, denominator: int) -> Threshold:
    return Threshold(Fraction(numerator, denominator))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of all texts, text by text in order, and where each text's begin."""
    starts, ends, first = B.words(data, offsets)
    counts = np.diff(first)
    h = B.hashes(data, starts, ends)
    n = len(h)
    run = np.zeros(n, dtype=np.uint64)
    text_of = np.repeat(np.arange(len(counts)), counts)
    last = np.repeat(first[1:], counts)
    at = np.arange(n)
    taken = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        inside = at + k < last
        run = np.where(inside, B.mix(run + h[np.minimum(at + k, n - 1)] + np.uint64(k + 1)), run) if n else run
        taken += inside.astype(np.uint64)
    run = B.mix(run + taken)
    keep = (taken == width) | (at == np.repeat(first[:-1], counts))  # a text of fewer words is one shingle
    run, text_of = run[keep], text_of[keep]
    # sorted by text and the hash's upper bits; equal hashes then stand side by side
    order = np.argsort((text_of.astype(np.uint64) << np.uint64(44)) | (run >> np.uint64(20)))
    run, text_of = run[order], text_of[order]
    new = np.ones(len(run), dtype=bool)
    new[1:] = (run[1:] != run[:-1]) | (text_of[1:] != text_of[:-1])
    run, text_of = run[new], text_of[new]
    return run, np.searchsorted(text_of, np.arange(len(counts) + 1))


def signatures(shingles: np.ndarray, at: np.ndarray, least: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set, the segments of its sketches in its own band of sizes and the next: values, where each set's begin,
    and for each value twice the number of segments that the set could do without in its band (-1: none, and empty ones
    count), plus 1 in the next band.

    A sketch has a bit for each 64-bit value, of which every shingle flips one; a segment holds the shingles whose hash
    falls to it. It is written as the XOR of its bits' codes, so that equal values mean equal segments. Two sets within
    the most differences that their band allows have at least one segment of that band in common. There are some more
    segments than differences: a set with more filled segments than those has a filled one in common with its partner, so
    that its empty ones, which say nothing, are left out. Only where both lack this do they meet by empty ones.
    """
    return _placed(shingles, at, least)[:3]


def _placed(shingles: np.ndarray, at: np.ndarray, least: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """See ``signatures``; besides, each value's band (times 2^40) and number of the segment there."""
    t, sizes = threshold(least.numerator, least.denominator), np.diff(at)
    bands = t.bands(sizes)
    segments, most = np.array(t.segments), np.array(t.most)
    spread = (B.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(33)).astype(np.int64)
    codes = B.mix(shingles + np.uint64(0x14057B7EF767814F))
    found = []
    for up in (0, 1):
        number = np.where(sizes > 0, segments[bands + up], 0)
        begin = np.concatenate([[0], np.cumsum(number)])
        where = np.repeat(begin[:-1], sizes) + (spread * np.repeat(number, sizes) >> 31)
        order = np.argsort(where, kind="stable")
        value = np.zeros(begin[-1], dtype=np.uint64)
        if len(order):
            cut = np.flatnonzero(np.concatenate([[True], np.diff(where[order]) > 0]))
            value[where[order][cut]] = np.bitwise_xor.reduceat(codes[order], cut)
        segment = np.arange(begin[-1]) - np.repeat(begin[:-1], number)
        held = np.zeros(begin[-1] + 1, dtype=np.int64)
        held[1:] = np.cumsum(np.bincount(where, minlength=begin[-1])[: begin[-1]] > 0)
        spare = held[begin[1:]] - held[begin[:-1]] - np.where(sizes > 0, most[bands + up], 0) - 1
        enough = spare >= 0
        place = (np.repeat(bands + up, number).astype(np.uint64) << np.uint64(40)) + segment.astype(np.uint64)
        value = B.mix(value ^ B.mix(place + np.uint64(1)))
        kept = ~np.repeat(enough, number) | (np.diff(held) > 0)
        number = np.add.reduceat(np.append(kept, False).astype(np.int64), begin[:-1]) * (sizes > 0) if len(sizes) else number
        found.append((number, np.concatenate([[0], np.cumsum(number)]), value[kept], np.repeat(2 * np.maximum(spare, -1) + up, number), place[kept]))
    (n0, b0, v0, s0, p0), (n1, b1, v1, s1, p1) = found
    begin = b0 + b1
    values, spares, places = np.empty(begin[-1], dtype=np.uint64), np.empty(begin[-1], dtype=np.int32), np.empty(begin[-1], dtype=np.uint64)
    for number, old, value, spare, place, to in ((n0, b0, v0, s0, p0, begin[:-1]), (n1, b1, v1, s1, p1, begin[:-1] + n0)):
        where = np.repeat(to, number) + np.arange(len(value)) - np.repeat(old[:-1], number)
        values[where], spares[where], places[where] = value, spare, place
    return values, begin, spares, places.view(np.int64)


def set_keys(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; 0 for empty ones."""
    key, full = np.zeros(len(at) - 1, dtype=np.uint64), np.flatnonzero(np.diff(at))
    if len(full):
        key[full] = B.mix(np.add.reduceat(B.mix(shingles ^ np.uint64(0xA0761D6478BD642F)), at[full]))
    return key.view(np.int64)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text_or_empty(text)).alias("hash"))


def sketched(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, hash (of the text), n_shingles, key (of the set) and sketch (its folded parities) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, sketches = [], [], []
        for _, data, offsets in B.chunks(batch.column(1)):
            shingles, at = shingle_sets(B.LOWER[data], offsets, width)
            sizes.append(np.diff(at))
            keys.append(set_keys(shingles, at))
            sketches += [folded(shingles[i:j]) for i, j in zip(at[:-1], at[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(keys)), pa.array(sketches, pa.binary())], names=["doc_id", "hash", "n_shingles", "key", "sketch"])

    return arrow_map(_texts(docs, doc_id, text), run, "doc_id long, hash long, n_shingles long, key long, sketch binary")


def _bytes_each(data: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Binary values, each the bytes of the items from its begin to the next one's."""
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer((begin * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _sets_by_band(rows: DataFrame, least: Fraction) -> np.ndarray:
    """How many rows with a set have segments in each band; a band has those of its own sets and of the one below."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.bincount(threshold(least.numerator, least.denominator).bands(batch.column(0).to_numpy()))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["band", "n"])

    counts = arrow_map(rows.where("n_shingles > 0").select("n_shingles"), run, "band long, n long").groupBy("band").agg(F.sum("n").alias("n")).collect()
    own = np.zeros(max([r.band for r in counts], default=0) + 2, dtype=np.int64)
    for r in counts:
        own[r.band] = r.n
    return own + np.append(0, own[:-1])


def segments(docs: DataFrame, width: int, least: Fraction, doc_id: str, text: str, in_band: np.ndarray) -> DataFrame:
    """Segments of the texts' sets by the group in which equal ones meet; a task gives on each of its sets once.

    A row holds segments of one group and of some sets: these (nodes, a set's key each), how many each has, spare of each,
    and 32 bits of each segment, so that a few unlike ones may meet, too. A group has up to TOGETHER neighbouring segments
    of a band, fewer where ``in_band`` says that many sets have them; where that is not enough, one segment is dealt by its
    values.
    """
    together = np.clip(MEETING // np.maximum(in_band, 1), 1, TOGETHER)
    dealt = np.minimum(-(-in_band // MEETING).clip(1), 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = np.zeros(0, np.int64)
        for batch in batches:
            for _, data, offsets in B.chunks(batch.column(1)):
                shingles, at = shingle_sets(B.LOWER[data], offsets, width)
                keys = set_keys(shingles, at)
                new = np.zeros(len(keys), dtype=bool)
                new[np.unique(keys, return_index=True)[1]] = True
                new &= ~np.isin(keys, given)
                given = np.concatenate([given, keys[new]])
                sizes = np.diff(at)
                values, begin, spares, places = _placed(shingles[np.repeat(new, sizes)], np.concatenate([[0], np.cumsum(sizes[new])]), least)
                if not len(values):
                    continue
                band = places >> 40
                group = (band << 40) + ((places & ((1 << 40) - 1)) // together[band] << 16) + (values.astype(np.uint32) % dealt[band])
                order = np.argsort(group, kind="stable")
                group, owner = group[order], np.repeat(np.arange(len(begin) - 1), np.diff(begin))[order]
                rows = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                each = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])]))
                upto = np.append(np.searchsorted(each, rows), len(each))
                columns = [
                    pa.array(group[rows]),
                    _bytes_each(keys[new][owner[each]], upto),
                    _bytes_each(np.diff(np.append(each, len(group))).astype(np.uint8), upto),
                    _bytes_each(spares[order][each], upto),
                    _bytes_each((values[order] >> np.uint64(32)).astype(np.uint32), np.append(rows, len(group))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "nodes", "counts", "spares", "segments"])

    return _texts(docs, doc_id, text).mapInArrow(run, "group long, nodes binary, counts binary, spares binary, segments binary")


def _settled(segment: np.ndarray, node: np.ndarray, spare: np.ndarray, first: np.ndarray, last: bool) -> tuple[tuple, tuple]:
    """What ``meetings`` gives of the segments at hand, and (segment, node, spare, first) that later ones need.

    Of more than FEW sets that share a segment the first is needed, and marked as such: the others have met it.
    """
    order = np.argsort(segment)
    equal = segment[order][1:] == segment[order][:-1]
    shared = np.append(False, equal) | np.append(equal, False) if len(order) else np.zeros(0, dtype=bool)
    alone, some = order[~shared], order[shared]
    some = some[np.lexsort((node[some], ~first[some], segment[some]))]
    s, n = segment[some], node[some]
    new = np.ones(len(some), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (n[1:] != n[:-1])
    some, s, n = some[new], s[new], n[new]
    starts = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(s)))
    met = first[some[starts]]
    large = np.repeat((lengths > FEW) | met, lengths)
    tell = large & ~first[some] & (~np.repeat(met, lengths) | (n != np.repeat(n[starts], lengths)))
    size = np.repeat(np.where(met | (not last), UNCOUNTED, lengths), lengths).astype(np.int32)
    out = [(np.repeat(n[starts], lengths)[tell], n[tell], spare[some][tell], size[tell], s[tell].view(np.int32))]
    if last:
        for d in range(1, FEW):
            near = np.flatnonzero((s[:-d] == s[d:]) & ~large[d:]) if len(s) > d else np.zeros(0, np.int64)
            out.append((n[near], n[near + d], np.full(len(near), PAIR, np.int32), np.zeros(len(near), np.int32), np.zeros(len(near), np.int32)))
    begins = np.zeros(len(s), dtype=bool)
    begins[starts] = True
    kept = np.concatenate([alone, some[~large | begins]])
    flags = np.concatenate([first[alone], (large & begins)[~large | begins]])
    return tuple(np.concatenate(x) for x in zip(*out)), (segment[kept], node[kept], spare[kept], flags)


def meetings(parts: DataFrame) -> DataFrame:
    """(a, b, spare, size, segment): pairs of up to FEW sets that share a segment (spare is PAIR); of more, each with the
    first one, how many they are and the segment's 32 bits.

    Groups are dealt and sorted. A task takes up about MEETING segments of them at a time, and where one group has more, it
    goes on with FEW rows at most of each segment; those of more sets are UNCOUNTED then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, dtype=bool))
        held, n, most, group = [none], 0, 2 * MEETING, None

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n, most
            out, left = _settled(*(np.concatenate(x) for x in zip(*held)), last)
            held = [none if last else left]
            n = len(held[0][0])
            most = 2 * max(MEETING, n)
            yield from pa.table([pa.array(x) for x in out], names=["a", "b", "spare", "size", "segment"]).to_batches(1 << 16)

        for batch in batches:
            groups = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, np.int64)
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(groups)]):
                if groups[i] != group and n > MEETING >> 3:
                    yield from settle(True)
                elif n > most:
                    yield from settle(False)
                group = groups[i]
                nodes, counts, spares, values = (np.frombuffer(b"".join(batch.column(k).slice(i, j - i).to_pylist()), kind) for k, kind in ((1, np.int64), (2, np.uint8), (3, np.int32), (4, np.uint32)))
                held.append((values, np.repeat(nodes, counts), np.repeat(spares, counts), np.zeros(len(values), dtype=bool)))
                n += len(values)
        yield from settle(True)

    return parts.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long, spare int, size int, segment int")


def folded(shingles: np.ndarray) -> bytes:
    """A parity sketch, whose Hamming distance to another's is at most the number of differences."""
    bits = BITS
    while bits < MOST_BITS and 2 * bits < 4 * len(shingles) - 4 * BITS:
        bits *= 2
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def apart(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The Hamming distances of sketches, pair by pair; halves of a larger one are laid upon each other until it is as small."""
    sizes = [np.array(x.binary_length().to_pylist() if isinstance(x, pa.ChunkedArray) else pa.compute.binary_length(x), dtype=np.int64) for x in (a, b)]
    out = np.zeros(len(a), dtype=np.int64)
    both = sizes[0] << 32 | sizes[1]
    for pair in np.unique(both):
        rows = np.flatnonzero(both == pair)
        x, y = (np.frombuffer(b"".join(side.take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1) for side in (a, b))
        while x.shape[1] > y.shape[1]:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        while y.shape[1] > x.shape[1]:
            y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
        out[rows] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def possible(pairs: DataFrame, sketches: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow to be similar enough."""
    p, q = least.numerator, least.denominator
    side = lambda x: sketches.select(F.col("key").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(q * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b")).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "s_a", "s_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fits = (p + q) * apart(batch.column(3), batch.column(4)) <= (q - p) * batch.column(2).to_numpy()
        return pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(fits))

    return arrow_map(both, run, "a long, b long")


def spanning(ids: np.ndarray, sets: list[np.ndarray], least: Fraction, every: bool = False) -> list[tuple[int, int]]:
    """Links that join whatever the links of these sets join: one fewer than there are sets at most, or ``every`` link.

    A pair is verified if its sketches and sizes allow it and no earlier link joins the two already.
    """
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets) & np.uint64(BITS - 1)
    bits = np.bincount(np.repeat(np.arange(len(sets)), sizes) * BITS + values.astype(np.int64), minlength=len(sets) * BITS)
    sketches = np.packbits((bits & 1).astype(np.uint8).reshape(len(sets), BITS), axis=1)
    parent, links = list(range(len(ids))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    p, q = least.numerator, least.denominator
    for i in range(len(ids) - 1):
        total = sizes[i] + sizes[i + 1 :]
        distance = np.bitwise_count(sketches[i + 1 :] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        for j in (i + 1 + np.flatnonzero((p + q) * distance <= (q - p) * total)).tolist():
            a, b = root(i), root(j)
            if a != b or every:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if q * common >= p * (sizes[i] + sizes[j] - common):
                    parent[max(a, b)] = min(a, b)
                    links.append((int(ids[i]), int(ids[j])))
    return links


def sifted(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows (key, text) whose key may be wanted, by a Bloom filter: the join that follows then shuffles few texts.

    The filter has 16 bits a wanted key, SIFT_BITS at most; a fuller one lets more rows pass, and the join drops them.
    """
    bits = 1 << min(SIFT_BITS, max(16, int(16 * wanted.count()).bit_length()))
    part = min(SIFT_PART, bits >> 3)
    places = lambda: [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)) for i in (1, 2)]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits >> 3, dtype=np.uint8)
        for batch in batches:
            for column in batch.columns:
                p = column.to_numpy()
                np.bitwise_or.at(table, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
        parts = table.reshape(-1, part)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["at", "bits"])

    def united(at: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts = np.zeros(part, np.uint8)
        for x in group["bits"]:
            parts |= np.frombuffer(x, np.uint8)
        return pd.DataFrame({"at": [at[0]], "bits": [parts.tobytes()]})

    marks = wanted.select(*(c.alias(f"p{i}") for i, c in enumerate(places()))).mapInArrow(marked, "at long, bits binary").groupBy("at").applyInPandas(united, "at long, bits binary").toArrow()
    table = np.zeros((bits >> 3) // part * part, dtype=np.uint8).reshape(-1, part)
    for at, held in zip(marks["at"].to_pylist(), marks["bits"].to_pylist()):
        table[at] = np.frombuffer(held, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(table.ravel())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pass_ = np.ones(batch.num_rows, dtype=bool)
        for i in (2, 3):
            p = batch.column(i).to_numpy()
            pass_ &= shared.value[p >> 3] >> (p & 7).astype(np.uint8) & 1 > 0
        return pa.RecordBatch.from_arrays(batch.columns[:2], names=[key, "text"]).filter(pa.array(pass_))

    return arrow_map(rows.where(F.col(key).isNotNull()).select(key, "text", *(c.alias(f"p{i}") for i, c in enumerate(places()))), run, f"{key} long, text string")


class Found(NamedTuple):
    """Documents' rows, their classes (equal sets), links between classes as (a, b), by the sets' keys."""

    rows: DataFrame
    classes: DataFrame
    links: DataFrame


def _blocked(members: DataFrame, by: list[str], times: int = 1) -> DataFrame:
    """Adds block: members with equal ``by`` are dealt into blocks of about BLOCK members and BLOCK_SHINGLES shingles, or so
    many times as large ones."""
    blocks = F.greatest(F.ceil(F.count("*") / (BLOCK * times)), F.ceil(F.sum("n_shingles") / (BLOCK_SHINGLES * times)))
    sizes = scratch(members.groupBy(*by).agg(blocks.alias("blocks")), "jaccard-blocks")
    return members.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _checked(meeting: DataFrame, by: list[str], least: Fraction, every: bool) -> DataFrame:
    """Links (a, b) among the sets (node, shingles) of each group."""

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node")
        found = spanning(group["node"].to_numpy(), [np.asarray(s, dtype=np.int64).view(np.uint64) for s in group["shingles"]], least, every)
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return meeting.groupBy(*by).applyInPandas(verify, "a long, b long")


def _kept(met: DataFrame) -> DataFrame:
    """(bucket, node, banded): the sets that must look for partners in a segment that more than FEW share; a set is banded
    under one number for its own band and under another for the next.

    Two similar sets have at least one segment more in common than either can spare, so that each may leave out as many as
    it can spare: the most crowded, ties by the segment. The least crowded that both have in common is then kept by both.
    """
    crowd = met.where(F.col("spare") != PAIR).select("a", "b", F.col("spare").bitwiseAND(1).alias("up"), F.shiftright("spare", 1).alias("can_spare"), "size", "segment")
    many = crowd.groupBy("b", "up").agg((F.count("*") - F.max("can_spare")).alias("keep")).where("keep > 0")
    many = scratch(many, "jaccard-crowded")
    some = marked(crowd, many, "b", "jaccard-marks").where("_may").join(many, ["b", "up"])
    rank = F.rank().over(Window.partitionBy("b", "up").orderBy("size", "segment"))
    return some.withColumn("rank", rank).where("rank <= keep").select(F.xxhash64("a", "segment").alias("bucket"), F.col("b").alias("node"), F.xxhash64("b", "up").alias("banded"))


def _families(met: DataFrame, classes: DataFrame, least: Fraction) -> DataFrame:
    """node and component of the sets that sizes and sketches allow to be similar enough, where their segments meet.

    In crowded segments each set is compared with the first one that is kept there. Sets of one band that such segments
    join are a crowd; where sketches leave parts of it apart, all of these are compared, in tasks of two blocks.
    """
    kept = scratch(_kept(met), "jaccard-kept")
    first = kept.groupBy("bucket").agg(F.min(F.struct("node", "banded")).alias("x"), F.max("node").alias("last")).where("x.node < last")
    stars = scratch(kept.join(first, "bucket").where("node <> x.node").select(F.col("x.node").alias("a"), F.col("node").alias("b"), F.col("x.banded").alias("a_banded"), "banded").distinct(), "jaccard-stars")
    pairs = met.where(F.col("spare") == PAIR).select("a", "b").unionByName(stars.select("a", "b")).distinct()
    joined = components(possible(pairs, classes, least))
    crowds = components(stars.select(F.col("a_banded").alias("a"), F.col("banded").alias("b"))).select(F.col("node").alias("banded"), F.col("component").alias("family"))
    ends = stars.select(F.col("a").alias("node"), F.col("a_banded").alias("banded")).unionByName(stars.select(F.col("b").alias("node"), "banded")).distinct()
    sketches = classes.select(F.col("key").alias("node"), "n_shingles", "sketch")
    parts = ends.join(crowds, "banded").join(joined, "node", "left").select("node", "family", F.coalesce("component", "node").alias("part"))
    parts = scratch(parts.join(sketches.drop("sketch"), "node"), "jaccard-crowds")
    meeting = sketches.join(_meeting(parts, SKETCHES), "node").select("node", "family", "low", "high", "part", "n_shingles", "sketch")
    near = meeting.groupBy("family", "low", "high").applyInArrow(lambda table: _near(table, least), "a long, b long")
    return components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(near))


def _near(table: pa.Table, least: Fraction) -> pa.Table:
    """Pairs (a, b) that sizes and sketches allow to be similar enough: some, which join all such pairs of different parts."""
    node, rows = np.unique(table["node"].to_numpy(), return_index=True)
    n, part = table["n_shingles"].to_numpy()[rows], np.unique(table["part"].to_numpy()[rows], return_inverse=True)[1]
    held = table["sketch"].take(pa.array(rows)).to_pylist()
    lengths = np.array([len(x) for x in held])
    sketches = np.empty((len(held), lengths.min(initial=MOST_BITS)), dtype=np.uint8)
    for length in np.unique(lengths):
        some = np.flatnonzero(lengths == length)
        x = np.frombuffer(b"".join(held[i] for i in some), np.uint8).reshape(len(some), -1)
        while x.shape[1] > sketches.shape[1]:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        sketches[some] = x
    sketches = sketches.view(np.uint64)
    p, q, found = least.numerator, least.denominator, []
    for i in range(len(node) - 1):
        j = i + 1 + np.flatnonzero((part[i + 1 :] != part[i]) & (q * np.minimum(n[i + 1 :], n[i]) >= p * np.maximum(n[i + 1 :], n[i])))
        if len(j):
            j = j[(p + q) * np.bitwise_count(sketches[j] ^ sketches[i]).sum(axis=1, dtype=np.int64) <= (q - p) * (n[j] + n[i])]
            others, at = np.unique(part[j], return_index=True)
            found += [(node[i], node[k]) for k in j[at]]
            part[np.isin(part, others)] = part[i]
    a, b = zip(*found) if found else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _found(docs: DataFrame, width: int, least: Fraction, doc_id: str, text: str, every: bool) -> Found:
    """See ``linked``; with ``every``, all links between classes are given, else some that join the same ones."""
    rows = scratch(sketched(docs, width, doc_id, text), "jaccard-rows")
    classes = scratch(rows.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("class"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "jaccard-classes")
    met = scratch(meetings(segments(docs, width, least, doc_id, text, _sets_by_band(rows, least))), "jaccard-met")
    families = _families(met, classes, least).withColumnRenamed("component", "family")
    families = families.join(classes.select("key", "class", "n_shingles"), F.col("node") == F.col("key")).where("class IS NOT NULL").select("node", "family", "class", "n_shingles")
    families = scratch(_blocked(families, ["family"]).select("node", "family", "block", "blocks", "class", "n_shingles"), "jaccard-families")
    body = sifted(docs.select(F.col(doc_id).cast("long").alias("class"), text_or_empty(text).alias("text")), families, "class")
    members = families.join(body, "class").select("node", "family", "block", "blocks", "n_shingles", "text")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, keys = [], []
        for _, data, offsets in B.chunks(batch.column(5)):
            shingles, at = shingle_sets(B.LOWER[data], offsets, width)
            found.append(list_array(at, shingles.view(np.int64)))
            keys.append(set_keys(shingles, at))
        out = pa.RecordBatch.from_arrays([*batch.columns[:5], pa.concat_arrays(found)], names=["node", "family", "block", "blocks", "n_shingles", "shingles"])
        return out.filter(pa.array(np.concatenate(keys) == batch.column(0).to_numpy()))

    known = scratch(arrow_map(members, sets, "node long, family long, block int, blocks long, n_shingles long, shingles array<long>"), "jaccard-sets")
    if every:
        other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other")
        meeting = known.select("node", "family", "block", "shingles", other).select("node", "family", "shingles", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        return Found(rows, classes, _checked(meeting, ["family", "low", "high"], least, True).distinct())
    # each block by itself, with its family's first set, so that a family of copies is one component already
    first = known.where("node = family").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    near = scratch(_checked(known.where("node <> family").unionByName(first).select("node", "family", "block", "shingles"), ["family", "block"], least, False), "jaccard-near")
    return Found(rows, classes, near.unionByName(_between(known, near, least)))


def _between(known: DataFrame, near: DataFrame, least: Fraction) -> DataFrame:
    """Links between sets of a family that the links ``near`` leave apart."""
    parts = known.select("node", "family", "n_shingles").join(components(near), "node", "left").withColumn("part", F.coalesce("component", "node"))
    members = known.select("node", "shingles").join(_meeting(parts, 1), "node").select("node", "family", "low", "high", "shingles")
    return _checked(members, ["family", "low", "high"], least, False)


def _meeting(parts: DataFrame, times: int) -> DataFrame:
    """node, family, part, low and high: the members of blocks low and high of a family, which meet.

    Of (node, family, part, n_shingles), parts of a block's members or more are dealt into blocks of their own and the other
    sets of a family into mixed ones. Two blocks meet unless they are of one part, so that what is joined is not compared
    again. Families of one part are left out.
    """
    sized = scratch(parts.groupBy("family", "part").agg(F.count("*").alias("n")), "jaccard-parts")
    open_ = sized.groupBy("family").agg(F.count("*").alias("parts")).where("parts > 1").select("family")
    large = sized.where(F.col("n") >= BLOCK * times).select("family", "part", F.lit(True).alias("large"))
    parts = parts.join(open_, "family", "left_semi").join(large, ["family", "part"], "left").select("node", "family", "part", "n_shingles", F.when(F.col("large"), F.col("part")).alias("own"))
    dealt = _blocked(parts.withColumn("group", F.coalesce(F.col("own").cast("string"), F.lit(""))), ["family", "group"], times)
    dealt = scratch(dealt.select("node", "family", "part", "own", F.concat_ws("/", "group", "block").alias("block")), "jaccard-dealt")
    blocks = scratch(dealt.select("family", "own", "block").distinct(), "jaccard-dealt-blocks")
    side = lambda df, x: df.select("family", F.col("own").alias(f"own_{x}"), F.col("block").alias(x))
    mixed = side(blocks.where("own IS NULL"), "low").join(side(blocks, "high"), "family").where("own_high IS NOT NULL OR low <= high")
    owns = blocks.where("own IS NOT NULL")
    apart_ = owns.select("family", F.col("own").alias("own_low")).distinct().join(owns.select("family", F.col("own").alias("own_high")).distinct(), "family").where("own_low < own_high")
    owned = apart_.join(side(owns, "low"), ["family", "own_low"]).join(side(owns, "high"), ["family", "own_high"])
    meeting = mixed.select("family", "low", "high").unionByName(owned.select("family", "low", "high"))
    ends = meeting.select("family", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    return dealt.select("node", "family", "part", "block").join(ends, ["family", "block"]).select("node", "family", "part", "low", "high")


def _named(found: Found) -> DataFrame:
    """key and component (a key, too) of every class, written."""
    joined = components(found.links)
    return scratch(found.classes.select("key", "class").join(joined, F.col("key") == F.col("node"), "left").select("key", "class", F.coalesce("component", "key").alias("component")), "jaccard-named")


def linked(docs: DataFrame, width: int = 5, least: Fraction = Fraction(8, 10), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of every row.

    Texts are lower-cased from A to Z; a set holds the distinct runs of ``width`` words, or all words if there are
    fewer. Two sets link when intersection / union >= ``least``. Null texts and texts without words have no shingles and
    link with nothing. Rows with one doc_id and different texts are documents of their own that share a name. A null
    doc_id names no class; its row has the component of rows with an equal set, else null. Repeated rows have equal
    results; empty tables have none; other columns are not looked at.

    1. Equal sets are one class, known by a 64-bit key of the set and named by its smallest doc_id.
    2. Classes that share a segment of their sketches meet, where sizes and folded sketches decide whether they can link: up
       to FEW of them each with each; of more each with the first, then those that this leaves apart. A class leaves out as
       many segments as it can spare, the most crowded first; if it can spare all large ones, it takes part in none.
    3. What may link is a family (a component), and each link lies within one. A family's members are dealt into blocks.
       The sets decide, in tasks of a block and the family's first set; then of two blocks, for what is still apart.
    4. Components of these links name the documents.
    No group of equal texts, of one segment or of one family comes to one task's memory as a whole.
    """
    found = _found(docs, width, least, doc_id, text, False)
    named = _named(found)
    low = scratch(named.groupBy("component").agg(F.min("class").alias("component_id")), "jaccard-low")
    names = named.join(low, "component").select("key", "component_id")
    rows = found.rows
    both = rows.where("n_shingles > 0").join(names, "key", "left").select("doc_id", "n_shingles", "component_id")
    return both.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def links(docs: DataFrame, width: int = 5, least: Fraction = Fraction(8, 10), doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links between different sets, as pairs (a, b) of classes, and membership: doc_id and class of every row.

    A class is known by its smallest doc_id and, since rows may share that, the set's key: a, a_key, b, b_key, and doc_id,
    class, key. Rows without shingles have no class, nor have sets that only rows without doc_id hold links. Otherwise as
    ``linked``, but no pair is left out because others join its ends already.
    """
    found = _found(docs, width, least, doc_id, text, True)
    side = lambda x: found.classes.select(F.col("key").alias(x), F.col("class").alias(f"{x}_class"))
    pairs = found.links.join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.select(F.col("a_class").alias("a"), F.col("a").alias("a_key"), F.col("b_class").alias("b"), F.col("b").alias("b_key"))
    member = found.rows.select("doc_id", F.when(F.col("n_shingles") > 0, F.col("key")).alias("key")).join(found.classes.select("key", "class"), "key", "left")
    return pairs, member.select("doc_id", "class", "key")


def keep_one(docs: DataFrame, width: int = 5, least: Fraction = Fraction(8, 10), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` but for near copies: of each component the row of the smallest doc_id stays.

    Rows of one doc_id and different texts are documents of their own: of those that are no near copies all stay. Of
    equal rows one stays. Texts without words link with nothing and stay, each. Rows without doc_id come last: one stays
    of a component that has no other. Null texts, ties and empty tables as in ``linked``; columns of any name pass.
    """
    found = _found(docs, width, least, doc_id, text, False)
    named = _named(found).select("key", "component")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("hash").alias("hash"))
    worded = found.rows.where("n_shingles > 0")
    first = worded.join(named, "key").groupBy("component").agg(F.min(order).alias("x"))
    first = scratch(first.select("x.id", "x.hash"), "jaccard-first")
    # texts are shuffled only where a row may go: it has equals or is not the first of its component
    both = worded.select(F.col("doc_id").alias("id"), "hash", F.lit(1).alias("n"), F.lit(0).alias("first")).unionByName(first.select("id", "hash", F.lit(0).alias("n"), F.lit(1).alias("first")))
    pair = F.xxhash64("id", "hash").alias("_pair")
    open_ = scratch(both.groupBy("id", "hash").agg(F.sum("n").alias("n"), F.max("first").alias("first")).where("n > 1 OR first = 0").select(pair), "jaccard-open")
    column = lambda c: F.col(f"`{c}`")
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("_row"), column(doc_id).cast("long").alias("id"), F.xxhash64(text_or_empty(column(text))).alias("hash"), column(text).alias("_text"))
    wordless = ~F.coalesce(F.col("_text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = marked(rows.select("_row", "id", "hash", wordless.alias("_wordless"), pair), open_, "_pair", "jaccard-marks").withColumn("_may", F.col("_may") & ~F.col("_wordless"))
    some = rows.where("_may").select("_row", "id", "hash")
    kept = some.where("id IS NOT NULL").join(first.where("id IS NOT NULL"), ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
    unnamed = some.where("id IS NULL").join(first.where("id IS NULL").select("hash"), "hash", "left_semi").dropDuplicates(["hash"])
    return rows.where("NOT _may").select("_row.*").unionByName(kept.select("_row.*")).unionByName(unnamed.select("_row.*"))
