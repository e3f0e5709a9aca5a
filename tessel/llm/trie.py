"""The prefix trie of conversations: nodes, members and what sharing prefixes saves."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm._common import scratch, small_batches

#: Turns that a shard of the trie holds, about.
SHARD_TURNS = 1_000_000
#: Paths sampled for each splitter, and bytes of all sampled paths together: the driver picks splitters from these.
SAMPLES, SKELETON_BYTES = 16, 1 << 26
#: Bytes of a turn's digest.
STEP = 16
#: Ids of one block when the ids that end at a node are hashed.
BLOCK = 65_536
NO_ENDS = hashlib.sha256(b"").hexdigest()

_SKELETON = "key binary, pkey binary"
_NODES = f"conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, skeleton boolean, step long, {_SKELETON}"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (turn, digest, size) in order, of every conversation; texts are not shuffled."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    step = F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).alias("size"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), step.alias("step"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("step")).alias("turns"))


def with_heads(turns: DataFrame, base: Column, keep: Column, most: int) -> DataFrame:
    """The turns of each conversation after its first ``keep``, behind the first ``keep`` (up to ``most``) of conversation
    ``base``: all of these if it has fewer, none if it is absent."""
    heads = turns.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    rows = turns.select("conv_id", "turns", base.alias("_of"), keep.cast("int").alias("_keep")).join(heads, F.col("_of") == F.col("_base"), "left")
    head = F.when(F.col("_keep") > 0, F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), 1, F.greatest("_keep", F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(head, F.slice("turns", F.col("_keep") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _ends(paths: DataFrame) -> DataFrame:
    """_path_key, n, conv_id (the least) and ends_sha256 of each distinct path.

    Ids are sorted by path and id over all tasks and joined in blocks, so that a path that very many conversations share
    meets in one task as a stream of blocks only: its hash, which is sequential, needs no more memory than one of them.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            joined = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, starts[1:])]
            first = np.array(starts[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in first], pa.binary()), pa.array(ids[first]), pa.array(np.diff(starts), pa.int64()), pa.array(joined)], names=["key", "first", "n", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, least, sha = None, 0, 0, None
        for batch in batches:
            done = []
            for k, first, some, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if key is not None:
                        done.append((key, n, least, sha.hexdigest()))
                    key, n, least, sha = k, 0, first, hashlib.sha256()
                sha.update(("," if n else "").encode() + ids.encode())
                n += some
            if done:
                yield _rows(done)
        if key is not None:
            yield _rows([(key, n, least, sha.hexdigest())])

    def _rows(done):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["key", "n", "least", "sha"])

    ordered = paths.select("_path_key", "conv_id").repartitionByRange("_path_key", "conv_id").sortWithinPartitions("_path_key", "conv_id")
    small = ordered.mapInArrow(blocks, "key binary, first long, n long, ids string")
    return small.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "_path_key binary, n long, conv_id long, ends_sha256 string")


def _splitters(paths: DataFrame) -> list[bytes]:
    """Sorted paths that cut all paths into shards of about SHARD_TURNS turns; those of the sample are cut off at a depth
    that keeps them within SKELETON_BYTES together, so the trie that they span is no larger."""
    turns = paths.agg(F.sum(F.length("path"))).first()[0] or 0
    shards = turns // (STEP * SHARD_TURNS) + 1
    if shards == 1:
        return []
    wanted = shards * SAMPLES
    depth = max(1, SKELETON_BYTES // (STEP * wanted))
    rows = paths.select(F.xxhash64("path").alias("h"), F.substring("path", 1, STEP * depth).alias("at"), F.length("path").alias("n")).orderBy("h", "at").limit(wanted).toArrow()
    sample = sorted(zip(rows["at"].to_pylist(), rows["n"].to_pylist()))
    total = np.cumsum([n + STEP for _, n in sample])
    picks = np.searchsorted(total, total[-1] * np.arange(1, shards) / shards)
    return sorted({sample[i][0] for i in picks} - {b""})


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    x, y = (np.frombuffer(p, "<u8").reshape(-1, 2) for p in (a, b))
    n = min(len(x), len(y))
    differs = np.flatnonzero((x[:n] != y[:n]).any(axis=1))
    return int(differs[0]) if len(differs) else n


def local_nodes(table: pa.Table, splitters: list[bytes]) -> pa.Table:
    """The nodes of one shard of (shard, path, sizes, n, conv_id, ends_sha256) rows, distinct by path.

    Nodes on a splitter's path may have members in other shards: they come as partial aggregates (``skeleton``), which
    hold what other nodes of this shard add below them. All others are finished, but for parents in the skeleton.
    """
    shard = table["shard"][0].as_py()
    order = sorted(range(table.num_rows), key=table["path"].to_pylist().__getitem__)
    table = table.take(pa.array(order))
    paths, ends = table["path"].to_pylist(), table["ends_sha256"].to_pylist()
    weight, conv = table["n"].to_numpy(), table["conv_id"].to_numpy()
    length = np.array([len(p) // STEP for p in paths])
    start = np.concatenate([[0], np.cumsum(length)])
    digests = np.frombuffer(b"".join(paths), "<u8").reshape(-1, 2)
    sizes = np.frombuffer(b"".join(table["sizes"].to_pylist()), ">i4")
    both = np.minimum(length[1:], length[:-1])
    row = np.repeat(np.arange(len(both)), both)
    at = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
    differs = (digests[start[row] + at] != digests[start[row + 1] + at]).any(axis=1)
    shared = both.copy()
    np.minimum.at(shared, row[differs], at[differs])
    shared = np.concatenate([[-1], shared])
    # -1: not even the root lies on a splitter
    low = _common(splitters[shard - 1], paths[0]) if shard else -1
    high = _common(splitters[shard], paths[-1]) if shard < len(splitters) else -1

    levels, node_of, active = [], np.zeros(len(paths), np.int64), np.arange(len(paths))
    depth = 0
    while len(active):
        opens = shared[active] < depth
        first = np.flatnonzero(opens)
        rows = active[first]
        above = node_of[rows]
        node_of[active] = np.cumsum(opens) - 1
        skeleton = np.zeros(len(rows), bool)
        skeleton[0] |= active[0] == 0 and depth <= low
        skeleton[-1] |= active[-1] == len(paths) - 1 and depth <= high
        step = sizes[start[rows] + depth - 1].astype(np.int64) if depth else np.zeros(1, np.int64)
        levels.append((rows, above, skeleton, np.add.reduceat(weight[active], first), np.minimum.reduceat(conv[active], first), step))
        depth += 1
        active = active[length[active] >= depth]

    children = leaves = saved = None
    parts = []
    for depth in range(len(levels) - 1, -1, -1):
        rows, above, skeleton, convs, least, step = levels[depth]
        n_children = np.zeros(len(rows), np.int64) if children is None else children
        n_leaves = (n_children == 0) & ~skeleton
        own = np.where(skeleton, 0, (convs - 1) * step)
        n_leaves = n_leaves.astype(np.int64) + (0 if leaves is None else leaves)
        total = own + (0 if saved is None else saved)
        sha = [ends[r] if length[r] == depth else NO_ENDS for r in rows]
        name = lambda r, d: hashlib.md5(paths[r][: STEP * d]).digest()
        keys = [name(r, depth) if s else None for r, s in zip(rows, skeleton)]
        if depth:
            up, up_skeleton = levels[depth - 1][4], levels[depth - 1][2]
            names = {i: name(levels[depth - 1][0][i], depth - 1) for i in np.flatnonzero(up_skeleton)}
            parent = pa.array(up[above], mask=up_skeleton[above])
            pkeys = [names.get(i) for i in above.tolist()]
            m = len(up)
            children = np.bincount(above[~skeleton], minlength=m)
            leaves, saved = np.zeros(m, np.int64), np.zeros(m, np.int64)
            local = ~skeleton  # what hangs below skeleton nodes goes up when these are reduced
            np.add.at(leaves, above[local], n_leaves[local])
            np.add.at(saved, above[local], total[local])
        else:
            parent, pkeys = pa.nulls(1, pa.int64()), [None]
        columns = [pa.array(least), pa.array(np.full(len(rows), depth, np.int64)), parent, pa.array(convs), pa.array(n_children), pa.array(n_leaves), pa.array(total), pa.array(sha), pa.array(skeleton), pa.array(step), pa.array(keys, pa.binary()), pa.array(pkeys, pa.binary())]
        parts.append(pa.table(columns, names=[x.split()[0] for x in _NODES.split(", ")]))
    return pa.concat_tables(parts)


def _reduce(table: pa.Table) -> pa.Table:
    """The finished skeleton from its merged nodes: what each adds goes up level by level."""
    order = np.argsort(table["depth"].to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    place = {k: i for i, k in enumerate(table["key"].to_pylist())}
    parent = [place.get(k, -1) for k in table["pkey"].to_pylist()]
    convs, step, least = (table[c].to_numpy() for c in ("n_convs", "step", "conv_id"))
    children, leaves, saved = (table[c].to_numpy().copy() for c in ("n_children", "n_leaves", "saved_tokens"))
    for i, p in enumerate(parent):
        if p >= 0:
            children[p] += 1
    leaves += children == 0
    saved += (convs - 1) * step
    for i in range(len(parent) - 1, 0, -1):
        leaves[parent[i]] += leaves[i]
        saved[parent[i]] += saved[i]
    above = pa.array([int(least[p]) if p >= 0 else None for p in parent], pa.int64())
    columns = dict(conv_id=least, depth=table["depth"], parent_conv_id=above, n_convs=convs, n_children=children, n_leaves=leaves, saved_tokens=saved, ends_sha256=table["ends_sha256"], key=table["key"])
    return pa.table(columns)


def trie(turns: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of the (conv_id, turns) rows, as ``prefix_trie`` describes."""
    spark = turns.sparkSession
    small_batches(spark)
    digests = F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), ""))
    sizes = F.unhex(F.array_join(F.transform("turns", lambda x: F.lpad(F.hex(x["size"].cast("long")), 8, "0")), ""))
    paths = turns.select("conv_id", digests.alias("path"), sizes.alias("sizes")).withColumn("_path_key", F.unhex(F.md5("path")))
    paths = scratch(paths, "trie-paths")
    distinct = paths.groupBy("_path_key").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    distinct = scratch(distinct.join(_ends(paths), "_path_key").drop("_path_key"), "trie-distinct")
    splitters = _splitters(distinct)
    shared = spark.sparkContext.broadcast(splitters)

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = [bisect_right(shared.value, p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *batch.columns], names=["shard", *batch.schema.names])

    columns = distinct.select("path", "sizes", "n", "conv_id", "ends_sha256")
    dealt = columns.mapInArrow(sharded, "shard long, path binary, sizes binary, n long, conv_id long, ends_sha256 string")
    nodes = scratch(dealt.groupBy("shard").applyInArrow(lambda table: local_nodes(table, shared.value), _NODES), "trie-nodes")
    merged = nodes.where("skeleton").groupBy("key").agg(
        F.first("pkey").alias("pkey"), F.first("depth").alias("depth"), F.first("step").alias("step"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.coalesce(F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))), F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    out = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    skeleton = scratch(merged.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(_reduce, out + ", key binary"), "trie-skeleton")
    names = [x.split()[0] for x in out.split(", ")]
    parents = skeleton.select(F.col("key").alias("pkey"), F.col("conv_id").alias("_up"))
    rest = nodes.where("NOT skeleton").join(parents, "pkey", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    return rest.select(names).unionByName(skeleton.select(names))


def prefix_trie(conversations: DataFrame, base: Column | None = None, keep: Column | None = None, most: int = 0) -> DataFrame:
    """The prefix trie of all conversations, given as (conv_id, turn, role, text) rows, rebuilt by ``with_heads`` if ``base``
    and ``keep`` are given.

    A row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. Paths are strings of turns' digests. Distinct ones are cut into shards by splitters, paths of a sample;
    shards finish the nodes that are on no splitter's path, the few others are reduced from partial aggregates.

    Null roles and texts are empty; a null turn comes first; rows of the same turn are ordered by their MD5 (of the
    role's length, a colon, role and text), and repeated rows are turns of their own. Rows without conv_id belong to no
    conversation and are left out. Other columns, of any name, play no part. An empty table has no node, not even a root.
    A turn is 24 bytes wherever its conversation meets in one task, whatever its text's length.
    """
    turns = turns_of(conversations)
    return trie(turns if base is None else with_heads(turns, base, keep, most))
