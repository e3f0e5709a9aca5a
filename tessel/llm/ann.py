"""Approximate nearest neighbours by inner product: balanced posting lists, found through a graph of their centroids."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm._common import scratch

#: Distinct vectors a list should hold, and how many lists there are at most: centroids are broadcast. Beyond that lists
#: grow; their vectors are dealt into blocks.
LIST_SIZE, MOST_LISTS = 64, 65_536
#: Distinct vectors that centroids are fitted on, for each list and in all, and those that queries are compared with to
#: know what product their k nearest reach at least; chosen by hash.
SAMPLE_PER_LIST, MOST_SAMPLE, FLOOR_SAMPLE = 16, 262_144, 16_384
#: Copies of a vector at most, and how much farther than the nearest centroid those of further copies may lie.
COPIES, COPY_RATIO = 4, 1.25
#: Lists that a query searches at least, and the share of vectors beyond its floor that the searched lists should hold.
LEAST_PROBES, TARGET = 32, 0.95
DEGREE = 24
#: Centroids up to which their graph is made on the driver; that of more is made by tasks.
FEW_POINTS = 4096
#: Queries whose lists are chosen together, and vectors to a task of that.
ASKED_TOGETHER, TO_A_TASK = 256, 5000
#: Neighbouring lists, numbered one after the other, that are read together.
TOGETHER = 8
#: Vectors, and queries, of such lists that meet in one task.
BLOCK = 256


class Graph(NamedTuple):
    """Centroids, their squared lengths, each one's near neighbours, where searches begin, and the spread of lists:
    the standard deviation of their vectors' products with a vector of length 1."""

    points: np.ndarray
    lengths: np.ndarray
    near: np.ndarray
    entries: np.ndarray
    spread: np.ndarray

    def nearest(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the numbers of near centroids and their distances, nearest first; -1 and infinity fill up.

        Best-first search by all rows at once: each round opens a row's nearest unopened centroid.
        """
        n, c = len(x), len(self.points)
        width = min(width, c)
        lengths = (x * x).sum(axis=1)

        def distance(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(lengths[rows, None] + self.lengths[ids] - 2 * np.einsum("rd,rkd->rk", x[rows], self.points[ids]), 0))

        seen = np.zeros((n, c), dtype=bool)
        everyone = np.arange(n)
        start = np.broadcast_to(self.entries, (n, len(self.entries)))
        seen[:, self.entries] = True
        ids, far, opened = start.copy(), distance(everyone, start), np.zeros(start.shape, bool)
        active = everyone
        for _ in range(4 * width + 16):
            todo = np.where(opened[active], np.inf, far[active])
            pick = todo.argmin(axis=1)
            going = np.isfinite(todo[np.arange(len(active)), pick])
            active, pick = active[going], pick[going]
            if not len(active):
                break
            opened[active, pick] = True
            around = self.near[ids[active, pick]]
            fresh = ~seen[active[:, None], around]
            seen[active[:, None], around] = True
            away = np.where(fresh, distance(active, around), np.inf)
            if ids.shape[1] < width + around.shape[1]:
                more = width + around.shape[1] - ids.shape[1]
                ids, far, opened = np.pad(ids, ((0, 0), (0, more)), constant_values=-1), np.pad(far, ((0, 0), (0, more)), constant_values=np.inf), np.pad(opened, ((0, 0), (0, more)), constant_values=True)
            all_ids, all_far = np.concatenate([ids[active], around], axis=1), np.concatenate([far[active], away], axis=1)
            all_open = np.concatenate([opened[active], ~fresh], axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, : ids.shape[1]]
            ids[active], far[active], opened[active] = (np.take_along_axis(v, order, 1) for v in (all_ids, all_far, all_open))
            opened[active[:, None], np.arange(width, ids.shape[1])] = True  # only the best ``width`` are gone on from
        order = np.argsort(far, axis=1, kind="stable")[:, :width]
        ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        return np.where(np.isfinite(far), ids, -1), far


    def every(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all centroids and their distances, nearest first: for rows that need a large part of them."""
        far = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + self.lengths - 2 * x @ self.points.T, 0))
        ids = np.argsort(far, axis=1, kind="stable")
        return ids, np.take_along_axis(far, ids, 1)


def balanced_centroids(x: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and spreads of ``lists`` (a power of two) groups of equal size: halves of halves, split across the line of
    two means. Groups of few rows have a spread drawn towards that of all."""
    groups = [np.arange(len(x))]
    while len(groups) < lists:
        halves = []
        for rows in groups:
            points = x[rows]
            center = points.mean(axis=0)
            a = points[((points - center) ** 2).sum(axis=1).argmax()]
            b = points[((points - a) ** 2).sum(axis=1).argmax()]
            for _ in range(6):
                side = points @ (a - b)
                upper = side > np.median(side)
                if upper.all() or not upper.any():
                    break
                a, b = points[upper].mean(axis=0), points[~upper].mean(axis=0)
            order = np.argsort(points @ (a - b), kind="stable")
            halves += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        groups = halves
    points = np.stack([x[rows].mean(axis=0) for rows in groups])
    squares = np.array([((x[rows] - c) ** 2).sum() for rows, c in zip(groups, points)]) / x.shape[1]
    counts = np.array([len(rows) for rows in groups])
    whole = squares.sum() / max(1, (counts - 1).sum())
    return points, np.sqrt((squares + 8 * whole) / (np.maximum(counts - 1, 0) + 8))


def near_points(points: np.ndarray, lengths: np.ndarray, ids: np.ndarray, degree: int) -> np.ndarray:
    """The numbers of the points nearest to those of ``ids``, nearest first; the next number comes last, so that a ring
    leads through all."""
    far = lengths[None, :] - 2 * points[ids] @ points.T
    some = np.argpartition(far, degree - 1, axis=1)[:, :degree] if degree < len(points) else np.broadcast_to(np.arange(len(points)), far.shape)
    near = np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)
    near[:, -1] = (ids + 1) % len(points)
    return near


def graph(points: np.ndarray, spread: np.ndarray | None = None, degree: int = DEGREE, spark: SparkSession | None = None) -> Graph:
    """Each centroid's nearest ones, and a ring through all so that none is out of reach; tasks find those of many."""
    lengths, c = (points * points).sum(axis=1), len(points)
    degree = min(degree, c)
    if spark is None or c <= FEW_POINTS:
        near = np.concatenate([near_points(points, lengths, np.arange(at, min(at + 256, c)), degree) for at in range(0, c, 256)])
    else:
        known = spark.sparkContext.broadcast((points, lengths))

        def find(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for at in range(0, len(ids), 256):
                    part = ids[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(list(near_points(*known.value, part, degree)))], names=["id", "near"])

        found = spark.range(0, c, 1, c // 512).mapInArrow(find, "id long, near array<long>").toArrow()
        near = np.empty((c, degree), dtype=np.int64)
        near[found["id"].to_numpy()] = found["near"].combine_chunks().flatten().to_numpy().reshape(-1, degree)
    return Graph(points, lengths, near, np.arange(0, c, max(1, c // 16)), np.zeros(c) if spread is None else spread)


def searched(g: Graph, x: np.ndarray, floor: np.ndarray, target: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and list numbers: the lists that each query searches, from its nearest up to a ratio of that one's distance.

    The ratio is the query's own: where lists within it hold ``target`` of all vectors whose product is expected to reach
    the query's floor. A list's products are taken to spread normally around its centroid's; lists that the graph has not
    reached count as much as the farthest that it has, and the search is widened as long as these matter. One that would
    reach a quarter of the lists looks at all of them instead.
    """
    rows, lists = [], []
    left, width, c = np.arange(len(x)), min(2 * LEAST_PROBES, len(g.points)), len(g.points)
    lengths = (x * x).sum(axis=1)
    while len(left):
        ids, far = g.nearest(x[left], width) if 4 * width < c else g.every(x[left])
        width = ids.shape[1]
        there = ids >= 0
        product = (lengths[left, None] + g.lengths[ids] - far * far) / 2
        away = (floor[left, None] - product) / np.maximum(np.sqrt(lengths[left])[:, None] * g.spread[ids], 1e-12)
        # of as many vectors each; computed from logs, so that a floor far beyond all lists still tells them apart
        tail = np.where(there, _log_upper_tail(away), -np.inf)
        hits = np.exp(tail - tail.max(axis=1, keepdims=True))
        sums = np.cumsum(hits, axis=1)
        rest = (c - there.sum(axis=1)) * np.where(there, hits, np.inf).min(axis=1)
        enough = sums >= target * (sums[:, -1] + rest)[:, None]
        number = np.maximum(np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, width), min(LEAST_PROBES, width))
        done = enough.any(axis=1) | (width >= c)
        ratio = np.take_along_axis(far, np.minimum(number, there.sum(axis=1))[:, None] - 1, 1)
        take = there & (far <= ratio) & done[:, None]
        row, at = np.nonzero(take)
        rows.append(left[row])
        lists.append(ids[row, at])
        left, width = left[~done], min(2 * width, c)
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *lists])


def _log_upper_tail(z: np.ndarray) -> np.ndarray:
    """log of the normal distribution's upper tail, by a rational bound (within some per cent)."""
    z = np.clip(z, -8, None)
    positive = np.maximum(z, 0)
    upper = -positive * positive / 2 - np.log(positive + np.sqrt(positive * positive + 8 / np.pi)) + np.log(np.sqrt(2 / np.pi))
    below = np.minimum(z, 0)
    lower = np.log1p(-np.exp(-below * below / 2 - np.log(-below + np.sqrt(below * below + 8 / np.pi)) + np.log(np.sqrt(2 / np.pi))))
    return np.where(z >= 0, upper, lower)


def chosen(g: Graph, ids: np.ndarray, far: np.ndarray, copies: int, ratio: float) -> np.ndarray:
    """Which of its near lists get a copy of a vector: those hardly farther than the nearest, and not behind one taken already."""
    take = np.zeros(ids.shape, dtype=bool)
    take[:, 0] = True
    points = g.points[ids]
    for k in range(1, ids.shape[1]):
        fits = (ids[:, k] >= 0) & (far[:, k] <= ratio * far[:, 0]) & (take.sum(axis=1) < copies)
        between = ((points[:, :k] - points[:, k : k + 1]) ** 2).sum(axis=2)
        take[:, k] = fits & ~((between < far[:, k : k + 1] ** 2) & take[:, :k]).any(axis=1)
    return take


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and v of rows with finite, non-zero vectors of the most frequent length (the shortest among equals).

    Vectors of other lengths have no product with these. Floats and doubles keep their type; other numbers become doubles.
    """
    inner = vectors.schema[embedding].dataType.elementType.simpleString()
    kind = inner if inner in ("float", "double") else "double"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    common = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("v") == (common["size"] if common else 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, target: float = TARGET, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` rows of largest inner product found for each query, its own left out.

    ``is_query`` is a condition on vec_id. Equal products rank by vec_id. Rows whose vector is null, zero, of an unusual
    length or not finite throughout take no part, nor do rows without an id; a row that stands twice counts once; an
    empty table gives none. ``target`` 1 searches all lists, so it is exact.

    1. Equal vectors become one, with the k + 1 smallest ids that have it: no others can be among the nearest k.
    2. A further dimension makes all vectors equally long, so that the nearest has the largest product.
    3. Balanced lists, as many as the table asks for up to MOST_LISTS: centroids of equal halves of a bounded sample.
       Every vector goes to the nearest list and, near a border, to others as well; a graph over the centroids finds them.
    4. A query searches its nearest lists up to a ratio of the nearest one's distance, which ``searched`` finds for it: the
       lists should hold ``target`` of what reaches the k-th best product of a sample. Blocks of neighbouring lists'
       vectors and of their queries meet in one task each, which gives on the best k that reach that product.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    keyed = rows.distinct().select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    keyed = keyed.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    unique = scratch(keyed.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")).select(F.col("ids")[0].alias("rep"), "ids", "v"), "ann-unique")
    asked = rows.where(is_query).distinct()
    length2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = unique.agg(F.count("*").alias("n"), F.max(length2).alias("most")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    n, most = facts["n"], float(facts["most"])
    lists = 1 << max(0, min(MOST_LISTS, n // LIST_SIZE).bit_length() - 1)
    share = min(1.0, min(SAMPLE_PER_LIST * lists, MOST_SAMPLE) / n)
    chance = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    drawn = unique.select("v", chance.alias("h"), "rep").where(F.col("h") < share if share < 1 else F.lit(True)).toArrow().sort_by([("h", "ascending"), ("rep", "ascending")])
    known = longer(drawn["v"].combine_chunks(), most)
    lists = min(lists, 1 << (len(known).bit_length() - 1)) if len(known) else 1
    points, spread = balanced_centroids(known, lists) if len(known) else (np.zeros((1, 1)), np.zeros(1))
    model = spark.sparkContext.broadcast((graph(points, spread, spark=spark), known[:FLOOR_SAMPLE, :-1].copy()))

    def placed(query: bool):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            (g, known), x = model.value, longer(batch.column(1), 0.0 if query else most)
            floor = np.full(len(x), -np.inf)
            if not query:
                ids, far = g.nearest(x, 4 * COPIES)
                row, at = np.nonzero(chosen(g, ids, far, COPIES, COPY_RATIO))
                lists = ids[row, at]
            else:
                # k others of the sample, or more, reach this product: less is not worth giving on
                if len(known) > k:
                    floor = np.partition(x[:, :-1] @ known.T, -(k + 1), axis=1)[:, -(k + 1)]
                    floor -= 1e-9 * (1 + np.abs(floor))
                if len(known) > k and target < 1:
                    row, lists = searched(g, x, floor, target)
                else:
                    row, lists = np.repeat(np.arange(len(x)), len(g.points)), np.tile(np.arange(len(g.points)), len(x))
            taken = pa.array(row)
            return pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(lists.astype(np.int32)), pa.array(floor[row])], names=["id", "v", "list", "floor"])

        def each(batches):
            size = ASKED_TOGETHER if query else 1000
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    yield run(batch.slice(at, size))

        return each

    tasks = max(1, n // TO_A_TASK)
    kind = f"id long, v {unique.schema['v'].dataType.simpleString()}, list int, floor double"
    together = lambda df: df.withColumn("list", F.floor(F.col("list") / TOGETHER).cast("int")).dropDuplicates(["id", "list"])
    posted = scratch(unique.select(F.col("rep").alias("id"), "v").repartition(tasks, "id").mapInArrow(placed(False), kind).transform(together), "ann-posted")
    probed = scratch(asked.select(F.col("vec_id").alias("id"), "v").repartition(tasks, "id").mapInArrow(placed(True), kind).transform(together), "ann-probed")
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    both = blocks(posted, "vector_blocks").join(blocks(probed, "query_blocks"), "list")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.col(n)).cast("int")
    left = posted.join(both, "list").select("list", own("vector_blocks").alias("a"), every("query_blocks").alias("b"), "id", "v")
    right = probed.join(both, "list").select("list", every("vector_blocks").alias("a"), own("query_blocks").alias("b"), "id", "v", "floor")

    def meet(these: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        if not len(these) or not len(those):
            return pd.DataFrame({"query_id": [], "rep": [], "score": []}).astype({"query_id": "int64", "rep": "int64"})
        x, q = (np.stack(df["v"].to_numpy()).astype(np.float64) for df in (these, those))
        scores, ids = q @ x.T, these["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        scores, ids = scores[:, order], ids[order]
        best = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
        top = np.take_along_axis(scores, best, 1)
        row, at = np.nonzero(top >= those["floor"].to_numpy()[:, None])
        return pd.DataFrame({"query_id": those["id"].to_numpy()[row], "rep": ids[best[row, at]], "score": top[row, at]})

    keys = ["list", "a", "b"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, rep long, score double")
    found = found.groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    named = found.join(unique.select("rep", "ids"), "rep").select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def longer(vectors: pa.Array, most: float) -> np.ndarray:
    """Vectors with a further dimension that gives each the squared length ``most``; queries get 0 there."""
    if not len(vectors):
        return np.zeros((0, 1))
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))[:, None] if most else np.zeros((len(x), 1))], axis=1)
