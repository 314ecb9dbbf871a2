"""Exact top-k by inner product: a KD-tree per shard, best-first traversal, a k-th score passed from shard to shard.

Components become floor(1024 * x), so scores are exact integers. Rows are cut into shards along the medians of a bounded
sample, so that a shard's box is tight; a cell that holds more rows than a shard may (copies) is dealt over several by hash.
Every shard's tree is built once and stored: points in leaf order, ids, boxes. Points are shuffled that one time only.

Queries meet the shards in blocks of bounded size, which are broadcast. A task goes through its shards one by one and carries
each query's ``k`` best so far: a shard whose box can't reach a query's k-th score is skipped, in the others the query visits
boxes in the order of their largest possible inner product and stops at the first that can't reach it (boxes that can tie are
visited, as ties go to the smaller vec_id). The k-th scores start from those in a few seed shards, found first. What a
task returns is ``k`` rows a query at most.
"""

from __future__ import annotations

import heapq
import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.llm.common import durable, forget, hashed_fraction, shared_dir, table

SCALE = 1024
LEAF = 128
#: Rows of a shard.
SHARD_ROWS = 8192
#: Expected number of rows whose medians cut the space into cells; any cut gives the same result.
SAMPLE_ROWS = 20_000
#: Queries of a block, fewer where vectors are so long that a block would exceed ``BLOCK_BYTES``.
BLOCK_ROWS = 32_768
BLOCK_BYTES = 64_000_000
#: Below this bound on a score's size, float64 products and sums of integers are exact.
EXACT = float(2**53)
LONG = 2**63


def quantise(embedding: Column) -> Column:
    """floor(1024 * x) of every component as double; null for vectors with null or non-finite components."""

    def unit(x: Column) -> Column:
        y = x.cast("double") * SCALE
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole numbers

    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(embedding.isNotNull() & finite, F.transform(embedding, unit))


class KDTree:
    """Median splits with tight bounding boxes, in arrays."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.lo, self.hi, self.kids, self.span = [], [], [], []
        stack = [(0, len(points), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            own = points[self.order[a:b]]
            node = len(self.lo)
            self.lo.append(own.min(axis=0))
            self.hi.append(own.max(axis=0))
            self.kids.append([-1, -1])
            self.span.append((a, b))
            if parent >= 0:
                self.kids[parent][side] = node
            width = self.hi[node] - self.lo[node]
            if b - a > leaf and width.size and width.max() > 0:
                axis, half = int(width.argmax()), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], half)]
                stack += [(a, a + half, node, 0), (a + half, b, node, 1)]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product that any point of each box can have with each query."""
        return _box_bounds(queries, self.lo, self.hi)


def _box_bounds(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.maximum(queries, 0) @ hi.T + np.minimum(queries, 0) @ lo.T


def pack_shard(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> bytes:
    """A shard's tree, points in leaf order and ids as bytes; whole numbers that fit are stored in four bytes."""
    tree = KDTree(points, leaf)
    placed = points[tree.order]
    small = np.abs(placed).max(initial=0) < 2**31
    out = io.BytesIO()
    np.savez(out, points=placed.astype(np.int32) if small else placed, ids=ids[tree.order], lo=tree.lo, hi=tree.hi, kids=np.array(tree.kids), span=np.array(tree.span))
    return out.getvalue()


class Best:
    """The ``k`` best (score, -vec_id) of every query of a block, and the score that the next must reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.vectors, self.floors, self.k = ids, vectors, floors.astype(float), k
        self.heaps: list[list[tuple]] = [[] for _ in ids]

    def visit(self, shard: dict[str, np.ndarray]) -> tuple[int, int]:
        """Search one packed shard; returns (shard and query pairs that were searched, leaves that were visited)."""
        points, names, kids, span = shard["points"].astype(float), shard["ids"], shard["kids"].tolist(), shard["span"].tolist()
        if points.shape[1] != self.vectors.shape[1] or not len(points):
            return 0, 0
        reach = np.maximum(np.abs(shard["lo"][:1]), np.abs(shard["hi"][:1]))
        sizes = (np.abs(self.vectors) @ reach.T)[:, 0]
        exact = float(sizes.max(initial=0)) < EXACT
        slack = np.zeros(len(sizes)) if exact else sizes * (1e-12 + 1e-15 * points.shape[1])
        root = _box_bounds(self.vectors, shard["lo"][:1], shard["hi"][:1])[:, 0] + slack
        meet, leaves = np.flatnonzero(root >= self.floors), 0
        whole = None if exact else [[int(x) for x in p] for p in points]
        for lo in range(0, len(meet), 1024):
            some = meet[lo : lo + 1024]
            bounds = _box_bounds(self.vectors[some], shard["lo"], shard["hi"]) + slack[some, None]
            for row, i in zip(bounds, some.tolist(), strict=True):
                leaves += self._search(i, row, points, names, kids, span, whole)
        return len(meet), leaves

    def _search(self, i: int, row: np.ndarray, points, names, kids, span, whole) -> int:
        q, best, own, k, floor, visited = self.vectors[i], self.heaps[i], self.ids[i], self.k, self.floors[i], 0
        heap = [(-row[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor:
                break
            left, right = kids[node]
            if left >= 0:
                heapq.heappush(heap, (-row[left], left))
                heapq.heappush(heap, (-row[right], right))
                continue
            a, b = span[node]
            visited += 1
            if whole is None:
                scores = points[a:b] @ q
            else:
                wide = [int(x) for x in q]
                scores = np.array([sum(map(int.__mul__, wide, p)) for p in whole[a:b]], object)
            for j in np.flatnonzero(scores >= floor).tolist():
                item = (scores[j], -int(names[a + j]))
                if -item[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k and best[0][0] > floor:
                    floor = best[0][0]
        self.floors[i] = floor if whole is None or floor == -math.inf else _below(int(floor))
        return visited

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for own, heap in zip(self.ids.tolist(), self.heaps, strict=True):
            for score, name in heap:
                score = int(score)
                if not -LONG <= score < LONG:
                    raise OverflowError(f"the score of {own} and {-name} doesn't fit a long")
                yield own, -name, score


def _search_batches(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Best(*block, k) for block in held.value]
        shards = searched = leaves = every = 0
        for batch in batches:
            for value in batch.column(0):
                shard = dict(np.load(io.BytesIO(value.as_py())))
                for block in blocks:
                    met, seen = block.visit(shard)
                    if block.vectors.shape[1] == shard["points"].shape[1]:
                        shards += len(block.ids)
                        every += met * int((shard["kids"][:, 0] < 0).sum())
                    searched += met
                    leaves += seen
        found = [row for block in blocks for row in block.rows()]
        columns = [pa.array([r[i] for r in found], pa.int64()) for i in range(3)]
        # the counters travel as one row without a query
        columns = [pa.concat_arrays([c, pa.array([v], pa.int64())]) for c, v in zip(columns, (None, None, None), strict=True)]
        counters = [[None] * len(found) + [v] for v in (shards, searched, every, leaves)]
        yield pa.record_batch([*columns, *[pa.array(c, pa.int64()) for c in counters]], ["query_id", "vec_id", "score", "pairs", "searched", "leaves", "visited"])

    return run


def sample_cuts(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Median cuts of the widest component, as (component, value, left, right); a negative end -1 - c is cell c."""
    cuts: list[tuple[int, float, int, int]] = []
    count = 0

    def grow(own: np.ndarray, want: int) -> int:
        nonlocal count
        width = own.max(axis=0) - own.min(axis=0) if len(own) else np.zeros(0)
        if want > 1 and width.size and width.max() > 0:
            axis = int(width.argmax())
            value = float(np.median(own[:, axis]))
            low = own[:, axis] < value
            if low.any():
                cuts.append((axis, value, 0, 0))
                at = len(cuts) - 1
                left = grow(own[low], want // 2)
                right = grow(own[~low], want - want // 2)
                cuts[at] = (axis, value, left, right)
                return at
        count += 1
        return -count

    grow(points, cells)
    return cuts


def cell_of(cuts: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    """Cell number of every point (0 without cuts)."""
    out = np.zeros(len(points), np.int64)
    stack = [(0, np.arange(len(points)))] if cuts else []
    while stack:
        at, own = stack.pop()
        axis, value, left, right = cuts[at]
        low = points[own, axis] < value
        for end, part in ((left, own[low]), (right, own[~low])):
            if end < 0:
                out[part] = -1 - end
            elif len(part):
                stack.append((end, part))
    return out


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _cell_batches(cuts: dict[int, list]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            cells = np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                if cuts.get(size):
                    cells[at] = cell_of(cuts[size], _vectors(batch.column(1).take(pa.array(at)), size))
            yield pa.record_batch([*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(cells)], ["vec_id", "v", "q", "size", "cell"])

    return run


def _pack(points: pd.DataFrame) -> pd.DataFrame:
    size = len(points["v"].iloc[0])
    blob = pack_shard(np.array(points["v"].tolist(), float).reshape(len(points), size), points["vec_id"].to_numpy())
    return pd.DataFrame({"shard": [blob], "seed": [bool(points["seed"].iloc[0])]})


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, counters: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` best other rows, ties to the smaller vec_id.

    A row with a null vec_id, a null vector, or a null or non-finite component takes no part; vectors of different lengths
    have no inner product. Rows that share a vec_id are candidates of their own, but never of a query with that id; a query
    id that is repeated is asked once, by its least vector. A best score that no long can hold raises. An empty table gives
    no rows; other columns don't matter. ``counters`` receives what was pruned: pairs of a query and a shard, those
    searched, their leaves, those visited.
    """
    spark = vectors.sparkSession
    ready = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantise(F.col("embedding")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter("vec_id is not null and v is not null")
    ready = durable(ready, "vectors")
    by_size = {r["size"]: r["n"] for r in ready.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).collect()}
    # the limit bounds what a repeated vec_id can add; the cuts move no result
    sample = hashed_fraction(ready, F.col("vec_id"), SAMPLE_ROWS / max(sum(by_size.values()), 1), "cells").select("v").limit(2 * SAMPLE_ROWS).collect()
    cuts = {}
    for size, n in by_size.items():
        own = [r["v"] for r in sample if len(r["v"]) == size]
        cuts[size] = sample_cuts(np.array(own, float).reshape(len(own), size), min(math.ceil(n / shard_rows), max(1, len(own) // 8)))
    placed = ready.mapInArrow(_cell_batches(cuts), "vec_id long, v array<double>, q boolean, size int, cell long")
    placed = durable(placed.withColumn("uid", F.monotonically_increasing_id()), "placed")
    # a cell needs 8 rows of the sample, so there are SAMPLE_ROWS / 4 at most, and one for each length of a vector
    fill = F.broadcast(placed.groupBy("size", "cell").agg(F.ceil(F.count("*") / shard_rows).alias("parts")))
    shards = placed.join(fill, ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")))
    whole = max(1, sum(math.ceil(n / shard_rows) for n in by_size.values()))
    # about one shard in 64, at least one of each length, gives the first k-th scores
    seed = (F.pmod(F.xxhash64("size", "cell", "part"), F.lit(64)) == 0) | ((F.col("cell") == 0) & (F.col("part") == 0))
    packed = shards.withColumn("seed", seed).repartition(max(whole, spark.sparkContext.defaultParallelism), "size", "cell", "part").groupBy("size", "cell", "part").applyInPandas(_pack, "shard binary, seed boolean")
    packed = durable(packed, "shards")

    asked = placed.filter("q").groupBy("vec_id").agg(F.min(F.struct("size", "v")).alias("one")).select("vec_id", "one.size", "one.v")
    longest = max(by_size, default=1)
    most = max(1, min(block_rows, BLOCK_BYTES // (8 * max(longest, 1))))
    asked = durable(asked, "queries")
    blocks = max(1, math.ceil(asked.count() / most))
    # a block's rows follow a hash, so its size is bounded up to chance
    asked = durable(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).repartition("block"), "blocks")
    path, schema = f"{shared_dir(spark)}/tessitura/found-{uuid.uuid4().hex}", "query_id long, vec_id long, score long, pairs long, searched long, leaves long, visited long"

    def search(block: list, given: DataFrame) -> DataFrame:
        held = spark.sparkContext.broadcast(block)
        return given.select("shard").mapInArrow(_search_batches(held, k), schema)

    for number in range(blocks):
        rows = asked.filter(F.col("block") == number).select("vec_id", "size", "v").collect()
        block = []
        for size in sorted({r["size"] for r in rows}):
            own = [r for r in rows if r["size"] == size]
            block.append((np.array([r["vec_id"] for r in own], np.int64), np.array([r["v"] for r in own], float).reshape(len(own), size), np.full(len(own), -np.inf)))
        seeds = durable(search(block, packed.filter("seed")), "seeds")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
        ranked = seeds.filter("query_id is not null").select("query_id", "score", F.row_number().over(best).alias("rank"))
        # at most one row a query of the block
        kth = {r["query_id"]: r["score"] for r in ranked.filter(F.col("rank") == k).select("query_id", "score").collect()}
        block = [(ids, v, np.array([_below(kth.get(i)) for i in ids.tolist()], float)) for ids, v, _ in block]
        found = seeds.unionByName(search(block, packed.filter("not seed")))
        found.select("*", F.row_number().over(best).alias("rank")).filter((F.col("rank") <= k) | F.col("query_id").isNull()).drop("rank").write.mode("append").parquet(path)
        forget(seeds)
    forget(ready, placed, packed, asked)
    done = spark.read.schema(schema).parquet(path)
    if counters is not None:
        counters |= done.agg(*[F.sum(c).alias(c) for c in ("pairs", "searched", "leaves", "visited")]).first().asDict()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return done.filter("query_id is not null").select("query_id", F.row_number().over(best).cast("int").alias("rank"), "vec_id", "score")


def _below(score: int | None) -> float:
    """The largest double that isn't over ``score``; minus infinity for none."""
    if score is None:
        return -math.inf
    value = float(score)
    return value if value <= score else math.nextafter(value, -math.inf)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all ``embeddings`` for every row whose vec_id is divisible by 100."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT * FROM e WHERE vec_id % 100 = 0) q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
