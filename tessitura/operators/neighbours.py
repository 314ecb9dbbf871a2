"""Exact nearest neighbours and counts in several dimensions, by the largest difference of a coordinate: cell against cell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.session import shared_table

#: Points of a cell, about; a task holds the points of two cells.
CELL_ROWS = 2_000
#: Pairs of a point and a box, or of two points, that are compared at once.
BLOCK = 1 << 20


def _numbers(columns: list[str], *more: str) -> str:
    return ", ".join([*(f"`{c}` double" for c in columns), *more])


class Cells:
    """Points dealt over the leaves of a KD-tree, each distinct point once with the number of its ``copies``.

    The cuts come from a hash-chosen part of the points, about 32 a leaf, and decide only how many points share a leaf. Each leaf
    has the box of its points: rounding is monotone, so its bounds hold for the computed differences too. Leaves, boxes and cuts
    are on the driver, some numbers for each ``CELL_ROWS`` points.
    """

    def __init__(self, data: DataFrame, columns: list[str]):
        self.columns = columns
        distinct = shared_table(data.groupBy(*columns).agg(F.count("*").alias("copies")), "points")
        n = distinct.count()
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / CELL_ROWS))))
        chosen = np.zeros((0, len(columns)))
        if self.depth:
            step = max(1, n // (32 << self.depth))
            chosen = distinct.filter(F.pmod(F.xxhash64(*columns), F.lit(step)) == 0).select(*columns).toPandas().to_numpy(float)
        self.axes, self.cuts = np.zeros((1 << self.depth) - 1, int), np.zeros((1 << self.depth) - 1)
        held = [chosen]
        for node in range(len(self.cuts)):
            own = held[node]
            if len(own):
                self.axes[node] = np.ptp(own, axis=0).argmax()
                self.cuts[node] = np.median(own[:, self.axes[node]])
            left = own[:, self.axes[node]] <= self.cuts[node]
            held += [own[left], own[~left]]
            held[node] = None
        self.points = self.deal(distinct, "dcell")
        ends = [f(c).alias(f"{name}{i}") for i, c in enumerate(columns) for f, name in ((F.min, "lo"), (F.max, "hi"))]
        rows = self.points.groupBy("dcell").agg(F.sum("copies").alias("size"), *ends).orderBy("dcell").collect()
        self.names, self.sizes = np.array([r["dcell"] for r in rows]), np.array([r["size"] for r in rows])
        self.low, self.high = (np.array([[r[f"{name}{i}"] for i in range(len(columns))] for r in rows]) for name in ("lo", "hi"))

    def deal(self, rows: DataFrame, name: str) -> DataFrame:
        columns, depth, axes, cuts = self.columns, self.depth, self.axes, self.cuts

        def run(batches):
            for pdf in batches:
                at, node = pdf[columns].to_numpy(float), np.zeros(len(pdf), int)
                for _ in range(depth):
                    node = 2 * node + 1 + (at[np.arange(len(at)), axes[node]] > cuts[node])
                yield pdf.assign(**{name: node})

        return rows.mapInPandas(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"{name} long"]))

    def queries(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id, columns, ...) with qcell: the leaf they fall into, in parts of about ``CELL_ROWS`` where many do."""
        dealt = shared_table(self.deal(rows, "leaf"), "queries")
        parts = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / CELL_ROWS).alias("parts"))
        return dealt.join(F.broadcast(parts), "leaf").withColumn("qcell", F.struct("leaf", F.pmod("id", "parts").alias("part"))).drop("leaf", "parts")

    def route(self, rows: DataFrame, choose, schema: str) -> DataFrame:
        """Rows to the cells that ``choose`` names: it takes rows and their least and largest differences from the boxes."""
        columns, low, high = self.columns, self.low, self.high

        def run(batches):
            for pdf in batches:
                step = max(1, BLOCK // len(low))
                for start in range(0, len(pdf), step):
                    own = pdf.iloc[start : start + step]
                    at = own[columns].to_numpy(float)[:, None]
                    yield choose(own, np.maximum(np.maximum(low - at, at - high), 0).max(axis=2), np.maximum(at - low, high - at).max(axis=2))

        return shared_table(rows.mapInPandas(run, schema), "routed")

    def meet(self, routed: DataFrame, run, schema: str) -> DataFrame:
        """``run`` of every two cells that routed rows ask for."""
        pairs = routed.select(F.col("qcell").alias("asker"), F.col("dcell").alias("asked")).distinct()
        points = self.points.join(F.broadcast(pairs), F.col("dcell") == F.col("asked"))
        return routed.groupBy("qcell", "dcell").cogroup(points.groupBy("asker", "asked")).applyInPandas(run, schema)


def _blocks(a: np.ndarray, b: np.ndarray):
    step = max(1, BLOCK // max(1, len(b)))
    for lo in range(0, len(a), step):
        yield lo, np.abs(a[lo : lo + step, None, :] - b[None]).max(axis=2)


QCELL = "qcell struct<leaf: long, part: long>"


def kth_distance(queries: DataFrame, data: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(id, radius): the distance of every query (id, columns) to the k-th nearest row of ``data``, the nearest being the 0-th.

    The nearest cell bounds the distance; then each query visits the other cells whose boxes lie nearer than its bound. No more
    than k + 1 copies of a point can be among its k + 1 nearest.
    """
    cells = Cells(data, columns)
    names = cells.names

    def met(q: pd.DataFrame, p: pd.DataFrame) -> tuple[np.ndarray, list]:
        b = np.repeat(p[columns].to_numpy(float), np.minimum(p["copies"], k + 1), axis=0)
        near = [np.zeros((0, 0))]
        if len(q) and len(b):
            near = [np.partition(d, k, axis=1)[:, : k + 1] if d.shape[1] > k + 1 else d for _, d in _blocks(q[columns].to_numpy(float), b)]
        return [v for block in near for v in block]

    def nearest(own: pd.DataFrame, near: np.ndarray, _) -> pd.DataFrame:
        return own.assign(dcell=names[near.argmin(axis=1)])

    def first(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        return q.assign(near=met(q, p))[["id", *columns, "qcell", "dcell", "near"]]

    def others(own: pd.DataFrame, near: np.ndarray, _) -> pd.DataFrame:
        bound = np.array([max(v) if len(v) > k else np.inf for v in own["near"]])
        row, cell = np.nonzero((near < bound[:, None]) & (names[None] != own["dcell"].to_numpy()[:, None]))
        return own.iloc[row][["id", *columns, "qcell"]].assign(dcell=names[cell])

    def further(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": q["id"], "near": met(q, p)})

    routed = _numbers(columns, QCELL, "dcell long")
    begun = cells.route(cells.queries(queries.select("id", *columns)).select("id", *columns, "qcell"), nearest, f"id long, {routed}")
    begun = shared_table(cells.meet(begun, first, f"id long, {routed}, near array<double>"), "nearest")
    more = cells.meet(cells.route(begun, others, f"id long, {routed}"), further, "id long, near array<double>")
    near = begun.select("id", "near").unionByName(more).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    return near.select("id", F.get("near", F.lit(k)).alias("radius"))


def count_within(queries: DataFrame, data: DataFrame, columns: list[str]) -> DataFrame:
    """(id, count): how many rows of ``data`` lie within every query's own radius (id, columns, radius).

    Cells that lie inside as a whole count by their size; only those on the border are searched.
    """
    cells = Cells(data, columns)
    names, sizes = cells.names, cells.sizes

    def border(own: pd.DataFrame, near: np.ndarray, far: np.ndarray) -> pd.DataFrame:
        radius = own["radius"].to_numpy()[:, None]
        inside = far <= radius
        row, cell = np.nonzero((near <= radius) & ~inside)
        kept = own[["id", *columns, "radius", "qcell"]]
        return pd.concat([kept.assign(dcell=-1, whole=inside @ sizes), kept.iloc[row].assign(dcell=names[cell], whole=0)])

    def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        a, radius, copies = q[columns].to_numpy(float), q["radius"].to_numpy(), p["copies"].to_numpy()
        counts = [(d <= radius[lo : lo + len(d), None]) @ copies for lo, d in _blocks(a, p[columns].to_numpy(float))]
        return pd.DataFrame({"id": q["id"], "count": np.concatenate([np.zeros(0, int), *counts])})

    asked = cells.queries(queries.select("id", *columns, "radius")).select("id", *columns, "radius", "qcell")
    routed = cells.route(asked, border, f"id long, {_numbers(columns, 'radius double', QCELL, 'dcell long', 'whole long')}")
    parts = cells.meet(routed.filter("dcell >= 0"), search, "id long, count long").unionByName(routed.filter("dcell < 0").select("id", F.col("whole").alias("count")))
    return parts.groupBy("id").agg(F.sum("count").alias("count"))
