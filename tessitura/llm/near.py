"""Near-duplicates by exact similarity: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Words are those of ``simhash``. Texts with one set (its XXH64 is the node) are copies. Links come from two exact checks:

1. SimHash comes first: fingerprints over the same shingles are linked by the generalised pigeonhole, and every text of a
   linked group is compared with the group's first one. What is similar becomes one component, and whatever follows
   compares texts of different components only.
2. A similarity of 0.8 leaves about 10 of 64 bits to differ, more than any pigeonhole can probe, so the prefix filter,
   which loses no pair, completes the links between what SimHash left apart: the shingles of a set are put in one global
   order, and two sets of similarity 0.8 meet in the first fifth of it, at places early enough that what follows can still
   make up the overlap. The order takes shingles first whose cell in a sketch of sampled sets is least filled, so that common
   lines and the body of large groups come last; any order gives the same result. Texts first meet each shingle's centre
   only (the set whose prefix is the commonest), so that large groups of copies don't meet as all pairs in the exact join.

Every candidate is verified on the two sets. Before that, a sketch of each set (how many of its hashes fall in each cell, a
few of them to a cell) bounds the overlap from above, which turns most candidates away for a small part of the sets' size
and loses none. Sets are never stored: they are made again where needed, from the texts of candidates within the bound only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.common import clear_state, durable, forget, text_batches
from tessitura.llm.components import connected_components
from tessitura.llm.simhash import link_fingerprints, majority, shingle_hashes

WORDS = 5
CELL_BITS = 20
#: One set in so many feeds the sketch; this moves the order, never the result.
SAMPLE = 8
#: Bits of the filter that keeps texts without a candidate from being hashed; a bit too many costs a row, never a result.
SLOTS = 1 << 24
#: Cells of a sketch: a power of two, at least this many, and about so many hashes to a cell.
LEAST_CELLS, CELL_FILL = 128, 3
#: Nodes that a task remembers, so as to send each but once; more only cost repeated rows.
REMEMBERED = 200_000
SET_SCHEMA = "node long, hashes binary"
MET_SCHEMA = "u long, v long, comp_u long, comp_v long, text_u long, text_v long"
PREFIX_SCHEMA = "key long, node long, n int, at int, common float"


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, words))


def _node(data: bytes) -> int:
    value = xxhash.xxh64_intdigest(data, 42)
    return value - (1 << 64) if value >> 63 else value


def _row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, node, fp, sketch): the texts' sets as nodes, their fingerprints and sketches."""
    clear_state()
    for batch in batches:
        nodes, sketches, found, some, size = [], [], [np.zeros(0, np.uint64)], [], 0
        for value in batch.column(2).cast(pa.binary()):
            own = shingle_hashes(value.as_py(), WORDS)
            distinct = np.unique(own)
            nodes.append(_node(distinct.tobytes()))
            sketches.append(set_sketch(distinct))
            some.append(own)
            size += len(own)
            if size > 100_000:
                found.append(majority(some))
                some, size = [], 0
        found.append(majority(some))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(np.concatenate(found).view(np.int64)), pa.array(sketches, pa.binary())], ["doc_id", "text_hash", "node", "fp", "sketch"])


def set_sketch(distinct: np.ndarray) -> bytes | None:
    """How many of a set's hashes fall in each cell; None if a cell holds more than a byte can say."""
    cells = max(LEAST_CELLS, 1 << max(0, len(distinct) // CELL_FILL).bit_length())
    counts = np.bincount((distinct & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def may_be_similar(a: bytes | None, b: bytes | None) -> bool:
    """Whether the sketches' bound on the overlap leaves a similarity of 0.8 possible; always, without a sketch."""
    if a is None or b is None:
        return True
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    total, cells = int(x.sum() + y.sum()), min(len(x), len(y))
    x, y = (v.reshape(-1, cells).sum(axis=0) for v in (x, y))
    return 9 * int(np.minimum(x, y).sum()) >= 4 * total


def _sets(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[int, bytes]]:
    """(node, set) of every text in column ``at``, each node once for as long as it is remembered."""
    seen: set[int] = set()
    for batch in batches:
        for value in batch.column(at).cast(pa.binary()):
            data = shingle_set(value.as_py()).tobytes()
            node = _node(data)
            if node not in seen:
                if len(seen) < REMEMBERED:
                    seen.add(node)
                yield node, data


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        for value in batch.column(0).cast(pa.binary()):
            np.add.at(total, _cells(shingle_set(value.as_py())), 1)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["k", "c"])


def _prefix_batches(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, parts, rows = held.value, [], 0
        for node, data in _sets(batches, 0):
            own = np.frombuffer(data, "<u8")
            n = len(own)
            if not n:
                continue
            fill = sketch[_cells(own)]
            first = np.lexsort((own, fill))[: n - (4 * n + 4) // 5 + 1]
            many = len(first)
            parts.append((own[first].view(np.int64), np.full(many, node), np.full(many, n, np.int32), np.arange(many, dtype=np.int32), np.full(many, np.log2(1.0 + fill[first]).mean(), np.float32)))
            rows += many
            if rows > 100_000:
                yield _prefixes(parts)
                parts, rows = [], 0
        if parts:
            yield _prefixes(parts)

    return run


def _prefixes(parts: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["key", "node", "n", "at", "common"])


def _wanted_batches(held):
    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy() & (SLOTS - 1)
            yield batch.filter(pa.array((held.value[slot >> 3] >> (slot & 7) & 1).astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, size = [], [], 0
        for node, data in _sets(wanted(batches), 1):
            nodes.append(node)
            sets.append(data)
            size += len(data)
            if size > 8_000_000:
                yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "hashes"])
                nodes, sets, size = [], [], 0
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "hashes"])

    return run


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8")
            both = np.concatenate((a, b))
            both.sort(kind="stable")
            keep.append(9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both))
        yield pa.record_batch(batch.columns[:2], ["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _bounded_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [may_be_similar(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        yield batch.drop_columns(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _reachable(n_a: Column, at_a: Column, n_b: Column, at_b: Column) -> Column:
    """A first common shingle at these places leaves enough behind it for a similarity of 0.8."""
    return F.least(n_a - at_a, n_b - at_b) * 9 >= (n_a + n_b) * 4


def _merged(comps: DataFrame, pairs: DataFrame, texts: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """``comps`` (node, comp) after similar sets among the pairs (u, v) have made their components one.

    Pairs within a component are neither sketched nor verified; ``nodes`` has (node, text_hash, sketch).
    """
    ends = nodes.hint("merge").join(comps, "node")
    a = ends.select(F.col("node").alias("u"), F.col("comp").alias("comp_u"), F.col("text_hash").alias("text_u"), F.col("sketch").alias("a"))
    b = ends.select(F.col("node").alias("v"), F.col("comp").alias("comp_v"), F.col("text_hash").alias("text_v"), F.col("sketch").alias("b"))
    apart = pairs.select("u", "v").distinct().hint("merge").join(a, "u").hint("merge").join(b, "v").filter("comp_u <> comp_v")
    met = durable(apart.select("u", "v", "comp_u", "comp_v", "text_u", "text_v", "a", "b").mapInArrow(_bounded_batches, MET_SCHEMA), "candidates")
    slot = F.pmod("text_hash", F.lit(SLOTS))
    wanted = met.select(F.explode(F.array("text_u", "text_v")).alias("text_hash")).select(F.shiftright(slot, 3).cast("int").alias("k"), F.expr("shiftleft(1, cast(pmod(text_hash, 8) as int))").alias("bit"))
    bits = wanted.groupBy("k").agg(F.bit_or("bit").alias("bit")).toArrow()
    if not bits.num_rows:
        forget(met)
        return comps
    filled = np.zeros(SLOTS // 8, np.uint8)
    filled[bits["k"].to_numpy()] = bits["bit"].to_numpy()
    sets = texts.select("text_hash", "text").mapInArrow(_wanted_batches(texts.sparkSession.sparkContext.broadcast(filled)), SET_SCHEMA)
    sets = durable(sets.repartition("node").dropDuplicates(["node"]), "wanted")
    a = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    both = met.hint("merge").join(a, "u").hint("merge").join(b, "v")
    links = durable(both.select("comp_u", "comp_v", "a", "b").mapInArrow(_verify_batches, "u long, v long"), "verified")
    labels = connected_components(links)
    out = durable(_labelled(comps, labels), name)
    forget(met, sets, links, labels, comps)
    return out


def near_groups(docs: DataFrame, distance: int = 4) -> DataFrame:
    """(doc_id, text_hash, node, comp) per row; comp is the smallest node of the near-duplicate group.

    ``distance`` is that of the fingerprints which are proposed; it moves work, never the result.
    """
    text_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = durable(slim.mapInArrow(_row_batches, "doc_id long, text_hash long, node long, fp long, sketch binary"), "nodes")
    sampled = slim.filter(F.pmod("text_hash", F.lit(SAMPLE)) == 0).select("text")
    found = sampled.mapInArrow(_sketch_batches, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    sketch = np.zeros(1 << CELL_BITS, np.int32)
    sketch[found["k"].to_numpy()] = np.minimum(found["c"].to_numpy(), 1 << 30)
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    # texts of one set can repeat shingles differently; one of their fingerprints stands for the set
    nodes = durable(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("text_hash").alias("text_hash"), F.any_value("sketch").alias("sketch")), "sets")
    groups = durable(nodes.select("node", "fp").hint("merge").join(link_fingerprints(nodes.select("fp"), distance), "fp"), "proposed")
    first = groups.groupBy("comp").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter(F.col("first") != F.col("last"))
    proposed = groups.join(first, "comp").filter(F.col("node") != F.col("first")).select(F.col("node").alias("u"), F.col("first").alias("v"))
    comps = durable(nodes.select("node", F.col("node").alias("comp")), "own")
    comps = _merged(comps, proposed, slim, nodes, "simhash")
    forget(groups)

    prefixes = slim.select("text").mapInArrow(_prefix_batches(held), PREFIX_SCHEMA)
    own = Window.partitionBy("key")
    shared = prefixes.repartition("key").dropDuplicates(["key", "node"])
    shared = shared.withColumn("members", F.count("*").over(own)).withColumn("centre", F.max(F.struct("common", "node", "n", "at")).over(own))
    shared = durable(shared.filter("members > 1").drop("members", "common"), "shared")

    star = shared.filter((F.col("node") != F.col("centre.node")) & _reachable(F.col("n"), F.col("at"), F.col("centre.n"), F.col("centre.at")))
    comps = _merged(comps, star.select(F.col("node").alias("u"), F.col("centre.node").alias("v")), slim, nodes, "starred")

    placed = durable(shared.drop("centre").hint("merge").join(comps, "node"), "placed")
    forget(shared)
    a = placed.select("key", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "at", "comp")])
    b = placed.filter((F.col("n") - F.col("at")) * 9 >= F.col("n") * 8).select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "at", "comp")])
    order = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    apart = order & (F.col("comp_a") != F.col("comp_b")) & _reachable(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"))
    pairs = a.hint("merge").join(b, (a["key"] == b["key"]) & apart).select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))
    comps = _merged(comps, pairs, slim, nodes, "groups")
    forget(placed, nodes)
    return rows.select("doc_id", "text_hash", "node").hint("merge").join(comps, "node")


def _labelled(comps: DataFrame, labels: DataFrame) -> DataFrame:
    step = labels.select(F.col("node").alias("old"), F.col("component").alias("new"))
    return comps.hint("merge").join(step, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp"))


def keep_one_near(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest doc_id, of rows that share it one.

    Null texts and texts without words have the empty set and are copies of each other. Null ids come after all others;
    equal rows count as one. An empty table gives no rows; other columns stay.
    A row's key is its doc_id and the hash of its text, so rows of other groups never replace it. The survivors' keys grow
    with the input, so they meet the texts in a sort-merge join at every size, never by broadcast.
    """
    found = near_groups(docs).groupBy("comp", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    least = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "copies")).alias("least"))
    keys = durable(least.select(F.col("least.doc_id").alias("keep_id"), F.col("least.text_hash").alias("keep_hash"), F.col("least.copies").alias("copies")), "survivors")
    keyed = docs.withColumn("_text_hash", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_text_hash") == F.col("keep_hash"))
    once = keyed.join(keys.filter("copies = 1").hint("merge"), same, "left_semi")
    repeated = keys.filter("copies > 1")
    if not repeated.isEmpty():
        once = once.unionByName(keyed.join(repeated.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "_text_hash"]))
    return once.drop("_text_hash")
