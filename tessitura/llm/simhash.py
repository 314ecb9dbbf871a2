"""SimHash near-duplicates: word-shingle fingerprints linked by the generalised pigeonhole principle.

Fingerprints: a text is lower-cased (A-Z only), cut into words, and every 4-word shingle is hashed with XXH64; a bit
of the fingerprint is set if more than half of the hashes set it. A null or wordless text has fingerprint zero and is
linked like any other. Distinct fingerprints are the nodes, so copies never meet each other as pairs.

Links (``max_distance`` differing bits or fewer) come from two exact steps:

1. Bits that differ in one place: fingerprints that agree outside one run of 4 bits (fewer for smaller distances) form
   groups of 16 at most, each of which yields a star. Their components collapse the dense cubes of near copies.
2. Generalised pigeonhole for the whole distance: correlated bits are grouped into partitions, every fingerprint gets
   its own threshold per partition by dynamic programming on estimated candidate counts, with the thresholds' sum
   fixed so that no pair within the distance can escape; probes meet the partition index in an equi-join that
   verifies the distance and skips pairs that are already known to be one component.

Between the two, index keys meet their smallest fingerprint only, in a few rounds, so that dense groups are one component
before the exact join, which then has few pairs left to emit. The number of partitions follows from the distance alone, so
probes per fingerprint are the same at every size. Nothing is dropped at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import durable, forget, table, text_batches
from tessitura.llm.components import connected_components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SUB_BITS = 8
#: Shingles that are unpacked to bits at a time.
PIECE = 100_000
#: Rounds in which index keys meet their smallest fingerprint only, before the exact join; they move no result.
STAR_ROUNDS = 3
#: Cost of comparing a candidate, in units of one probe row's shuffle and sort.
CANDIDATE_COST = 0.05
#: Cost of a threshold whose probes would be too many to list.
UNLISTED = 1e30


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``words`` words, repeats included; fewer words make one shingle."""
    parts = (text or b"").translate(LOWER).split()
    if not parts:
        return np.zeros(0, "<u8")
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, 42)], "<u8")
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    del parts
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(ends) - words + 1]
    ends, out = ends[words - 1 :], np.empty(len(starts), "<u8")
    for lo in range(0, len(out), PIECE):
        some = zip(starts[lo : lo + PIECE].tolist(), ends[lo : lo + PIECE].tolist(), strict=True)
        out[lo : lo + PIECE] = [digest(joined[a:b], 42) for a, b in some]
    return out


def majority(runs: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each run of hashes, a bit set if over half of the run sets it; an empty run gives zero."""
    sizes = np.array([len(r) for r in runs], np.int64)
    out, full = np.zeros(len(runs), np.uint64), np.flatnonzero(sizes)
    if len(full):
        hashes, ends = np.concatenate([runs[i] for i in full]), np.cumsum(sizes[full])
        ones = np.zeros((len(full), 64), np.int64)
        for lo in range(0, len(hashes), PIECE):
            some = hashes[lo : lo + PIECE]
            bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first, last = np.searchsorted(ends, [lo, lo + len(some) - 1], "right")
            starts = np.concatenate(([0], ends[first:last] - lo))
            ones[first : last + 1] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        over = (2 * ones > sizes[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _fingerprint_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, some, size = [np.zeros(0, np.uint64)], [], 0
            for value in batch.column(1).cast(pa.binary()):
                some.append(shingle_hashes(value.as_py(), words))
                size += len(some[-1])
                if size > PIECE:
                    found.append(majority(some))
                    some, size = [], 0
            found.append(majority(some))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(found).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp is the 64-bit fingerprint as a signed long. Null text counts as empty."""
    text_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_fingerprint_batches(words), "doc_id long, fp long")


# --- generalised pigeonhole ---------------------------------------------------------------------------------------


def _cooccurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64))
    for batch in batches:
        fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(fps, axis=1, bitorder="little").astype(np.float32)
        total += bits.T @ bits
    yield pa.record_batch([pa.array(np.arange(4096, dtype=np.int32)), pa.array(total.ravel().astype(np.int64))], ["k", "c"])


def _grid(rows: list, size: int) -> np.ndarray:
    out = np.zeros(size)
    for k, c in rows:
        out[k] = c
    return out


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Cut 64 bits into ``parts`` groups of near-equal size, each grown from a seed by its strongest correlations."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    link = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(link, 0)
    left, groups = set(range(64)), []
    for i in range(parts):
        size = 64 // parts + (i < 64 % parts)
        seed = max(sorted(left), key=lambda b: link[b, sorted(left)].max(initial=0))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: link[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(group)
    return groups


def parts_for(distance: int) -> int:
    """Number of partitions, a matter of the distance alone, so probes per fingerprint don't grow with the input.

    Half a partition per bit leaves most thresholds at one bit: 45 probes on 21-bit partitions for 4 bits.
    """
    return max(2, (distance + 2) // 2)


def _choose(n: float, d: int) -> float:
    out = 1.0
    for i in range(d):
        out *= (n - i) / (i + 1)
    return out


def _gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for at, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << at
    return out


def _subs(group: list[int]) -> list[list[int]]:
    return [group[i : i + SUB_BITS] for i in range(0, len(group), SUB_BITS)]


def _sub_histograms(groups: list[list[int]]):
    subs = [s for g in groups for s in _subs(g)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(subs), 256), np.int64)
        for batch in batches:
            fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for i, s in enumerate(subs):
                total[i] += np.bincount(_gather(fps, s), minlength=256)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(flat[at])], ["k", "c"])

    return run


def distance_tables(histograms: np.ndarray, distance: int) -> np.ndarray:
    """For every sub-partition and value, the share of fingerprints at each distance 0..``distance`` from it."""
    values = np.arange(256)
    apart = np.array([bin(x).count("1") for x in values])[values[:, None] ^ values[None, :]]
    share = histograms / max(histograms[0].sum(), 1)
    return np.stack([share @ (apart == d) for d in range(distance + 1)], axis=2)


def allocate(counts: list[np.ndarray], probes: list[np.ndarray], distance: int) -> np.ndarray:
    """Thresholds + 1 per fingerprint and partition, of sum ``distance`` + 1, of least estimated cost.

    counts[i][:, t] estimates the candidates of partition i at threshold t, probes[i][t] its probes. A threshold of
    -1 (0 here) leaves a partition out. By the generalised pigeonhole principle two fingerprints that differ in
    ``distance`` bits or fewer agree to within the threshold in some partition.
    """
    rows, budget = len(counts[0]), distance + 1
    best = np.full((rows, budget + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for own, tries in zip(counts, probes, strict=True):
        cost = np.concatenate([np.zeros((rows, 1)), tries[None, :] + CANDIDATE_COST * own], axis=1)
        new, pick = np.full_like(best, np.inf), np.zeros((rows, budget + 1), np.int8)
        for units in range(budget + 1):
            for spent in range(budget + 1 - units):
                value = best[:, spent] + cost[:, units]
                better = value < new[:, spent + units]
                new[better, spent + units] = value[better]
                pick[better, spent + units] = units
        best = new
        picks.append(pick)
    out, left = np.zeros((rows, len(counts)), np.int64), np.full(rows, budget)
    for i in range(len(counts) - 1, -1, -1):
        out[:, i] = picks[i][np.arange(rows), left]
        left = left - out[:, i]
    if rows and best[:, budget].max() >= UNLISTED:
        raise ValueError(f"{len(counts)} partitions need too many probes for {distance} bits; take more of them")
    return out


def _probe_batches(groups: list[list[int]], near: np.ndarray, n: int, distance: int):
    masks, cuts, at = [], [], 0
    where = []
    for g in groups:
        own, cut = [], []
        for d in range(distance + 1):
            own += [sum(1 << b for b in c) for c in combinations(range(len(g)), d)] if _choose(len(g), d) < 2e5 else []
            cut.append(len(own))
        masks.append(np.array(own, np.int64))
        cuts.append(np.array(cut))
        where.append(range(at, at + len(_subs(g))))
        at += len(_subs(g))
    # a threshold whose probes were not listed costs more than any other, so the allocation leaves it out or raises
    tries = [np.array([c if i == 0 or c > cut[i - 1] else UNLISTED for i, c in enumerate(cut)], float) for cut in cuts]

    def estimates(fps: np.ndarray) -> list[np.ndarray]:
        out = []
        for g, subs in zip(groups, where, strict=True):
            spread = np.zeros((len(fps), distance + 1))
            spread[:, 0] = 1
            for i, s in zip(subs, _subs(g), strict=True):
                own = near[i][_gather(fps, s)]
                spread = np.stack([sum(spread[:, a] * own[:, d - a] for a in range(d + 1)) for d in range(distance + 1)], axis=1)
            out.append(n * np.cumsum(spread, axis=1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            all_comps = batch.column(1).to_numpy(zero_copy_only=False)
            for lo in range(0, len(all_fps), 4096):
                signed, comps = all_fps[lo : lo + 4096], all_comps[lo : lo + 4096]
                fps = signed.view(np.uint64)
                units = allocate(estimates(fps), tries, distance)
                for i, g in enumerate(groups):
                    value, tag = _gather(fps, g), np.int64(i) << np.int64(56)
                    rows = [(value | tag, signed, comps, False)]
                    for t in range(1, distance + 2):
                        pick = np.flatnonzero(units[:, i] == t)
                        if len(pick):
                            flips = masks[i][: cuts[i][t - 1]]
                            keys = (value[pick][:, None] ^ flips[None, :]).ravel() | tag
                            rows.append((keys, np.repeat(signed[pick], len(flips)), np.repeat(comps[pick], len(flips)), True))
                    for keys, own, comp, probe in rows:
                        yield pa.record_batch(
                            [pa.array(keys), pa.array(own), pa.array(comp), pa.array(np.full(len(keys), probe))],
                            ["key", "fp", "comp", "probe"],
                        )

    return run


def _cube_edges(nodes: DataFrame, width: int) -> DataFrame:
    """Stars over fingerprints that agree outside one run of ``width`` bits; a group has 2^width members at most."""
    outside = [((1 << 64) - 1) & ~(((1 << width) - 1) << at) for at in range(0, 64, width)]
    signed = [m - (1 << 64) if m >> 63 else m for m in outside]
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("rest")) for i, m in enumerate(signed)])
    grouped = (
        nodes.select("fp", F.explode(keys).alias("k"))
        .groupBy("k.part", "k.rest")
        .agg(F.collect_set("fp").alias("members"))
        .filter(F.size("members") > 1)
    )
    return grouped.select(F.explode("members").alias("u"), F.array_min("members").alias("v")).filter("u <> v")


def _relabel(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """comp of ``nodes`` replaced by the component that ``labels`` gives it."""
    step = labels.select(F.col("node").alias("old"), F.col("component").alias("new"))
    return nodes.join(step, F.col("comp") == F.col("old"), "left").select("fp", F.coalesce("new", "comp").alias("comp"))


def link_fingerprints(fps: DataFrame, distance: int = 4, parts: int | None = None) -> DataFrame:
    """(fp, comp) per distinct non-null fp: comp is the smallest fingerprint (as a signed long) of its component."""
    nodes = durable(fps.select("fp").filter("fp is not null").distinct(), "fps")
    n = nodes.count()
    labelled = nodes.select("fp", F.col("fp").alias("comp"))
    if n < 2 or distance < 1:
        return labelled
    labelled = durable(_relabel(labelled, connected_components(_cube_edges(nodes, min(distance, 4)))), "cubes")
    if distance == 1:
        return labelled
    both = _grid(nodes.mapInArrow(_cooccurrence, "k int, c long").groupBy("k").agg(F.sum("c")).collect(), 4096)
    groups = group_bits(both.reshape(64, 64), n, parts or parts_for(distance))
    labelled = _star_rounds(labelled, groups, distance)
    size = 256 * sum(len(_subs(g)) for g in groups)
    counts = nodes.mapInArrow(_sub_histograms(groups), "k int, c long").groupBy("k").agg(F.sum("c")).collect()
    near = distance_tables(_grid(counts, size).reshape(-1, 256), distance)
    schema = "key long, fp long, comp long, probe boolean"
    rows = durable(labelled.mapInArrow(_probe_batches(groups, near, n, distance), schema), "probes")
    left = rows.filter("probe").select("key", F.col("fp").alias("fp_a"), F.col("comp").alias("u"))
    right = rows.filter("not probe").select("key", F.col("fp").alias("fp_b"), F.col("comp").alias("v"))
    # every fingerprint's own probes find all that is near it, so of two fingerprints only the smaller one's need count
    near_by = (F.col("fp_a") < F.col("fp_b")) & (F.col("u") != F.col("v")) & (_apart("fp_a", "fp_b") <= distance)
    pairs = left.hint("merge").join(right, (left["key"] == right["key"]) & near_by)
    merged = connected_components(pairs.select("u", "v"))
    linked = durable(_relabel(labelled, merged), "linked")
    forget(nodes, rows, merged, labelled)
    return linked


def _apart(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _star_rounds(labelled: DataFrame, groups: list[list[int]], distance: int) -> DataFrame:
    """``labelled`` with components merged along links to the centre of each index key, so that dense groups meet the
    exact join as one component.

    A key's centre is one fingerprint of its smallest component; in the next round the members that are still apart from
    it have centres of their own. Rounds end when a round merges under one fingerprint in a thousand.
    """
    masks = [sum(1 << b for b in g) for g in groups]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed)])
    total = labelled.count()
    apart = labelled.select("fp", "comp", F.explode(keys).alias("k")).select("fp", "comp", "k.part", "k.value")
    tables = []
    for _ in range(STAR_ROUNDS):
        # partial aggregates first, so a hot key costs its task one row from each other task
        centres = apart.groupBy("part", "value").agg(F.min(F.struct("comp", "fp")).alias("centre"), F.max("comp").alias("most")).filter(F.col("centre.comp") != F.col("most"))
        met = durable(apart.join(centres.select("part", "value", F.col("centre.comp").alias("v"), F.col("centre.fp").alias("to")), ["part", "value"]).filter("comp <> v"), "met")
        tables.append(met)
        links = met.filter(_apart("fp", "to") <= distance).select(F.col("comp").alias("u"), "v").distinct()
        merged = connected_components(links)
        moved = merged.count()
        if moved:
            before, labelled = labelled, durable(_relabel(labelled, merged), "stars")
            forget(before)
        if moved * 1000 < total:
            break
        left = met.filter(_apart("fp", "to") > distance).select("fp", "part", "value")
        apart = left.hint("merge").join(labelled, "fp")
    forget(*tables)
    return labelled


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row: component_id is the smallest doc_id reachable over links, itself included.

    Repeated rows stay, each with its own result. Null texts and texts without words have fingerprint zero. A null
    doc_id stays null and is never a component's id while another member has one. Empty input gives no rows.
    """
    fps = durable(fingerprints(docs, words, id_col, text_col), "fingerprints")
    linked = link_fingerprints(fps, distance)
    by_fp = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    of_fp = by_fp.join(linked, "fp")
    ids = durable(of_fp.groupBy("comp").agg(F.min("least").alias("component_id")), "ids")
    final = durable(linked.join(ids, "comp").select("fp", "component_id"), "components")
    return fps.join(final, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for all of ``documents``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
