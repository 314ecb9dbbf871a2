"""Quality classifier: a byte-level convolutional network in numpy.

Every byte of the whole document is embedded and joined by an echo channel (does the four-byte string that ends here
also end within the last ``ECHO`` bytes). Filters of 8 bytes at every fourth byte give activations; overlapping chunks
of two 64-byte blocks average them; a second layer of filters reads each chunk, is max-pooled over all chunks of the
document, and is combined into one probability. Memory is bounded per slice of a document batch.

Training runs on the driver over a bounded, hash-chosen sample of labelled documents, the same for the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import DOCUMENT_COLUMNS, crc_fold, hashed_fraction, plus, table, text_batches, worker_state

#: Expected number of labelled documents per class that training reads at most, and the longest text among them.
TRAIN_PER_CLASS = 700
TRAIN_CHARS = 200_000
EMBED, FILTERS, CHUNK_FILTERS = 8, 16, 8
ECHO = 32
BLOCK = 64
STEP = 4
CHANNELS = EMBED + 1
EPOCHS = 10
BATCH = 16
RATE = 0.01
SEED = 7


def echo_channel(data: np.ndarray) -> np.ndarray:
    """1 where the four bytes that end here also end within the last ``ECHO`` bytes."""
    n = len(data)
    out = np.zeros(n, bool)
    if n > 4:
        four = np.lib.stride_tricks.sliding_window_view(data, 4).copy().view("<u4")[:, 0]
        for lag in range(2, min(ECHO, len(four) - 1) + 1):
            out[3 + lag :] |= four[lag:] == four[:-lag]
    return out


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, echo, valid windows per block, first block of each text), texts padded to whole blocks, two at least."""
    blocks = np.array([max(2, -(-len(t) // BLOCK)) for t in texts])
    starts = np.concatenate(([0], np.cumsum(blocks)))
    data = np.zeros(starts[-1] * BLOCK, np.uint8)
    echo = np.zeros(len(data), np.float32)
    valid = np.zeros(starts[-1], np.float32)
    for t, s, b in zip(texts, starts.tolist(), blocks.tolist(), strict=False):
        own = np.frombuffer(t, np.uint8)
        data[s * BLOCK : s * BLOCK + len(own)] = own
        echo[s * BLOCK : s * BLOCK + len(own)] = echo_channel(own)
        valid[s : s + b] = np.clip(-(-(len(t) - BLOCK * np.arange(b)) // STEP), 0, BLOCK // STEP)
    return data, echo, valid, starts


class Network:
    """The parameters, scoring, and training by hand-written gradients."""

    NAMES = ("embed", "conv", "conv_bias", "chunk", "chunk_bias", "out", "out_bias")

    def __init__(self, parameters: dict[str, np.ndarray] | None = None):
        rng = np.random.default_rng(SEED)
        start = {
            "embed": rng.normal(0, 0.5, (256, EMBED)),
            "conv": rng.normal(0, 0.2, (2 * STEP * CHANNELS, FILTERS)),
            "conv_bias": np.zeros(FILTERS),
            "chunk": rng.normal(0, 0.5, (FILTERS, CHUNK_FILTERS)),
            "chunk_bias": np.zeros(CHUNK_FILTERS),
            "out": rng.normal(0, 0.5, CHUNK_FILTERS),
            "out_bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in (parameters or start).items()}

    def activations(self, data: np.ndarray, echo: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Filter outputs (before the rectifier) at every fourth byte; behind a text's last block its windows see zeros."""
        cells = np.empty((len(data), CHANNELS), np.float32)
        cells[:, :EMBED] = self.p["embed"][data]
        cells[:, EMBED] = echo
        cells = cells.reshape(-1, STEP * CHANNELS)
        half = STEP * CHANNELS
        out = cells @ self.p["conv"][:half]
        after = cells[1:] @ self.p["conv"][half:]
        after[starts[1:-1] * (BLOCK // STEP) - 1] = 0
        out[:-1] += after
        return out + self.p["conv_bias"]

    def chunks(self, texts: list[bytes]):
        """(chunk filter outputs, means per chunk, windows' outputs, layout) of a list of texts."""
        data, echo, valid, starts = lay_out(texts)
        raw = self.activations(data, echo, starts)
        per = BLOCK // STEP
        mask = np.arange(per)[None, :] < valid[:, None]
        active = (np.maximum(raw, 0).reshape(-1, per, FILTERS) * mask[:, :, None]).sum(axis=1)
        total = active[:-1] + active[1:]
        weight = np.maximum(valid[:-1] + valid[1:], 1)
        means = total / weight[:, None]
        return means @ self.p["chunk"] + self.p["chunk_bias"], means, raw, (data, echo, valid, starts, mask, weight)

    def pooled(self, texts: list[bytes]):
        value, means, raw, layout = self.chunks(texts)
        starts = layout[3]
        best = np.zeros((len(texts), CHUNK_FILTERS), np.int64)
        for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            best[i] = a + value[a : b - 1].argmax(axis=0)
        peak = np.maximum(np.take_along_axis(value, best, axis=0), 0)
        return peak, best, value, means, raw, layout

    def score(self, texts: list[bytes]) -> np.ndarray:
        peak = self.pooled(texts)[0]
        logit = (peak @ self.p["out"] + self.p["out_bias"][0]).astype(float)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        peak, best, value, means, raw, (data, echo, valid, starts, mask, weight) = self.pooled(texts)
        p, per = self.p, BLOCK // STEP
        logit = peak @ p["out"] + p["out_bias"][0]
        d_logit = (1 / (1 + np.exp(-logit)) - labels) / len(texts)
        g = {"out": peak.T @ d_logit, "out_bias": np.array([d_logit.sum()])}
        d_peak = d_logit[:, None] * p["out"] * (peak > 0)
        d_value = np.zeros_like(value)
        for i in range(len(texts)):
            d_value[best[i], np.arange(CHUNK_FILTERS)] += d_peak[i]
        touched = np.flatnonzero(np.abs(d_value).sum(axis=1) > 0)
        g["chunk"], g["chunk_bias"] = means[touched].T @ d_value[touched], d_value.sum(axis=0)
        g |= {"embed": np.zeros_like(p["embed"]), "conv": np.zeros_like(p["conv"]), "conv_bias": np.zeros_like(p["conv_bias"])}
        if len(touched):
            d_mean = d_value[touched] @ p["chunk"].T / weight[touched, None]
            d_block = np.zeros((len(valid), FILTERS), np.float32)
            np.add.at(d_block, touched, d_mean)
            np.add.at(d_block, touched + 1, d_mean)
            rows = np.flatnonzero(np.abs(d_block).sum(axis=1) > 0)
            d_raw = d_block[rows][:, None, :] * mask[rows][:, :, None] * (raw.reshape(-1, per, FILTERS)[rows] > 0)
            d_raw = d_raw.reshape(-1, FILTERS)
            first = (rows[:, None] * BLOCK + STEP * np.arange(per)[None, :]).ravel()
            place = first[:, None] + np.arange(2 * STEP)[None, :]
            ends = np.repeat(starts[1:], np.diff(starts))[rows] * BLOCK
            inside = place < np.repeat(ends, per)[:, None]
            place = np.minimum(place, len(data) - 1)
            cells = np.concatenate([p["embed"][data[place]], echo[place][:, :, None]], axis=2) * inside[:, :, None]
            g["conv"] = cells.reshape(len(first), -1).T @ d_raw
            g["conv_bias"] = d_raw.sum(axis=0)
            d_cells = (d_raw @ p["conv"].T).reshape(len(first), 2 * STEP, CHANNELS)[:, :, :EMBED] * inside[:, :, None]
            flat = data[place].ravel()
            d_flat = d_cells.reshape(-1, EMBED)
            g["embed"] = np.stack([np.bincount(flat, d_flat[:, j], 256) for j in range(EMBED)], axis=1)
        return g


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Parameters fitted by Adam; without both classes, a constant at the share of ones (0.5 if there are no rows)."""
    net, y = Network(), np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.p["out"][:] = 0
        net.p["out_bias"][:] = 0 if not len(y) else (4 if y[0] else -4)
        return net.p
    share = float(y.mean())
    net.p["out_bias"][:] = np.log(share / (1 - share))
    rng = np.random.default_rng(SEED)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / epochs) + 1e-4
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            g = net.gradients([texts[i] for i in pick], y[pick])
            step += 1
            for k, v in g.items():
                v = v.astype(np.float32) + 1e-5 * net.p[k]
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                net.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net.p


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1, per_class: int = TRAIN_PER_CLASS) -> dict[str, np.ndarray]:
    """Parameters learned from labelled rows outside fold ``out``; a document with both labels counts as 0.

    A doc_id that several texts share teaches by one of them, and texts over ``TRAIN_CHARS`` characters teach nothing, so
    what reaches the driver is bounded: about 2 * ``per_class`` texts. Null ids, null or other labels are left out.
    """
    known = labels.select("doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_fold("doc_id", folds) != out))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    picks = [hashed_fraction(known.filter(F.col("quality") == q), F.col("doc_id"), per_class / max(counts.get(q, 0), 1), "quality") for q in (0, 1)]
    # about 2 * per_class ids by construction, whatever the tables hold
    chosen = F.broadcast(picks[0].unionByName(picks[1]))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.length("text") <= TRAIN_CHARS)
    one = texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "quality")).alias("one"))
    rows = one.select("doc_id", "one.text", "one.quality").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"].encode() for r in rows], [r["quality"] for r in rows])


def _network(key: str, parameters_of) -> Network:
    return worker_state(key, lambda: Network(parameters_of()))


def score_quality(docs: DataFrame, parameters: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns and score (0 to 1, higher is better) of every row; null text counts as empty.

    Repeated rows are scored each, equal texts alike whatever lies beside them (to 6 decimals, so that the order of
    float sums in a batch doesn't show). An empty table gives no rows; other columns don't matter.
    """
    text_batches(docs.sparkSession)
    key, held = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(parameters)
    slim = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_quality_text"))
    schema = plus(slim.drop("_quality_text").schema, "score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = _network(key, lambda: held.value)
        for batch in batches:
            scores, some, size = [np.zeros(0)], [], 0
            for value in batch.column(batch.num_columns - 1).cast(pa.binary()):
                some.append(value.as_py())
                size += len(some[-1])
                if size > 500_000:
                    scores.append(net.score(some))
                    some, size = [], 0
            if some:
                scores.append(net.score(some))
            yield pa.record_batch([*batch.columns[:-1], pa.array(np.round(np.concatenate(scores), 6))], schema.names)

    return slim.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (the documents' columns) that score ``least`` or more.

    Null and empty texts are scored as empty ones. Repeated rows stay or go together; an empty table gives no rows. Without
    both labels to learn from, all rows score alike: 0.5 without any label, which keeps them.
    """
    scored = score_quality(docs, fit(docs, labels), DOCUMENT_COLUMNS)
    return scored.filter(F.col("score") >= least).select(*DOCUMENT_COLUMNS)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all of ``documents``; learned from labels outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
