"""Language-model scoring: a weighted backoff automaton over words.

Tokens are the lower-cased (A-Z) words of a text and one end; the end is also what every text starts from. The automaton:

* states: every history of up to ``order`` - 1 tokens in the texts learned from, and the empty history;
* arcs: every n-gram of up to ``order`` tokens in them, from the state of its first tokens to that of its longest suffix
  which is a state, with the probability (count + m * p) / (count of the history + m), p that of the n-gram without its first
  token;
* failure arcs: from every history to the one without its first token, with m / (count of the history + m), so that the
  probabilities of a state sum to 1;
* at the empty history every word has its discounted share, and the mass that discounting frees is that of one outcome
  which stands for all words never seen. The discount is estimated from the numbers of words seen once and twice.

Nothing is cut off: all arcs are kept, whatever their counts, and none is broadcast. Texts are cut into blocks of tokens; a
block asks for each distinct n-gram of its own once, by its key, so that a frequent one is asked once for each block and
no key is hot. A key holds the order and a hash, of 62 bits for words and 54 for longer n-grams (of n of them about
n^2 / 2^55 pairs share a key and a count). The asked keys, with the block's counts of them in learned texts, are dealt over ranges of the key (a
partitioned arc table), every range adds up the counts and answers its blocks, and the block traverses its texts with the
part of the automaton that they can reach: left to right, each token's arc taken from the longest state that has it, and the
failure arcs before it. All texts of a block are traversed at once, order by order.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.bpe import Memory
from tessitura.llm.common import crc_fold, durable, table, text_batches
from tessitura.llm.simhash import LOWER

ORDER = 3
#: Imaginary counts that a history spends on what its shorter history says (m above); 50 did best of 1 to 50 on held-out rows.
STRENGTH = 50.0
#: Discount of words where none was seen twice.
DISCOUNT = 0.75
#: Tokens after which a block is full (a longer text is a block of its own).
BLOCK_TOKENS = 1_500_000
#: Bytes of keys that a range aims at.
RANGE_BYTES = 16_000_000
#: The end of a text, which is also the history that every text starts from. No word is empty.
END = b""
BLOCK_SCHEMA = "block long, n long, ids array<long>, learn array<boolean>, sizes array<long>, words binary, tokens binary"
ASK_SCHEMA = "part int, block long, keys binary, counts binary"
ANSWER_SCHEMA = "block long, part int, counts binary, n long, v long, n1 long, n2 long"
SCORE_SCHEMA = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


# --- packed arrays --------------------------------------------------------------------------------------------------


def pack_ints(values: np.ndarray) -> bytes:
    """Whole numbers from 0, each byte of them in a plane of its own, compressed."""
    wide = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(wide[:, :width].T).tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : data[0]] = planes.T
    return wide.view("<u8")[:, 0]


def pack_keys(keys: np.ndarray) -> bytes:
    """Rising 64-bit keys as the bytes of their steps; a low byte that is 0 in all of them is left out."""
    shift = 0 if (keys & np.uint64(255)).any() else 8
    steps = np.diff(keys >> np.uint64(shift), prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps[1:].max(initial=0)).bit_length() + 7) // 8)
    return bytes([width, shift]) + steps[:1].tobytes() + np.ascontiguousarray(steps[1:].view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    width, shift, first = data[0], data[1], np.frombuffer(data, "<u8", 1, 2)
    rest = np.frombuffer(data, np.uint8, offset=10).reshape(-1, width)
    wide = np.zeros((len(rest), 8), np.uint8)
    wide[:, :width] = rest
    return np.cumsum(np.concatenate([first, wide.view("<u8")[:, 0]]), dtype=np.uint64) << np.uint64(shift)


# --- blocks ---------------------------------------------------------------------------------------------------------


class _Block:
    """Texts as numbers of the block's words."""

    def __init__(self):
        self.seen = Memory()
        self.end = self.seen[END]
        self.tokens, self.ids, self.learn, self.sizes = array("i"), [], [], []

    def add(self, doc_id: int | None, learn: bool, text: bytes | None) -> None:
        before = len(self.tokens)
        self.tokens.extend(map(self.seen.__getitem__, words_of(text)))
        self.tokens.append(self.end)
        self.ids.append(doc_id)
        self.learn.append(learn)
        self.sizes.append(len(self.tokens) - before)

    def row(self, number: int) -> pa.RecordBatch:
        tokens = np.frombuffer(self.tokens, np.int32)
        words = np.array([xxhash.xxh64_intdigest(w, 42) for w in self.seen], "<u8")
        # the commonest words get the smallest numbers, which pack well
        order = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        columns = [[number], [len(tokens)], [self.ids], [self.learn], [self.sizes], [np.append(words[order], words[self.end]).tobytes()], [pack_ints(place[tokens])]]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "n", "ids", "learn", "sizes", "words", "tokens"])


def _block_batches(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for doc_id, learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                block.add(doc_id, learn, text.as_py())
                if len(block.tokens) >= block_tokens:
                    yield block.row(number)
                    number, block = number + 1, _Block()
        if block.ids:
            yield block.row(number)

    return run


def _mixed(state: np.ndarray, word: np.ndarray, order: int) -> np.ndarray:
    """Key of the n-gram of ``order`` tokens that goes on from ``state`` with ``word``."""
    x = state * np.uint64(0x9E3779B97F4A7C15)
    x ^= word
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return _tagged(x, order)


def _tagged(hashes: np.ndarray, order: int) -> np.ndarray:
    """Keys from hashes: the order less 1 in the two highest bits; of longer n-grams the lowest byte is 0."""
    keys = hashes >> np.uint64(2)
    keys |= np.uint64((order - 1) << 62)
    if order > 1:
        keys &= ~np.uint64(255)
    return keys


def block_keys(words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, (places, keys): the key of the n-gram that ends at each place; a text's places are its start, then
    its tokens. The last word given is the end. Places with fewer tokens before them than the order asks have no key."""
    n = len(tokens) + len(sizes)
    starts = np.cumsum(sizes + 1) - sizes - 1
    inner = np.ones(n, bool)
    inner[starts] = False
    own = np.full(n, words[-1])
    own[inner] = words[tokens]
    own = _tagged(own, 1)
    depth = np.arange(n, dtype=np.int32) - np.repeat(starts, sizes + 1).astype(np.int32)
    state = own
    for k in range(1, order + 1):
        if k > 1:
            state = np.concatenate([state[:1], _mixed(state[:-1], own[1:], k)])
        at = np.flatnonzero(depth >= max(1, k - 1)).astype(np.int32)
        yield at, state[at]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, each key's place among them)."""
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(first, dtype=np.int32) - 1
    return ranked[first], place


def _opened(words: bytes, tokens: bytes, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, distinct keys, each place's key among them) for each order; all orders' keys in a row are sorted."""
    for at, keys in block_keys(np.frombuffer(words, "<u8"), unpack_ints(tokens).astype(np.int32), sizes, order):
        yield at, *_distinct(keys)


def _ask_batches(order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, learn, sizes, words, tokens = (batch.column(c)[i].as_py() for c in range(5))
                sizes, keys, sums = np.array(sizes, np.int64), [], []
                learned = np.repeat(np.array(learn, bool), sizes + 1)
                for at, distinct, place in _opened(words, tokens, sizes, order):
                    keys.append(distinct)
                    sums.append(np.bincount(place, learned[at], len(distinct)).astype(np.int64))
                distinct, counts = np.concatenate(keys), np.concatenate(sums)
                ends = np.searchsorted(distinct >> np.uint64(64 - bits), np.arange(1, 1 << bits, dtype=np.uint64))
                edges = [0, *ends.tolist(), len(distinct)]
                rows = [(part, a, b) for part, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
                yield pa.record_batch(
                    [
                        pa.array([p for p, _, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()),
                        pa.array([pack_keys(distinct[a:b]) for _, a, b in rows], pa.binary()), pa.array([pack_ints(counts[a:b]) for _, a, b in rows], pa.binary()),
                    ],
                    ["part", "block", "keys", "counts"],
                )

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """Sums of all blocks' counts in one range of keys: to each block those of its keys, and one row about the words."""
    keys = [unpack_keys(v.as_py()) for v in asked.column("keys")]
    counts = np.concatenate([unpack_ints(v.as_py()) for v in asked.column("counts")])
    distinct, place = _distinct(np.concatenate(keys))
    total = np.bincount(place, counts, len(distinct)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys]).tolist()
    words = total[distinct < np.uint64(1 << 62)]
    facts = [int(words.sum()), int((words > 0).sum()), int((words == 1).sum()), int((words == 2).sum())]
    packed = [pack_ints(total[place[a:b]]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    columns = [[*asked.column("block").to_pylist(), None], [*asked.column("part").to_pylist(), None], [*packed, None], *[[None] * len(keys) + [f] for f in facts]]
    types = [pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 4]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "part", "counts", "n", "v", "n1", "n2"])


class Model:
    """What of the automaton isn't a count: order, strength, and the words' totals."""

    def __init__(self, total: int, distinct: int, once: int, twice: int, order: int = ORDER, strength: float = STRENGTH):
        self.total, self.distinct, self.order, self.strength = total, distinct, order, strength
        self.discount = min(0.95, max(0.05, once / (once + 2 * twice))) if twice else DISCOUNT
        self.unseen = self.discount * distinct / total if total else 1.0

    def traverse(self, sizes: np.ndarray, places: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of every token of texts of these sizes; ``counts`` has, by order, those of the n-grams that
        end at ``places`` (a text's start, then its tokens).

        From the word's own share on, each longer state either has an arc, whose weight blends in what the shorter one
        says, or is left by its failure arc, which scales it; a state without a count isn't there and changes nothing.
        """
        n = int(sizes.sum()) + len(sizes)
        ends = np.cumsum(sizes + 1) - 1
        words = np.zeros(n)
        words[places[0]] = counts[0]
        p = np.where(words > 0, (words - self.discount) / max(self.total, 1), self.unseen)
        history = words
        # the start of a text is the end as a history: as many as there are texts
        history[ends - sizes] = words[ends]
        for at, own in zip(places[1:], counts[1:], strict=True):
            before = history[at - 1]
            p[at] = (own + self.strength * p[at]) / (before + self.strength)
            history = np.zeros(n)
            history[at] = own
        return np.log10(p[places[0]])


def _score_block(model: Model):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        ids, sizes, words, tokens = (block.column(c)[0].as_py() for c in ("ids", "sizes", "words", "tokens"))
        sizes, at, places, counts = np.array(sizes, np.int64), 0, [], []
        told = np.concatenate([unpack_ints(v.as_py()).astype(np.int64) for v in answers.sort_by("part").column("counts")])
        for own, distinct, place in _opened(words, tokens, sizes, model.order):
            places.append(own)
            counts.append(told[at : at + len(distinct)][place].astype(float))
            at += len(distinct)
        starts = np.cumsum(sizes) - sizes
        base = np.log10((counts[0] + 1) / (model.total + model.distinct + 1))
        score = model.traverse(sizes, places, counts)
        sums = [np.add.reduceat(v, starts) for v in (counts[0] > 0, base, score)]
        return pa.table(
            [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])],
            ["doc_id", "n_tokens", "n_known", "base_score", "score"],
        )

    return run


def score_texts(docs: DataFrame, learn: Column, order: int = ORDER, strength: float = STRENGTH, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row, the model learned from rows where ``learn`` is true.

    A null or empty text is the end alone. Repeated rows are scored, and learned from, each; a null ``learn`` is false.
    With nothing to learn from, every token has probability 1. An empty table gives no rows; other columns don't matter.
    Orders up to 4 fit the keys.
    """
    if not 1 <= order <= 4:
        raise ValueError("orders are 1 to 4")
    text_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).cast("string").alias("text"))
    blocks = durable(slim.mapInArrow(_block_batches(block_tokens), BLOCK_SCHEMA), "blocks")
    tokens = blocks.agg(F.sum("n")).first()[0] or 0
    # a key takes 5 or 6 bytes, and an order, which has a quarter of the ranges, as many of them as there are tokens at most
    bits = min(24, max(2, int(np.ceil(np.log2(max(1, tokens * 6 / range_bytes)))) + 2))
    asked = blocks.select("block", "learn", "sizes", "words", "tokens").mapInArrow(_ask_batches(order, bits), ASK_SCHEMA)
    # written, so the asked keys' shuffle is gone before the blocks meet their answers
    answers = durable(asked.groupBy("part").applyInArrow(_answer, ANSWER_SCHEMA), "answers")
    facts = answers.filter("block is null").agg(*[F.sum(c).alias(c) for c in ("n", "v", "n1", "n2")]).first()
    model = Model(*[facts[c] or 0 for c in ("n", "v", "n1", "n2")], order, strength)
    given = answers.filter("block is not null").select("block", "part", "counts")
    scored = blocks.select("block", "ids", "sizes", "words", "tokens").groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_score_block(model), SCORE_SCHEMA)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all of ``documents``; learned from the folds but 2 of 7."""
    scored = score_texts(table(spark, sf_dir, "documents"), crc_fold("doc_id", 7) != 2)
    return scored.select("doc_id", (crc_fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
