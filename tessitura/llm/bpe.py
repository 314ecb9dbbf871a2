"""Byte-level BPE, speculate and verify.

Texts are cut into the vocabulary's pre-tokens, and only words that a task hasn't met are encoded:

1. Speculate: one Aho-Corasick pass over the new words proposes the longest matching token at each place.
2. Verify: every adjacent pair of proposed tokens is looked up, as one array of pair keys, in the table of pairs that
   merging would leave as they are. Tokens that merging produces, with compatible neighbours throughout, are exactly
   what merging gives for the word.
3. Only words with a failing pair are merged exactly, lowest rank first.

Whole texts are encoded, special-token strings inside a text become their own id (as the tokenizers library does by
default), and decoding concatenates the tokens' bytes and reads them as UTF-8 with replacement.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import DOCUMENT_COLUMNS, plus, table, text_batches, worker_state

#: Pre-token pattern of byte-level BPE vocabularies of this kind (a fixed value of the file format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 300_000
#: Words longer than this are merged with a heap instead of a scan for the lowest rank.
LONG_WORD = 200
NO_MERGE = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself, or 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


def read_vocabulary(path: str | None = None) -> dict:
    """What encoding needs of a tokenizers JSON file, small enough (a few MB) to travel with the tasks."""
    with open(path or default_vocabulary(), encoding="utf-8") as file:
        spec = json.load(file)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return {
        "vocab": spec["model"]["vocab"],
        "merges": merges,
        "special": {t["content"]: t["id"] for t in spec.get("added_tokens", [])},
    }


class Memory(dict):
    """Words to their numbers; a word that is asked for and not there gets the next number and is noted as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Codec:
    """Encoder and decoder of one vocabulary, built once per worker."""

    def __init__(self, spec: dict):
        import ahocorasick
        import regex

        self.alphabet = byte_alphabet()
        self.ids: dict[str, int] = spec["vocab"]
        self.special: dict[str, int] = spec["special"]
        self.strings = {i: s for s, i in self.ids.items()}
        # left * 2^20 + right -> rank * 2^20 + merged, so that the least value is the merge to make
        self.pair = {self.ids[a] << 20 | self.ids[b]: r << 20 | self.ids[a + b] for r, (a, b) in enumerate(spec["merges"])}
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        to_byte = {c: b for b, c in enumerate(self.alphabet)}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for s, i in self.ids.items():
            self.bytes[i] = bytes(to_byte[c] for c in s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.decimal = [str(i) for i in range(size)]
        self.widths = np.array([len(b) for b in self.bytes], np.int64)
        self.size = size
        # merges in order of rank reach every string that a merge names whose own merging ends in itself
        self.match = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.match.add_word(s, (i, len(s)))
        self.match.make_automaton()
        self.single: dict[int, bool] = {}
        self.known = np.zeros(0, np.int64)
        self.fits = np.zeros(0, bool)
        self.translate = {b: c for b, c in enumerate(self.alphabet)}
        self.clear()

    def clear(self) -> None:
        self.index, self.flat, self.starts = Memory(), array("i"), array("q", [0])

    # exact merging -------------------------------------------------------------------------------------------------

    def merge(self, word: str) -> list[int]:
        """Exact merging of a word in the file's alphabet: the pair of lowest rank first, leftmost first."""
        parts, get = list(map(self.ids.__getitem__, word)), self.pair.get
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        found = [get(a << 20 | b, NO_MERGE) for a, b in zip(parts, parts[1:], strict=False)]
        while found:
            best = min(found)
            if best == NO_MERGE:
                break
            i = found.index(best)
            parts[i] = best & 0xFFFFF
            del parts[i + 1], found[i]
            if i:
                found[i - 1] = get(parts[i - 1] << 20 | parts[i], NO_MERGE)
            if i < len(found):
                found[i] = get(parts[i] << 20 | parts[i + 1], NO_MERGE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same for long words, with a heap over a linked list."""
        n, get = len(parts), self.pair.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m, i) for i in range(n - 1) if (m := get(parts[i] << 20 | parts[i + 1], NO_MERGE)) != NO_MERGE]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or get(parts[i] << 20 | parts[j], NO_MERGE) != m:
                continue
            parts[i], parts[j], after[i] = m & 0xFFFFF, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (m := get(parts[i] << 20 | parts[after[i]], NO_MERGE)) != NO_MERGE:
                    heapq.heappush(heap, (m, i))
            if before[i] >= 0 and (m := get(parts[before[i]] << 20 | parts[i], NO_MERGE)) != NO_MERGE:
                heapq.heappush(heap, (m, before[i]))
        return [p for p in parts if p >= 0]

    # speculation and verification ----------------------------------------------------------------------------------

    def _produced(self, tokens: np.ndarray) -> np.ndarray:
        """Which tokens merging makes of their own string."""
        out = np.zeros(self.size, bool)
        for t in np.unique(tokens).tolist():
            ok = self.single.get(t)
            if ok is None:
                ok = self.single[t] = self.merge(self.strings[t]) == [t]
            out[t] = ok
        return out[tokens]

    def _compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Which pairs (left * size + right) merging leaves as they are; pairs not met before are merged once."""
        wanted, back = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.known, wanted)
        at[at == len(self.known)] = 0
        new = wanted[self.known[at] != wanted] if len(self.known) else wanted
        if len(new):
            fits = [self.merge(self.strings[k // self.size] + self.strings[k % self.size]) == [k // self.size, k % self.size] for k in new.tolist()]
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.known, self.fits = known[order], np.concatenate([self.fits, np.array(fits, bool)])[order]
            at = np.searchsorted(self.known, wanted)
        answer = self.fits[at]
        if len(self.known) > 2_000_000:
            self.known, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        return answer[back]

    def learn(self, words: list[str]) -> None:
        """Append the ids of words to the memory, in order."""
        mapped = [w.encode().decode("latin-1").translate(self.translate) for w in words]
        sizes = np.array([len(w) for w in mapped])
        ends = np.cumsum(sizes + 1) - 1  # place of the separator after each word
        token, last, width = [], [], []
        for end, (t, n) in self.match.iter_long("\0".join(mapped)):
            token.append(t)
            last.append(end)
            width.append(n)
        token, last, width = np.array(token, np.int64), np.array(last, np.int64), np.array(width, np.int64)
        word = np.searchsorted(ends, last)
        bad = np.zeros(len(words), bool)
        bad[np.bincount(word, width, len(words)).astype(np.int64) != sizes] = True
        bad[word[~self._produced(token)]] = True
        inside = np.flatnonzero(word[1:] == word[:-1])
        if len(inside):
            bad[word[inside[~self._compatible(token[inside] * self.size + token[inside + 1])]]] = True
        bounds = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        tokens, failed = token.tolist(), bad.tolist()
        for i, w in enumerate(words):
            if w in self.special:
                self.flat.append(self.special[w])
            else:
                self.flat.extend(self.merge(mapped[i]) if failed[i] else tokens[bounds[i] : bounds[i + 1]])
            self.starts.append(len(self.flat))

    # texts ---------------------------------------------------------------------------------------------------------

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a whole text; a special token's string is one of them."""
        if self.cut is None or not self.cut.search(text):
            return self.find(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.find(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.find(text[at:])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        if len(self.index) > CACHE_WORDS:
            self.clear()
        get = self.index.__getitem__
        numbers = [np.fromiter(map(get, words), np.int64, len(words)) for words in map(self.pretokens, texts)]
        if self.index.new:
            self.learn(self.index.new)
            self.index.new = []
        flat, starts, out = np.frombuffer(self.flat, np.int32), np.frombuffer(self.starts, np.int64), []
        for w in numbers:
            first, sizes = starts[w], starts[w + 1] - starts[w]
            shift = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
            out.append(flat[shift + np.arange(len(shift))])
        del flat, starts  # else the arrays that they look into can't grow
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


def codec(key: str, spec_of) -> Codec:
    """The worker's codec for a vocabulary, built at its first use."""
    return worker_state(key, lambda: Codec(spec_of()))


def slices(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters, so that memory follows neither the batch nor the partition."""
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def ship(spark: SparkSession, path: str | None = None):
    """(key, function that returns the vocabulary on any worker): the file is read by the driver and broadcast."""
    text_batches(spark)
    spec = read_vocabulary(path)
    key = hashlib.sha256(json.dumps(spec["merges"]).encode()).hexdigest()
    held = spark.sparkContext.broadcast(spec)
    return key, lambda: held.value


def encode_decode(docs: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns, ids (array of int) and decoded text of every row. Null text counts as empty."""
    key, spec_of = ship(docs.sparkSession, vocabulary)
    slim = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_bpe_text"))
    schema = plus(slim.drop("_bpe_text").schema, "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(key, spec_of)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(batch.num_columns - 1).to_pylist()):
                ids = own.encode_batch(texts)
                kept = [c.slice(at, len(texts)) for c in batch.columns[:-1]]
                at += len(texts)
                decoded = [own.decode(i.tolist()) for i in ids]
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                values = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
                yield pa.record_batch([*kept, pa.ListArray.from_arrays(offsets, values), pa.array(decoded, pa.string())], schema.names)

    return slim.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, digested beside the encoding.

    Null text counts as empty: no tokens, digests of nothing. Null ids and repeated rows stay; an empty table gives no rows;
    other columns don't matter.
    """
    key, spec_of = ship(docs.sparkSession, vocabulary)
    slim = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(key, spec_of)
        sha = hashlib.sha256
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for texts in slices(batch.column(1).to_pylist()):
                for ids in own.encode_batch(texts):
                    ids = ids.tolist()
                    counts.append(len(ids))
                    of_ids.append(sha(",".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                    of_text.append(sha(own.decode(ids).encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of all of ``documents``."""
    return digests(table(spark, sf_dir, "documents"))


def encode_stage(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The documents' columns with ``text`` as decoded, then ids and n_tokens.

    A null text stays null, with no ids and 0 tokens. Null ids and repeated rows stay; an empty table gives no rows; columns
    that documents lack, among them ones named ids or n_tokens, are left behind.
    """
    coded = encode_decode(docs.select(*DOCUMENT_COLUMNS), vocabulary, DOCUMENT_COLUMNS)
    text = F.when(F.col("text").isNotNull(), F.col("decoded")).alias("text")
    return coded.select(*[text if c == "text" else c for c in DOCUMENT_COLUMNS], "ids", F.size("ids").cast("long").alias("n_tokens"))
