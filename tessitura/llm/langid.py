"""Language identification: known words first, shorter and shorter character n-grams for the rest.

Training counts, per language, the words and the character n-grams (1 to 4, with word edges marked) of a bounded,
hash-chosen sample of labelled rows. A word is known if the sample has it twice; one seen once counts through its n-grams,
which are all kept. The sample's bounds, in rows and in characters of a row, bound the model whatever the corpus.
A text's score per language sums log frequencies over all its words: a word that the model knows counts by its own
frequency; another counts by its n-grams, each place by the longest one known.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.llm.bpe import Memory
from tessitura.llm.common import crc_fold, hashed_fraction, plus, table, text_batches, worker_state

#: Expected number of labelled rows that training reads at most.
TRAIN_ROWS = 5_000
#: Longest text among them, and how often a word must be in them to be known.
TRAIN_CHARS = 200_000
KNOWN_TIMES = 2
LONGEST = 4
#: Languages share this many imaginary counts of an entry that they lack.
SMOOTH = 0.5
#: Weight of one place of an unknown word against a whole known word.
GRAM_WEIGHT = 0.5
UNDETERMINED = "und"
CACHE_WORDS = 250_000


_RUNS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def letter_runs(token: str) -> list[str]:
    """Maximal runs of letters (and marks inside them) of a token, lower-cased."""
    token = token.lower()
    return [token] if token.isalpha() else _RUNS.findall(token)


def grams(word: str) -> Iterator[str]:
    marked = f"^{word}$"
    for end in range(1, len(marked) + 1):
        for n in range(1, min(LONGEST, end) + 1):
            yield marked[end - n : end]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(text.split())
        if sum(map(len, words.values())) > 500_000:
            yield from _counted(words)
            words = {}
    yield from _counted(words)


def _counted(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, tokens in words.items():
        clean: Counter = Counter()
        for token, n in tokens.items():
            for run in letter_runs(token):
                clean[run] += n
        parts: Counter = Counter()
        for run, n in clean.items():
            for g in grams(run):
                parts[g] += n
        for kind, counts in (("word", clean), ("gram", parts)):
            keys = list(counts)
            kinds = [0 if kind == "word" else len(k) for k in keys]
            yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(kinds, pa.int32()), pa.array(keys, pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "kind", "entry", "n"])


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> dict:
    """The model, from (text, lang) of rows with both; {} languages if there are none."""
    labelled = docs.filter("text is not null and lang is not null").filter(F.length("text") <= train_chars)
    total = labelled.count()
    sample = hashed_fraction(labelled, F.struct("doc_id", F.xxhash64("text")), train_rows / max(total, 1), "langid").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    counted = sample.mapInArrow(_count_batches, "lang string, kind int, entry string, n long").groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n"))
    # at most the words and n-grams of the bounded sample
    same = Window.partitionBy("entry", F.col("kind") > 0)
    kept = counted.withColumn("of_all", F.sum("n").over(same)).filter((F.col("kind") > 0) | (F.col("of_all") >= KNOWN_TIMES)).select("lang", "kind", "entry", "n").toArrow()
    names, kinds, keys, times = kept.column("lang"), kept.column("kind").to_numpy(), kept.column("entry").to_pylist(), kept.column("n").to_numpy()
    langs = sorted(set(names.unique().to_pylist()))
    numbers = {lang: i for i, lang in enumerate(langs)}
    own = np.array([numbers[v] for v in names.to_pylist()], np.int64)
    whole = np.zeros((LONGEST + 1, len(langs)))
    np.add.at(whole, (kinds, own), times)
    entries: list[dict[str, int]] = [{}, {}]
    tables = []
    for group in (0, 1):
        picks = np.flatnonzero((kinds > 0) == (group == 1)).tolist()
        at = np.array([entries[group].setdefault(keys[i], len(entries[group])) for i in picks], np.int64)
        seen, lengths = np.zeros((len(entries[group]), len(langs))), np.zeros(len(entries[group]), np.int64)
        np.add.at(seen, (at, own[picks]), times[picks])
        lengths[at] = kinds[picks]
        tables.append(np.log((seen + SMOOTH) / (whole[lengths] + SMOOTH * (len(entries[group]) + 1))).astype(np.float32))
    return {"langs": langs, "words": entries[0], "grams": entries[1], "word_logs": tables[0], "gram_logs": tables[1]}


class Scorer:
    """Scores texts; remembers what each token contributes."""

    def __init__(self, model: dict):
        self.model, self.langs = model, model["langs"]
        self.logs = np.concatenate([model["word_logs"], GRAM_WEIGHT * model["gram_logs"]]) if self.langs else np.zeros((0, 0))
        self.clear()

    def clear(self) -> None:
        self.seen = Memory()
        self.rows, self.runs = np.zeros((0, len(self.langs))), np.zeros(0, np.int64)

    def places(self, word: str) -> list[int]:
        """Rows of the model that speak for a word: its own, or those of the longest known n-gram at each place."""
        known = self.model["words"].get(word)
        if known is not None:
            return [known]
        marked, get, shift, out = f"^{word}$", self.model["grams"].get, len(self.model["words"]), []
        for end in range(2, len(marked) + 1):
            for n in range(min(LONGEST, end), 0, -1):
                at = get(marked[end - n : end])
                if at is not None:
                    out.append(shift + at)
                    break
        return out

    def learn(self, tokens: list[str]) -> None:
        """Append what new tokens contribute to the memory, in order."""
        places: list[int] = []
        sizes, runs = [], []
        for token in tokens:
            found, before = letter_runs(token), len(places)
            for run in found:
                places += self.places(run)
            sizes.append(len(places) - before)
            runs.append(len(found))
        owner = np.repeat(np.arange(len(tokens)), sizes)
        at = np.array(places, np.int64)
        rows = np.stack([np.bincount(owner, self.logs[at, i], len(tokens)) for i in range(len(self.langs))], axis=1) if self.langs else np.zeros((len(tokens), 0))
        self.rows, self.runs = np.concatenate([self.rows, rows]), np.concatenate([self.runs, np.array(runs, np.int64)])

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.seen) > CACHE_WORDS:
            self.clear()
        get = self.seen.__getitem__
        numbers = [np.fromiter(map(get, words), np.int64, len(words)) for words in ((t or "").split() for t in texts)]
        if self.seen.new:
            self.learn(self.seen.new)
            self.seen.new = []
        langs, scores = [], []
        for at in numbers:
            n = int(self.runs[at].sum())
            if not n or not self.langs:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = self.rows[at].sum(axis=0) / np.sqrt(n)
            share = np.exp(total - total.max())
            best = int(share.argmax())
            langs.append(self.langs[best])
            scores.append(float(share[best] / share.sum()))
        return langs, scores


def _scorer(key: str, model_of) -> Scorer:
    return worker_state(key, lambda: Scorer(model_of()))


def _slices(texts: list, most: int = 2_000_000) -> Iterator[list]:
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t or "")
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def identify(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred and score (0 to 1) of every row; ``und`` and 0 for null texts and texts without letters.

    A text whose words and letters say nothing gets the first language by name at an even score. With no languages
    learned every row is ``und``.
    """
    text_batches(docs.sparkSession)
    key, held = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(*keep, F.col(text_col).cast("string").alias("_lang_text"))
    schema = plus(slim.drop("_lang_text").schema, "lang_pred string, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _scorer(key, lambda: held.value)
        for batch in batches:
            langs, scores = [], []
            for texts in _slices(batch.column(batch.num_columns - 1).to_pylist()):
                a, b = own.score(texts)
                langs += a
                scores += b
            yield pa.record_batch([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return slim.mapInArrow(run, schema)


def fit_outside(docs: DataFrame, folds: int = 5, out: int = 0) -> dict:
    """A model from the rows whose crc32 fold isn't ``out``."""
    return train(docs.filter(crc_fold("doc_id", folds) != out))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all of ``documents``; learned from the folds but 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_outside(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
