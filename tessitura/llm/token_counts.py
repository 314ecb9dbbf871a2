"""Token counts by section: encode whole documents once, then attribute token spans to sections.

A document is encoded as a whole (never section by section, which would change the tokens at the seams). Running sums of
token widths give every token's byte span; sections are byte intervals of the same text, and a sorted interval join
(binary search of the spans in the section bounds) gives each token its section. A token that crosses a boundary counts
once, under an explicit rule: ``first`` gives it to the section of its first byte, ``last`` to that of its last byte,
``most`` to the section with most of its bytes (of equals, the first). Section counts therefore always sum to the
document's token count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.bpe import codec, ship, slices
from tessitura.llm.common import plus, table

RULES = ("first", "last", "most")


def line_starts(text: bytes) -> np.ndarray:
    """First bytes of the sections of a text: its lines, each with the newline that ends it."""
    after = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate(([0], after[after < len(text)]))


def attribute(widths: np.ndarray, starts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """(tokens per section, number of crossing tokens) from token byte widths and section starts."""
    ends = np.cumsum(widths)
    begins = ends - widths
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, np.maximum(ends - 1, begins), "right") - 1
    crossing = np.flatnonzero(last > first)
    owner = last.copy() if rule == "last" else first.copy()
    if rule == "most":
        for i in crossing.tolist():
            edges = np.concatenate(([begins[i]], starts[first[i] + 1 : last[i] + 1], [ends[i]]))
            owner[i] = first[i] + int(np.argmax(np.diff(edges)))
    return np.bincount(owner, minlength=len(starts)), len(crossing)


def section_tokens(docs: DataFrame, vocabulary: str | None = None, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_sections, crossing_tokens, section_tokens) per row.

    Sections are lines. A null or empty text has one empty section and no tokens. Repeated rows are counted each.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    key, spec_of = ship(docs.sparkSession, vocabulary)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(key, spec_of)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1).to_pylist()):
                tokens, sections, crossing = [], [], []
                for text, ids in zip(texts, own.encode_batch(texts), strict=True):
                    counts, crossed = attribute(own.widths[ids], line_starts(text.encode()), rule)
                    tokens.append(len(ids))
                    sections.append(counts)
                    crossing.append(crossed)
                sizes = [len(s) for s in sections]
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                values = pa.array(np.concatenate(sections).astype(np.int64))
                columns = [batch.column(0).slice(at, len(texts)), pa.array(tokens, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crossing, pa.int64()), pa.ListArray.from_arrays(offsets, values)]
                at += len(texts)
                yield pa.record_batch(columns, ["doc_id", "n_tokens", "n_sections", "crossing_tokens", "section_tokens"])

    schema = plus(slim.select("doc_id").schema, "n_tokens long, n_sections long, crossing_tokens long, section_tokens array<long>")
    return slim.mapInArrow(run, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every line of all of ``documents``."""
    return section_tokens(table(spark, sf_dir, "documents"))
