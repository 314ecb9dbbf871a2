"""A corpus pipeline: quality, language, near-duplicates, mixture, tokens; each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.bpe import encode_stage
from tessitura.llm.common import DOCUMENT_COLUMNS, durable, table
from tessitura.llm.langid import UNDETERMINED, fit_outside, identify
from tessitura.llm.mixing import mix
from tessitura.llm.near import keep_one_near
from tessitura.llm.quality import keep_good



def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from ``labels``.

    Null texts are judged as empty ones, repeated rows alike; an empty table gives no rows.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined.

    Null texts and texts without letters go; so does everything where no row has a language to learn from.
    """
    found = identify(docs, fit_outside(docs.select("doc_id", "text", "lang")), DOCUMENT_COLUMNS)
    return found.filter(F.col("lang_pred") != UNDETERMINED).select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingle similarities of 0.8 or more, each verified on the texts.

    SimHash proposes groups; a prefix filter completes what its distance can't reach. The row with the smallest doc_id stays,
    null last; null and wordless texts are one group; repeated rows are one.
    """
    return keep_one_near(docs.select(*DOCUMENT_COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target weight; sources without words go, a null source is one of its own."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns (text as decoded from its ids), ids and n_tokens; a null text stays null, with no ids."""
    return encode_stage(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: No SQL expresses the classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
