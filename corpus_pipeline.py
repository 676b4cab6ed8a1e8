"""A training-corpus pipeline over `documents`: five stages, each written and read again.

Every stage takes any columns besides doc_id, text, lang and source and hands them on unchanged, whatever
their names; texts are taken whole. An empty table stays empty. Rows are told apart by doc_id and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procera.llm import decontamination, mixing, quality, simhash, templates
from procera.llm.common import mark, release, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    NULL and empty texts have no words and go. NULL lang or source forms a group like any other. Repeated rows
    are judged each for itself, alike. A value on a threshold stays.
    """
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; the documents and their columns stay, n_chars follows the text if there is one.

    NULL text stays NULL; a text all of whose lines go becomes empty. Repeated rows lose the same lines.
    """
    cleaned = templates.cleaned(docs)
    kinds = dict(docs.dtypes)
    return cleaned.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else cleaned


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of similar ones stays: the one with the least doc_id that is not NULL.

    Texts without words are alike. Rows without doc_id, or different texts under one doc_id, stand each for
    itself; of rows equal in doc_id and text one stays.
    """
    return simhash.distinct_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    NULL and empty texts and items match nothing. Of rows that share a doc_id only those with the item go.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with their columns, text included, and how often they stand in it (copies).

    Beside them size, source_size, target and taken (words, copies counted); a column of the documents by one of these
    names gives way. Texts without words (NULL and empty ones) are not drawn; NULL source is a source of its own. Rows
    equal in doc_id and text become one, with the copies of all.
    """
    drawn = mixing.drawn(docs)
    added = [c for c in drawn.columns if c != "row"]
    return drawn.select(*(f"row.`{c}`" for c in docs.columns if c not in added), *added)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Template growth and star rounds have no SQL form; the tests hold every stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result on the documents of `sf_dir`. What a stage wrote on its way goes once its result is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = mark()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
            release(spark, since, last=1)
    return docs
