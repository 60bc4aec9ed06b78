"""From documents to token ids: toxic texts go, then repeated lines, then near-duplicates; sources are mixed to target weights, and what is taken is encoded.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the
columns of documents. Each works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import written
from quire.llm.line_dedup import documents_without_repeats
from quire.llm.mixing import mixed_documents
from quire.llm.near_dup import without_near_duplicates
from quire.llm.sentencepiece_codec import encode_texts
from quire.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, trained on the labelled ones among them, doesn't reject.

    Null and empty texts stay; a row with a null or repeated doc_id is judged by its own text; without labels of both
    classes nothing goes. Extra columns pass through under any name; an empty table gives an empty one.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share.

    Null text stays null, an emptied text is empty; every row counts as a document, so a text that ten rows repeat loses
    all its lines. Extra columns pass through under any name; an empty table gives an empty one.
    """
    return documents_without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (from PERCENT of similarity on), the one with the smallest doc_id.

    Texts without words and rows with a null doc_id stay, rows that repeat a kept doc_id stay all. Extra columns pass
    through under any name; an empty table gives an empty one.
    """
    return without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source of its own, documents without words stay once, rows with a null or repeated doc_id count by
    themselves. Extra columns pass through under any name; an empty table gives an empty one.
    """
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of each document of the mix; null and empty texts have none, an empty table gives no rows."""
    return encode_texts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("source_mixing", mix),
    ("sentencepiece", encode),
]

#: The toxicity machine and the encoder are no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written, as the next stage reads it more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
