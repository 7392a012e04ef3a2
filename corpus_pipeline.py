"""From raw documents to packed training sequences, in five stages.

quality (lines above the limits go, failing and depleted documents go), toxicity
(documents scored 0.5 or more go), near duplicates (one document of each group stays),
mixing (documents are repeated or left out so that sources reach their targets),
packing (the rows of sequences). All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import common, minhash, mixing, packing, quality, tokens, toxicity

#: No stage after the first can be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted, without the lines above the limit; ``n_chars`` follows the text.

    A null or empty text fails. A null source is a host of its own. Repeated rows are judged alike and all stay or go.
    A text of any length is judged whole. An empty table gives no rows. Columns beyond those of ``documents`` stay as they are.
    """
    common.release(spark)
    return quality.clean(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Clean documents, by a network trained on the labelled among them; the score is a column-wise judgement of the text alone.

    A null or empty text scores 0 and stays. Null labels, and labels of documents that are gone, are not used; without labels of both
    classes every score is the share of label 1, or 0. Repeated rows are judged alike. All windows of a text of any
    length are scored. An empty table gives no rows. Other columns stay as they are.
    """
    common.release(spark)
    net = toxicity.trained(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.non_toxic(docs, net)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one with its smallest id. Stages take shingles of five words; ``op6_minhash``, whose result is set, takes two.

    Rows, not ids, are grouped: of rows repeated with id and text one stays, and rows that share an id but not a text are
    judged each by itself. Rows without an id take part and stay only if no row of the group has one (then the one with
    the smallest text hash). Null texts and texts without words are nobody's copies and stay. An empty table gives no rows. Other columns stay.
    """
    common.release(spark)
    return minhash.distinct_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it, perhaps not at all.

    A null source is a source of its own; a null or empty text has size 0 and is taken or not like others of its source. Rows that
    repeat id, text and source share what they are taken. An empty table gives no rows. Other columns stay.
    """
    common.release(spark)
    return mixing.mixture(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of sequences, see ``packing.PACKED``: every row's pieces as often as the row is there.

    A null or empty text is its end id alone; longer texts than a sequence are cut. A null id stays null. An empty
    table gives no rows. Other columns are ignored.
    """
    common.release(spark)
    return packing.pack(docs, tokens.default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, f"stage{k}")
    return docs
