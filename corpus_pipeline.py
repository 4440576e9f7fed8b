"""The training-data pipeline: stages over the documents table, one after the other.

Null texts are empty for every stage. An empty table gives an empty result; without labels
nothing is rejected as toxic. All stages but the last keep the columns of the documents.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from guestlens.llm import exact, mixing, pieces, simhash, toxicity
from guestlens.llm.common import read
from guestlens.llm.queries import piece_model
from guestlens.session import stage


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. Repeated rows go or stay together."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text but for white space the one with the smallest doc_id
    stays, so one of all null and empty ones."""
    return exact.drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by the fingerprints of op1_simhash_dedup, one stays."""
    return simhash.drop_near_copies(docs, shingle_words=3, radius=3)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, once or twice. Those
    without words come once; a null source is one of its own."""
    return mixing.repeat_by_copies(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document and what they decode to, as digests. An empty text has
    the end id alone."""
    return pieces.digest_pieces(docs, piece_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("mix sources", mixing_stage),
    ("encode pieces", encoding_stage),
]

# A classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are stored and read again by the next one."""
    docs = read(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
