"""From raw documents to token ids: each stage works on all rows that its predecessor kept.

``STAGES`` lists (name, function of (spark, docs, sf_dir)); each result is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``; rows with nulls, empty and
repeated rows pass as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketspark.llm import bagminhash, exact_dedup, mixing, pieces, toxicity
from ticketspark.llm.queries import table, vocabulary
from ticketspark.session import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that the classifier rejects go."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the longest original stays."""
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays."""
    return bagminhash.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: sources to target weights, on a budget of the tokens there are. Rows of small sources repeat,
    large sources are cut."""
    return mixing.keep_mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids, and the text that they decode to."""
    return pieces.encode_and_decode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: The learned stages have no SQL form. Tests hold single stages against plain forms, and run() only against the
#: stages applied in turn, so a document lost by a stage on the table at hand would not be noticed there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
