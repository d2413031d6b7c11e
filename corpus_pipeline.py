"""Training-data pipeline over ``documents``: each stage takes what its predecessor kept and is written as Parquet.

Every function takes (spark, docs, sf_dir). All stages but the last return the columns of ``documents``, extra ones included.
Empty tables go through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipledger.llm.common import placed, saved, table
from equipledger.llm.kn_quality import keep_quality
from equipledger.llm.pfair import mixed
from equipledger.llm.pii import mask_pii
from equipledger.llm.simhash import drop_near_duplicates
from equipledger.llm.sp_lattice import encode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney quality classifier keeps. Null and empty texts stay; a null language has the bounds of
    all languages; without labels all rows stay; repeated rows stay or go together."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the smallest id: 3-word shingles, at most 3 differing bits. Texts without a word
    are one group; of repeated rows one stays; rows without an id stay once a text."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked in whole texts; null text stays null."""
    return mask_pii(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the Pfair mix; rows without a source are a source of their own."""
    return mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, mix_position, n_pieces, ids and whether decoding gives the text back. ``mix_position`` is
    the row's place in ``docs`` as the mix wrote it (gapless from 0): the order to train in."""
    at, starts = placed(docs)
    coded = encode(at, keep=["doc_id", "lang", "source", "file_name", "file_row"])
    # one row a file
    return coded.join(F.broadcast(starts), "file_name").select(
        "doc_id", "lang", "source", (F.col("file_start") + F.col("file_row")).alias("mix_position"), "ids", "n_pieces", "round_trip")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("pieces", pieces),
]

# the quality model, XXH64 bit sums, the mix and the lattice are beyond SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
