"""From raw documents to packed training sequences, stage by stage.

Each stage is one operator over all that its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, near_dedup, packing, quality, substring_dedup
from tidemark.llm.common import drop, keep, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labels, accepts.

    Null and empty texts are scored as texts without words; rows with null or repeated ids are scored
    each for itself; an empty table stays empty; columns that documents don't have go.
    """
    scored = quality.score_documents(docs, table(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return scored.filter("predicted = 1").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Null and empty texts are like nothing and stay, as do rows with a null id. Rows of one id are one
    document and stay or go together; of rows equal in all columns one stays. An empty table stays empty.
    """
    groups = near_dedup.near_duplicates(docs, size=5, percent=80)
    others = groups.filter("not kept").select("doc_id").distinct()
    rest = docs.join(others, "doc_id", "left_anti").select(*COLUMNS)
    repeated = keep(docs.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    if repeated.filter("doc_id is not null").isEmpty():
        return rest
    return rest.join(repeated, "doc_id", "left_anti").unionByName(rest.join(repeated, "doc_id", "left_semi").dropDuplicates())


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that an earlier document has.

    A null text becomes empty, a document that loses all its words too; rows with a null id keep their
    text; rows of one id take nothing from each other. n_chars is that of what is left.
    """
    cut = substring_dedup.remove_repeats(docs, carry=("lang", "source"), keep_space=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts and rows with a null id stay; rows of one id go together; without items all stay.
    """
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end id; null and repeated ids are packed each for itself.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("near dedup", keep_one_of_each),
    ("substring dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's table is deleted when that of the next is complete; the last stage's input stays."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
