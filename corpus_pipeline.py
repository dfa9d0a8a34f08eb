"""The corpus pipeline: each stage reads what the stage before it kept, as Parquet in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import stored, table
from framelake.llm.decontaminate import contained_items
from framelake.llm.lines import dedup_lines
from framelake.llm.packing import measured, pack
from framelake.llm.simhash import copy_groups
from framelake.llm.toxicity import toxic_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in ``ids`` (id).

    Decisions name documents by their id, in every stage: rows that share an id are one document, of which all go or all
    stay, equal rows included; rows without id are named by nothing and stay.
    """
    return docs.join(ids.distinct(), docs["doc_id"] == ids["id"], "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a row without id is judged by nothing and stays."""
    scored = toxic_scores(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scored.where("predicted = 1 and id is not null").select("id"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows are cut out of the texts; documents stay, n_chars follows."""
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies the document with the smallest id stays.

    Copies are texts with linked fingerprints, and texts whose five-word shingles have a similarity of 0.8 or more.
    Documents without words have one fingerprint, as in the operator, so one of them stays; rows without id stay.
    """
    return _without(docs, copy_groups(docs).where("id <> group").select("id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, contained_items(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("id")))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their place in the training sequences."""
    return pack(measured(docs), "doc_id", "n", "source", "g").withColumnRenamed("id", "doc_id")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: Learned scores and hash fingerprints have no SQL twin; tests compare the operators of the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
