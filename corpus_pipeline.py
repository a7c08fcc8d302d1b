"""The corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage takes what its predecessor kept as ``docs`` and is written as Parquet
before the next one reads it.  All but the last return the columns of ``docs``.
A stage looks at doc_id, text and (where present) n_chars; other columns pass
through whatever their names are.  Null texts count as empty; a row
without doc_id has no smaller copy and stays a group's own.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapescope.llm import decontam, neardup, packing, pii, toxicity
from tapescope.llm.common import ready, scratch, shared_path, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is below one half; learned from ``labels`` on ``docs``.

    Labels that no classifier can be fitted to say nothing about a document: all stay, with a warning.
    """
    ready(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    if model.trees is None:
        warnings.warn("toxicity: the labels of these documents lack a class, so no document is rejected", stacklevel=2)
        return docs
    return model.scored(docs).where("score < 0.5").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of five-word-shingle similarity 0.8 or more: that of the smallest id.

    A row is known by all its columns (two 64-bit hashes of them), not by its id, so rows without an id and different
    rows of one id are told apart: rows with an id come first, then the smaller hashes.  Of rows that are equal in
    every column one stays.  Rows without words are in no group and stay.
    """
    ready(spark)
    hashed = lambda k: F.xxhash64(F.lit(k), *[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), hashed(1).alias("_k1"), hashed(2).alias("_k2"))
    with scratch(spark):  # sketches, sets and links go as soon as the rows are judged
        groups = written(neardup.labelled(keyed, 5, 80, "doc_id", ["doc_id", "_k1", "_k2"]).where("group is not null"), "groups")
        rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_k1", "_k2")
        first = groups.groupBy("group").agg(F.min(rank).alias("_first"))
        stays = (F.col("_k1") == F.col("_first._k1")) & (F.col("_k2") == F.col("_first._k2"))
        judged = groups.join(first, "group").groupBy("_k1", "_k2").agg(F.max(stays).alias("_stays"), F.count(F.lit(1)).alias("_times"))
        judged = written(judged.where("not _stays or _times > 1"), "judged", keep=True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), hashed(1).alias("_k1"), hashed(2).alias("_k2"))
    kept = rows.join(judged, ["_k1", "_k2"], "left").where("_stays is null or _stays")
    if judged.where("_stays").isEmpty():
        return kept.select("_row.*")
    repeated = kept.where("_stays").dropDuplicates(["_k1", "_k2"])
    return kept.where("_stays is null").select("_row.*").unionByName(repeated.select("_row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    ready(spark)
    return decontam.without_hits(docs, table(spark, sf_dir, "benchmark"), window=10)


def redact_identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers replaced by their kind; n_chars is counted anew where the text changed."""
    ready(spark)
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 16 bit, which the vocabulary fits), sequence and offset."""
    ready(spark)
    return packing.pack(packing.tokenize(docs, width=2))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("decontamination", drop_contaminated), ("pii", redact_identifiers), ("packing", pack_sequences)]

#: Trees and packing cannot be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
