"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes what a
stage returns as a Parquet table in the shared folder and reads it again as the next
stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.llm import common
from freightlens.llm.decontaminate import decontaminate
from freightlens.llm.line_dedup import dedup_lines
from freightlens.llm.near_dedup import near_duplicates
from freightlens.llm.packing import pack
from freightlens.llm.quality import classify_quality
from freightlens.llm.queries import graded_labels, vocabulary
from freightlens.sources import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _own(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(df[f"`{c}`"] for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose chance of the top grade is under one half.

    Fitted on the rated documents of the table, graded 0 toxic, 1 poor, 2 good. A
    document without text is judged by the model's odds alone.
    """
    common.ship(spark)
    training = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = classify_quality(docs, graded_labels(spark, sf_dir), training_docs=training)
    return _own(judged.where("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts common blocks from later documents; documents with nothing left go.

    ``n_chars`` is counted anew where a text was cut. A document that had no text
    before, or whose text is null, stays.
    """
    common.ship(spark)
    cut = F.size("deleted_lines") > 0
    empty = F.length(F.trim(F.regexp_replace("text", r"\s", ""))) == 0
    found = dedup_lines(docs).where(~(cut & empty))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        counted = F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", counted)
    return _own(found, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group linked at a similarity of 0.8.

    Rows that share an id but not the text are documents of their own, ordered by a hash
    of the text; of equal rows (same id and text) one stays. Documents without words, and
    those with a null id, are in no group and stay.
    """
    common.ship(spark)
    own = F.xxhash64("text")
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", own.alias("own")))
    found = near_duplicates(docs.select(key.alias("key"), "text"), "key", percent=80)
    fates = found.where("key is not null").groupBy("key").agg(
        F.first("kept").alias("__stays"), F.count(F.lit(1)).alias("rows")
    )
    fates = fates.where("not __stays or rows > 1").select(
        F.col("key.doc_id").alias("__id"), F.col("key.own").alias("__own"), "__stays"
    )
    # stored, as both branches read it and a join may split a key that many rows have
    fates = stored(fates, "fates")
    same = (docs["doc_id"] == fates["__id"]) & (own == fates["__own"])
    single = docs.join(fates, same, "left_anti")
    repeated = docs.join(fates.where("__stays"), same).dropDuplicates(["__id", "__own"])
    return _own(single, docs).unionByName(_own(repeated, docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    common.ship(spark)
    return decontaminate(docs, common.table(spark, sf_dir, "benchmark"), mode="documents")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences; ``ids`` are their token ids."""
    common.ship(spark)
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: No SQL: the classifier and the tokenizer cannot be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
