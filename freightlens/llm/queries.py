"""The registered queries of the operators: thin callables over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.llm import common
from freightlens.llm.decontaminate import find_contamination
from freightlens.llm.fill_middle import fill_in_middle, restored
from freightlens.llm.language_id import identify_languages
from freightlens.llm.line_dedup import dedup_lines
from freightlens.llm.mixing import mix_sources
from freightlens.llm.near_dedup import near_duplicates
from freightlens.llm.packing import pack
from freightlens.llm.quality import classify_quality
from freightlens.llm.secret_scan import joined_spans, scan_secrets
from freightlens.llm.sharding import rendezvous_shard, with_shards, with_slots
from freightlens.llm.topk import top_k
from freightlens.llm.url_filter import Rule, filter_urls, url_host
from freightlens.llm.vector_codes import codebook_text, encode_vectors, fit_codebooks
from freightlens.sources import stored

#: Fixed values of the query on URLs.
URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]
#: Host names with one of these terms feed the list of blocked URLs.
SPAM_TERMS = ["casino", "pills", "bets"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.ship(spark)
    return common.table(spark, sf_dir, name)


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def graded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))


def op1_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(
        table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents").select("text", "lang")
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = dedup_lines(docs)
    return found.select(
        "doc_id",
        "text",
        "n_lines",
        F.size("deleted_lines").alias("n_deleted"),
        F.array_join("deleted_lines", ",").alias("deleted_lines"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    spam = pages.where(url_host(F.col("url")).rlike("|".join(SPAM_TERMS))).select("url")
    judged = filter_urls(pages, spam, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "listed", "verdict")


def op5_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    slotted = with_slots(with_shards(docs, "doc_id", [1.0] * 16))
    grown = rendezvous_shard(F.col("doc_id"), [1.0] * 17)
    return slotted.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        grown.alias("grown_shard"),
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined_spans("base"), 256).alias("base_sha256"),
        joined_spans("spans").alias("spans"),
    )


def op7_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = classify_quality(docs, graded_labels(spark, sf_dir))
    return judged.select(
        "doc_id",
        F.round("expected_grade", 6).alias("expected_grade"),
        F.round("tail_probability", 6).alias("tail_probability"),
        "kept",
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = fit_codebooks(vectors)
    coded = stored(encode_vectors(vectors, books, keep=["label"]), "codes")
    # stored, so that Spark knows its size and may split a label that many rows have
    totals = stored(
        coded.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error")), "errors"
    )
    found = coded.join(totals, F.col("label").eqNullSafe(F.col("own")))
    return found.select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.sha2(F.lit(codebook_text(books)), 256).alias("codebooks_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_fusion": op1_language_fusion,
    "op2_decontaminate": op2_decontaminate,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_rendezvous": op5_rendezvous,
    "op6_secret_scan": op6_secret_scan,
    "op7_minhash_join": op7_minhash_join,
    "op8_threshold_topk": op8_threshold_topk,
    "op9_packing": op9_packing,
    "op10_ordinal_quality": op10_ordinal_quality,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_source_mix": op12_source_mix,
    "op13_vector_codes": op13_vector_codes,
}
