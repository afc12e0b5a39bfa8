"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, exact_dedup, fill_middle, langid, merge_dropout, ngram_join, packing, quality, shards, suffix_dedup, token_counts, turn_repair, url_filter
from tesserae.llm.oracles import ORACLES, URL_RULES
from tesserae.session import table

__all__ = ["ORACLES", "QUERIES"]

def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    out = shards.assign(
        table(spark, sf_dir, "documents"),
        "doc_id",
        [1.0] * 8,
        extra={"size": (F.octet_length(body) + 1).cast("long"), "text_crc32": F.crc32(F.encode(body, "UTF-8"))},
    )
    return out.withColumn("law", F.lit("key"))


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number at a url's end names the document whose labels hold for that page."""
    pages = table(spark, sf_dir, "pages")
    _, path = url_filter.host_and_path(F.col("url"))
    numbered = pages.select("url", F.regexp_extract(path, r"/([0-9]{1,18})(\.[a-z]+)?/?$", 1).alias("n"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("n"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad"))
    labelled = numbered.join(labels.where("bad is not null"), "n").select("url", "bad")
    return url_filter.judge(pages, labelled, URL_RULES)


def op5_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = merge_dropout.encode(table(spark, sf_dir, "documents"), model, seed=17)
    return merge_dropout.decode(encoded, model).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == F.col("text")).alias("lossless"),
    )


def op6_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id have no remainder: they are not held out, and nothing is learned from them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.fold(F.col("doc_id")) == 2, F.lit(False))
    model = langid.fit(docs.where(langid.fold(F.col("doc_id")) != 2))
    return langid.classify(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held_out})


def op7_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("cleaned_text")


def op9_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op11_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = decontaminate.automata(table(spark, sf_dir, "benchmark"))
    found = decontaminate.find(table(spark, sf_dir, "documents"), blocks)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        decontaminate.n_hit(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damage(table(spark, sf_dir, "conversations")))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.rearrange(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(fill_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_prefix_counts": op2_prefix_counts,
    "op3_rendezvous_shards": op3_rendezvous_shards,
    "op4_url_templates": op4_url_templates,
    "op5_merge_dropout": op5_merge_dropout,
    "op6_compression_language": op6_compression_language,
    "op7_content_sort": op7_content_sort,
    "op8_line_rules": op8_line_rules,
    "op9_swap_packing": op9_swap_packing,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_suffix_automaton": op11_suffix_automaton,
    "op12_turn_repair": op12_turn_repair,
    "op13_fill_middle": op13_fill_middle,
}
