"""One registered query per operator, over its whole table with production
parameters; the digest columns are derived from the operator's real outputs."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonscope.llm import alignment, bpe, centroids, chat, decontamination, fingerprints, hmm, html_template, packing, token_counts
from reasonscope.llm.common import table
from reasonscope.llm.oracles import ORACLES  # noqa: F401
from reasonscope.llm.quality import judge
from reasonscope.llm.simhash import components
from reasonscope.llm.substring_dedup import remove_repeats


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"),
                       public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.table_records(table(spark, sf_dir, "conversations"))
    said = "</s>[INST] ok [/INST]"
    extra = json.dumps({"messages": [{"role": r, "content": said} for r in ("user", "assistant")]})
    records = rows.unionAll(spark.range(1).select(F.lit(-7).cast("long"), F.lit(0).cast(rows.schema["turn"].dataType), F.lit(extra)))
    return chat.read_back(chat.format_turns(records), ["turn"])


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"),
                            public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_template.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"), "kept")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    out = centroids.with_inertia(found)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("center", 256).alias("centroid_sha256"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                        table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      "contaminated", "n_near_items")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.compare_tokenizers(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"),
                                       public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    return out.select("doc_id", *alignment.SUMS, "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hmm_scores": op1_hmm_scores,
    "op2_token_counts": op2_token_counts,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_packing": op4_packing,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_rules": op10_quality_rules,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_decontamination": op12_decontamination,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
