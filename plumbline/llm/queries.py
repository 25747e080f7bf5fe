"""The registered queries of this package: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import (
    alignment,
    chat,
    decontaminate,
    exact_dedup,
    hard_negatives,
    language,
    line_dedup,
    mixing,
    near_dedup,
    quality,
    secrets,
    substring_dedup,
    tokens,
)
from plumbline.llm.common import held_out, read_table, tokenizer_file


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model)
    return scored.select(
        F.col("doc.doc_id").alias("doc_id"),
        held_out(F.col("doc.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language.predict_languages(docs, language.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.judged(
        decontaminate.find_hits(docs, read_table(spark, sf_dir, "benchmark"))
    )
    return hits.select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        *[secrets.count_of("spans", kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(secrets.as_text(base), 256).alias("base_sha256"),
        secrets.as_text(F.col("spans")).alias("spans"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.open_index(spark)
    found = exact_dedup.append_new(index, read_table(spark, sf_dir, "documents"), batches=4)
    index.forget()
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.without_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.measure(read_table(spark, sf_dir, "documents"))
    plan = mixing.plan_sources(sizes)
    return mixing.taken_by_document(sizes, plan, mixing.draw(sizes, plan))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "kept")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_file())


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(
        read_table(spark, sf_dir, "documents"),
        tokenizer_file("byte_bpe_50k.json"),
        tokenizer_file("piece_bpe_32k.model"),
    )


#: A conversation whose texts hold control strings, added to those of the table.
PLANTED_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "conv_id bigint, turn bigint, role string, text string"
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_and_read(given.unionByName(spark.createDataFrame(PLANTED_CHAT, columns)))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10)
    relabelled = vectors.withColumn("label", F.coalesce(moved, F.col("label").cast("long")))
    return hard_negatives.mine(relabelled, F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_language_id": op2_language_id,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_secret_scan": op4_secret_scan,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_line_dedup": op6_line_dedup,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_mixing": op8_mixing,
        "op9_near_dedup": op9_near_dedup,
        "op10_token_output": op10_token_output,
        "op11_tokenizer_alignment": op11_tokenizer_alignment,
        "op12_chat_formatting": op12_chat_formatting,
        "op13_hard_negatives": op13_hard_negatives,
        "pipeline": pipeline,
    }
