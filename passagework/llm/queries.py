"""The registered queries of this folder. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagework.llm import chat, collocations, contamination, exact, licenses, lines, mixing, personal, quality, repeats, shards, simhash, spelling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(query):
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op5_quality_rules(spark, sf_dir):
    rows = quality.judged(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.array_join("failed", ",").alias("failed"),
    )


@register
def op9_jump_shards(spark, sf_dir):
    return shards.sharded(table(spark, sf_dir, "documents"))


@register
def op10_pivotal_mix(spark, sf_dir):
    rows = mixing.mixture(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


@register
def op3_winnowing(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rows = contamination.verdicts(contamination.matched(docs, items, ["doc_id"]))
    return rows.select(F.col("_row.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@register
def op7_simhash(spark, sf_dir):
    return simhash.near_classes(table(spark, sf_dir, "documents"))


@register
def op8_suffix_repeats(spark, sf_dir):
    rows = repeats.without_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select(
        F.col("_row.doc_id").alias("doc_id"), "n_bytes", "n_removed",
        F.shiftright(F.size("spans"), 1).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@register
def op4_weak_supervision(spark, sf_dir):
    rows = personal.personal_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        F.col("_row.doc_id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in personal.BASE_KINDS],
        F.sha2(personal.span_text("base"), 256).alias("base_sha256"),
        personal.span_text(F.concat("base", "added")).alias("spans"), personal.span_text("added").alias("added"),
    )


@register
def op6_license_rules(spark, sf_dir):
    rows = licenses.license_labels(table(spark, sf_dir, "documents"))
    return rows.select(F.col("_row.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@register
def op1_tool_links(spark, sf_dir):
    calls, results = chat.conversation_calls(table(spark, sf_dir, "conversations"))
    return chat.every_call(calls, results, chat.SCHEMAS)


@register
def op2_site_spread(spark, sf_dir):
    rows = lines.without_boilerplate(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op12_exact_dedup(spark, sf_dir):
    rows = exact.exact_groups(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select(
        F.col("_row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@register
def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


@register
def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
