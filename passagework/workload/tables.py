"""The shared tables seen as files, texts, vectors and queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from passagework.plans.corpus import Corpus, scan_corpus
from passagework.session import spread
from passagework.sources.listing import describe

INDEXED_AT = datetime(2025, 1, 1)
FIRST_HOUR = 1704067200  # 2024-01-01 00:00 UTC, in seconds
KANA_FROM, KANA_TO = "aeioursnt", "アエイオう認証ー한"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, spread over the cores for text work."""
    return spread(read(spark, sf_dir, "documents"), "doc_id")


def document_path() -> Column:
    ext = (
        F.when(F.col("source") == "src7", ".png").when(F.col("source") == "src13", "")
        .when(F.col("lang") == "en", ".md").when(F.col("lang") == "fr", ".txt")
        .when(F.col("lang") == "de", ".html").otherwise(".py")
    )
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), ext)


def listing(docs: DataFrame, content: Column | None = None) -> DataFrame:
    """documents as listed files; the tags are language and source of the document."""
    return docs.select(
        "doc_id",
        document_path().alias("path"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.timestamp_seconds(F.lit(FIRST_HOUR) + F.col("doc_id") * 3600).alias("modified"),
        F.array("lang", "source").alias("tags"),
        (F.col("text") if content is None else content).alias("content"),
    )


def files(docs: DataFrame, content: Column | None = None) -> DataFrame:
    """File rows with content."""
    return describe(listing(docs, content), INDEXED_AT, F.col("doc_id"))


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return scan_corpus(files(texts(spark, sf_dir)))


def kana_text() -> Column:
    """The Spanish texts with some letters replaced by kana, Han and Hangul."""
    return F.when(F.col("lang") == "es", F.translate("text", KANA_FROM, KANA_TO)).otherwise(F.col("text"))


def kana_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return scan_corpus(files(texts(spark, sf_dir), kana_text()))


def frontmatter_text() -> Column:
    """The texts behind front matter: two list styles, none, and an unclosed block by language."""
    title = F.concat(F.lit("\ntitle: "), F.col("source"))
    head = (
        F.when(F.col("lang") == "en", F.concat(F.lit("---"), title, F.lit("\ntags: [en, "), F.col("source"), F.lit("]\n---\n")))
        .when(F.col("lang") == "fr", F.concat(F.lit("---\ntitle: \"Le "), F.col("source"), F.lit("\"\ntags:\n  - fr\n  - fr\n---\n")))
        .when(F.col("lang") == "de", F.concat(F.lit("---"), title, F.lit("\n# no tags\n---\n")))
        .otherwise(F.concat(F.lit("---"), title, F.lit("\n")))
    )
    return F.concat(head, "text")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as files of a site: the address without scheme, two folders renamed to common ones."""
    path = F.regexp_replace("url", "^https?://", "")
    path = F.replace(F.replace(path, F.lit("/fr/"), F.lit("/node_modules/")), F.lit("/es/"), F.lit("/dist/"))
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path"))


def benchmark_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as a batch of queries."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as chunk vectors; the label is the file."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("file_id"), F.col("vec_id").cast("int").alias("chunk_no"), "embedding"
    )
