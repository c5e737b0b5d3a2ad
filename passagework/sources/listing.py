"""Files of a folder tree as rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from passagework.functions import files as P, frontmatter
from passagework.functions.text import valid_text

FRONTMATTER_EXTENSIONS = [".md", ".mdx"]


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, size_bytes, modified of every file below `root`; contents stay unread."""
    return _scan(spark, root, glob).select(
        "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")
    )


def read_texts(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """`list_files` with the content as text."""
    return _scan(spark, root, glob).select(
        "path",
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
        valid_text(F.col("content")).alias("content"),
    )


def unread_files(listed: DataFrame, texts: DataFrame) -> DataFrame:
    """Listed files whose text could not be read."""
    return listed.join(texts.select("path"), "path", "left_anti")


def _scan(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    # A file that vanishes or breaks between listing and reading is skipped;
    # `unread_files` counts it.
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
        .option("ignoreCorruptFiles", "true")
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root)


def describe(listing: DataFrame, indexed_at: datetime, file_id: Column | None = None) -> DataFrame:
    """File rows from a listing: names, language, title and tags, one stamp for the run.

    A `tags` column of the listing is kept; otherwise title and tags come from the
    front matter of a `content` column, which stays. Empty values become NULL.
    """
    ext = P.extension(F.col("path"))
    has_content = "content" in listing.columns
    if has_content and "tags" not in listing.columns:
        front = F.when(ext.isin(FRONTMATTER_EXTENSIONS), frontmatter.parse(F.col("content")))
        listing = listing.withColumn("front", front)
        title, tags = F.col("front.title"), F.col("front.tags")
    else:
        title = F.lit(None).cast("string")
        tags = F.col("tags") if "tags" in listing.columns else F.lit(None).cast("array<string>")
    return listing.select(
        (F.md5("path") if file_id is None else file_id).alias("file_id"),
        "path",
        P.file_name(F.col("path")).alias("filename"),
        ext.alias("extension"),
        "size_bytes",
        "modified",
        P.language(ext).alias("lang"),
        title.alias("title"),
        tags.alias("tags"),
        F.lit(indexed_at).cast("timestamp").alias("indexed_at"),
        *(["content"] if has_content else []),
    )


def text_files(
    files: DataFrame, extensions: Sequence[str] | None = None, max_bytes: int | None = None
) -> DataFrame:
    """The files whose text is cut into chunks: text files that are not empty, of any size unless bounded."""
    from passagework.operators import filters

    chosen = filters.by_text_extension(files, extensions)
    return chosen.filter("size_bytes > 0") if max_bytes is None else filters.by_size(chosen, max_bytes)
