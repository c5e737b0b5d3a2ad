"""Statistics, tags, meta values and listings of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from passagework.functions import files as P
from passagework.operators.filters import is_noise_name


def file_tags(files: DataFrame) -> DataFrame:
    """file_id, tag: one row per file and tag."""
    return files.select("file_id", F.explode(F.array_distinct("tags")).alias("tag"))


def totals(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, bytes and chunks."""
    per_file = files.agg(
        F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes")
    )
    n_chunks = chunks.agg(F.count("*")).scalar()
    return per_file.withColumn("n_chunks", n_chunks)


def by_extension(files: DataFrame, limit: int = 15) -> DataFrame:
    """Files and bytes of the most frequent extensions."""
    return (
        files.filter(F.col("extension").isNotNull())
        .groupBy("extension")
        .agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("total_bytes"))
        .orderBy(F.desc("n_files"), "extension")
        .limit(limit)
    )


def tags_to_json(tags: Column) -> Column:
    """Tag list as JSON text, NULL for none."""
    return F.when(F.size(tags) > 0, F.to_json(tags))


def tags_from_json(text: Column) -> Column:
    """JSON text as a list of trimmed, non-empty tags."""
    items = F.from_json(text, "array<string>")
    return F.filter(F.transform(items, lambda t: F.trim(t)), lambda t: t != "")


def files_per_tag(files: DataFrame) -> DataFrame:
    """Uses of each tag; a tag repeated in one file counts again."""
    return (
        files.filter(F.size("tags") > 0)
        .select(F.explode("tags").alias("tag"))
        .groupBy("tag")
        .agg(F.count("*").alias("n_files"))
        .orderBy(F.desc("n_files"), "tag")
    )


def embedding_count(embeddings: DataFrame) -> DataFrame:
    return embeddings.agg(F.count("*").alias("n_embeddings"))


def run_counts(files: DataFrame, chunks: DataFrame, unread: DataFrame) -> DataFrame:
    """One row: files listed, chunks written, files that could not be read."""
    return (
        files.agg(F.count("*").alias("n_files"))
        .withColumn("n_chunks", chunks.agg(F.count("*")).scalar())
        .withColumn("n_errors", unread.agg(F.count("*")).scalar())
    )


def latest_meta(meta: DataFrame) -> DataFrame:
    """key, value: the value written last, an empty text for none."""
    return meta.groupBy("key").agg(F.coalesce(F.max_by("value", "written_at"), F.lit("")).alias("value"))


def listing(files: DataFrame, max_depth: int = 0, path: str = "path") -> DataFrame:
    """Every folder and file as (parent, depth, name, is_dir), folders first, then by name.

    A hidden or noise name leaves out everything below it. `max_depth` 0 means all
    levels. The order is one range-partitioned sort, so a huge folder is no single task.
    """
    parts = F.split(F.regexp_replace(F.col(path), "^/+", ""), "/")
    levels = F.size("parts") if max_depth <= 0 else F.least(F.size("parts"), F.lit(max_depth))
    rows = files.select(parts.alias("parts")).select(
        F.inline(
            F.transform(
                F.sequence(F.lit(0), levels - 1),
                lambda d: F.struct(
                    F.array_join(F.slice("parts", F.lit(1), d), "/").alias("parent"),
                    d.alias("depth"),
                    F.get("parts", d).alias("name"),
                    (d < F.size("parts") - 1).alias("is_dir"),
                    F.exists(F.slice("parts", F.lit(1), d + 1), is_noise_name).alias("noise"),
                ),
            )
        )
    )
    return (
        rows.filter(~F.col("noise"))
        .drop("noise")
        .distinct()
        .orderBy("parent", F.desc("is_dir"), "name")
    )


def display_rows(files: DataFrame) -> DataFrame:
    """File rows as printed by metadata searches."""
    return files.select("path", "size_bytes", P.epoch_seconds(F.col("modified")).alias("modified"), "lang")
