"""Result formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from passagework.operators.catalog import tags_to_json


def paths_only(results: DataFrame) -> DataFrame:
    """query_id, rank, path."""
    return results.select("query_id", "rank", "path")


def as_json(results: DataFrame, queries: DataFrame, time_ms: float | None = None) -> DataFrame:
    """One JSON text per query: query, count, time_ms if given, results in rank order.

    `results` is a top-k frame (bounded per query) with path, title, tags, score and
    snippet or content; empty fields are left out. A query without hits has null
    results.
    """
    optional = [c for c in ("snippet", "content") if c in results.columns]
    hit = F.struct(
        "path",
        F.nullif("title", F.lit("")).alias("title"),
        tags_to_json(F.col("tags")).alias("tags"),
        "score",
        *(F.nullif(c, F.lit("")).alias(c) for c in optional),
    )
    lists = results.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", hit.alias("hit")))), lambda h: h["hit"]).alias("results")
    )
    head = [F.col("query"), F.when(F.col("results").isNull(), 0).otherwise(F.size("results")).alias("count")]
    if time_ms is not None:
        head.append(F.lit(float(time_ms)).alias("time_ms"))
    # Null fields of hits are dropped, the null list of a query without hits is not.
    nothing = F.concat(F.regexp_replace(F.to_json(F.struct(*head)), r"\}$", ""), F.lit(',"results":null}'))
    text = F.when(F.col("results").isNull(), nothing).otherwise(F.to_json(F.struct(*head, "results")))
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    return asked.join(lists, "query_id", "left").select("query_id", text.alias("json"))
