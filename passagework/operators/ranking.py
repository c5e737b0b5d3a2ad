"""Relevance scores, best chunk per file, top k per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from passagework.operators import bags
from passagework.operators.clauses import CLAUSE_KEY
from passagework.operators.joins import bounded_join
from passagework.schemas import CHUNK_KEY

# Fixed values of the relevance formula, and the constant of rank fusion.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_CONSTANT = 60


def inverse_frequency(n_chunks: Column, df: Column) -> Column:
    raw = F.log((n_chunks - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def bm25(tf: Column, df: Column, dl: Column, n_chunks: Column, avg_dl: Column) -> Column:
    """Relevance of one clause in one chunk; higher is better."""
    return inverse_frequency(n_chunks, df) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avg_dl))


def score_hits(hits: DataFrame, stats: DataFrame, avg_dl: str, rows: int | None) -> DataFrame:
    """Clause hits with their score; `rows` bounds the number of clauses.

    Clause frequencies come from the hits themselves, so a phrase or a prefix counts
    as one unit. Corpus values are one scalar subquery: one row, computed once.

    The count names every column of the hits and filters none: so both uses of the
    hits are the same shuffle to Spark, and the texts are read once.
    """
    counted = (F.col("kind") == "must") & F.col("scored") & (F.col("tf") > 0) & (F.col("dl") >= 0) & (F.col("n_must") >= 0)
    df = hits.groupBy(*CLAUSE_KEY).agg(F.count(F.when(counted, 1)).alias("df"))
    joined = bounded_join(hits, df, CLAUSE_KEY, rows, [F.col(c) for c in CHUNK_KEY], "left")
    corpus = stats.select(F.struct("n_chunks", F.col(avg_dl).alias("avg_dl"))).scalar()
    value = bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("corpus.n_chunks"), F.col("corpus.avg_dl"))
    relevant = (F.col("kind") == "must") & F.col("scored")
    return (
        joined.withColumn("corpus", corpus)
        .withColumn("score", F.when(relevant, value).otherwise(F.lit(0.0)))
        .drop("df", "corpus")
    )


def score_postings(rows: DataFrame, stats: DataFrame, avg_dl: str, terms: int) -> DataFrame:
    """Placed postings of a bag of `terms` words with the `value` of one of their clauses: clauses of a word have its frequency."""
    joined = bounded_join(rows, bags.frequencies(rows), ["term_no"], terms, [F.col(c) for c in CHUNK_KEY])
    corpus = stats.select(F.struct("n_chunks", F.col(avg_dl).alias("avg_dl"))).scalar()
    value = bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("corpus.n_chunks"), F.col("corpus.avg_dl"))
    return joined.withColumn("corpus", corpus).withColumn("value", value).drop("df", "corpus")


def best_per_file(hits: DataFrame, keys: tuple[str, ...] = ("query_id", "file_id")) -> DataFrame:
    """The best chunk of each file per query."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_no")
    return hits.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def top_k(hits: DataFrame, k: int, tie: tuple[str, ...] = ("file_id", "chunk_no"), score: str = "score") -> DataFrame:
    """The k best rows per query with their rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), *tie)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse_ranks(*lists: DataFrame, constant: int = RRF_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: query_id, file_id, score."""
    union = lists[0].select("query_id", "file_id", "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select("query_id", "file_id", "rank"))
    return union.groupBy("query_id", "file_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
