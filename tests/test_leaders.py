"""Top-k lists made task by task before they are ranked."""

import random

from pyspark.sql import functions as F

from passagework.operators import leaders as L, ranking
from passagework.plans import search

SCHEMA = "query_id string, file_id {id}, chunk_no int, score double, branch string"


def _hits(spark, id_type="long", n=3000):
    dice = random.Random(3)
    ids = list(range(90)) if id_type == "long" else [f"ä{i}" if i % 7 else f"Z{i}" for i in range(90)]
    scores = [None, float("nan"), 0.0, -0.0, -1.5, 0.25, 0.5, 2.0]
    rows = [
        (dice.choice(["a", "b", "é", None]), dice.choice([*ids, None]), dice.choice([0, 1, 2, None]), dice.choice(scores), dice.choice(["gram", "word"]))
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA.format(id=id_type)).repartition(5)


def _rows(frame):
    return sorted(map(repr, frame.select("query_id", "file_id", "chunk_no", "score", "rank").collect()))


def _plain_files(hits, k):
    return ranking.top_k(ranking.best_per_file(hits), k)


def test_results_are_those_of_the_windows(spark, monkeypatch):
    monkeypatch.setattr(L, "CUT_ROWS", 50)
    tie = ("file_id", "chunk_no", "branch")
    for id_type in ("long", "string"):
        hits = _hits(spark, id_type).withColumn("score", F.when(F.col("score") == 0, F.lit(0.0)).otherwise(F.col("score")))
        assert _rows(search.top_files(hits, 7)) == _rows(_plain_files(hits, 7))
        assert _rows(search.top_chunks(hits, 9)) == _rows(ranking.top_k(hits, 9, tie))
        cut = ranking.top_k(hits.drop("branch").distinct(), 6).drop("rank")
        assert _rows(search.top_files(hits.drop("branch").distinct(), 2, overfetch=3)) == _rows(_plain_files(cut, 2))


def test_a_task_passes_on_few_rows(spark):
    # Every chunk meets every query: the windows alone would sort all of them.
    hits = spark.range(4000).repartition(4).select(
        F.explode(F.array(F.lit("a"), F.lit("b"))).alias("query_id"), (F.col("id") / 2).cast("long").alias("file_id"),
        (F.col("id") % 2).cast("int").alias("chunk_no"), F.xxhash64("id").cast("double").alias("score"), F.lit("word").alias("branch"),
    )
    assert L.leaders(hits, 3).count() <= 4 * 2 * 3
    assert L.leaders(hits, 3, per_file=True).count() <= 4 * 2 * 3
    for top in (search.top_files(hits, 3), search.top_chunks(hits, 3), search.top_files(hits, 3, overfetch=3)):
        assert "MapInArrow" in top._jdf.queryExecution().executedPlan().toString()


def test_a_task_holds_few_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "CUT_ROWS", 20)
    monkeypatch.setattr(L, "HELD_ROWS", 10)
    hits = _hits(spark, n=1000).withColumn("query_id", F.concat("query_id", (F.col("file_id") % 11).cast("string")))
    assert _rows(search.top_files(hits, 2)) == _rows(_plain_files(hits, 2))


def test_no_rows_give_no_rows(spark):
    assert search.top_files(_hits(spark).limit(0), 3).count() == 0
