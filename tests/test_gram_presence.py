"""Grams of a stored index are grouped in the task."""

from pyspark.sql import functions as F

from passagework.functions import text as X
from passagework.operators import postings


def test_grams_leave_a_task_once_for_many_chunks(spark, monkeypatch):
    rows = [
        (1, 0, "abcABC 認証𝒳é"), (1, 1, "ab"), (1, 1, "ab"), (2, 0, None), (None, 0, "İstanbul ẞx"), (3, None, "x"), (4, 0, ""),
        *[(i, 0, "the same text in many chunks") for i in range(10, 400)],
    ]
    chunks = spark.createDataFrame(rows, "file_id long, chunk_no int, content string").repartition(2)
    folded = X.fold_grams(F.col("content"))
    grams = F.when(F.char_length(folded) < 3, F.array(folded)).otherwise(F.array_distinct(X.char_grams(folded)))
    want = chunks.select(F.explode(grams).alias("term"), "file_id", "chunk_no")
    for flags in (postings.FLAGS, 100):
        monkeypatch.setattr(postings, "FLAGS", flags)
        found = postings.gram_presence(chunks)
        got = found.select("term", F.inline("places"))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        assert found.count() < want.count() / 50
