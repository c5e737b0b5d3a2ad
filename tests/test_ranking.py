import math

import pytest

from passagework.operators import clauses as C, ranking
from passagework.plans import output, search
from passagework.plans.corpus import scan_corpus


def test_relevance_against_the_formula(spark):
    texts = ["a a b", "a c", "c c c c", "d"]
    rows = [(i, str(i), None, None, t) for i, t in enumerate(texts)]
    corpus = scan_corpus(spark.createDataFrame(rows, "file_id long, path string, title string, tags array<string>, content string"))
    got = {r.file_id: r.score for r in search.word_matches(corpus, C.any_of(spark, {"q": ["a", "d"]})).collect()}
    mean = 10 / 4

    def unit(tf, df, dl):
        idf = math.log((4 - df + 0.5) / (df + 0.5))
        return (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))

    assert got == pytest.approx({0: unit(2, 2, 3), 1: unit(1, 2, 2), 3: unit(1, 1, 1)})


@pytest.fixture(scope="module")
def hits(spark):
    rows = [("q", f, n, s) for f, n, s in [("a", 0, 9.0), ("a", 1, 8.0), ("a", 2, 7.0), ("a", 3, 6.0), ("a", 4, 5.0), ("a", 5, 4.0), ("b", 0, 3.0)]]
    return spark.createDataFrame(rows, "query_id string, file_id string, chunk_no int, score double")


def test_overfetch_cuts_before_files_are_told_apart(hits):
    assert [r.file_id for r in search.top_files(hits, 2).orderBy("rank").collect()] == ["a", "b"]
    assert [r.file_id for r in search.top_files(hits, 2, overfetch=3).collect()] == ["a"]
    assert search.top_chunks(hits, 4).count() == 4


def test_tags_are_alternatives_and_do_not_repeat_hits(spark, hits):
    tags = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "file_id string, tag string")
    assert search.top_chunks(hits, 30, tags, ["x", "y"]).count() == 6
    assert [r.file_id for r in search.top_files(hits, 9, tags, ["z"]).collect()] == ["b"]


def test_rank_fusion(spark):
    def ranked(names):
        return spark.createDataFrame([("q", n, i) for i, n in enumerate(names, 1)], "query_id string, file_id string, rank int")

    got = {r.file_id: round(r.score, 6) for r in ranking.fuse_ranks(ranked("ABC"), ranked("BD")).collect()}
    assert got == {"B": 0.032522, "A": 0.016393, "D": 0.016129, "C": 0.015873}


def test_top_k_cuts_before_the_shuffle(hits, plan):
    text = plan(ranking.top_k(hits, 2))
    assert text.count("WindowGroupLimit") == 2


def test_json(spark):
    results = spark.createDataFrame(
        [("1", 2, "b", None, None, 1.0, ""), ("1", 1, "a", "T", ["x"], 2.5, "s")],
        "query_id string, rank int, path string, title string, tags array<string>, score double, snippet string",
    )
    queries = spark.createDataFrame([("1", "hi"), ("2", 'no "hits"')], "query_id string, text string")
    got = {r.query_id: r.json for r in output.as_json(results, queries).collect()}
    assert got["1"] == (
        '{"query":"hi","count":2,"results":[{"path":"a","title":"T","tags":"[\\"x\\"]","score":2.5,"snippet":"s"},'
        '{"path":"b","score":1.0}]}'
    )
    assert got["2"] == '{"query":"no \\"hits\\"","count":0,"results":null}'
    timed = output.as_json(results, queries, time_ms=1.5).filter("query_id = '2'").first().json
    assert timed == '{"query":"no \\"hits\\"","count":0,"time_ms":1.5,"results":null}'
    assert [r.path for r in output.paths_only(results).orderBy("rank").collect()] == ["a", "b"]
