"""A batch of one-word clauses gives what the hits of each clause give, without a row for each."""

import os
import random
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import Row, functions as F

from passagework.operators import bags, banded, clauses as C, matching, postings, ranking, semantic
from passagework.plans import search
from passagework.plans.corpus import scan_corpus
from passagework.plans.store import Store, open_corpus, write_batch
from passagework.sources import listing

WORDS = [f"w{i}" for i in range(9)]


def clause_hits(corpus, table):
    hits = ranking.score_hits(matching.word_hits(corpus, table), corpus.stats, "avg_words", table.rows)
    return rows_of(matching.combine(hits, table.one_group))


def rows_of(frame):
    return sorted(
        ((r.query_id, r.file_id, r.chunk_no, round(r.score, 9)) for r in frame.collect()), key=repr
    )


def texts(seed, n=60):
    dice = random.Random(seed)
    return ["\n".join(" ".join(dice.choices(WORDS, k=3)) for _ in range(dice.randrange(70))) for _ in range(n)]


def corpus_of(spark, rows):
    return scan_corpus(spark.createDataFrame([(i, f"{i}.md", t) for i, t in rows], "file_id long, path string, content string"))


def table_of(spark, seed):
    dice = random.Random(seed)
    clause = lambda: C.term(dice.choice(WORDS)) if dice.random() < 0.7 else C.without(C.term(dice.choice(WORDS)))
    return C.clause_table(spark, {
        f"q{q}": [[clause() for _ in range(dice.randrange(1, 4))] for _ in range(dice.randrange(1, 4))] for q in range(12)
    })


@pytest.mark.parametrize("seed", range(3))
def test_scanned(spark, seed):
    rows = list(enumerate(texts(seed)))
    # Ids that come twice, with the same and with another text, and a null one.
    rows += rows[:5] + [(i, rows[i + 1][1]) for i in range(10, 15)] + [(None, rows[0][1])]
    corpus, table = corpus_of(spark, rows), table_of(spark, seed)
    assert bags.bag_of(table) is not None
    want = clause_hits(corpus, table)
    assert want
    assert rows_of(search.word_matches(corpus, table)) == want
    met = matching.word_chunks(corpus, table).collect()
    assert sorted((r.query_id, r.file_id, r.chunk_no) for r in met if r.file_id is not None) == sorted(w[:3] for w in want if w[1] is not None)


def test_stored(spark, tmp_path):
    frame = spark.createDataFrame([(f"{i}.md", t) for i, t in enumerate(texts(7))], "path string, content string")
    frame = frame.withColumns({"size_bytes": F.octet_length("content").cast("long"), "modified": F.to_timestamp(F.lit("2024-01-01"))})
    place = Store(str(tmp_path / "index"), with_grams=False)
    write_batch(place, listing.describe(frame, F.to_timestamp(F.lit("2024-01-02"))), all_files=True)
    corpus, table = open_corpus(place, spark), table_of(spark, 7)
    want = clause_hits(corpus, table)
    assert want and rows_of(search.word_matches(corpus, table)) == want


def test_repeated_clause_keys_take_the_general_way(spark):
    asked = spark.createDataFrame([("a", "w1 w2"), ("a", "w1 w3")], "query_id string, text string")
    table = C.from_texts(asked, "any", bag_of_words=True)
    assert bags.bag_of(table) is None
    corpus = corpus_of(spark, list(enumerate(texts(1))))
    assert rows_of(search.word_matches(corpus, table)) == clause_hits(corpus, table)


def test_chunk_over_many_batches(spark):
    """A chunk whose postings come in several Arrow batches is one chunk."""
    corpus, table = corpus_of(spark, list(enumerate(texts(2)))), table_of(spark, 2)
    want = rows_of(search.word_matches(corpus, table))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        assert rows_of(search.word_matches(corpus, table)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_shuffle_of_clause_hits(spark, plan):
    """Words of a batch are shuffled by file; a shuffle by query and chunk would hold a row for every clause hit."""
    corpus = corpus_of(spark, list(enumerate(texts(3))))
    asked = spark.createDataFrame([(str(i), " ".join(WORDS)) for i in range(5)], "query_id string, text string")
    for match in ("any", "all"):
        table = C.from_texts(asked, match, bag_of_words=True)
        for found in (search.word_matches(corpus, table), matching.word_chunks(corpus, table)):
            assert "hashpartitioning(query_id" not in plan(found)


@pytest.mark.parametrize("made", [
    lambda: bags._in_runs(bags.Bag([Row(query_id="a", group_no=0, kind="must", term="w")])), lambda: postings._group,
    lambda: banded._keys(3, 2), lambda: banded._bucket_best(5, 0.8), lambda: semantic.hashing_embedder(),
])
def test_tasks_need_no_installed_package(tmp_path, made):
    """What is sent to tasks can be read where this package is not installed."""
    (tmp_path / "sent").write_bytes(cloudpickle.dumps(made()))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import sys; from pyspark import cloudpickle; cloudpickle.loads(open('sent', 'rb').read()); assert 'passagework' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_a_search_is_run_once_for_its_texts(spark, plan):
    corpus, table = corpus_of(spark, list(enumerate(texts(4)))), table_of(spark, 4)
    top = search.top_chunks(search.word_matches(corpus, table), 3)
    found = search.with_content(top, corpus, search.result_rows(table, 3))
    assert "MapInArrow" in plan(top) and "MapInArrow" not in plan(found)
    contents = {(r.file_id, r.chunk_no): r.content for r in corpus.chunks.collect()}
    want = [(*r, contents[r.file_id, r.chunk_no]) for r in top.collect()]
    assert want and sorted(tuple(r) for r in found.select(*top.columns, "content").collect()) == sorted(want)
