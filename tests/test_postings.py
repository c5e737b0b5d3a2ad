"""Postings against plain Python; tokens of a chunk are not sorted as structs inside its row."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from passagework.functions import text as X
from passagework.operators import postings
from passagework.plans.corpus import scan_corpus
from passagework.workload import spark_queries

TEXTS = ["b a b", "", "a", None, "x y x y x", "--", "É e é", "a" * 50]


def rows_of(frame):
    return sorted(((r.term, r.file_id, r.chunk_no, r.dl, r.tf, list(r.positions)) for r in frame.collect()), key=repr)


def wanted(rows, tokens):
    out = []
    for file_id, chunk_no, text in rows:
        places = defaultdict(list)
        cut = tokens(text or "")
        for i, token in enumerate(cut):
            places[token].append(i)
        out += [(t, file_id, chunk_no, len(cut), len(p), p) for t, p in places.items()]
    return sorted(out, key=repr)


def words(text):
    return re.findall(r"\w+", text.lower().replace("é", "e"))


def grams(text):
    return [text.lower()[i : i + 3] for i in range(len(text) - 2)]


@pytest.mark.parametrize("most", [1, 3, 1 << 20])
def test_postings(spark, monkeypatch, most):
    rows = [(i, i % 2, t) for i, t in enumerate(TEXTS * 3)] + [(0, 0, "b"), (None, 0, "b a")]
    chunks = spark.createDataFrame(rows, "file_id long, chunk_no int, content string").coalesce(2)
    assert rows_of(postings.word_postings(chunks)) == wanted(rows, words)
    assert rows_of(postings.gram_postings(chunks)) == wanted(rows, grams)
    # The same with few tokens at once, in this process.
    monkeypatch.setattr(postings, "GROUPED", most)
    batches = postings._tokenised(chunks, postings.words_of).toArrow().to_batches(max_chunksize=5)
    found = [r for b in postings._group(batches) for r in b.to_pylist()]
    assert sorted(((r["term"], r["file_id"], r["chunk_no"], r["dl"], r["tf"], r["positions"]) for r in found), key=repr) == wanted(rows, words)


def test_no_sort_of_structs(spark, plan):
    chunks = spark.createDataFrame([(1, 0, "a b")], "file_id long, chunk_no int, content string")
    assert "sort_array" not in plan(postings.gram_postings(chunks))


def test_digests_are_made_below_the_join(spark):
    """Texts of a stored index do not meet the shuffle of the join with their paths."""
    rows = [(1, "a", "x y"), (2, "b", "z"), (2, "b", "z"), (None, "c", "z")]
    corpus = scan_corpus(spark.createDataFrame(rows, "file_id long, path string, content string"))
    found = spark_queries._stored_chunks(corpus)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("md5")
    digest = lambda text: hashlib.md5(text.encode()).hexdigest()
    assert sorted(map(tuple, found.collect())) == sorted([("a", 0, digest("x y")), *[("b", 0, digest("z"))] * 4])


def test_rows_of_a_word_follow_each_other(spark):
    rows = [(i, i % 2, t) for i, t in enumerate(TEXTS * 3)] + [(0, 0, "b"), (None, 0, "b a")]
    chunks = spark.createDataFrame(rows, "file_id long, chunk_no int, content string").coalesce(1)
    found = postings.word_postings(chunks, by_term=True)
    assert rows_of(found) == wanted(rows, words)
    terms = [r.term for r in found.collect()]
    assert sum(a != b for a, b in zip(terms, terms[1:])) == len(set(terms)) - 1


def test_lists_of_words(spark, monkeypatch):
    """Words leave a task once for many chunks, folded after they are told apart, and are the same postings."""
    odd = ["áb ́ ́a", "İİ ẞß", "x̲y Ⓐ Ⅰ", " ́ ", "Été ete ETÉ"]
    rows = [(i, i % 2, t) for i, t in enumerate([*TEXTS, *odd] * 30)] + [(0, 0, "b"), (0, 0, "b"), (None, 0, "b a")]
    chunks = spark.createDataFrame(rows, "file_id long, chunk_no int, content string").coalesce(2)
    want = rows_of(postings.word_postings(chunks))
    lists = postings.word_lists(chunks)
    assert rows_of(postings.postings_of(lists)) == want
    assert lists.count() < len(want) / 10
    assert rows_of(postings.postings_of(postings.lists_of(postings.word_postings(chunks)))) == want
    stats = lambda frame: sorted((r.term, r.df, r.cf) for r in frame.collect())
    assert stats(postings.list_stats(lists)) == stats(postings.term_stats(postings.word_postings(chunks)))
    lengths = postings.with_lengths(chunks).select("n_words", "content").collect()
    assert [r.n_words for r in lengths] == [None if r.content is None else len(words_cut(spark, r.content)) for r in lengths]
    # Few words at once.
    monkeypatch.setattr(postings, "LISTED", 3)
    assert rows_of(postings.postings_of(postings.word_lists(chunks))) == want


def words_cut(spark, text, known={}):
    if text not in known:
        frame = spark.createDataFrame([(text,)], "t string")
        known[text] = frame.select(X.word_tokens(F.col("t"))).first()[0]
    return known[text]
