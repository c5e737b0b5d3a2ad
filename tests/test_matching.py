import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from passagework.operators import clauses as C, joins, matching
from passagework.plans import corpus as corpora, search
from passagework.plans.corpus import scan_corpus


def corpus_of(spark, texts):
    """One chunk per text; the file id is its number."""
    rows = [(i, f"{i}.md", None, None, t) for i, t in enumerate(texts, 1)]
    return scan_corpus(spark.createDataFrame(rows, "file_id long, path string, title string, tags array<string>, content string"))


def ids(frame, query=None):
    return sorted(r.file_id for r in frame.collect() if query is None or r.query_id == query)


FORMS = {
    "term": [[C.term("alpha")]],
    "and": [[C.term("alpha"), C.term("beta")]],
    "or": [[C.term("alpha")], [C.term("gamma")]],
    "not": [[C.term("alpha"), C.without(C.term("gamma"))]],
    "phrase": [[C.phrase("alpha beta")]],
    "prefix": [[C.prefix("alpha*")]],
    "only not": [[C.without(C.term("alpha"))]],
    "nothing": [[C.term("--")]],
}
EXPECTED = {"term": [1, 2], "and": [1, 2], "or": [1, 2, 4], "not": [2], "phrase": [1], "prefix": [1, 2, 3], "only not": [], "nothing": []}


@pytest.fixture(scope="module")
def small(spark):
    return corpus_of(spark, ["alpha beta gamma", "beta alpha", "alphabet soup", "gamma"])


def test_clause_forms(spark, small):
    hits = search.word_matches(small, C.clause_table(spark, FORMS))
    assert {q: ids(hits, q) for q in FORMS} == EXPECTED


def test_trigram(spark, small):
    assert ids(search.gram_matches(small, C.all_of(spark, {"q": "PHA"}))) == [1, 2, 3]
    assert ids(search.gram_matches(small, C.all_of(spark, {"q": "alpha g"}))) == [1]
    assert ids(search.gram_matches(small, C.all_of(spark, {"q": "al"}))) == []


def test_script_routing(spark):
    corpus = corpus_of(spark, ["認証 Guard の設計", "この提案はウォークスルーで確認", "guard rails only", "認証の仕組み"])
    queries = {"guard": "Guard", "short": "提案", "long": "ウォークスルー", "mixed": "認証 Guard"}
    hits = search.routed_matches(corpus, C.all_of(spark, queries)).cache()
    best = search.best_branch(hits)
    assert ids(best, "guard") == [1, 3]
    assert ids(best, "short") == [2]
    assert ids(best, "long") == [2]
    assert ids(best, "mixed") == [1]
    branches = {q: {r.branch for r in hits.collect() if r.query_id == q} for q in queries}
    assert branches == {"guard": {"word"}, "short": {"substring"}, "long": {"gram"}, "mixed": {"word", "gram", "substring"}}


def test_substring_branch_takes_tokens_literally(spark):
    corpus = corpus_of(spark, ["100% ÄB", "1000 äb", "100% x OR y"])
    assert ids(search.substring_matches(corpus, C.all_of(spark, {"q": "100%"}))) == [1, 3]
    assert ids(search.substring_matches(corpus, C.all_of(spark, {"q": "Äb"}))) == [1]
    table = C.clause_table(spark, {"q": [[C.term("100%")], [C.term("äb")]]})
    hits = search.substring_matches(corpus, table).collect()
    assert sorted((r.file_id, r.score) for r in hits) == [(1, 0.01), (2, 0.01), (3, 0.01)]


@pytest.fixture
def no_broadcast(monkeypatch):
    """Every side counts as too large to broadcast or to keep as a constant."""
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(corpora, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(search, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(matching, "DIRECT_CLAUSES", 0)
    monkeypatch.setattr(joins, "SALTS", 3)


def test_salted_joins_give_the_same_hits(spark, small, no_broadcast, plan):
    hits = search.word_matches(small, C.clause_table(spark, FORMS))
    assert {q: ids(hits, q) for q in FORMS} == EXPECTED
    assert ids(search.gram_matches(small, C.all_of(spark, {"q": "PHA"}))) == [1, 2, 3]
    assert ids(search.gram_matches(small, C.all_of(spark, {"q": "alpha g"}))) == [1]
    assert ids(search.substring_matches(small, C.all_of(spark, {"q": "et so"}))) == [3]


def test_gram_batches_within_the_broadcast_bound(spark, small, monkeypatch):
    monkeypatch.setattr(matching, "DIRECT_CLAUSES", 0)
    assert ids(search.gram_matches(small, C.all_of(spark, {"q": "PHA"}))) == [1, 2, 3]
    assert ids(search.gram_matches(small, C.all_of(spark, {"q": "alpha g"}))) == [1]
    assert ids(search.substring_matches(small, C.all_of(spark, {"q": "et so"}))) == [3]


def test_salt_spreads_a_hot_word(spark, no_broadcast):
    corpus = corpus_of(spark, ["the"] * 300 + ["rare the"])
    table = C.all_of(spark, {"a": "the", "b": "rare"})
    hits = search.word_matches(corpus, table)
    assert len(ids(hits, "a")) == 301 and ids(hits, "b") == [301]
    top = search.with_files(search.with_snippets(search.top_files(hits, 2), corpus, table, 4), corpus.files, 4)
    assert {r.query_id: r.snippet for r in top.filter("query_id = 'b'").collect()} == {"b": ">>>rare<<< the"}
    assert top.count() == 3


WORDS = st.lists(st.sampled_from(["a", "b", "ab", "aa", "ba"]), max_size=12).map(" ".join)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(WORDS, min_size=1, max_size=6), phrase=st.lists(st.sampled_from(["a", "b", "ab"]), min_size=1, max_size=3))
def test_phrases_against_brute_force(spark, texts, phrase):
    corpus = corpus_of(spark, texts)
    text = " ".join(phrase)
    table = C.clause_table(spark, {"p": [[C.phrase(text)]], "x": [[C.prefix("a")]], "g": [[C.term("a")]]})
    hits = {(r.query_id, r.file_id): r.tf for r in matching.word_hits(corpus, table).collect()}
    want = {}
    for i, t in enumerate(texts, 1):
        words = t.split()
        n = sum(words[at:at + len(phrase)] == phrase for at in range(len(words) - len(phrase) + 1))
        starts = sum(w.startswith("a") for w in words)
        exact = words.count("a")
        want.update({k: v for k, v in {("p", i): n, ("x", i): starts, ("g", i): exact}.items() if v})
    assert hits == want
    grams = {(r.query_id, r.file_id): r.tf for r in matching.gram_hits(corpus, C.clause_table(spark, {"p": [[C.phrase(text)]]})).collect()}
    if len(text) >= 3:
        assert grams == {
            ("p", i): n for i, t in enumerate(texts, 1)
            if (n := sum(t.startswith(text, at) for at in range(len(t)))) and t.strip()
        }


def test_query_batches_from_a_frame(spark, small):
    texts = spark.createDataFrame([(1, "Alpha, beta"), (2, "soup gamma"), (3, "")], "query_id long, text string")
    every = C.from_texts(texts, "all", bag_of_words=True)
    some = C.from_texts(texts, "any", bag_of_words=True)
    assert every.rows == some.rows == 4 and every.one_group and not some.one_group
    assert {q: ids(search.word_matches(small, every), q) for q in "123"} == {"1": [1, 2], "2": [], "3": []}
    assert {q: ids(search.word_matches(small, some), q) for q in "123"} == {"1": [1, 2], "2": [1, 3, 4], "3": []}


def test_word_search_stays_in_the_jvm(spark, small, plan):
    table = C.clause_table(spark, FORMS)
    for hits in (search.routed_matches(small, table), search.top_files(search.word_matches(small, table), 3)):
        text = plan(hits)
        assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "WindowGroupLimit" in plan(search.top_files(search.word_matches(small, table), 3))


def test_one_word_tables_need_no_position_lists(spark, small, plan):
    assert "collect_list" not in plan(matching.word_hits(small, C.all_of(spark, {"q": "alpha beta"})))
    assert "collect_list" in plan(matching.word_hits(small, C.clause_table(spark, {"q": [[C.phrase("alpha beta")]]})))
