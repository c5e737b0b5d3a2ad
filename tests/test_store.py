import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from passagework.operators import clauses as C, matching, postings
from passagework.plans import incremental, search, store as stores
from passagework.plans.corpus import scan_corpus
from passagework.sources.listing import describe, list_files, read_texts, text_files, unread_files

STAMP = datetime(2024, 1, 1)
LISTED = "path string, size_bytes long, modified timestamp, content string"


def listed(spark, entries):
    rows = [(p, len(t), datetime(2024, 1, day), t) for p, (day, t) in entries.items()]
    return describe(spark.createDataFrame(rows, LISTED), STAMP)


FIRST = {"a.md": (1, "alpha beta"), "b.md": (1, "beta gamma alpha alpha"), "c.md": (1, "gamma delta"), "x.png": (1, "alpha")}
SECOND = {"a.md": (1, "alpha beta"), "b.md": (2, "epsilon"), "d.md": (1, "alpha zeta")}
FORMS = {
    "term": [[C.term("alpha")]], "phrase": [[C.phrase("gamma alpha")]], "prefix": [[C.prefix("gam"), C.without(C.term("delta"))]],
    "two": [[C.term("alpha")], [C.term("epsilon")]],
}


def found(frame):
    return sorted((r.query_id, r.file_id, r.chunk_no, round(r.score, 9)) for r in frame.collect())


@pytest.fixture
def place(tmp_path):
    return stores.Store(str(tmp_path / "index"), buckets=4)


def test_stored_equals_scanned(spark, place, plan):
    files = listed(spark, FIRST)
    stores.write_batch(place, files)
    stored, scanned = stores.open_corpus(place, spark), scan_corpus(text_files(files))
    table = C.clause_table(spark, FORMS)
    assert found(search.word_matches(stored, table)) == found(search.word_matches(scanned, table)) != []
    for text in ("alph", "ma alpha", "LPHA be"):
        one = C.clause_table(spark, {"g": [[C.phrase(text)]], "w": [[C.term("eta"), C.term("a")]]})
        assert found(search.gram_matches(stored, one)) == found(search.gram_matches(scanned, one)) != []
    text = plan(matching.word_hits(stored, C.all_of(spark, {"q": "alpha"})))
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line and "term" in line)
    assert "isnotnull(bucket" in scan.split("PartitionFilters")[1] and "positions" not in scan.split("ReadSchema")[1]
    assert stored.files.count() == 4 and stored.chunks.count() == 3


def test_texts_of_results_are_read_from_their_segments(spark, place, plan):
    stores.write_batch(place, listed(spark, FIRST).repartition(3, "path"))
    corpus = stores.open_corpus(place, spark)
    table = C.all_of(spark, {"q": "gamma"})
    top = search.with_content(search.top_chunks(search.word_matches(corpus, table), 2), corpus, 2)
    assert sorted(r.content for r in top.collect()) == ["beta gamma alpha alpha", "gamma delta"]
    scan = next(line for line in plan(top).splitlines() if "FileScan parquet" in line and "content" in line)
    assert "segment#" in scan.split("PartitionFilters")[1] and "EqualTo(file_id" in scan


def test_sizing(tmp_path):
    assert stores.Store.sized("x", 1).buckets == stores.BUCKETS
    assert stores.Store.sized("x", 100 * 1024**4).buckets == 6400


def test_update_equals_rebuild(spark, place, tmp_path):
    stores.write_batch(place, listed(spark, FIRST), 0)
    changes = stores.update(place, listed(spark, SECOND), 1)
    assert {r.path: r.change for r in incremental.change_set(listed(spark, FIRST), listed(spark, SECOND)).collect()} == {
        "a.md": "same", "b.md": "changed", "c.md": "deleted", "d.md": "new", "x.png": "deleted",
    }
    assert changes.count() == 5
    rebuilt = stores.Store(str(tmp_path / "rebuilt"), buckets=4)
    stores.write_batch(rebuilt, listed(spark, SECOND))
    table = C.clause_table(spark, FORMS)
    for _ in range(2):
        a, b = stores.open_corpus(place, spark), stores.open_corpus(rebuilt, spark)
        assert found(search.word_matches(a, table)) == found(search.word_matches(b, table))
        one = C.clause_table(spark, {"g": [[C.phrase("lpha")]]})
        assert found(search.gram_matches(a, one)) == found(search.gram_matches(b, one))
        assert sorted(r.path for r in a.files.collect()) == ["a.md", "b.md", "d.md"]
        # A batch that runs again after a failure changes nothing.
        stores.update(place, listed(spark, SECOND), 1)
    # Files that come back.
    stores.update(place, listed(spark, FIRST), 2)
    fresh = stores.Store(str(tmp_path / "fresh"), buckets=4)
    stores.write_batch(fresh, listed(spark, FIRST))
    assert found(search.word_matches(stores.open_corpus(place, spark), table)) == found(
        search.word_matches(stores.open_corpus(fresh, spark), table)
    )


def test_deleting_everything(spark, place):
    stores.write_batch(place, listed(spark, FIRST), 0)
    nothing = listed(spark, FIRST).filter("false")
    stores.update(place, nothing, 1)
    corpus = stores.open_corpus(place, spark)
    assert corpus.files.count() == 0 and corpus.chunks.count() == 0
    assert found(search.word_matches(corpus, C.all_of(spark, {"q": "alpha"}))) == []


def test_meta_only_and_meta_values(spark, place):
    stores.write_batch(place, listed(spark, FIRST), meta_only=True)
    assert stores.live_files(place, spark).count() == 4
    stores.set_meta(place, spark, "last_indexed_at", "old", datetime(2024, 1, 1))
    stores.set_last_indexed(place, spark, datetime(2024, 1, 2))
    assert [tuple(r) for r in stores.get_meta(place, spark).collect()] == [("last_indexed_at", "2024-01-02T00:00:00")]


def test_changes_applied_to_any_frame(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 2), ("d", 3)], "path string, v int")
    changes = spark.createDataFrame([("a", "same"), ("b", "changed"), ("c", "deleted"), ("d", "new")], "path string, change string")
    got = incremental.apply_changes(old, changes, new)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1), ("b", 2), ("d", 3)]


def test_folder_listing(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.MD").write_bytes(b"---\ntitle: T\n---\nx\xff")
    (tmp_path / "d" / "e" / "b.txt").write_text("hello\n")
    os.utime(tmp_path / "d" / "a.MD", (1700000000, 1700000000))
    rows = list_files(spark, str(tmp_path))
    got = {os.path.basename(r.path): r for r in rows.collect()}
    assert got["a.MD"].size_bytes == 19 and got["b.txt"].size_bytes == 6
    texts = read_texts(spark, str(tmp_path))
    assert unread_files(rows, texts).count() == 0
    described = {r.filename: r for r in describe(texts, STAMP).collect()}
    assert (described["a.MD"].title, described["a.MD"].extension, described["a.MD"].lang) == ("T", ".md", "Markdown")
    assert described["a.MD"].content.endswith("x�")
    assert "content" not in rows._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def state(store, spark):
    corpus = stores.open_corpus(store, spark)
    table, one = C.clause_table(spark, FORMS), C.clause_table(spark, {"g": [[C.phrase("lpha")]], "s": [[C.term("et")]]})
    return (
        sorted(r.path for r in corpus.files.collect()), sorted((r.file_id, r.chunk_no, r.content) for r in corpus.chunks.collect()),
        found(search.word_matches(corpus, table)), found(search.gram_matches(corpus, one)), found(search.substring_matches(corpus, one)),
        tuple(corpus.stats.first()), tuple(postings.corpus_stats(corpus.chunks).first()),
    )


class Broken:
    """Lets so many writes of an attempt pass, then breaks one after it wrote."""

    def __init__(self, monkeypatch, passing):
        self.left, original = passing, stores.Attempt.write

        def write(attempt, frame, table, *partitions):
            original(attempt, frame, table, *partitions)
            if not self.left:
                raise OSError("lost")
            self.left -= 1

        def commit(*_):
            raise OSError("lost before the commit")

        monkeypatch.setattr(stores.Attempt, "write", write)
        monkeypatch.setattr(stores.Attempt, "commit", commit)


TABLES = ["changes", "chunks", "words", "vocabulary", "grams", "gram_vocabulary", "gram_parts", "files", "places", "marks"]


def stored(store, spark):
    """What a reader sees of every table, without a search."""
    corpus = stores.open_corpus(store, spark)
    terms = lambda rows: sorted((r.term, r.file_id) for r in corpus.alive(rows.select("term", "file_id", "batch")).collect())
    return (
        sorted(r.path for r in corpus.files.collect()), sorted((r.file_id, r.content) for r in corpus.chunks.collect()),
        tuple(corpus.stats.first()), terms(corpus.words), terms(corpus.grams),
    )


def test_a_broken_run_loses_nothing(spark, place, tmp_path, monkeypatch):
    """An update breaks after some writes in its first run, and after every single one when its complete batch runs again."""
    stores.write_batch(place, listed(spark, FIRST), 0)
    before = stored(place, spark)

    def breaks(passing, entries):
        with monkeypatch.context() as patch, pytest.raises(OSError):
            Broken(patch, passing)
            stores.update(place, listed(spark, entries), 1)
        assert stored(place, spark) == before

    for passing in (0, 1, 7, len(TABLES)):
        breaks(passing, SECOND)
    stores.update(place, listed(spark, SECOND), 1)
    before = stored(place, spark)
    for passing in range(len(TABLES) + 1):
        breaks(passing, {**SECOND, "e.md": (1, "eta")})
    stores.update(place, listed(spark, SECOND), 1)
    assert stores.complete_batches(place, spark) == [0, 1]
    fresh = stores.Store(str(tmp_path / "fresh"), buckets=4)
    stores.write_batch(fresh, listed(spark, SECOND))
    rebuilt = stores.rebuild(place, str(tmp_path / "rebuilt"), spark)
    want = state(fresh, spark)
    assert state(place, spark) == want and state(rebuilt, spark) == want
    with pytest.raises(ValueError):
        stores.rebuild(place, str(tmp_path / "rebuilt"), spark)


def test_batches_go_on_and_do_not_overwrite(spark, place):
    assert [stores.write_batch(place, listed(spark, {k: v})) for k, v in FIRST.items()] == [0, 1, 2, 3]
    assert sorted(r.path for r in stores.live_files(place, spark).collect()) == sorted(FIRST)
    with pytest.raises(ValueError):
        stores.write_batch(place, listed(spark, SECOND), 1)


def test_statistics_are_sums_over_commits(spark, place, plan):
    """No table is read for them, whatever was replaced, deleted and brought back."""
    for entries in (FIRST, SECOND, {}, FIRST):
        stores.update(place, listed(spark, entries or FIRST).filter("true" if entries else "false"))
        corpus = stores.open_corpus(place, spark)
        assert tuple(corpus.stats.first()) == tuple(postings.corpus_stats(corpus.chunks).first())
        assert "FileScan" not in plan(corpus.stats)


@pytest.mark.parametrize("batches", [1, 2])
def test_a_word_search_reads_no_chunks(spark, place, plan, batches):
    for entries in (FIRST, SECOND)[:batches]:
        stores.update(place, listed(spark, entries))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(search.word_matches(stores.open_corpus(place, spark), C.all_of(spark, {"q": "alpha"})))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [line for line in text.splitlines() if "FileScan parquet" in line]
    assert scans and not any("content" in s or "/files/" in s or "/chunks/" in s for s in scans)


def scanned_rows(frame, column):
    """Rows that the scans holding a column gave when the frame was collected."""
    frame.collect()
    rows, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if "FileSourceScan" in name and column in node.output().mkString(","):
            rows += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """4,000 files in several segments, with row groups of some hundred rows."""
    store = stores.Store(str(tmp_path_factory.mktemp("large") / "index"), buckets=4, group_bytes=4096)
    names = spark.range(4000).selectExpr(
        "concat('f', id, '.md') as path", "100L as size_bytes", "timestamp '2024-01-01' as modified",
        "concat('common text number ', id, if(id % 400 = 7, ' rare認認word 提案', ''), ' ', md5(string(id))) as content",
    )
    stores.write_batch(store, describe(names.repartition(8), STAMP))
    return store


def test_results_read_few_row_groups(spark, large):
    corpus = stores.open_corpus(large, spark)
    table = C.all_of(spark, {"q": "common"})
    top = search.with_content(search.top_chunks(search.word_matches(corpus, table), 10), corpus, 10)
    assert len(top.collect()) == 10
    # Ten files lie in ten row groups at most; a group has some hundred rows here.
    assert 10 <= scanned_rows(top, "content") <= 10 * 200


@pytest.mark.parametrize("text, chunks", [("rare認認word", 10), ("認認", 10), ("提案", 10), ("認", 10), ("認認 提案 number", 10), ("認証", 0)])
def test_parts_are_found_on_the_index(spark, large, monkeypatch, text, chunks):
    """Grams and short parts: texts are read for candidates alone."""
    read = []
    original = matching.attach_texts
    monkeypatch.setattr(matching, "attach_texts", lambda rows, *rest: read.append(original(rows, *rest)) or read[-1])
    corpus = stores.open_corpus(large, spark)
    hits = search.substring_matches(corpus, C.all_of(spark, {"q": text}))
    assert hits.count() == chunks
    assert [scanned_rows(r, "content") <= 10 * 200 for r in read] == [True]
    assert [r.count() for r in read] == [chunks]


def test_plain_words_read_no_grams(spark, large, plan):
    corpus = stores.open_corpus(large, spark)
    scans = [s for s in plan(search.routed_matches(corpus, C.all_of(spark, {"q": "common text"}))).splitlines() if "FileScan" in s]
    assert scans and not any("/grams" in s or "content" in s or "gram_" in s for s in scans)


def test_a_prefix_reads_its_range_of_the_dictionary_once(spark, large, monkeypatch):
    corpus = stores.open_corpus(large, spark)
    table = C.clause_table(spark, {"q": [[C.prefix("rar"), C.prefix("commo")]]})
    assert search.word_matches(corpus, table).count() == 10
    text = corpus.vocabulary.filter(F.col("term").startswith("rar"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith" in text
    found, rows = matching.expand_prefixes(corpus.vocabulary, matching._word_units(table).filter("is_prefix"), table.rows)
    assert rows == 2 and "FileScan" not in found._jdf.queryExecution().executedPlan().toString()


def test_sigma_is_sought_in_the_texts(spark, place):
    stores.write_batch(place, listed(spark, {"a.md": (1, "認ΑΣΑ 認"), "b.md": (1, "認ΑΣ")}))
    corpus, table = stores.open_corpus(place, spark), C.all_of(spark, {"q": "認ΑΣ"})
    assert search.substring_matches(corpus, table).count() == 2


def test_short_texts_are_found_by_their_parts(spark, place):
    entries = {"a.md": (1, "提"), "b.md": (1, "提案"), "c.md": (1, "案提案"), "d.md": (1, "案")}
    stores.write_batch(place, listed(spark, entries))
    corpus, scanned = stores.open_corpus(place, spark), scan_corpus(listed(spark, entries))
    table = C.all_of(spark, {"one": "提", "two": "提案", "both": "提 案"})
    assert found(search.substring_matches(corpus, table)) == found(search.substring_matches(scanned, table)) != []


def test_unread_files_are_counted_and_due_again(spark, place):
    names = listed(spark, FIRST).drop("content")
    stores.update(place, listed(spark, FIRST).filter("path <> 'b.md'"), names=names)
    assert [c.n_unread for c in stores.commits(place, spark)] == [1]
    changes = stores.update(place, listed(spark, FIRST), names=names)
    assert {r.path: r.change for r in changes.collect()} == {"a.md": "same", "b.md": "new", "c.md": "same", "x.png": "same"}
    # Unread files keep what is stored of them.
    stores.update(place, listed(spark, SECOND).filter("path = 'd.md'"), names=listed(spark, {**FIRST, "b.md": (2, "later"), "d.md": (1, "alpha")}))
    assert sorted(r.path for r in stores.live_files(place, spark).collect()) == sorted([*FIRST, "d.md"])
    assert [c.n_unread for c in stores.commits(place, spark)] == [1, 0, 1]


def test_files_without_a_time_are_taken(spark, place):
    stores.write_batch(place, listed(spark, FIRST), 0)
    new = listed(spark, {**FIRST, "n.md": (1, "new words"), "m.md": (2, "more words")})
    for gone in (["n.md"], ["n.md", "m.md"]):
        rows = new.withColumn("modified", F.when(~F.col("path").isin(gone), F.col("modified")))
        stores.update(place, rows, 1)
        assert {r.path for r in stores.live_files(place, spark).collect()} == {*FIRST, "n.md", "m.md"}
        assert stores.open_corpus(place, spark).chunks.count() == 5


def test_long_files_are_indexed(spark, place):
    text = "word " * 200_000
    stores.write_batch(place, listed(spark, {"long.md": (1, text)}))
    assert stores.open_corpus(place, spark).chunks.count() == 1


def test_words_are_stored_as_lists(spark, tmp_path, plan, monkeypatch):
    """One row holds the postings of many chunks, and a search deals out those of its own words only."""
    place = stores.Store(str(tmp_path / "lists"), buckets=2, with_grams=False)
    stores.write_batch(place, listed(spark, {f"{i}.md": (1, "alpha beta gamma alpha") for i in range(300)}).coalesce(1))
    corpus = stores.open_corpus(place, spark)
    assert corpus.words.count() == 900 and spark.read.parquet(f"{place.folder}/word_lists").count() < 90
    text = plan(matching.word_hits(corpus, C.clause_table(spark, {"q": [[C.phrase("alpha beta")], [C.prefix("gam")]]})))
    scans = [line for line in text.splitlines() if "FileScan parquet" in line and "ends" in line]
    # Places are read of phrases only.
    assert {"positions#" in scan for scan in scans} == {False, True}
    assert " = gamma)" in text and " = alpha)" in text
    rows = matching.word_hits(corpus, C.clause_table(spark, {"q": [[C.phrase("gamma alpha")], [C.prefix("al")]]})).collect()
    assert sorted((r.group_no, r.tf, r.dl) for r in rows) == [(0, 1, 4)] * 300 + [(1, 2, 4)] * 300
    # More words than a scan lists are joined with the lists, not with what is dealt out of them.
    monkeypatch.setattr(matching, "LISTED_TERMS", 0)
    table = C.all_of(spark, {"q": "gamma"})
    text = plan(matching.bag_postings(corpus, table, matching.bags.bag_of(table)))
    assert text.index("Generate posexplode") < text.index("LeftSemi")
    assert found(search.word_matches(corpus, table)) != []
