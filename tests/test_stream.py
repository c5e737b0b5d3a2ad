import os
import time
from datetime import datetime

import pytest

from passagework.plans import store as stores
from passagework.sources.listing import describe, read_texts
from passagework.streaming import watch as streams


def put(root, name, text, at):
    (root / name).write_text(text)
    os.utime(root / name, (at, at))


def texts(spark, place):
    corpus = stores.open_corpus(place, spark)
    rows = corpus.chunks.join(corpus.files.select("file_id", "filename"), "file_id").collect()
    return {r.filename: r.content for r in rows}


def test_new_files_become_batches(spark, tmp_path):
    root, place = tmp_path / "in", stores.Store(str(tmp_path / "index"), buckets=4, with_grams=False)
    root.mkdir()

    def run():
        streams.watch(streams.folder_stream(spark, str(root), 1), place, str(tmp_path / "progress")).awaitTermination()
        return texts(spark, place)

    put(root, "a.md", "one", 1_700_000_000)
    put(root, "b.md", "two", 1_700_000_100)
    assert run() == {"a.md": "one", "b.md": "two"}
    put(root, "c.png", "no text", 1_700_000_200)
    put(root, "d.md", "three", 1_700_000_300)
    assert run() == {"a.md": "one", "b.md": "two", "d.md": "three"}
    assert run() == {"a.md": "one", "b.md": "two", "d.md": "three"}
    assert stores.live_files(place, spark).count() == 4


def test_refresh_sees_changes_and_deletions(spark, tmp_path):
    root, place = tmp_path / "in", stores.Store(str(tmp_path / "index"), buckets=4, with_grams=False)
    root.mkdir()
    put(root, "a.md", "one", 1_700_000_000)
    put(root, "b.md", "two", 1_700_000_100)
    stores.write_batch(place, describe(read_texts(spark, str(root)), datetime(2024, 1, 1)))
    assert streams.refresh(spark, str(root), place, 1) is False
    put(root, "a.md", "one more", 1_600_000_000)
    (root / "b.md").unlink()
    put(root, "c.md", "three", 1_700_000_200)
    assert streams.refresh(spark, str(root), place, 1) is True
    assert texts(spark, place) == {"a.md": "one more", "c.md": "three"}
    assert streams.refresh(spark, str(root), place, 1) is True
    assert texts(spark, place) == {"a.md": "one more", "c.md": "three"}
    assert streams.refresh(spark, str(root), place, 2) is False


def test_watch_folder(spark, tmp_path):
    root, place = tmp_path / "in", stores.Store(str(tmp_path / "index"), buckets=4, with_grams=False)
    root.mkdir()
    put(root, "a.md", "one", 1_700_000_000)
    stores.write_batch(place, describe(read_texts(spark, str(root)), datetime(2024, 1, 1)))
    put(root, "b.md", "two", 1_700_000_100)
    query = streams.watch_folder(spark, str(root), place, str(tmp_path / "progress"), "1 second")
    try:
        end = time.time() + 60
        while time.time() < end and not query.lastProgress:
            time.sleep(0.5)
    finally:
        query.stop()
    assert texts(spark, place) == {"a.md": "one", "b.md": "two"}


def test_last_version_wins_within_a_batch(spark):
    rows = spark.createDataFrame(
        [("a", datetime(2024, 1, 1), 1, "old"), ("a", datetime(2024, 1, 2), 1, "new"), ("b", datetime(2024, 1, 1), 1, "b")],
        "path string, modified timestamp, size_bytes long, content string",
    )
    assert sorted(r.content for r in streams.last_versions(rows).collect()) == ["b", "new"]


def test_a_late_older_version_loses(spark):
    stored = spark.createDataFrame([("a", datetime(2024, 1, 2)), ("c", None)], "path string, modified timestamp")
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 1)), ("c", datetime(2024, 1, 1))], "path string, modified timestamp")
    assert sorted(r.path for r in streams.not_older(rows, stored).collect()) == ["b", "c"]
    same = spark.createDataFrame([("a", datetime(2024, 1, 2), 1, "x")] * 2, "path string, modified timestamp, size_bytes long, content string")
    assert streams.last_versions(same).count() == 1


def test_watch_goes_on_with_a_filled_store(spark, tmp_path, monkeypatch):
    """200 stored files, a stream with new and changed ones, and a micro-batch that breaks and runs again."""
    root, place = tmp_path / "in", stores.Store(str(tmp_path / "index"), buckets=4, with_grams=False)
    root.mkdir()
    rows = spark.range(200).selectExpr("concat('/old/', id, '.md') path", "3L size_bytes", "timestamp '2024-01-01' modified", "'old' content")
    stores.write_batch(place, describe(rows, datetime(2024, 1, 1)))
    for name in ("a.md", "b.md"):
        put(root, name, name, 1_700_000_000)

    def run():
        streams.watch(streams.folder_stream(spark, str(root)), place, str(tmp_path / "progress")).awaitTermination()

    with monkeypatch.context() as patch:
        patch.setattr(stores.Attempt, "commit", lambda *_: 1 / 0)
        with pytest.raises(Exception):
            run()
    assert stores.live_files(place, spark).count() == 200
    run()
    assert stores.live_files(place, spark).count() == 202 and len(texts(spark, place)) == 202
    assert stores.complete_batches(place, spark) == [0, 1]
    put(root, "c.md", "more", 1_700_000_300)
    run()
    assert stores.complete_batches(place, spark) == [0, 1, 2]
    # The same micro-batch again, under its own number.
    assert stores.stream_batch(place, spark, str(tmp_path / "progress"), 1) == 2
    assert len(texts(spark, place)) == 203


def test_refresh_counts_unread_files(spark, tmp_path, monkeypatch):
    root, place = tmp_path / "in", stores.Store(str(tmp_path / "index"), buckets=4, with_grams=False)
    root.mkdir()
    put(root, "a.md", "one", 1_700_000_000)
    put(root, "b.md", "two", 1_700_000_000)
    read = streams.read_texts
    with monkeypatch.context() as patch:
        patch.setattr(streams, "read_texts", lambda *args: read(*args).filter("path not like '%b.md'"))
        stores.write_batch(place, describe(read(spark, str(root)), datetime(2024, 1, 1)).filter("false"))
        assert streams.refresh(spark, str(root), place)
    assert texts(spark, place) == {"a.md": "one"} and stores.commits(place, spark)[-1].n_unread == 1
    assert streams.refresh(spark, str(root), place)
    assert texts(spark, place) == {"a.md": "one", "b.md": "two"} and not streams.refresh(spark, str(root), place)
