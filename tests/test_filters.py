from datetime import datetime

import pytest
from pyspark.sql import functions as F

from passagework.operators import catalog, filters


def paths(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "path string")


def kept(frame):
    return sorted(r.path for r in frame.collect())


def test_default_ignores(spark):
    rows = paths(spark, "node_modules/x.js", "a/node_modules/x.js", "dist/i.html", ".git/config", "src/a.go", "distance.md")
    assert kept(filters.drop_ignored(rows, filters.default_ignores())) == ["distance.md", "src/a.go"]


def test_pattern_forms(spark):
    cases = {
        "*.log": (["a.log", "d/b.log"], ["a.logs", "log"]),
        "/top": (["top", "top/x"], ["d/top"]),
        "build/": (["build/x", "d/build/y"], ["build"]),
        "a/b": (["a/b", "a/b/c"], ["x/a/b"]),
        "**/z": (["z", "q/w/z"], ["zz"]),
        "docs/**": (["docs/a", "docs/b/c"], ["docs"]),
        "f?o[ab].c": (["fxoa.c"], ["fxoc.c", "f/oa.c"]),
        "x[!a]y": (["xby"], ["xay"]),
        "a.b": (["a.b"], ["axb"]),
    }
    for pattern, (drops, keeps) in cases.items():
        rows = paths(spark, *drops, *keeps)
        assert kept(filters.drop_ignored(rows, [filters.ignore_set([pattern])])) == sorted(keeps), pattern


def test_negation_works_inside_a_set_only(spark):
    rows = paths(spark, "a.log", "keep.log", "logs/keep.log")
    one = filters.ignore_set(["# note", "", "*.log", "!keep.log"])
    assert kept(filters.drop_ignored(rows, [one])) == ["keep.log", "logs/keep.log"]
    assert kept(filters.drop_ignored(rows, [filters.ignore_set(["*.log"]), filters.ignore_set(["!keep.log"])])) == []
    folder = filters.ignore_set(["logs/", "!keep.log"])
    assert kept(filters.drop_ignored(rows, [folder])) == ["a.log", "keep.log"]


def test_substring_exclusion_looks_at_folders(spark):
    rows = paths(spark, "h/.cache/x", "h/.cache", "h/snap/x", "h/snap/y/x", "h/ok/x")
    assert kept(filters.drop_containing(rows)) == ["h/.cache", "h/ok/x", "h/snap/x"]


def test_metadata_search(spark):
    rows = spark.createDataFrame(
        [("a/Big.MD", "Big.MD", ".md", 10, datetime(2024, 1, 5), "Markdown"),
         ("a/b.md", "b.md", ".md", 20, datetime(2024, 1, 7), "Markdown"),
         ("a/c.go", "c.go", ".go", 30, datetime(2024, 1, 6), "Go")],
        "path string, filename string, extension string, size_bytes long, modified timestamp, lang string",
    )
    assert [r.path for r in filters.metadata_search(rows).collect()] == ["a/b.md", "a/c.go", "a/Big.MD"]
    assert [r.path for r in filters.metadata_search(rows, ext="md", name="b").collect()] == ["a/b.md", "a/Big.MD"]
    assert [r.path for r in filters.metadata_search(rows, recent_days=2, as_of=datetime(2024, 1, 8)).collect()] == ["a/b.md"]
    assert [r.path for r in filters.largest(rows, 2).collect()] == ["a/c.go", "a/b.md"]
    with pytest.raises(ValueError):
        filters.metadata_search(rows, recent_days=1)


def test_extension_filters(spark):
    rows = spark.createDataFrame([("a", ".MD", 0), ("b", ".png", 5), ("c", ".go", 524289), ("d", None, 5)], "path string, extension string, size_bytes long")
    assert kept(filters.by_text_extension(rows)) == ["a", "c"]
    assert kept(filters.by_text_extension(rows, ["png"])) == ["b"]
    assert kept(filters.by_size(rows)) == ["b", "d"]


def test_listing(spark):
    rows = paths(spark, "b.txt", "src/x.py", "src/sub/y.py", ".git/config", "node_modules/m/i.js", "src/.env")
    got = [(r.parent, r.depth, r.name, r.is_dir) for r in catalog.listing(rows).collect()]
    assert got == [
        ("", 0, "src", True), ("", 0, "b.txt", False),
        ("src", 1, "sub", True), ("src", 1, "x.py", False), ("src/sub", 2, "y.py", False),
    ]
    assert [r.name for r in catalog.listing(rows, max_depth=1).collect()] == ["src", "b.txt"]


def test_statistics(spark):
    rows = spark.createDataFrame(
        [(1, ".md", 10, ["x", "x"]), (2, ".md", 5, ["x", "y"]), (3, None, 1, None)],
        "file_id long, extension string, size_bytes long, tags array<string>",
    )
    assert [(r.tag, r.n_files) for r in catalog.files_per_tag(rows).collect()] == [("x", 3), ("y", 1)]
    assert catalog.file_tags(rows).count() == 3
    assert [tuple(r) for r in catalog.by_extension(rows).collect()] == [(".md", 2, 15)]
    empty = rows.filter("file_id < 0")
    assert tuple(catalog.totals(empty, empty).first()) == (0, 0, 0)
    back = rows.select(catalog.tags_from_json(catalog.tags_to_json(F.col("tags"))).alias("t")).collect()
    assert [r.t for r in back] == [["x", "x"], ["x", "y"], None]


def test_latest_meta(spark):
    rows = spark.createDataFrame(
        [("k", "old", datetime(2024, 1, 1)), ("k", "new", datetime(2024, 1, 2)), ("n", None, datetime(2024, 1, 1))],
        "key string, value string, written_at timestamp",
    )
    assert {r.key: r.value for r in catalog.latest_meta(rows).collect()} == {"k": "new", "n": ""}


def test_ignore_sets_have_a_folder_and_marks_can_be_escaped(spark):
    rows = spark.createDataFrame([(p,) for p in ("a/x.log", "b/x.log", "a/b/y.log", "!keep", "#tag", "ab/x.log")], "path string")
    left = lambda *sets: sorted(r.path for r in filters.drop_ignored(rows, sets).collect())
    assert left(filters.ignore_set(["*.log"], "a")) == ["!keep", "#tag", "ab/x.log", "b/x.log"]
    assert left(filters.ignore_set(["/x.log"], "a/")) == ["!keep", "#tag", "a/b/y.log", "ab/x.log", "b/x.log"]
    assert left(filters.ignore_set([r"\!keep", r"\#tag", "*.log"])) == []
