from datetime import datetime

from passagework.functions import frontmatter
from passagework.operators import catalog
from passagework.sources.listing import describe
from pyspark.sql import functions as F

STAMP = datetime(2024, 1, 1)


def parsed(spark, content, path="a.md"):
    rows = spark.createDataFrame([(path, 1, STAMP, content)], "path string, size_bytes long, modified timestamp, content string")
    out = describe(rows, STAMP)
    row = out.first()
    return row.title, row.tags, out


def test_cases(spark):
    assert parsed(spark, "---\ntitle: A\ntags: [x, y]\n---\nbody")[:2] == ("A", ["x", "y"])
    title, tags, out = parsed(spark, "---\ntags:\n  - x\n  - x\n---\n")
    assert (title, tags) == (None, ["x", "x"])
    assert catalog.file_tags(out).count() == 1
    assert catalog.files_per_tag(out).first().n_files == 2
    assert parsed(spark, "---\ntitle: A\nbody")[:2] == (None, None)
    assert parsed(spark, "body\n---\ntitle: A\n---")[:2] == (None, None)
    assert parsed(spark, "---\ntitle: A\ntags: [x, y]\n---\nbody", "a.txt")[:2] == (None, None)


def test_scalars_and_broken_blocks(spark):
    assert parsed(spark, "---\ntitle: \"A: b\"\ntags: ['x y', z]\n---")[:2] == ("A: b", ["x y", "z"])
    assert parsed(spark, "---\ntitle: A: b\n---")[:2] == (None, None)
    assert parsed(spark, "---\ntitle: A\ntags: x\n---")[:2] == (None, None)
    assert parsed(spark, "---\njust text\n---")[:2] == (None, None)
    assert parsed(spark, "---\nsidebar:\n  label: L\ntitle: A\n---")[:2] == ("A", None)
    assert parsed(spark, "---\ntitle:\n---")[:2] == (None, None)


def test_body(spark):
    row = spark.createDataFrame([("---\ntitle: A\n---\nbody\n---\n",), ("plain",)], "s string")
    assert [r.b for r in row.select(frontmatter.body(F.col("s")).alias("b")).collect()] == ["\nbody\n---\n", "plain"]


def test_comments_flow_lists_and_block_scalars(spark):
    assert parsed(spark, "---\ntitle: A # note\ntags: [a, \"b, c\", 'd]'] # more\n---")[:2] == ("A", ["a", "b, c", "d]"])
    assert parsed(spark, "---\ntitle: \"A # b\"\ntags:\n  - x # c\n  - y#z\n---")[:2] == ("A # b", ["x", "y#z"])
    assert parsed(spark, "---\ntitle: >\n  folded\n---")[:2] == ("folded\n", None)


def test_body_of_an_unreadable_block_is_the_whole_text(spark):
    text = "---\ntitle: x\nfree prose here\n---\nrest"
    assert spark.createDataFrame([(text,)], "s string").select(frontmatter.body(F.col("s")).alias("b")).first().b == text


FORMS = [
    ("og.title: x\ntitle: A\ntags: [a]", "A", ["a"]),
    ("my key: x\ntitle: A", "A", None),
    ('"title": A\n\'tags\': [a]', "A", ["a"]),
    ("title: >\n  folded\n  text\n\n  more\ntags: [a, b]", "folded text\nmore\n", ["a", "b"]),
    ("title: |-\n  kept: yes\n   # as it is\n\ntags:\n- a", "kept: yes\n # as it is", ["a"]),
    ("title: A\ntags: [\n  a,\n  \"b, c\"\n]\nother: 1", "A", ["a", "b, c"]),
    ("title: foo\n  bar\ntags: [a]", "foo bar", ["a"]),
    ('title: "a \\"b\\" \\\\ c"', 'a "b" \\ c', None),
    ("title: 'it''s'\ntags: ['it''s', x]", "it's", ["it's", "x"]),
    ("title: &x A\ntags: &t\n  - a\n  - !!str b", "A", ["a", "b"]),
    ("# first\ntitle: !!str A # why\n# between\ntags: # all\n  # none\n  - a # one\n  - b", "A", ["a", "b"]),
    ("title:\n  below\ntags: []", "below", None),
    ("title: ~\ntags: null", None, None),
    ("title: \"two\n  lines\"", "two lines", None),
    ("title: http://x.y/z:1\nlinks:\n  - name: a\n    to: b", "http://x.y/z:1", None),
]


UNREADABLE = [
    "title: A\ntitle: B", "title: [A]", "title:\n  a: b", "title: \"open", "title: \"\\x41\"\ntags: [a]", "- a\n- b", "title: A\ntags: {a: b}",
    "title: A\ntags: ['open, b]", "title: A\nplain line",
]


def test_forms_of_values(spark):
    blocks = FORMS + [(block, None, None) for block in UNREADABLE]
    rows = spark.createDataFrame([(n, f"---\n{block}\n---\nbody") for n, (block, *_) in enumerate(blocks)], "n int, content string")
    parts = frontmatter.parse(F.col("content"))
    found = {r.n: r for r in rows.select("n", parts.alias("parts")).collect()}
    for n, (block, title, tags) in enumerate(blocks):
        got = found[n].parts
        assert (got is None) == (block in UNREADABLE), block
        assert got is None or (got.title, got.tags) == (title, tags), block
