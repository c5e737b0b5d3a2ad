import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from passagework.operators import chunking


def cut(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")
    out = {}
    for r in chunking.cut_chunks(rows, **options).orderBy("file_id", "chunk_no").collect():
        out.setdefault(r.file_id, []).append((r.chunk_no, r.content))
    return out


def lines(n, start=0):
    return "\n".join(f"l{i}" for i in range(start, start + n))


def test_window_borders(spark):
    texts = ["a", lines(30), lines(30) + "\n", lines(50), lines(51), "\n" * 30 + lines(30), " \n \n　", None, ""]
    got = cut(spark, texts)
    assert [len(got.get(i, [])) for i in range(9)] == [1, 1, 2, 2, 3, 2, 0, 0, 0]
    assert [no for no, _ in got[5]] == [0, 1]
    assert got[3][1][1] == lines(30, 20)
    assert got[4][2][1] == lines(11, 40)


def test_small_sizes():
    assert chunking.window_plan(30) == (10, 20)
    assert chunking.window_plan(9) == (3, 6)
    assert chunking.window_plan(1) == (0, 1)
    with pytest.raises(ValueError):
        chunking.window_plan(0)


def test_plain_windows_keep_their_place(spark):
    rows = spark.createDataFrame([(1, "\n" * 50 + lines(10))], "file_id long, content string")
    assert [(r.chunk_no, r.content) for r in chunking.cut_plain_chunks(rows).collect()] == [(1, lines(10))]


def reference_windows(text, size, overlap):
    """Brute force: every step a window, stop at the one that holds the last line."""
    overlap, step = chunking.window_plan(size, overlap)
    split = text.split("\n")
    kept, at = [], 0
    while True:
        window = "\n".join(split[at:at + size])
        if window.strip():
            kept.append(window)
        if at + size >= len(split):
            return kept
        at += step


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text("ab \n", max_size=120), min_size=1, max_size=8), size=st.integers(1, 12), overlap=st.integers(0, 12))
def test_equals_brute_force(spark, texts, size, overlap):
    got = cut(spark, texts, size=size, overlap=overlap)
    for i, text in enumerate(texts):
        want = reference_windows(text, size, overlap)
        assert got.get(i, []) == list(enumerate(want))
        for line in text.split("\n"):
            assert not line.strip() or any(line in chunk.split("\n") for _, chunk in got[i])
