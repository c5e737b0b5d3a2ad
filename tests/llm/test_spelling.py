"""Words one edit apart, against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from passagework.llm import spelling
from passagework.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def counted(docs, drop=199):
    out = Counter()
    for doc, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def linked(words):
    """Near words by their common shapes: a letter left out, or replaced by a mark."""
    shapes = defaultdict(set)
    for w in words:
        shapes["", w].add(w)
        for i in range(len(w)):
            shapes["", w[:i] + w[i + 1 :]].add(w)
            shapes["*", w[:i] + "\0" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (mark, shape), group in shapes.items():
        for w in group:
            # Without a mark only the shape itself is one letter away: two words that lose a letter may be two edits apart.
            near[w] |= group - {w} if mark else {shape} - {w} if shape in words else set()
            if not mark and shape in words and w != shape:
                near[shape].add(w)
    return near


def groups(words):
    near, forms = linked(words), {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 5 * n:
                forms[w] = best
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        yield w, forms.get(w), root, n, len(near[w]), words.get(forms.get(w))


NAMES = ("word", "form", "root", "n", "n_near", "form_n")


def rows(frame):
    return sorted((tuple(r[c] for c in NAMES) for r in frame.collect()), key=repr)


def test_words_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted(groups(counted(docs)), key=repr)
    assert any(r[1] for r in want) and any(r[4] > 1 for r in want)
    assert rows(QUERIES["op13_spelling_variants"](spark, SF)) == want


def planted():
    base = ["lantern", "lanterns", "lantren", "elantern", "lintern", "läntern", "lÄntern", "l÷ntern", "lntern", "listen", "silent", "enlist",
            "listens", "aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "abababab", "babababa", "word" * 70, "word" * 70 + "s"]
    return [(k, " ".join([w] * (5 * 6 ** (k % 4))), "a") for k, w in enumerate(base)]


@pytest.mark.parametrize("part_words", [20_000, 8, 1])
def test_planted_and_odd_rows(spark, docs_of, odd_rows, monkeypatch, part_words):
    """Small parts cut the trie at one more letter group after another."""
    monkeypatch.setattr(spelling, "PART_WORDS", part_words)
    monkeypatch.setattr(spelling, "BRANCHES", 16)
    monkeypatch.setattr(spelling, "PAIR_BYTES", 64)
    docs = planted() + odd_rows * 5 + [(None, "LANTERN Lantern, lantern;lan-tern", None)] * 5
    assert rows(spelling.spelling_groups(docs_of(docs), drop=3)) == sorted(groups(counted(docs, 3)), key=repr)


def test_chains_end_in_their_last_form(spark, docs_of):
    words = ["abcdefgh", "abcdefgi", "abcdefji", "abcdekji", "abcdlkji"]
    docs = [(k, " ".join([w] * 5 ** (k + 1)), "a") for k, w in enumerate(words)]
    found = {r.word: r.root for r in spelling.spelling_groups(docs_of(docs), drop=10**9).collect()}
    assert found == dict.fromkeys(words, words[-1])


def test_empty_table(docs_of):
    assert rows(spelling.spelling_groups(docs_of([]))) == []
