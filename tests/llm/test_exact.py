"""Binary fuse filters and exact dedup, against plain Python."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import exact
from passagework.llm.fuse import FuseFilter


@pytest.mark.parametrize("count", [0, 1, 2, 3, 7, 100, 5_000, 100_000])
def test_filter_holds_its_keys_and_few_others(count):
    made = np.random.default_rng(count)
    keys, others = (made.integers(0, 2**64, n, dtype=np.uint64) for n in (count, 50_000))
    found = FuseFilter.from_bytes(FuseFilter.of(np.concatenate([keys, keys])).to_bytes())
    assert found.holds(keys).all()
    assert found.holds(others).mean() < 0.006
    assert len(found.prints) <= 1.25 * count or count < 10_000


def expected(rows):
    """(doc_id, keep_id, group_size, sha) for every row, and the kept rows."""
    best, size = {}, Counter()
    for doc, text, *_ in rows:
        body = text or ""
        size[body] += 1
        best[body] = max((best.get(body), doc), key=lambda d: (d is not None, d or 0))
    out = [(doc, best[t or ""], size[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for doc, t, *_ in rows]
    return sorted(out, key=repr), sorted(((best[b], b) for b in size), key=repr)


def weak(text):
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 1)


@pytest.mark.parametrize("digest", [exact.sha256, weak])
@pytest.mark.parametrize("deliveries", [1, 3])
@pytest.mark.parametrize("broadcast", [True, False])
def test_groups_of_odd_rows(spark, docs_of, odd_rows, monkeypatch, digest, deliveries, broadcast):
    """With the weak digest most positives are other texts: only the byte check and the second hash tell them apart."""
    if not broadcast:
        monkeypatch.setattr(exact, "bounded_rows", lambda frame: None)
    rows = odd_rows + [(100 + i, f"copy {i % 7}", "z") for i in range(60)]
    found = exact.exact_groups(docs_of(rows), ["doc_id", "text"], deliveries=deliveries, digest=digest).collect()
    sha = lambda r: hashlib.sha256((r._row.text or "").encode()).hexdigest()
    want, kept = expected(rows)
    assert sorted(((r._row.doc_id, r.keep_id, r.group_size, sha(r)) for r in found), key=repr) == want
    assert sorted(((r._row.doc_id, r._row.text or "") for r in found if r.kept), key=repr) == kept


def test_positives_are_checked_and_new_texts_found(spark):
    docs = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    judged, first = exact.taken_in(docs(["a", "b", "b", None]), [])
    assert judged.filter("new").count() == 3
    judged, second = exact.taken_in(docs(["b", "c", ""]), [first])
    assert [r.n for r in judged.groupBy("new").agg(F.count("*").alias("n")).orderBy("new").collect()] == [2, 1]
    judged, third = exact.taken_in(docs(["a", "c", "c"]), [first, second])
    assert third is None and judged.filter("new").isEmpty()


def test_false_positives_of_the_filter_stay_new(spark, monkeypatch):
    monkeypatch.setattr(FuseFilter, "holds", lambda self, keys: np.ones(len(keys), dtype=bool))
    _, first = exact.taken_in(spark.range(50).selectExpr("cast(id as string) text"), [])
    judged, _ = exact.taken_in(spark.range(40, 90).selectExpr("cast(id as string) text"), [first])
    assert judged.filter("new").count() == 40


def test_empty_table_and_kept_rows(docs_of, odd_rows):
    assert exact.exact_groups(docs_of([]), ["doc_id"]).count() == 0
    docs = docs_of(odd_rows)
    kept = exact.without_copies(docs)
    assert kept.schema == docs.schema
    assert kept.count() == len({r[1] or "" for r in odd_rows})


def test_large_groups_are_broadcast(spark, docs_of, plan):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i}", "a") for i in range(6000)]
    found = exact.exact_groups(docs_of(rows), ["doc_id"])
    assert found.filter("kept").count() == 4001
    assert found.filter("digest is not null and kept and group_size = 2000").first()["keep_id"] == 5997
    assert "BroadcastHashJoin" in plan(found)
