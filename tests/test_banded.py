"""Related files by bands, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from passagework.operators import banded, semantic


def vectors(seed=3, centres=40, around=12, dim=48):
    rng = np.random.default_rng(seed)
    middle = np.repeat(rng.standard_normal((centres, dim)), around, axis=0)
    spread = np.tile(np.linspace(0.1, 0.9, around), centres)[:, None]
    return middle + spread * rng.standard_normal(middle.shape)


def frame(spark, matrix, first=0):
    rows = [(first + i, 0, v.tolist()) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "file_id long, chunk_no int, embedding array<float>")


def listed(rows):
    return {(r.query_id, r.file_id): round(r.score, 6) for r in rows.collect()}


def exact(rows, k, similarity):
    return {p: s for p, s in listed(semantic.related_files(rows, k)).items() if s >= similarity}


def test_recall_against_all_pairs(spark):
    rows = frame(spark, vectors())
    want = exact(rows, 5, 0.8)
    got = listed(banded.related_banded(rows, 5, 0.8, 0.05))
    assert len(want) > 1000
    assert len(got.keys() & want.keys()) >= 0.95 * len(want)
    assert all(got[p] == want[p] for p in got.keys() & want.keys())
    assert all(s >= 0.8 for s in got.values())


def test_long_keys_and_dealt_buckets(spark, monkeypatch):
    rows = frame(spark, vectors(seed=4))
    want = exact(rows, 5, 0.8)
    monkeypatch.setattr(banded, "BUCKET_ROWS", 2)
    monkeypatch.setattr(banded, "BLOCK_ROWS", 6)
    assert banded.band_plan(480, 0.8, 0.05)[0] == 8
    got = listed(banded.related_banded(rows, 5, 0.8, 0.05))
    assert len(got.keys() & want.keys()) >= 0.95 * len(want)


def test_equal_vectors_are_one_class(spark):
    some = vectors(seed=5, centres=3, around=4)
    matrix = np.concatenate([some, np.repeat(some[:1], 300, axis=0), np.zeros((5, 48))])
    rows = frame(spark, matrix).union(spark.createDataFrame([(999, 0, None)], "file_id long, chunk_no int, embedding array<float>"))
    got, want = listed(banded.related_banded(rows, 4, 0.8, 1e-6)), exact(frame(spark, matrix), 4, 0.8)
    assert got == want and len(got) > 1200
    ranks = banded.related_banded(rows, 4, 0.8, 1e-6).filter("query_id = '200'").orderBy("rank").collect()
    assert [(r.rank, r.file_id, r.score) for r in ranks] == [(1, 0, 1.0), (2, 12, 1.0), (3, 13, 1.0), (4, 14, 1.0)]


def test_no_rows_and_one_row(spark):
    assert banded.related_banded(frame(spark, np.zeros((0, 4))), 3).collect() == []
    assert banded.related_banded(frame(spark, np.ones((1, 4))), 3).collect() == []


@pytest.mark.parametrize("count", [0, 10**4, 10**9])
def test_band_plan(count):
    width, bands = banded.band_plan(count, 0.8, 0.01)
    agree = 1 - np.arccos(0.8) / np.pi
    assert (1 - agree**width) ** bands <= 0.01 < (1 - agree**width) ** (bands - 1)
    with pytest.raises(ValueError):
        banded.band_plan(count, 1.5, 0.01)


def test_copies_of_vectors_are_bands_times_the_classes(spark):
    rows = frame(spark, vectors(seed=6))
    keyed = rows.select("file_id", "embedding").withColumnRenamed("file_id", "least")
    keyed = keyed.mapInPandas(banded._keys(4, 3), "key long, least long, embedding array<double>")
    assert keyed.count() == 3 * rows.count() == banded._dealt(keyed).count()


def test_buckets_of_some_thousands_are_not_copied(spark):
    keyed = spark.range(20_000).selectExpr("7L as key", "id as least", "array(1D, cast(id as double)) as embedding")
    assert banded._dealt(keyed).count() == 20_000


def test_crowded_classes_are_compared_with_all(spark, monkeypatch):
    rows = frame(spark, np.concatenate([vectors(seed=8), 0.3 * vectors(seed=9, centres=6) + 1]))
    monkeypatch.setattr(banded, "BLOCK_ROWS", 50)
    monkeypatch.setattr(banded, "PACKED_ROWS", 40)
    monkeypatch.setattr(banded, "TILE", 16)
    monkeypatch.setattr(banded, "CENTRES", 5)
    # One band of four bits by itself misses more than half of the pairs at 0.8.
    assert banded.band_plan(552, 0.8, 0.8) == (4, 1)
    monkeypatch.setattr(banded, "CROWDED", 0.002)
    assert listed(banded.related_banded(rows, 5, 0.8, 0.8)) == exact(rows, 5, 0.8)


def test_crowded_classes_by_text_are_packed_once(spark, monkeypatch):
    rows = frame(spark, np.concatenate([0.3 * vectors(seed=10, centres=5) + 1, vectors(seed=11, centres=24, around=1)]))
    classes = rows.selectExpr("concat('f', file_id) as least", "cast(embedding as array<double>) as embedding")
    monkeypatch.setattr(banded, "BLOCK_ROWS", 50)
    monkeypatch.setattr(banded, "PACKED_ROWS", 16)
    marked = banded._marked(classes, 84, 8, 10)
    assert 0 < marked.filter("crowded").count() < 84
    packed, blocks, crowded = banded._packed(marked)
    files = packed.selectExpr("block", "explode(files) as least").join(marked, "least")
    assert files.count() == 84 and files.filter(files["crowded"] != (files["block"] < crowded)).count() == 0
    renamed = rows.selectExpr("concat('f', file_id) as file_id", "chunk_no", "embedding")
    assert listed(banded.related_banded(renamed, 4, 0.8, 1e-9)) == exact(renamed, 4, 0.8)
