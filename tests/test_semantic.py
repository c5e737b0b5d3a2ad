import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from passagework.functions.vectors import cosine
from passagework.operators import semantic

VECTORS = "file_id long, chunk_no int, embedding array<float>"


def test_cosine(spark):
    rows = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])],
        "a array<float>, b array<float>",
    )
    assert [round(r.s, 6) for r in rows.select(cosine(F.col("a"), F.col("b")).alias("s")).collect()] == [1, 0, 0, 0.707107]


@pytest.fixture(scope="module")
def data(spark):
    """40 files of one to five chunks, and one file of copies that holds a third of all rows."""
    rng = np.random.default_rng(3)
    rows = [(f, c, rng.normal(size=6).astype("float32").tolist()) for f in range(40) for c in range(1 + f % 5)]
    rows += [(99, c, rows[0][2]) for c in range(60)]
    asked = [(f"q{i}", rng.normal(size=6).astype("float32").tolist()) for i in range(7)] + [("same", rows[0][2])]
    return rows, asked


def brute(rows, asked, k):
    out = {}
    for name, q in asked:
        best = {}
        for f, c, v in rows:
            sim = round(float(np.dot(np.float64(q), np.float64(v)) / np.linalg.norm(np.float64(q)) / np.linalg.norm(np.float64(v))), 9)
            if f not in best or (-sim, c) < best[f]:
                best[f] = (-sim, c)
        order = sorted((s, f, c) for f, (s, c) in best.items())
        out[name] = [(f, c) for _, f, c in order[:k]]
    return out


def listed(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.file_id, r.chunk_no))
    return out


def test_nearest_files_equal_brute_force(spark, data, monkeypatch):
    rows, asked = data
    stored = spark.createDataFrame(rows, VECTORS).repartition(5)
    queries = spark.createDataFrame(asked, "query_id string, embedding array<float>")
    want = brute(rows, asked, 4)
    assert listed(semantic.nearest_files(queries, stored, 4)) == want
    monkeypatch.setattr(semantic, "MAX_QUERY_NUMBERS", 6)
    monkeypatch.setattr(semantic, "BLOCK_ROWS", 16)
    assert listed(semantic.nearest_files(queries, stored, 4)) == want
    assert semantic.nearest_files(queries.filter("false"), stored, 4).count() == 0


def test_no_pair_list_reaches_the_shuffle(spark, data):
    rows, asked = data
    stored = spark.createDataFrame(rows, VECTORS).coalesce(1)
    queries = spark.createDataFrame(asked, "query_id string, embedding array<float>")
    found = semantic._block_join(queries, stored, 2)
    assert found.count() <= 2 * len(asked)


def test_related_files(spark, data):
    rows, _ = data
    stored = spark.createDataFrame(rows, VECTORS)
    means = {}
    for f, _, v in rows:
        means.setdefault(f, []).append(np.float64(v))
    means = {f: np.mean(v, axis=0) for f, v in means.items()}
    want = {}
    for f, m in means.items():
        sims = sorted((-round(float(m @ o / np.linalg.norm(m) / np.linalg.norm(o)), 6), g) for g, o in means.items() if g != f)
        want[str(f)] = [g for _, g in sims[:3]]
    got = {}
    for r in semantic.related_files(stored, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.file_id)
    assert got == want


def test_failed_batches_are_marked(spark):
    chunks = spark.createDataFrame([(i, 0, "bad" if i == 3 else f"text {i}") for i in range(6)], "file_id long, chunk_no int, content string").coalesce(1)

    def embedder(texts):
        if "bad" in texts:
            raise RuntimeError("no model")
        return [[float(len(t))] for t in texts]

    rows = {r.file_id: r for r in semantic.embed_chunks(chunks, embedder, batch_size=2).collect()}
    assert sorted(f for f, r in rows.items() if r.error) == [2, 3]
    assert rows[0].embedding == [6.0] and rows[2].embedding is None
    assert semantic.embedded(semantic.embed_chunks(chunks, embedder, batch_size=2)).count() == 4
    cut = semantic.embed_chunks(chunks, lambda t: [[float(len(x))] for x in t], max_chars=2)
    assert {r.embedding[0] for r in cut.collect()} == {2.0}


def test_comparison_and_unknown_paths(spark):
    keyword = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, file_id long, rank int")
    near = spark.createDataFrame([("q", 2, 1, 0.5), ("q", 3, 2, 0.4)], "query_id string, file_id long, rank int, score double")
    assert {r.file_id: r.method for r in semantic.compare_methods(keyword, near).collect()} == {1: "keyword", 2: "both", 3: "semantic"}
    files = spark.createDataFrame([(2, "b.md")], "file_id long, path string")
    assert {r.file_id: r.path for r in semantic.with_paths(near, files).collect()} == {2: "b.md", 3: "?"}


def test_rows_without_a_vector_are_left_out(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, None), (3, 0, [0.0, 1.0])], "file_id long, chunk_no int, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.1]), ("none", None)], "query_id string, embedding array<double>")
    assert [(r.query_id, r.file_id) for r in semantic.nearest_files(asked, rows, 1).collect()] == [("q", 1)]
    assert {r.query_id for r in semantic.related_files(rows, 5).collect()} == {"1", "3"}
    assert semantic.file_vectors(rows).count() == 2


@pytest.mark.parametrize("skip_self", [False, True])
@pytest.mark.parametrize("chunks", [1, 7])
def test_tiles_equal_brute_force(monkeypatch, chunks, skip_self):
    """Many ties, zero vectors, and files that go over the end of a tile; ids of queries are names of files or not."""
    monkeypatch.setattr(semantic, "TILE_ROWS", 16)
    monkeypatch.setattr(semantic, "SLICE_CELLS", 1)
    rng = np.random.default_rng(chunks)
    values = rng.integers(-1, 2, (700, 5)).astype("float32")
    values[300:] += rng.normal(0, 1e-5, (400, 5)).astype("float32")
    stored = pd.DataFrame({"file_id": np.arange(700) // chunks, "chunk_no": np.arange(700) % chunks, "embedding": list(values)})
    ids = np.array([str(i) for i in range(40)] + ["x"], dtype=object)
    asked = semantic._unit(pd.Series(list(values[:280:7]) + [values[-1]]))
    sims = np.round(asked @ semantic._unit(stored["embedding"]).T, semantic.SCORE_DIGITS)
    want = []
    for q, name in enumerate(ids):
        best = {}
        for f, c, s in zip(stored["file_id"], stored["chunk_no"], sims[q]):
            if not (skip_self and str(f) == name) and (f not in best or s > best[f][0]):
                best[f] = (s, c)
        order = sorted(best, key=lambda f: (-best[f][0], f))[:6]
        want += [(name, f, best[f][1], best[f][0]) for f in order]
    got = semantic._best_of_slices(asked, ids, stored.sample(frac=1, random_state=1), 6, skip_self)
    assert [tuple(r) for r in got.to_numpy()] == want


def test_blocks_follow_the_size_of_vectors(spark):
    rows = spark.range(20_000)
    assert semantic._blocks(rows.selectExpr("array(1F, 2F) as embedding")) == 1
    assert semantic._blocks(rows.selectExpr("array_repeat(1F, 3000) as embedding")) == 10
    assert semantic._blocks(rows.selectExpr("array(1F) as embedding").limit(0)) == 1


def test_embedder_hashes_a_word_once(monkeypatch):
    made = []
    monkeypatch.setattr(semantic, "md5", lambda code: made.append(code) or hashlib.md5(code))
    vector, none = semantic.hashing_embedder(8)(["a b a B ", "..."])
    assert sorted(made) == [b"7:a", b"7:b"]
    assert np.linalg.norm(vector) == pytest.approx(1) and not none.any()
    one = hashlib.md5(b"7:a").hexdigest()
    assert semantic.hashing_embedder(8)(["a a"])[0][int(one[:8], 16) % 8] == (1 if one[8] >= "8" else -1)
