"""Embeddings: filling them in, exact nearest neighbours, related files.

Vectors are compared as blocks: each task multiplies a block of candidates with a
block of queries and hands on only the best files of each query, never all pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from passagework.operators.ranking import best_per_file, top_k

# Tasks get the functions of this module themselves and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]

# Fixed value: texts per embedder call.
EMBED_BATCH = 20
# Words that a hashing embedder remembers.
KNOWN_WORDS = 1 << 17
# Queries up to this many numbers (32 MiB) go to every task with the task itself.
MAX_QUERY_NUMBERS = 4 * 1024 * 1024
# Target rows of a block on each side of a block join, and the most numbers of their vectors.
BLOCK_ROWS, BLOCK_NUMBERS = 32_768, 6 * 1024 * 1024
# Similarities held at once by a task, for so many queries; pairs scored in double precision at once.
SLICE_CELLS, TILE_ROWS, SCORED_AT_ONCE = 4 * 1024 * 1024, 1024, 65_536
# Error of a product of unit vectors in single precision, for each of their numbers.
ERROR = 1.2e-7
# Similarities are rounded before they are ranked, so that copies tie exactly.
SCORE_DIGITS = 9

SCORED = "query_id string, file_id {id}, chunk_no int, score double"


# Embedding ---------------------------------------------------------------------------


def embed_chunks(
    chunks: DataFrame, embedder: Embedder, batch_size: int = EMBED_BATCH, max_chars: int | None = None
) -> DataFrame:
    """file_id, chunk_no, embedding, error: vectors from a caller's batch function.

    A failed batch gives rows with `error` and no vector; the others go on. Whole
    texts are embedded unless `max_chars` is given.
    """
    text = F.col("content") if max_chars is None else F.substring("content", 1, max_chars)
    source = chunks.select("file_id", "chunk_no", text.alias("content"))
    schema = T.StructType([
        source.schema["file_id"], source.schema["chunk_no"],
        T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType()),
    ])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at:at + batch_size]
                vectors: list = [None] * len(part)
                error = None
                try:
                    given = [np.asarray(v, dtype=np.float32) for v in embedder(part["content"].tolist())]
                    vectors[:len(given)] = given[:len(part)]
                except Exception as problem:  # noqa: BLE001 - any model failure marks the batch
                    error = f"{type(problem).__name__}: {problem}"
                yield pd.DataFrame({
                    "file_id": part["file_id"], "chunk_no": part["chunk_no"], "embedding": vectors, "error": error,
                })

    return source.mapInPandas(run, schema)


def with_vector(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("embedding").isNotNull())


def embedded(rows: DataFrame) -> DataFrame:
    return with_vector(rows).drop("error")


class _Words(dict):
    """Twice the dimension of a word, and one more if its sign is plus; the words met last are remembered."""

    def __init__(self, dim: int, seed: int):
        super().__init__()
        self.dim, self.seed = dim, seed

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        code = md5(f"{self.seed}:{word}".encode()).hexdigest()
        self[word] = 2 * (int(code[:8], 16) % self.dim) + (code[8] >= "8")
        return self[word]

    def __reduce__(self):
        return _Words, (self.dim, self.seed)


def hashing_embedder(dim: int = 64, seed: int = 7) -> Embedder:
    """A model-free embedder for tests: signed word hashing to a unit vector.

    The first eight hex digits of the MD5 of seed and word give its dimension, the ninth its sign (8 and above: plus).
    """
    import re

    word = re.compile(r"\w+")

    known = _Words(dim, seed)

    def embed(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            codes = np.array([known[token] for token in word.findall(text.lower())], dtype=np.int64)
            minus, plus = np.bincount(codes, minlength=2 * dim).reshape(dim, 2).T
            vector = (plus - minus).astype(np.float64)
            length = np.linalg.norm(vector)
            out.append(vector / length if length else vector)
        return out

    return embed


# Nearest neighbours ------------------------------------------------------------------


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _best_of_slices(
    asked: np.ndarray, query_ids: np.ndarray, stored: pd.DataFrame, k: int, skip_self: bool = False, least: float = -np.inf
) -> pd.DataFrame:
    """The k best files of each query within a block, each by its best chunk; `asked` holds unit vectors.

    A file among the k best overall is also among the k best of the block that holds its best chunk, so nothing is lost.
    Tiles small enough for a task's memory are multiplied in single precision; what may be among the k best by more than
    the error of that is scored anew in double precision, which alone decides. Files that score below `least` may be left out.
    """
    stored = stored.sort_values(["file_id", "chunk_no"])
    unit = _unit(stored["embedding"])
    files, chunk_nos = stored["file_id"].to_numpy(), stored["chunk_no"].to_numpy()
    begins = np.r_[True, files[1:] != files[:-1]][: len(files)]
    file_no = np.cumsum(begins) - 1
    single = unit.astype(np.float32)
    names = files[begins].astype(str)
    step = max(256, SLICE_CELLS // TILE_ROWS)
    best = []
    for at in range(0, len(asked), TILE_ROWS):
        some, ids = asked[at:at + TILE_ROWS], query_ids[at:at + TILE_ROWS]
        own = _places(ids.astype(str), names) if skip_self else None
        rows, cols, scores = _best_of_tiles(some, unit, single, file_no, own, k, step, least)
        best.append(pd.DataFrame({
            "query_id": ids[rows], "file_id": files[cols], "chunk_no": chunk_nos[cols].astype(np.int32), "score": scores,
        }))
    return pd.concat(best) if best else pd.DataFrame(columns=["query_id", "file_id", "chunk_no", "score"])


def _places(ids: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `ids` and the places in `names` that have the same name."""
    rows = pd.DataFrame({"name": ids, "row": np.arange(len(ids))})
    both = rows.merge(pd.DataFrame({"name": names, "file": np.arange(len(names))}), on="name")
    return both["row"].to_numpy(), both["file"].to_numpy()


def _best_of_tiles(
    asked: np.ndarray, unit: np.ndarray, single: np.ndarray, file_no: np.ndarray, own: tuple[np.ndarray, np.ndarray] | None,
    k: int, step: int, least: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k best files of each row."""
    error = ERROR * (asked.shape[1] + 8)
    some = asked.astype(np.float32)
    # What a row has to reach: as much as k files are known to reach, less the errors of both.
    floor = np.full(len(asked), least - error, dtype=np.float64)
    rows, cols, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(single), step):
        end = min(at + step, len(single))
        sims = some @ single[at:end].T
        first, last = file_no[at], file_no[end - 1]
        whole = last - first + 1 == end - at
        if own is not None:
            inside = (own[1] >= first) & (own[1] <= last)
            if whole:
                sims[own[0][inside], own[1][inside] - first] = -np.inf
            else:
                for row, file in zip(own[0][inside], own[1][inside]):
                    left, right = np.searchsorted(file_no, [file, file + 1])
                    sims[row, max(left - at, 0):max(right - at, 0)] = -np.inf
        if whole:
            top = sims
        else:
            starts = np.flatnonzero(np.r_[True, np.diff(file_no[at:end]) > 0])
            top = np.maximum.reduceat(sims, starts, axis=1)
        floor = np.maximum(floor, _kth(top, k) - 2 * error)
        bar = np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None]
        good = sims >= bar
        if not whole:
            sizes = np.diff(np.r_[starts, end - at])
            good &= sims >= np.repeat(top, sizes, axis=1) - np.float32(2 * error)
        row, col = np.divmod(np.flatnonzero(good), end - at)
        if own is not None:
            kept = sims[row, col] > -np.inf
            row, col = row[kept], col[kept]
        if not len(row):
            continue
        rows, cols = np.r_[rows, row], np.r_[cols, col + at]
        scores = np.r_[scores, _scores(asked, unit, row, col + at)]
        if len(rows) > 8 * k * len(asked):
            rows, cols, scores = _cut(rows, cols, scores, file_no, k)
    return _cut(rows, cols, scores, file_no, k)


def _kth(top: np.ndarray, k: int) -> np.ndarray:
    """For every row a value that k of its columns reach, or -inf: the k-th of the greatest of some groups of columns."""
    if top.shape[1] < k:
        return np.full(len(top), -np.inf)
    width = min(64, top.shape[1] // (2 * k))
    if width > 1:
        groups = top.shape[1] // width
        top = top[:, : groups * width].reshape(len(top), width, groups).max(axis=1)
    return np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k].astype(np.float64)


def _scores(asked: np.ndarray, unit: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for at in range(0, len(rows), SCORED_AT_ONCE):
        some = slice(at, at + SCORED_AT_ONCE)
        out[some] = np.einsum("ij,ij->i", asked[rows[some]], unit[cols[some]])
    return np.round(out, SCORE_DIGITS)


def _cut(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, file_no: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best files of each row by their best chunk; ties go by file and chunk, which is the order of the columns."""
    order = np.lexsort((cols, -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    # The first entry of a file is its best.
    files = file_no[cols]
    by_file = np.lexsort((np.arange(len(rows)), files, rows))
    new = np.ones(len(rows), dtype=bool)
    new[by_file[1:]] = (rows[by_file[1:]] != rows[by_file[:-1]]) | (files[by_file[1:]] != files[by_file[:-1]])
    rows, cols, scores = rows[new], cols[new], scores[new]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k], scores[place < k]


def nearest_files(queries: DataFrame, embeddings: DataFrame, k: int = 10) -> DataFrame:
    """The k most similar files per query by their best chunk, exact.

    `queries`: query_id, embedding. `embeddings`: file_id, chunk_no, embedding.
    Queries within MAX_QUERY_NUMBERS travel with the tasks and the vectors are read
    once, without a shuffle; more queries are joined block by block. Rows without a
    vector, as embedding leaves them after an error, are neither asked nor found.
    """
    embeddings = with_vector(embeddings)
    asked = with_vector(queries).select(F.col("query_id").cast("string").alias("query_id"), "embedding")
    dim = asked.limit(1).select(F.size("embedding")).first()
    if dim is None:
        few = []
    else:
        room = max(MAX_QUERY_NUMBERS // max(dim[0], 1), 1)
        few = asked.limit(room + 1).collect()
        if len(few) > room:
            return _finish(_block_join(asked, embeddings, k), k)
    id_type = embeddings.schema["file_id"].dataType.simpleString()
    names = np.array([r["query_id"] for r in few], dtype=object)
    matrix = _unit(pd.Series([r["embedding"] for r in few])) if few else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:
            if matrix is None or frame.empty:
                continue
            found = _best_of_slices(matrix, names, frame, k)
            # One running list of at most k files per query for the whole task.
            best = found if best is None else _keep_best(pd.concat([best, found]), k)
        if best is not None:
            yield best

    scored = embeddings.select("file_id", "chunk_no", "embedding").mapInPandas(run, SCORED.format(id=id_type))
    return _finish(scored, k)


def _keep_best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = rows.sort_values(["query_id", "score", "file_id", "chunk_no"], ascending=[True, False, True, True])
    return rows.drop_duplicates(["query_id", "file_id"]).groupby("query_id", sort=False).head(k)


def _blocks(rows: DataFrame) -> int:
    count, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    return max(1, -(-count // max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(dim or 0, 1)))))


def _block_join(queries: DataFrame, embeddings: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """Local best files for every pair of a query block and a vector block.

    Blocks are hash classes of unique keys, so no key can make one large.
    """
    id_type = embeddings.schema["file_id"].dataType.simpleString()
    right_blocks = _blocks(embeddings)
    left_blocks = right_blocks if skip_self else _blocks(queries)
    left = queries.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(left_blocks))).withColumn(
        "v_block", F.explode(F.sequence(F.lit(0), F.lit(right_blocks - 1)).cast("array<bigint>"))
    )
    right = embeddings.withColumn("v_block", F.pmod(F.xxhash64("file_id", "chunk_no"), F.lit(right_blocks))).withColumn(
        "q_block", F.explode(F.sequence(F.lit(0), F.lit(left_blocks - 1)).cast("array<bigint>"))
    )

    def run(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or stored.empty:
            return pd.DataFrame(columns=["query_id", "file_id", "chunk_no", "score"])
        return _best_of_slices(_unit(asked["embedding"]), asked["query_id"].to_numpy(), stored, k, skip_self)

    return (
        left.groupBy("q_block", "v_block")
        .cogroup(right.groupBy("q_block", "v_block"))
        .applyInPandas(run, SCORED.format(id=id_type))
    )


def _finish(scored: DataFrame, k: int) -> DataFrame:
    return top_k(best_per_file(scored), k)


def with_paths(results: DataFrame, files: DataFrame) -> DataFrame:
    """Result rows with the path of their file, `?` for an unknown one."""
    return results.join(files.select("file_id", "path"), "file_id", "left").withColumn(
        "path", F.coalesce("path", F.lit("?"))
    )


def file_vectors(embeddings: DataFrame) -> DataFrame:
    """file_id, embedding: the mean of the chunk vectors of a file.

    The mean is built per task before the shuffle, so a file with very many chunks is
    no large group.
    """
    mean = Summarizer.mean(array_to_vector(F.col("embedding")))
    return with_vector(embeddings).groupBy("file_id").agg(vector_to_array(mean).alias("embedding"))


def related_files(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """query_id, file_id, score, rank: the k most similar other files of every file, exact."""
    vectors = file_vectors(embeddings)
    asked = vectors.select(F.col("file_id").cast("string").alias("query_id"), "embedding")
    stored = vectors.select("file_id", F.lit(0).alias("chunk_no"), "embedding")
    scored = _block_join(asked, stored, k, skip_self=True)
    return _finish(scored, k).drop("chunk_no")


def compare_methods(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """Both ranked lists of each query side by side, one row per file in either."""
    left = keyword.select("query_id", "file_id", F.col("rank").alias("keyword_rank"))
    right = semantic.select("query_id", "file_id", F.col("rank").alias("semantic_rank"), F.col("score").alias("similarity"))
    return left.join(right, ["query_id", "file_id"], "full_outer").withColumn(
        "method",
        F.when(F.col("semantic_rank").isNull(), "keyword").when(F.col("keyword_rank").isNull(), "semantic").otherwise("both"),
    )
