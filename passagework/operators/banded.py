"""Related files at scale: signs of random projections find candidates, exact scores rank them.

Files with equal vectors are one class, so copies meet nobody twice. Each class goes into one bucket for each band; the
buckets are compared with the exact cosine, and each class hands on its k best. The vectors copied are bands times the
classes: linear in the input but for the bands, which grow slowly with the count (about its third root at 0.8).

Where vectors crowd together, buckets hold a large part of all classes, and all bands together as many pairs as there
are. Such classes are compared with all others instead, once and without a chance of missing any: classes are packed
into blocks, and tasks read pairs of blocks, so that no vector is copied for the pairs it is in. Blocks hold classes near
each other; classes that cannot be near enough to any of a tile of a block, by its middle and radius, are not scored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import acos, ceil, isqrt, log, log2, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from passagework.operators.joins import bounded_join, bounded_rows
from passagework.operators.ranking import best_per_file, top_k
from passagework.operators.semantic import ERROR, SCORED, _best_of_slices, _kth, _scores, _unit, file_vectors
from passagework.session import arrow_batches, written

# Tasks get the functions of this module themselves and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 7
# Classes that share a bucket on average; more of them ask for longer keys.
BUCKET_ROWS = 8192
# A bucket above so many classes is dealt into blocks, each pair of which is a task's work.
BLOCK_ROWS = 32_768
# Classes whose buckets hold together so large a part of all classes are compared with all.
CROWDED = 0.25
# Classes of a packed block and of a tile, bytes of the blocks that a task reads again and again, centres of blocks.
PACKED_ROWS, TILE, READ_BYTES, CENTRES = 16_384, 1024, 128 * 1024 * 1024, 64
# A pair of blocks is a row of some MB: a few at a time are enough.
BATCH_BYTES = 8 * 1024 * 1024


def band_plan(count: int, similarity: float, missed: float) -> tuple[int, int]:
    """Bits of a key and number of bands, so that a pair at `similarity` meets nowhere with a chance of `missed` at most."""
    if not 0 < similarity <= 1 or not 0 < missed < 1:
        raise ValueError("similarity and missed lie between 0 and 1")
    width = max(4, ceil(log2(max(count, 1) / BUCKET_ROWS + 1)))
    meet = (1 - acos(similarity) / pi) ** width
    return width, 1 if meet >= 1 else ceil(log(missed) / log(1 - meet))


def _band_keys(unit: np.ndarray, width: int, bands: int) -> Iterator[np.ndarray]:
    for band in range(bands):
        planes = np.random.default_rng([SEED, band]).standard_normal((unit.shape[1], width))
        signs = unit @ planes > 0
        yield signs @ (np.int64(1) << np.arange(width, dtype=np.int64)) + (np.int64(band) << 40)


def _keys(width: int, bands: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            for key in _band_keys(_unit(frame["embedding"]), width, bands):
                yield frame.assign(key=key)

    return run


def _bucket_best(k: int, similarity: float):
    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        rows = bucket.rename(columns={"least": "file_id"}).assign(chunk_no=0)
        return _best_of_slices(_unit(rows["embedding"]), rows["file_id"].astype(str).to_numpy(), rows, k, True, similarity)

    return run


def _dealt(keyed: DataFrame) -> DataFrame:
    """Rows of large buckets dealt into blocks: any two meet under at least one key of two blocks."""
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_ROWS)
    large = written(large.select("key", F.ceil(2 * F.col("n") / BLOCK_ROWS).cast("long").alias("blocks")), "blocks")
    both = bounded_join(keyed, large, ["key"], bounded_rows(large), [F.col("least")], "left")
    own = F.pmod(F.xxhash64("least"), F.col("blocks"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.xxhash64("key", F.least(own, other), F.greatest(own, other)),
    )
    keys = F.when(F.col("blocks").isNull(), F.array("key")).otherwise(pairs)
    return both.select(F.explode(keys).alias("key"), "least", "embedding")


# Crowded classes --------------------------------------------------------------------------


def _units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a column that is not empty; zeros where a vector has no finite length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.unique(column.value_lengths())
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[-1]} numbers")
    matrix = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=(lengths > 0) & np.isfinite(lengths))


def _bucket_sizes(width: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            some = [np.unique(key, return_counts=True) for key in _band_keys(_units(batch.column(0)), width, bands)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*some)], ["key", "n"])

    return run


def _marks(width: int, bands: int, keys: np.ndarray, sizes: np.ndarray, most: float):
    """A column `crowded` more: whether the large buckets of a class hold `most` classes together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = np.zeros(batch.num_rows)
            for key in _band_keys(_units(batch.column("embedding")), width, bands):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                held += np.where(keys[at] == key, sizes[at], 0)
            yield batch.append_column("crowded", pa.array(held >= most))

    return run


def _marked(classes: DataFrame, count: int, width: int, bands: int) -> DataFrame | None:
    """The classes with `crowded`; none if no class is. Few classes are in no large bucket and need no other way."""
    if count <= BLOCK_ROWS:
        return None
    sizes = classes.select("embedding").mapInArrow(_bucket_sizes(width, bands), "key long, n long")
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("n"))
    # Buckets below half the average of what makes a class crowded do not count: those that do are few, whatever the input.
    large = sorted((r["key"], r["n"]) for r in sizes.filter(F.col("n") >= CROWDED * count / (2 * bands)).collect())
    if not large:
        return None
    keys, sizes = (np.array(x, np.int64) for x in zip(*large))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", crowded boolean"
    return written(classes.mapInArrow(_marks(width, bands, keys, sizes, CROWDED * count), schema), "marked")


def _nearest_centres(centres: np.ndarray):
    """Columns more: `centre`, the number of the nearest, and `far`, which grows with the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sims = _units(batch.column("embedding")) @ centres.T
            centre = sims.argmax(axis=1)
            batch = batch.append_column("centre", pa.array(centre.astype(np.int32)))
            yield batch.append_column("far", pa.array(-sims[np.arange(len(centre)), centre]))

    return run


def _pack(table: pa.Table) -> pa.Table:
    table = table.sort_by([("far", "ascending"), ("least", "ascending")]).combine_chunks()
    unit = _units(table["embedding"])
    files = pa.ListArray.from_arrays([0, len(unit)], table["least"].combine_chunks())
    return pa.table({"block": table["block"][:1], "files": files, "unit": pa.array([unit.tobytes()], pa.binary())})


class _Nearest:
    """The k best files of every class of a block, of those a task has met; the middles and radii of the block's tiles."""

    def __init__(self, files: np.ndarray, unit: np.ndarray, k: int, similarity: float):
        self.files, self.similarity = files, similarity
        self.scores, self.found = np.full((len(files), k), -np.inf), np.zeros((len(files), k), files.dtype)
        # What k files are known to reach.
        self.floor = np.full(len(files), similarity)
        tiles = [unit[at:at + TILE] for at in range(0, len(unit), TILE)]
        self.middles = np.array([tile.mean(axis=0) for tile in tiles])
        self.radii = np.array([np.linalg.norm(tile - x, axis=1).max() for tile, x in zip(tiles, self.middles)])

    def reached(self, single: np.ndarray) -> np.ndarray:
        """What the products of some vectors with those of each tile reach at most, but for the error of single precision."""
        return single @ self.middles.T.astype(np.float32) + self.radii.astype(np.float32)

    def offer(
        self, unit: np.ndarray, mine: np.ndarray, files: np.ndarray, others: np.ndarray, theirs: np.ndarray,
        sims: np.ndarray, across: bool,
    ) -> None:
        """Products in single precision of some classes, in rows or across, and others: what may be best is scored anew."""
        error, k = _error(unit), self.scores.shape[1]
        floor = self.floor[mine]
        good = sims >= _bar(floor - error, across)
        met = np.count_nonzero(good)
        if not met:
            return
        if met > 8 * k * len(mine):
            floor = np.maximum(floor, _kth(np.ascontiguousarray(sims.T) if across else sims, k) - error)
            good = sims >= _bar(floor - error, across)
        rows, cols = np.divmod(_true(good), sims.shape[1])
        if across:
            rows, cols = cols, rows
        rows, cols = mine[rows], theirs[cols]
        scores = _scores(unit, others, rows, cols)
        near = scores >= self.similarity
        if near.any():
            self._keep(rows[near], files[cols[near]], scores[near])

    def _keep(self, rows: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
        hit, k = np.unique(rows), self.scores.shape[1]
        rows = np.concatenate([np.repeat(hit, k), rows])
        found = np.concatenate([self.found[hit].ravel(), found])
        scores = np.concatenate([self.scores[hit].ravel(), scores])
        order = np.lexsort((found, -scores, rows))
        rows = rows[order]
        best = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]
        self.found = self.found.astype(found.dtype, copy=False)
        self.found[hit], self.scores[hit] = found[best].reshape(-1, k), scores[best].reshape(-1, k)
        self.floor[hit] = np.maximum(self.floor[hit], self.scores[hit, -1])

    def rows(self, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.files), 4096):
            row, place = np.nonzero(self.scores[at:at + 4096] > -np.inf)
            if len(row):
                yield pa.RecordBatch.from_arrays([
                    pa.array(self.files[row + at].astype(str), pa.string()), pa.array(self.found[row + at, place], id_type),
                    pa.array(np.zeros(len(row), np.int32)), pa.array(self.scores[row + at, place]),
                ], ["query_id", "file_id", "chunk_no", "score"])


def _error(unit: np.ndarray) -> float:
    return ERROR * (unit.shape[1] + 8)


def _bar(floor: np.ndarray, across: bool) -> np.ndarray:
    bar = np.nextafter(floor.astype(np.float32), np.float32(-np.inf))
    return bar if across else bar[:, None]


def _true(good: np.ndarray) -> np.ndarray:
    """Where few of many flags are set."""
    flat = good.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    at = (8 * np.flatnonzero(flat.view(np.uint64))[:, None] + np.arange(8)).ravel()
    return at[flat[at]]


def _meet(left: _Nearest, a: np.ndarray, right: _Nearest, b: np.ndarray) -> None:
    """All pairs of two blocks, or of one with itself; each product serves both classes of a pair."""
    x, y = a.astype(np.float32), b.astype(np.float32)
    from_left, from_right = right.reached(x) + 2 * _error(a), left.reached(y) + 2 * _error(a)
    for i in range(0, len(a), TILE):
        for j in range(i if left is right else 0, len(b), TILE):
            mine, theirs = np.arange(i, min(i + TILE, len(a))), np.arange(j, min(j + TILE, len(b)))
            same = left is right and i == j
            if not same:
                # A pair matters if it reaches what either class asks for.
                mine = mine[from_left[mine, j // TILE] >= np.minimum(left.floor[mine], right.floor[theirs].min())]
                if not len(mine):
                    continue
                theirs = theirs[from_right[theirs, i // TILE] >= np.minimum(right.floor[theirs], left.floor[mine].min())]
                if not len(theirs):
                    continue
            sims = x[mine] @ y[theirs].T
            if same:
                np.fill_diagonal(sims, -np.inf)
            left.offer(a, mine, right.files, b, theirs, sims, False)
            if not same:
                right.offer(b, theirs, left.files, a, mine, sims, True)


def _blocks_best(k: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, id_type = {}, None
        for batch in batches:
            for at in range(batch.num_rows):
                sides = []
                for side in ("a", "b"):
                    no, listed, unit = (batch.column(f"{side}_{c}")[at] for c in ("block", "files", "unit"))
                    id_type, files = listed.values.type, listed.values.to_numpy(zero_copy_only=False)
                    unit = np.frombuffer(unit.as_buffer(), np.float64).reshape(len(files), -1)
                    if no.as_py() not in met:
                        met[no.as_py()] = _Nearest(files.astype(str) if files.dtype == object else files, unit, k, similarity)
                    sides += [met[no.as_py()], unit]
                _meet(*sides)
        for best in met.values():
            yield from best.rows(id_type)

    return run


def _packed(marked: DataFrame) -> tuple[DataFrame, int, int]:
    """block, files, unit: each class in one block; the number of blocks, and of the crowded ones, which come first."""
    id_type = marked.schema["least"].dataType.simpleString()
    # Any classes serve as centres: they order the work and decide no result.
    some = marked.orderBy(F.xxhash64("least"), "least").limit(CENTRES).select("embedding").collect()
    schema = f"least {id_type}, embedding array<double>, crowded boolean, centre int, far double"
    rows = marked.select("least", "embedding", "crowded")
    rows = rows.mapInArrow(_nearest_centres(_unit(pd.Series([r["embedding"] for r in some]))), schema)
    n = {(r["crowded"], r["centre"]): r["count"] for r in rows.groupBy("crowded", "centre").count().collect()}
    starts, sizes, blocks = {}, {}, 0
    for kind in sorted(n, key=lambda x: (not x[0], x[1])):
        starts[kind], sizes[kind] = blocks, ceil(n[kind] / PACKED_ROWS)
        blocks += sizes[kind]
    crowded = sum(size for kind, size in sizes.items() if kind[0])
    listed = lambda of, x: F.array(*(F.lit(of.get((x, c), 1)).cast("long") for c in range(len(some))))
    own = lambda of: F.get(F.when(F.col("crowded"), listed(of, True)).otherwise(listed(of, False)), F.col("centre"))
    block = own(starts) + F.pmod(F.xxhash64("least"), own(sizes))
    rows = rows.select(block.alias("block"), "least", "embedding", "far")
    return rows.groupBy("block").applyInArrow(_pack, f"block long, files array<{id_type}>, unit binary"), blocks, crowded


def _crowded_best(marked: DataFrame, k: int, similarity: float) -> DataFrame:
    """The best files of each class, of all pairs with a crowded one."""
    packed, blocks, crowded = _packed(marked)
    slots = marked.sparkSession.sparkContext.defaultParallelism
    dim = marked.select(F.size("embedding")).first()[0]
    # A task reads its own part of the blocks once for each block of another part.
    parts = min(blocks, max(isqrt(8 * slots), ceil(8 * dim * marked.count() / READ_BYTES)))
    # Blocks next to each other hold classes near each other and go to different parts.
    placed = packed.withColumn("part", F.pmod("block", F.lit(parts)).cast("int")).repartitionById(parts, F.col("part"))
    left, right = (placed.select(*(F.col(c).alias(f"{side}_{c}") for c in placed.columns)) for side in "ab")
    # Without a key to shuffle by: Spark reads the parts for each pair of them and copies nothing.
    once = (F.col("a_part") < F.col("b_part")) | ((F.col("a_part") == F.col("b_part")) & (F.col("a_block") <= F.col("b_block")))
    some = F.least("a_block", "b_block") < crowded
    pairs = left.join(right.hint("shuffle_replicate_nl"), once & some)
    id_type = marked.schema["least"].dataType.simpleString()
    with arrow_batches(marked.sparkSession, BATCH_BYTES):
        return written(pairs.mapInArrow(_blocks_best(k, similarity), SCORED.format(id=id_type)), "met")


def related_banded(embeddings: DataFrame, k: int = 10, similarity: float = 0.8, missed: float = 0.01) -> DataFrame:
    """query_id, file_id, score, rank: up to k other files of every file with a cosine of `similarity` or more.

    Scores are exact. A file at `similarity` is left out with a chance of `missed`, nearer ones with less; equal vectors
    never, nor any pair with a crowded class. `semantic.related_files` has no such chance and no threshold, at the cost of
    all pairs. Files without a vector, or with a zero one, are related to none.
    """
    vectors = file_vectors(embeddings)
    # 96 bits name a vector.
    named = F.concat_ws(".", F.xxhash64("embedding"), F.hash("embedding"))
    some = F.exists("embedding", lambda x: x != 0)
    vectors = written(vectors.filter(some).withColumn("vector", named), "vectors")
    # k + 1 members of a class are as many as any list can take; the cut is made before the shuffle.
    first = F.row_number().over(Window.partitionBy("vector").orderBy("file_id"))
    members = vectors.withColumn("place", first).filter(F.col("place") <= k + 1)
    classes = members.groupBy("vector").agg(
        F.min("file_id").alias("least"), F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("file_id")).alias("files")
    )
    classes = written(classes, "classes")

    id_type = embeddings.schema["file_id"].dataType.simpleString()
    count = classes.count()
    width, bands = band_plan(count, similarity, missed)
    rows = classes.select("least", "embedding")
    marked = _marked(rows.filter(F.col("least").isNotNull()), count, width, bands)
    if marked is not None:
        rows = marked.filter(~F.col("crowded")).drop("crowded")
    keyed = rows.mapInPandas(_keys(width, bands), f"key long, least {id_type}, embedding array<double>")
    # A bucket's best files come with their scores; bands repeat pairs, which best_per_file makes one.
    scored = _dealt(keyed).groupBy("key").applyInPandas(_bucket_best(k, similarity), SCORED.format(id=id_type))
    scored = best_per_file(scored.filter(F.col("score") >= similarity))
    if marked is not None:
        scored = scored.unionByName(_crowded_best(marked, k, similarity))
    near = top_k(scored, k)

    own = classes.select("vector", F.explode("files").alias("file_id"), F.lit(1.0).alias("score"))
    names = classes.select("vector", F.col("least").cast("string").alias("query_id"))
    others = classes.select(F.col("least").alias("file_id"), "files")
    found = near.join(others, "file_id").join(names, "query_id").select("vector", F.explode("files").alias("file_id"), "score")
    # At most (k + 1) ** 2 rows for each class.
    entry = F.struct((-F.col("score")).alias("back"), "file_id")
    lists = own.union(found).groupBy("vector").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k + 1).alias("list"))
    lists = written(lists, "lists")
    files = vectors.select("vector", F.col("file_id").alias("asked"))
    joined = bounded_join(files, lists, ["vector"], bounded_rows(lists), [F.col("asked")])
    kept = F.slice(F.filter("list", lambda x: x["file_id"] != F.col("asked")), 1, k)
    rows = joined.select(F.col("asked").cast("string").alias("query_id"), F.posexplode(kept).alias("at", "hit"))
    return rows.select("query_id", F.col("hit.file_id").alias("file_id"), (-F.col("hit.back")).alias("score"), (F.col("at") + 1).alias("rank"))
