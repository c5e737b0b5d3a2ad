"""The best rows of each query within a task, so that only few rows are sorted and shuffled.

A batch of queries may meet most chunks. Ranking all its hits by a window sorts every one
of them and, where files are told apart, shuffles one row for each query and file. Here a
task keeps a running list of what may be among the k best of a query and passes on that.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Tasks get the functions of this module themselves and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows that are cut at once, and rows that a task holds on to: more are passed on, which loses nothing.
CUT_ROWS, HELD_ROWS = 1 << 18, 1 << 20
ORDER = ("file_id", "chunk_no")


def leaders(hits: DataFrame, k: int, tie: Sequence[str] = ORDER, per_file: bool = False, score: str = "score") -> DataFrame:
    """Rows of `hits` that hold the k best rows of every query, or with `per_file` the best row of its k best files.

    The order is that of `ranking.top_k` (and `ranking.best_per_file`), which decide afterwards: a row
    among the k best of all is among the k best of its task, and so is a file by its best chunk.
    """
    return hits.mapInArrow(_run(k, tuple(tie), per_file, score), hits.schema)


def _run(k: int, tie: tuple[str, ...], per_file: bool, score: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, fresh = 0, [], 0
        for batch in batches:
            parts.append(batch)
            fresh += batch.num_rows
            if fresh < max(CUT_ROWS, held):
                continue
            kept = _cut(pa.Table.from_batches(parts), k, tie, per_file, score)
            held, parts, fresh = kept.num_rows, kept.to_batches(), 0
            if held > HELD_ROWS:
                yield from parts
                held, parts = 0, []
        if parts:
            yield from _cut(pa.Table.from_batches(parts), k, tie, per_file, score).to_batches()

    return run


def _cut(rows: pa.Table, k: int, tie: tuple[str, ...], per_file: bool, score: str) -> pa.Table:
    query, (kind, less) = _ranks(rows["query_id"]), _descending(rows[score])
    at = np.arange(rows.num_rows)
    if per_file:
        file = _ranks(rows["file_id"])
        order = np.lexsort((_ranks(rows["chunk_no"]), less, kind, file, query))
        at = order[_begins(query[order], file[order])]
    ties = [_ranks(rows[name])[at] for name in reversed(tie)]
    at = at[np.lexsort((*ties, less[at], kind[at], query[at]))]
    begins = np.flatnonzero(_begins(query[at]))
    place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    return rows.take(pa.array(np.sort(at[place < k]))).combine_chunks()


def _begins(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values, nulls first."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    coded = pa.chunked_array([column.combine_chunks()]).dictionary_encode(null_encoding="encode").combine_chunks()
    values = coded.dictionary
    place = np.empty(len(values), np.int64)
    place[pc.array_sort_indices(values, null_placement="at_start").to_numpy()] = np.arange(len(values))
    return place[coded.indices.to_numpy()]


def _descending(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Two keys whose ascending order is Spark's descending one: NaN before all numbers, null after them."""
    missing = column.is_null().to_numpy()
    value = column.cast(pa.float64()).fill_null(0.0).to_numpy()
    nan = np.isnan(value)
    return np.where(missing, 2, np.where(nan, 0, 1)), np.where(nan, 0.0, -value)
