"""Batches of one-word clauses, met and scored chunk by chunk.

A chunk meets most queries of a batch on some word, so a row for every clause and chunk is
many times the text. Here only the postings of the query words are placed by file, one
row per word and chunk; the clauses of a batch are known to every task, which sums what a
chunk gives to each query and passes on the queries met.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from passagework.operators.clauses import CLAUSE_KEY, ClauseTable
from passagework.operators.joins import MAX_BROADCAST_ROWS
from passagework.schemas import CHUNK_KEY

# Tasks get the functions of this module themselves and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSTING = [*CHUNK_KEY, "dl", "term_no", "tf"]


class Bag:
    """The clauses of a bounded table as arrays, by number of their word.

    `of_term[t]:of_term[t + 1]` are the clauses of word `t`; each has its group and
    whether it is required; each group its query and the number of required clauses.
    """

    def __init__(self, rows: list):
        self.terms = sorted({r.term for r in rows})
        number = {t: i for i, t in enumerate(self.terms)}
        rows = sorted(rows, key=lambda r: number[r.term])
        queries = sorted({r.query_id for r in rows})
        groups = sorted({(r.query_id, r.group_no) for r in rows})
        query_no, group_no = ({x: i for i, x in enumerate(xs)} for xs in (queries, groups))
        self.queries = pa.array(queries, pa.string())
        self.of_term = np.searchsorted([number[r.term] for r in rows], np.arange(len(self.terms) + 1))
        self.group = np.array([group_no[r.query_id, r.group_no] for r in rows], np.int64)
        self.must = np.array([r.kind == "must" for r in rows])
        self.banned = np.array([r.kind == "must_not" for r in rows])
        self.query = np.array([query_no[q] for q, _ in groups], np.int64)
        self.n_must = np.bincount(self.group[self.must], minlength=len(groups))

    def numbers(self, spark: SparkSession) -> DataFrame:
        """term, term_no of the words."""
        columns = [pa.array(self.terms, pa.string()), pa.array(range(len(self.terms)), pa.int32())]
        return spark.createDataFrame(pa.table(columns, names=["term", "term_no"]))

    def met(self, chunk: np.ndarray, term: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunk, query and score of the queries met by postings given by the number of their chunk."""
        first, size = self.of_term[term], self.of_term[term + 1] - self.of_term[term]
        clause = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        must = self.must[clause]
        keys, place = np.unique(np.repeat(chunk, size) * len(self.query) + self.group[clause], return_inverse=True)
        sums = lambda weights: np.bincount(place, weights, len(keys))
        group = keys % len(self.query)
        good = (sums(must) == self.n_must[group]) & (sums(self.banned[clause]) == 0)
        score = sums(np.where(must, np.repeat(value, size), 0.0))[good]
        keys, place = np.unique((keys // len(self.query) * len(self.queries) + self.query[group])[good], return_inverse=True)
        return keys // len(self.queries), keys % len(self.queries), np.bincount(place, score, len(keys))


def bag_of(table: ClauseTable) -> Bag | None:
    """The table as a bag if it is a bounded list of one-word clauses with keys of their own; it is read once."""
    if not table.one_word or "prefix" in table.forms or table.rows is None or table.rows > MAX_BROADCAST_ROWS:
        return None
    rows = table.frame.select(*CLAUSE_KEY, "kind", F.explode("terms").alias("term")).collect()
    keys = {tuple(r[c] for c in CLAUSE_KEY) for r in rows}
    if len(keys) < len(rows) or any(None in key for key in keys) or not rows:
        return None
    return Bag(rows)


def placed(found: DataFrame, repeated: bool) -> DataFrame:
    """Postings by file. Where chunk keys may repeat, the frequencies of equal keys are summed."""
    rows = found.select(*POSTING).repartition("file_id")
    if not repeated:
        return rows
    # Rows of a file are in one place already: no shuffle.
    return rows.groupBy(*CHUNK_KEY, "dl", "term_no").agg(F.sum("tf").cast("int").alias("tf")).select(*POSTING)


def frequencies(rows: DataFrame) -> DataFrame:
    """term_no, df. Every column is named and none filters, so that both uses of the postings share their shuffle."""
    counted = (F.col("tf") > 0) & (F.col("dl") >= 0) & (F.col("chunk_no") >= 0)
    return rows.groupBy("term_no").agg(F.count(F.when(counted, 1)).alias("df"))


def queries_met(rows: DataFrame, bag: Bag) -> DataFrame:
    """query_id, file_id, chunk_no, score of the queries met by placed postings with their `value`."""
    rows = rows.select(*CHUNK_KEY, "term_no", "value")
    schema = T.StructType([
        T.StructField("query_id", T.StringType()), *(rows.schema[c] for c in CHUNK_KEY), T.StructField("score", T.DoubleType()),
    ])
    return rows.sortWithinPartitions(*CHUNK_KEY).mapInArrow(_in_runs(bag), schema)


def _in_runs(bag: Bag) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if left is None else pa.concat_tables([left, rows])
            if rows.num_rows == 0:
                continue
            # The last chunk may go on in the next batch.
            begins = _begins(rows)
            yield from _results(rows.slice(0, begins[-1]), begins[:-1], bag)
            left = rows.slice(begins[-1])
        if left is not None:
            yield from _results(left, np.array([0]), bag)

    return run


def _begins(rows: pa.Table) -> np.ndarray:
    """Where the chunks begin in rows sorted by chunk."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for name in CHUNK_KEY:
        codes = pc.dictionary_encode(rows[name].combine_chunks(), null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _results(rows: pa.Table, begins: np.ndarray, bag: Bag) -> Iterator[pa.RecordBatch]:
    if rows.num_rows == 0:
        return
    chunk = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, rows.num_rows)))
    at, query, score = bag.met(chunk, rows["term_no"].to_numpy(), rows["value"].to_numpy())
    keys = [rows[name].take(pa.array(begins[at])) for name in CHUNK_KEY]
    table = pa.table([bag.queries.take(pa.array(query)), *keys, pa.array(score)], names=["query_id", *CHUNK_KEY, "score"])
    yield from table.combine_chunks().to_batches()
