"""The frames a search runs on."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from passagework.operators import chunking, postings
from passagework.operators.joins import MAX_BROADCAST_ROWS
from passagework.schemas import CHUNK_KEY
from passagework.session import written

# Up to this many rows are looked up by their files: the ids become filters of the scan.
LOCATED_ROWS = 512


def _as_they_are(rows: DataFrame) -> DataFrame:
    return rows


@dataclass(frozen=True)
class Corpus:
    """Files, their chunks and one row of corpus statistics.

    A scanned corpus has only these and finds words by reading the chunks. A stored
    one also has postings (`words`, `grams`) and dictionaries (`vocabulary`,
    `gram_vocabulary`, `gram_parts`) and reads the postings of the query words alone. Its
    `texts` are the chunk rows, `places` tells segment and batch of every file. These
    tables hold all versions of a file: `alive` leaves out the rows (file_id, batch) of
    replaced ones, and is best applied to what little a lookup has found.
    """

    files: DataFrame
    chunks: DataFrame
    stats: DataFrame
    words: DataFrame | None = None
    grams: DataFrame | None = None
    vocabulary: DataFrame | None = None
    gram_vocabulary: DataFrame | None = None
    gram_parts: DataFrame | None = None
    buckets: int | None = None
    texts: DataFrame | None = None
    places: DataFrame | None = None
    alive: Callable[[DataFrame], DataFrame] = _as_they_are
    # What `words` are dealt out from.
    word_lists: DataFrame | None = None


def scan_corpus(files: DataFrame, size: int = chunking.CHUNK_LINES, overlap: int = chunking.OVERLAP_LINES) -> Corpus:
    """A corpus over file rows with a `content` column; nothing is stored."""
    chunks = postings.with_lengths(chunking.cut_chunks(files.select("file_id", "content"), size, overlap))
    return Corpus(files.drop("content"), chunks, postings.corpus_stats(chunks))


def any_of(tests: Sequence[Column]) -> Column:
    """One of the tests holds, as a balanced tree: a list of values would reach the scan as a range only."""
    if len(tests) <= 1:
        return tests[0] if tests else F.lit(False)
    half = len(tests) // 2
    return any_of(tests[:half]) | any_of(tests[half:])


def attach_texts(rows: DataFrame, corpus: Corpus, bound: int | None) -> DataFrame:
    """Rows of chunks with the `content` of their chunk; `bound` is a proven row count or None.

    In a stored corpus few rows are evaluated first, once: their files give the segments,
    and segments and ids become filters of the scan, so that only the row groups are read
    that may hold them. More rows meet their texts by a join in which segments prune. In a
    scanned corpus few rows are evaluated once as well, and a semi join on the file moves
    below the chunking, so only files with a row are cut again. Chunk keys are unique: nothing can be skewed.
    """
    small = bound is not None and bound <= MAX_BROADCAST_ROWS
    if corpus.places is None:
        hint = F.broadcast if small else _as_they_are
        texts = corpus.chunks.select(*CHUNK_KEY, "content")
        if small:
            # Needed twice, found once.
            rows = written(rows, "found")
            texts = texts.join(F.broadcast(rows.select("file_id").distinct()), "file_id", "left_semi")
        return texts.join(hint(rows), CHUNK_KEY)
    if bound is None or bound > LOCATED_ROWS:
        rows = written(rows, "found")
        bound = rows.count()
    if bound <= LOCATED_ROWS:
        return _located_texts(rows, corpus)
    hint = F.broadcast if bound <= MAX_BROADCAST_ROWS else _as_they_are
    located = corpus.alive(corpus.places).join(hint(rows), "file_id")
    return corpus.texts.join(hint(located), [*CHUNK_KEY, "segment", "batch"]).drop("segment", "batch")


def _located_texts(rows: DataFrame, corpus: Corpus) -> DataFrame:
    spark, schema = rows.sparkSession, rows.schema
    here = spark.createDataFrame(rows.toArrow(), schema)
    ids = sorted({r.file_id for r in here.select("file_id").collect() if r.file_id is not None})
    is_wanted = any_of([F.col("file_id") == F.lit(i) for i in ids])
    places = corpus.alive(corpus.places.filter(is_wanted)).toArrow()
    found = spark.createDataFrame(places, corpus.places.schema)
    spots = sorted({(r.batch, r.segment) for r in found.collect()})
    in_place = any_of([(F.col("batch") == b) & (F.col("segment") == s) for b, s in spots])
    texts = corpus.texts.filter(in_place & is_wanted)
    return texts.join(F.broadcast(found.join(here, "file_id")), [*CHUNK_KEY, "segment", "batch"]).drop("segment", "batch")
