"""A stored index: Parquet tables written in batches of files.

Every attempt at a batch writes folders of its own, `<table>/batch=<n>/attempt=<name>`,
and touches nothing written before. Its last act is one row of `commits`, which names
the attempt: readers follow the commits, so what a broken run left behind is never
read, and a batch that runs again replaces its earlier attempt at once or not at all.
One writer at a time.

A batch knows what it replaces. Its `marks` name the versions that its files take the
place of, and its commit carries the difference in chunks, words and grams, so
that corpus statistics are sums over commits and only marked versions are left out
while reading. A deletion is a file row with `deleted`. `rebuild` writes all live rows
as the one batch of a new folder.

Postings are split into hash buckets of the term and sorted by term inside, so a
query reads the buckets of its words and skips row groups by their term range; those
of words lie in lists, many in a row. Dictionaries are in order of the term. Chunks lie in segments, as they come, without a
shuffle, sorted by file inside in small row groups; `places` tells the segment of each
file, so the texts of a result are read from the row groups they lie in.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from passagework.operators import catalog, chunking, filters, postings
from passagework.operators.joins import MAX_BROADCAST_ROWS, bounded_rows
from passagework.operators.matching import bucket_of
from passagework.plans.corpus import Corpus
from passagework.plans.incremental import change_set
from passagework.schemas import CHUNK_KEY, META

BUCKETS, SEGMENTS = 64, 256
# Text per bucket and per segment that `sized` aims at.
PART_BYTES = 16 * 1024**3
# Text per row group of the chunks: what one result costs to read.
GROUP_BYTES = 8 * 1024**2
# Rows of word lists in a page.
PAGE_ROWS = 1000
# The row of a chunk table that holds the file itself.
FILE_ROW = -1
TOTALS = ["n_chunks", "n_words", "n_grams"]
# The table of word postings; an index of single rows, named `words`, is not mistaken for one of lists.
WORDS = "word_lists"


@dataclass(frozen=True)
class Store:
    """Where an index lives and how it is cut."""

    folder: str
    buckets: int = BUCKETS
    chunk_lines: int = chunking.CHUNK_LINES
    overlap_lines: int = chunking.OVERLAP_LINES
    max_bytes: int | None = None
    extensions: tuple[str, ...] | None = None
    with_grams: bool = True
    segments: int = SEGMENTS
    group_bytes: int = GROUP_BYTES

    @classmethod
    def sized(cls, folder: str, text_bytes: int, **options) -> Store:
        """A store cut for a corpus of about `text_bytes`."""
        parts = max(BUCKETS, -(-text_bytes // PART_BYTES))
        return cls(folder, **{"buckets": parts, "segments": max(SEGMENTS, parts), **options})

    def table(self, name: str) -> str:
        return f"{self.folder}/{name}"


COMMIT = T.StructType([
    T.StructField("batch", T.IntegerType()), T.StructField("attempt", T.IntegerType()), T.StructField("name", T.StringType()),
    # What a stream calls the batch, so that it finds it again.
    T.StructField("stream", T.StringType()), T.StructField("epoch", T.LongType()),
    T.StructField("with_texts", T.BooleanType()),
    *[T.StructField(n, T.LongType()) for n in ("n_files", "n_chunks", "n_words", "n_grams", "n_marks", "n_unread")],
    T.StructField("written_at", T.TimestampType()),
])


def commits(store: Store, spark: SparkSession) -> list:
    """The commit that counts of every batch, in their order: one small row for each run since the last rebuild."""
    try:
        rows = spark.read.schema(COMMIT).parquet(store.table("commits")).collect()
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return []
    last = {r.batch: r for r in sorted(rows, key=lambda r: (r.batch, r.attempt))}
    return [last[b] for b in sorted(last)]


def complete_batches(store: Store, spark: SparkSession) -> list[int]:
    """Numbers of the batches that were written to their end."""
    return [c.batch for c in commits(store, spark)]


def stream_batch(store: Store, spark: SparkSession, stream: str, epoch: int) -> int:
    """The number of a stream's batch: that of its earlier attempt, or the next one."""
    done = commits(store, spark)
    own = [c.batch for c in done if (c.stream, c.epoch) == (stream, epoch)]
    return own[0] if own else _next(done)


def _next(done: list) -> int:
    return done[-1].batch + 1 if done else 0


@dataclass(frozen=True)
class Attempt:
    """One run of a batch: the commits it builds on and the folders it writes."""

    store: Store
    batch: int
    number: int
    name: str
    before: list

    @staticmethod
    def of(store: Store, spark: SparkSession, batch: int | None) -> Attempt:
        done = commits(store, spark)
        batch = _next(done) if batch is None else batch
        if done and batch < done[-1].batch:
            raise ValueError(f"batch {batch} is followed by batch {done[-1].batch}, which builds on it")
        earlier = [c.attempt for c in done if c.batch == batch]
        number = max(earlier, default=0) + 1
        return Attempt(store, batch, number, f"{number}-{uuid.uuid4().hex}", [c for c in done if c.batch < batch])

    def folder(self, table: str) -> str:
        return f"{self.store.table(table)}/batch={self.batch}/attempt={self.name}"

    def write(self, frame: DataFrame, table: str, *partitions: str) -> None:
        # A row group holds few texts, so that a result does not cost many.
        writer = frame.write.option("parquet.block.size", str(self.store.group_bytes if table == "chunks" else 128 * 1024**2))
        if table == WORDS:
            # Sorted words and rising numbers: differences are smaller than a dictionary, and sooner written.
            # Pages of few rows, so that a query word does not cost many.
            page = {"parquet.page.row.count.limit": str(PAGE_ROWS)}
            writer = writer.options(**{"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", **page})
        (writer.partitionBy(*partitions) if partitions else writer).parquet(self.folder(table))

    def read(self, spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(self.folder(table))

    def commit(self, spark: SparkSession, stream: str | None, epoch: int | None, with_texts: bool, counts: dict[str, int]) -> None:
        at = datetime.now(timezone.utc).replace(tzinfo=None)
        row = {"batch": self.batch, "attempt": self.number, "name": self.name, "stream": stream, "epoch": epoch,
               "with_texts": with_texts, **counts, "written_at": at}
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.timestamp("us", "UTC")]
        columns = [pa.array([row[f.name]], kind) for f, kind in zip(COMMIT.fields, kinds, strict=True)]
        # One row is one file: it is there or it is not.
        spark.createDataFrame(pa.table(columns, names=COMMIT.names), COMMIT).coalesce(1).write.mode("append").parquet(self.store.table("commits"))


# Schemas are given when reading: a batch without words leaves no file to infer one from.


def _read(store: Store, spark: SparkSession, table: str, schema: T.StructType, done: list) -> DataFrame:
    """A table of the committed attempts, with `batch`."""
    parts = [T.StructField("batch", T.IntegerType()), T.StructField("attempt", T.StringType())]
    partitions = [f for f in schema.fields if f.name in ("segment", "bucket")]
    inner = [f for f in schema.fields if f not in partitions]
    paths = [f"{store.table(table)}/batch={c.batch}/attempt={c.name}" for c in done]
    whole = T.StructType([*inner, *parts, *partitions])
    if not paths:
        return spark.createDataFrame([], whole).drop("attempt")
    return spark.read.schema(whole).option("basePath", store.table(table)).parquet(*paths).drop("attempt")


def _integers(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.IntegerType()) for n in names]


def _chunk_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("file_id", id_type), *_integers("chunk_no"), T.StructField("content", T.StringType()),
        *_integers("n_words", "n_grams", "segment"),
    ])


def _place_schema(id_type: T.DataType) -> T.StructType:
    # The segment is data here: places are found by file.
    return T.StructType([T.StructField("file_id", id_type), *_integers("lies_in"), *[T.StructField(n, T.LongType()) for n in TOTALS]])


def _mark_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("file_id", id_type), *_integers("replaced"), *[T.StructField(n, T.LongType()) for n in TOTALS]])


def _gram_schema(id_type: T.DataType) -> T.StructType:
    key = [T.StructField("term", T.StringType()), T.StructField("file_id", id_type), *_integers("chunk_no")]
    return T.StructType([*key, *_integers("bucket")])


def _list_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([*postings.lists_schema(id_type).fields, *_integers("bucket")])


TERMS = T.StructType([T.StructField("term", T.StringType()), T.StructField("df", T.LongType())])
GRAM_PARTS = T.StructType([T.StructField("part", T.StringType()), *TERMS.fields])


def write_batch(
    store: Store, files: DataFrame, batch: int | None = None, meta_only: bool = False, all_files: bool = False,
    stream: str | None = None, epoch: int | None = None, expected: DataFrame | None = None,
) -> int:
    """Write file rows (with `content`) and all that follows from them as one batch; returns its number.

    Without `batch` it is the next one. The number of the last batch replaces that
    batch; an earlier number is refused, as later batches build on it. `meta_only` leaves
    out chunks and postings; `all_files` chunks files of any extension. Rows with `deleted`
    set only mark their path as gone. Files of any size are taken unless the store has
    `max_bytes`. The input is evaluated once, so a file is in the batch as a whole or not
    at all; paths that were `expected` and did not come are counted in the commit as unread.
    """
    spark = files.sparkSession
    attempt = Attempt.of(store, spark, batch)
    if "deleted" not in files.columns:
        files = files.withColumn("deleted", F.lit(False))
    id_type, meta = files.schema["file_id"].dataType, [c for c in files.columns if c != "content"]
    attempt.write(_cut(store, files, meta, meta_only, all_files), "chunks", "segment")
    kind = T.StructType([*_chunk_schema(id_type).fields[:-1], T.StructField("file", files.select(*meta).schema), *_integers("segment")])
    rows = attempt.read(spark, "chunks", kind)
    chunks = rows.filter(F.col("chunk_no") > FILE_ROW).drop("file", "segment")
    if not meta_only:
        _write_words(attempt, spark, id_type, postings.word_lists(chunks))
        if store.with_grams:
            _write_grams(attempt, spark, id_type, postings.gram_presence(chunks))
    _finish(attempt, spark, rows, id_type, not meta_only, stream, epoch, expected)
    return attempt.batch


def _cut(store: Store, files: DataFrame, meta: list[str], meta_only: bool, all_files: bool) -> DataFrame:
    """One row for every file and one for each of its chunks, sorted by file inside the segments."""
    readable = ~F.col("deleted") & F.col("content").isNotNull() & F.lit(not meta_only)
    if not all_files:
        readable = readable & filters.is_text_extension(store.extensions) & (F.col("size_bytes") > 0)
    if store.max_bytes is not None:
        readable = readable & (F.col("size_bytes") <= store.max_bytes)
    windows = F.when(F.coalesce(readable, F.lit(False)), chunking.kept_windows(F.col("content"), store.chunk_lines, store.overlap_lines))
    # The outer form keeps files without chunks: their one row is the file row.
    cut = files.select(
        F.struct(*meta).alias("file"),
        F.explode(F.concat(
            F.array(F.struct(F.lit(FILE_ROW).alias("chunk_no"), F.lit(None).cast("string").alias("content"))),
            F.coalesce(F.transform(windows, lambda w, i: F.struct(i.alias("chunk_no"), w.alias("content"))), F.array()),
        )).alias("chunk"),
    )
    rows = cut.select(
        F.col("file.file_id").alias("file_id"), "chunk.chunk_no", "chunk.content",
        F.when(F.col("chunk.chunk_no") == FILE_ROW, F.col("file")).alias("file"),
    )
    measured = postings.with_lengths(rows).withColumn("segment", F.pmod(F.spark_partition_id(), F.lit(store.segments)))
    return measured.select("file_id", "chunk_no", "content", "n_words", "n_grams", "file", "segment").sortWithinPartitions("segment", *CHUNK_KEY)


def _write_words(attempt: Attempt, spark: SparkSession, id_type: T.DataType, lists: DataFrame) -> None:
    attempt.write(_dealt(attempt, lists).sortWithinPartitions("bucket", "term"), WORDS, "bucket")
    _write_dictionary(attempt, "vocabulary", postings.list_stats(attempt.read(spark, WORDS, _list_schema(id_type))))


def _write_grams(attempt: Attempt, spark: SparkSession, id_type: T.DataType, rows: DataFrame) -> None:
    dealt = _dealt(attempt, rows)
    if "places" in rows.columns:
        # Sorted as they come, many places in a row, and dealt out after it.
        dealt = dealt.sortWithinPartitions("bucket", "term", F.get("places", F.lit(0))["file_id"])
        dealt = dealt.select("term", F.inline("places"), "bucket")
    else:
        dealt = dealt.sortWithinPartitions("bucket", "term", *CHUNK_KEY)
    attempt.write(dealt, "grams", "bucket")
    _write_dictionary(attempt, "gram_vocabulary", postings.term_stats(attempt.read(spark, "grams", _gram_schema(id_type))))
    # Which stored grams hold a part of one or two characters.
    parts = postings.gram_parts(attempt.read(spark, "gram_vocabulary", TERMS))
    attempt.write(parts.repartitionByRange("part").sortWithinPartitions("part", "term"), "gram_parts")


def _dealt(attempt: Attempt, rows: DataFrame) -> DataFrame:
    # `rebalance` splits the bucket of a hot term over several tasks and files. As many parts as buckets: fewer
    # would hold several each, and every task would write a small file for all of them.
    n = attempt.store.buckets
    return rows.withColumn("bucket", bucket_of(F.col("term"), n)).hint("rebalance", n, "bucket")


def _write_dictionary(attempt: Attempt, table: str, stats: DataFrame) -> None:
    # In order of the term, so that the words of a prefix lie together.
    attempt.write(stats.repartitionByRange("term").sortWithinPartitions("term"), table)


def _finish(
    attempt: Attempt, spark: SparkSession, rows: DataFrame, id_type: T.DataType, with_texts: bool, stream: str | None = None,
    epoch: int | None = None, expected: DataFrame | None = None,
) -> None:
    """File rows, places, marks and the commit, from the rows of the chunk table."""
    files = rows.filter(F.col("chunk_no") == FILE_ROW).select("file.*")
    attempt.write(files, "files")
    unread = 0 if expected is None else expected.join(attempt.read(spark, "files", files.schema).select("path"), "path", "left_anti").count()
    places = rows.groupBy("file_id").agg(
        F.max("segment").alias("lies_in"), F.count(F.when(F.col("chunk_no") > FILE_ROW, 1)).alias("n_chunks"),
        *[F.coalesce(F.sum(F.when(F.col("chunk_no") > FILE_ROW, F.col(n))), F.lit(0)).alias(n) for n in ("n_words", "n_grams")],
    )
    attempt.write(places.repartitionByRange("file_id").sortWithinPartitions("file_id"), "places")
    written = attempt.read(spark, "places", _place_schema(id_type))
    sums = lambda frame: frame.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(n), F.lit(0)) for n in TOTALS]).first()
    own = sums(written)
    replaced = [0] * 4
    if attempt.before and own[0]:
        ids = written.select("file_id")
        small = F.broadcast(ids) if bounded_rows(ids) is not None else ids
        old = _alive(attempt.store, spark, id_type, attempt.before)(_read(attempt.store, spark, "places", _place_schema(id_type), attempt.before))
        marks = old.join(small, "file_id", "left_semi").select("file_id", F.col("batch").alias("replaced"), *TOTALS)
        attempt.write(marks, "marks")
        replaced = sums(attempt.read(spark, "marks", _mark_schema(id_type)))
    counts = {"n_files": own[0], "n_marks": replaced[0], "n_unread": unread}
    counts |= {name: own[i] - replaced[i] for i, name in enumerate(TOTALS, 1)}
    attempt.commit(spark, stream, epoch, with_texts, counts)


def _alive(store: Store, spark: SparkSession, id_type: T.DataType, done: list) -> Callable[[DataFrame], DataFrame]:
    """Leaves out rows (file_id, batch) of replaced versions. Marks are few against what they are taken from."""
    marking = [c for c in done if c.n_marks]
    if not marking:
        return lambda rows: rows
    marks = _read(store, spark, "marks", _mark_schema(id_type), marking).select("file_id", F.col("replaced").alias("batch"))
    small = sum(c.n_marks for c in marking) <= MAX_BROADCAST_ROWS
    return lambda rows: rows.join(F.broadcast(marks) if small else marks, ["file_id", "batch"], "left_anti").select(rows.columns)


def _file_schema(store: Store, spark: SparkSession, done: list) -> T.StructType:
    last = done[-1]
    return spark.read.parquet(f"{store.table('files')}/batch={last.batch}/attempt={last.name}").schema


#: File rows of a store without batches.
NO_FILES = "file_id string, path string, filename string, extension string, size_bytes long, modified timestamp, lang string, " \
    "title string, tags array<string>, indexed_at timestamp, batch int"


def _files(store: Store, spark: SparkSession, done: list) -> DataFrame:
    if not done:
        return spark.createDataFrame([], NO_FILES)
    schema = _file_schema(store, spark, done)
    rows = _alive(store, spark, schema["file_id"].dataType, done)(_read(store, spark, "files", schema, done))
    return rows.filter(~F.col("deleted")).drop("deleted")


def live_files(store: Store, spark: SparkSession) -> DataFrame:
    """The newest row of every path that is not deleted, with its `batch`."""
    return _files(store, spark, commits(store, spark))


def open_corpus(store: Store, spark: SparkSession) -> Corpus:
    """The stored index as a corpus of its live files. Statistics come from the commits; no table is read for them."""
    done = commits(store, spark)
    texts = [c for c in done if c.with_texts]
    files = _files(store, spark, done)
    id_type = files.schema["file_id"].dataType
    alive = _alive(store, spark, id_type, done)
    read = lambda table, schema: _read(store, spark, table, schema, texts)
    all_texts = read("chunks", _chunk_schema(id_type)).filter(F.col("chunk_no") > FILE_ROW)
    grams, lists = store.with_grams, read(WORDS, _list_schema(id_type))
    return Corpus(
        files=files.drop("batch"),
        chunks=alive(all_texts).drop("segment", "batch"),
        stats=_stats(spark, done),
        words=postings.postings_of(lists),
        grams=read("grams", _gram_schema(id_type)) if grams else None,
        # Several batches may count replaced files: enough to find words and to choose
        # the rarer gram, never used as a score.
        vocabulary=read("vocabulary", TERMS).drop("batch"),
        gram_vocabulary=read("gram_vocabulary", TERMS).drop("batch") if grams else None,
        gram_parts=read("gram_parts", GRAM_PARTS).drop("batch") if grams else None,
        buckets=store.buckets,
        texts=all_texts.select(*CHUNK_KEY, "content", "segment", "batch"),
        places=_read(store, spark, "places", _place_schema(id_type), done).select("file_id", F.col("lies_in").alias("segment"), "batch"),
        alive=alive,
        word_lists=lists,
    )


def _stats(spark: SparkSession, done: list) -> DataFrame:
    """One row of corpus statistics, summed from the commits."""
    n, words, grams = (sum(getattr(c, name) for c in done) for name in TOTALS)
    mean = lambda total: pa.array([total / n if n else None], pa.float64())
    row = [pa.array([n]), pa.array([words]), pa.array([grams]), mean(words), mean(grams)]
    return spark.createDataFrame(pa.table(row, names=["n_chunks", "total_words", "total_grams", "avg_words", "avg_grams"]))


def rebuild(store: Store, folder: str, spark: SparkSession) -> Store:
    """Write the live rows of all batches as the next batch of another folder, a new one as a rule; sources are not read again."""
    done, target = commits(store, spark), replace(store, folder=folder)
    attempt = Attempt.of(target, spark, None)
    if attempt.before:
        raise ValueError(f"{folder} holds an index already")
    schema = _file_schema(store, spark, done)
    id_type = schema["file_id"].dataType
    alive = _alive(store, spark, id_type, done)
    kind = T.StructType([*_chunk_schema(id_type).fields[:-1], T.StructField("file", schema), *_integers("segment")])
    rows = alive(_read(store, spark, "chunks", kind, done)).filter((F.col("chunk_no") > FILE_ROW) | ~F.col("file.deleted"))
    dealt = rows.withColumn("segment", F.pmod(F.xxhash64("batch", "segment"), F.lit(store.segments)).cast("int"))
    # Old segments move as a whole: the rows of a file stay together without a shuffle.
    dealt = dealt.sortWithinPartitions("segment", *CHUNK_KEY)
    attempt.write(dealt.select("file_id", "chunk_no", "content", "n_words", "n_grams", "file", "segment"), "chunks", "segment")
    corpus = open_corpus(store, spark)
    _write_words(attempt, spark, id_type, postings.lists_of(alive(corpus.words)))
    if store.with_grams:
        _write_grams(attempt, spark, id_type, alive(corpus.grams).drop("batch", "bucket"))
    _finish(attempt, spark, attempt.read(spark, "chunks", kind), id_type, True)
    return target


def stored_before(store: Store, spark: SparkSession, batch: int | None) -> DataFrame:
    """Live file rows as they were before `batch` (None: now), so that a repeated run sees the same state."""
    done = [c for c in commits(store, spark) if batch is None or c.batch < batch]
    return _files(store, spark, done).drop("batch")


def update(
    store: Store, listed: DataFrame, batch: int | None = None, all_files: bool = False, names: DataFrame | None = None,
    stream: str | None = None, epoch: int | None = None,
) -> DataFrame:
    """Write the difference between a listing with contents and the stored files as a batch.

    Returns the change set. Deciding what changed reads no contents. Contents are read
    from the oldest modification time among the changes on, a filter that file and
    Parquet scans apply before they open or decode anything.

    `names` is the listing without contents, if there is one. A file whose text could
    not be read counts as unread in the commit, keeps its stored version, and is due again.
    """
    spark = listed.sparkSession
    attempt = Attempt.of(store, spark, batch)
    stored = _files(store, spark, attempt.before).drop("batch")
    found = change_set(stored, listed if names is None else names)
    # Small rows, written once: they steer the batch and are handed back.
    attempt.write(found, "changes")
    changes = attempt.read(spark, "changes", T.StructType([T.StructField("path", T.StringType()), T.StructField("change", T.StringType())]))
    wanted = changes.filter(F.col("change").isin("new", "changed")).select("path")
    gone = changes.filter(F.col("change") == "deleted").select("path")
    # One look at the wanted rows: whether there are any, and their oldest time if all have one.
    times = listed.select("path", "modified").join(wanted, "path", "left_semi").agg(
        F.count(F.lit(1)), F.count("modified"), F.unix_micros(F.min("modified"))
    ).first()
    if not times[0]:
        fresh = listed.filter(F.lit(False))
    elif times[0] == times[1]:
        fresh = listed.filter(F.col("modified") >= F.timestamp_micros(F.lit(times[2]))).join(wanted, "path", "left_semi")
    else:
        late = F.col("modified") >= F.timestamp_micros(F.lit(times[2]))
        fresh = listed.filter(F.col("modified").isNull() | late).join(wanted, "path", "left_semi")
    removed = stored.join(gone, "path", "left_semi").withColumns(
        {"content": F.lit(None).cast("string"), "deleted": F.lit(True)}
    )
    rows = fresh.withColumn("deleted", F.lit(False))
    if attempt.before:
        rows = rows.unionByName(removed, allowMissingColumns=True)
    write_batch(store, rows, attempt.batch, all_files=all_files, stream=stream, epoch=epoch, expected=wanted)
    return changes


def set_meta(store: Store, spark: SparkSession, key: str, value: str, at: datetime) -> None:
    """Append a value; the last one written counts."""
    spark.createDataFrame([(key, value, at)], META).write.mode("append").parquet(store.table("meta"))


def get_meta(store: Store, spark: SparkSession) -> DataFrame:
    return catalog.latest_meta(spark.read.schema(META).parquet(store.table("meta")))


def set_last_indexed(store: Store, spark: SparkSession, at: datetime) -> None:
    set_meta(store, spark, "last_indexed_at", at.isoformat(), at)
