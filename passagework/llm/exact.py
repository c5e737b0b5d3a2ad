"""Exact dedup: binary fuse filters of immutable snapshots screen incoming digests, positives are checked byte by byte."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from passagework.llm.base import text_or_empty, written
from passagework.llm.fuse import FuseFilter
from passagework.operators.joins import bounded_rows

#: Keys that one filter is made for; the filters of a snapshot are as many as its keys ask for.
BUCKET_KEYS = 1 << 16
#: A group of more than this part of all rows meets its rows by broadcast; there are no more such groups than that.
HOT_GROUPS = 4096
#: Deliveries that the query takes `documents` as.
DELIVERIES = 3

MARK = ["digest", "other", "n_bytes"]
Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass(frozen=True)
class Snapshot:
    """Texts taken in before, never changed: their marks, one filter for each bucket of keys, and the texts themselves."""

    marks: DataFrame
    filters: DataFrame
    buckets: int
    texts: DataFrame


def marked(docs: DataFrame, text: str = "text", digest: Digest = sha256) -> DataFrame:
    """`docs` with the mark of their text: a digest, another hash and the size; a null text counts as empty."""
    body = text_or_empty(f"`{text}`")
    return docs.withColumns({"digest": digest(body), "other": F.xxhash64(body), "n_bytes": F.octet_length(body).cast("long")})


def _key() -> Column:
    return F.xxhash64("digest")


def freeze(marks: DataFrame, texts: DataFrame) -> Snapshot:
    """The snapshot of some texts: `marks` are their distinct marks, `texts` their rows (digest, other, n_bytes, _text).

    Keys are dealt into buckets, and each bucket makes its filter in a task of its own.
    """
    keys = marks.select(_key().alias("key")).distinct()
    buckets = max(1, -(-keys.count() // BUCKET_KEYS))
    dealt = keys.withColumn("bucket", _bucket(buckets))
    filters = dealt.groupBy("bucket").applyInArrow(_filter_of, "bucket int, body binary")
    return Snapshot(marks, written(filters, "filters"), buckets, texts)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.col("key"), F.lit(buckets)).cast("int")


def _filter_of(rows: pa.Table) -> pa.Table:
    keys = rows.column("key").to_numpy().view(np.uint64)
    body = FuseFilter.of(keys).to_bytes()
    return pa.table({"bucket": rows.column("bucket")[:1], "body": pa.array([body], type=pa.binary())})


def screened(marks: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """(snapshot, digest) of the marks whose key a filter of that snapshot holds: all that are there and few others.

    Keys and filters meet by bucket; a task has one filter at a time and the keys of the bucket pass by it.
    """
    marks = marks.select("digest").distinct()
    sides = []
    for number, snapshot in enumerate(snapshots):
        at = F.lit(number).alias("snapshot")
        sides.append(snapshot.filters.select(at, "bucket", F.lit(0).cast("long").alias("key"), "body", F.lit(None).cast("binary").alias("digest")))
        asked = marks.withColumn("key", _key()).withColumn("bucket", _bucket(snapshot.buckets))
        sides.append(asked.select(at, "bucket", "key", F.lit(None).cast("binary").alias("body"), "digest"))
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side)
    rows = rows.repartition("snapshot", "bucket").sortWithinPartitions("snapshot", "bucket", F.col("body").isNull())
    return rows.mapInArrow(_screen, "snapshot int, digest binary")


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, of = None, None
    for batch in batches:
        snapshot, bucket, body = (batch.column(n) for n in ("snapshot", "bucket", "body"))
        keys = batch.column("key").to_numpy().view(np.uint64)
        place = np.stack([snapshot.to_numpy(), bucket.to_numpy()])
        # Borders: a filter row, or a bucket that has none.
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (place[:, 1:] != place[:, :-1]).any(axis=0)
        new |= ~np.asarray(body.is_null())
        begins = np.append(np.flatnonzero(new), len(keys))
        for begin, end in zip(begins[:-1], begins[1:], strict=True):
            here = tuple(place[:, begin])
            if body[begin].is_valid:
                held, of = FuseFilter.from_bytes(body[begin].as_py()), here
                begin += 1
            if begin < end and of == here:
                found = pa.array(held.holds(keys[begin:end]))
                yield pa.RecordBatch.from_pydict({
                    "snapshot": snapshot.slice(begin, end - begin).filter(found),
                    "digest": batch.column("digest").slice(begin, end - begin).filter(found),
                })


def known(texts: DataFrame, positives: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """The marks of incoming `texts` that a snapshot holds, byte for byte.

    Only texts of positive digests move: to a checked number of digests the texts of both sides are sought by
    broadcast, beyond it by a shuffle. Of each side one text of a mark is compared.
    """
    count = bounded_rows(positives)
    hint = F.broadcast if count is not None else lambda frame: frame
    found = None
    for number, snapshot in enumerate(snapshots):
        wanted = positives.filter(F.col("snapshot") == number).select("digest")
        one = lambda rows: rows.join(hint(wanted), "digest", "left_semi").groupBy(*MARK).agg(F.first("_text").alias("_text"))  # noqa: E731, B023
        theirs = one(snapshot.texts).select("digest", F.col("_text").alias("_stored"))
        same = one(texts).join(theirs, "digest").filter(F.col("_text").cast("binary") == F.col("_stored").cast("binary")).select(*MARK)
        found = same if found is None else found.unionByName(same)
    return found.distinct()


def taken_in(
    docs: DataFrame, snapshots: Sequence[Snapshot], text: str = "text", digest: Digest = sha256, marks: DataFrame | None = None
) -> tuple[DataFrame, Snapshot | None]:
    """(marks of `docs` with `new`: no snapshot holds the text, the snapshot of the new texts or None).

    Texts that repeat inside the batch are grouped apart, by their marks, and are asked about once. `marks` are those
    of the rows if they are known.
    """
    rows = marked(docs, text, digest).select(*MARK, text_or_empty(f"`{text}`").alias("_text"))
    marks = written((rows if marks is None else marks).select(*MARK).distinct(), "marks")
    old = marks.limit(0)
    if snapshots:
        positives = written(screened(marks, snapshots), "positives")
        old = written(known(rows, positives, snapshots), "known")
    judged = marks.join(old.withColumn("_old", F.lit(True)), MARK, "left").select(*MARK, F.col("_old").isNull().alias("new"))
    judged = written(judged, "judged")
    fresh = judged.filter("new").select(*MARK)
    return judged, None if fresh.isEmpty() else freeze(fresh, rows)


def exact_groups(docs: DataFrame, carry: list[str], key: str = "doc_id", text: str = "text", deliveries: int = DELIVERIES, digest: Digest = sha256) -> DataFrame:
    """(_row: the columns `carry`, keep_id, group_size, kept, digest, first_delivery) for every row of `docs`.

    `docs` come as so many deliveries, dealt by the hash of the key; each is screened by the snapshots of those before
    and leaves a snapshot of its new texts. Rows of equal texts form a group, whichever deliveries they came with.
    The row with the largest key stays; of rows that share it, and of rows without a key, one does. A null text
    is empty. A very long text costs its digest and, if it is positive, one comparison.

    A text is known if a snapshot holds the same bytes; inside a batch texts are equal if digest, second hash and size
    are. Marks are shuffled, texts only of positives. Rows find their group by a join on the mark; the groups of
    more than a `HOT_GROUPS`-th of all rows, which are at most so many, are broadcast.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in carry])
    body = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"), row.alias("_row"))
    delivered = body.withColumn("_delivery", F.pmod(F.xxhash64("_key"), F.lit(deliveries)).cast("int"))
    rows = marked(delivered, "_text", digest).withColumn("_place", F.monotonically_increasing_id())
    rows = written(rows.drop("_text"), "rows")

    snapshots: list[Snapshot] = []
    firsts = None
    for number in range(deliveries):
        own = F.col("_delivery") == number
        judged, snapshot = taken_in(delivered.filter(own), snapshots, "_text", digest, rows.filter(own))
        new = judged.filter("new").select(*MARK, F.lit(number).alias("first_delivery"))
        firsts = new if firsts is None else firsts.unionByName(new)
        snapshots += [snapshot] if snapshot else []

    best = F.max(F.struct("_key", (-F.col("_place")).alias("place")))
    groups = rows.groupBy(*MARK).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.join(firsts, MARK).select(
        *MARK, F.col("best._key").alias("keep_id"), (-F.col("best.place")).alias("_keep"), "group_size", "first_delivery"
    )
    return with_groups(rows, written(groups, "groups"))


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the columns of their group; a group with many rows is not gathered in one task."""
    total = rows.count()
    hot = F.col("group_size") * HOT_GROUPS > total
    large = groups.filter(hot)  # fewer than `HOT_GROUPS`, as their sizes add up to no more than all rows
    common = rows.join(F.broadcast(large), MARK)
    rest = rows.join(F.broadcast(large.select(*MARK)), MARK, "left_anti").join(groups.filter(~hot), MARK)
    found = common.unionByName(rest.select(common.columns))
    return found.withColumn("kept", F.col("_place") == F.col("_keep")).select(
        "_row", "keep_id", "group_size", "kept", "digest", "first_delivery"
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with; each text is written once and goes to its group once."""
    found = exact_groups(docs, docs.columns, key, text)
    return found.filter("kept").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
