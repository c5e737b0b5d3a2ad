"""Repeated passages by longest-previous-factor arrays: later copies go, the first one stays.

Only matches of `LENGTH` bytes or more count, so a suffix array of the whole corpus is not needed. Every window of
`LENGTH` bytes belongs to the smallest hash of its `GRAM`-byte strings; equal windows have the same one. Windows in a
row with the same smallest hash form a stretch. Stretches meet by that hash; those that are equal as a whole are settled
by their 128-bit mark, the texts of the others go into suffix order, where the previous and next smaller positions give
every window its longest earlier match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from passagework.llm.base import mixed, text_parts, written

LENGTH = 100
GRAM = 32
STEPS = LENGTH - GRAM + 1
#: Text whose hashes are in memory at once, and stretches whose suffixes are.
PART_BYTES = 1 << 18
SORT_BYTES = 1 << 20
#: A hash with more different stretches is common: its windows then meet one by one, spread over all tasks.
COMMON = 2_048

_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64))
_NO_ID = -(1 << 63)
SETTLED, OPEN, OPEN_COMMON = 0, 1, 2


def _doubled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of strings of twice `size` bytes from those of `size` bytes."""
    if len(hashes) <= size:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:-size] * _ODD + hashes[size:]
    out ^= out >> np.uint64(29)
    return out


def _long_mark(h64: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the `size` bytes at each start, 64 to 192 of them, from three 64-byte blocks that cover them."""
    out = mixed(h64[start] + size.astype(np.uint64))
    out = mixed(out * _ODD + h64[start + (size - 64) // 2])
    return mixed(out * _ODD + h64[start + size - 64])


def _slid(values: np.ndarray, of, width: int) -> np.ndarray:
    """The minimum or maximum (`of`) of every `width` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = of(values[: max(0, len(values) - step)], values[step:])
        done += step
    return values


def stretches(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, smallest hash, mark, loop) of the stretches of some texts, in order.

    `loop` tells that the smallest hash stands twice in a stretch, so that its own windows may be equal.
    """
    hashes = _TABLE[data]
    for size in (1, 2, 4, 8, 16):
        hashes = _doubled(hashes, size)
    h64 = _doubled(hashes, 32)
    grams = mixed(hashes)
    smallest = _slid(grams, np.minimum, STEPS)
    n = len(smallest)
    if not n:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),) * 2 + (np.zeros(0, dtype=bool),)
    # Windows that reach into the next text are none.
    valid = np.ones(n, dtype=bool)
    for border in borders[1:-1]:
        valid[max(0, border - LENGTH + 1) : border] = False
    new = np.ones(n, dtype=bool)
    new[1:] = (smallest[1:] != smallest[:-1]) | (valid[1:] != valid[:-1])
    starts = np.flatnonzero(new)
    # A text that repeats itself may keep its smallest hash for long: a stretch has STEPS windows at most.
    lengths = np.diff(np.append(starts, n))
    pieces = -(-lengths // STEPS)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(starts, pieces) + within * STEPS
    count = np.minimum(np.repeat(lengths, pieces) - within * STEPS, STEPS)
    kept = valid[first]
    first, count = first[kept], count[kept]
    text = np.searchsorted(borders, first, side="right") - 1
    # The places of smallest hashes: those that are the smallest of some window around them.
    wide = np.concatenate([np.zeros(STEPS - 1, dtype=np.uint64), smallest, np.zeros(STEPS - 1, dtype=np.uint64)])
    at = np.flatnonzero(_slid(wide, np.maximum, STEPS) == grams)
    twice = np.flatnonzero((grams[at[1:]] == grams[at[:-1]]) & (at[1:] - at[:-1] < STEPS))
    loop = np.searchsorted(at[twice + 1], first + count + STEPS - 1) > np.searchsorted(at[twice], first)
    return text, first - borders[text], count, smallest[first], _long_mark(h64, first, count + LENGTH - 1), loop


def _later(*columns: np.ndarray) -> np.ndarray:
    """Whether a row equals an earlier one; rows are in order of position."""
    order = np.lexsort(columns[::-1])
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for column in columns:
        same &= column[order][1:] == column[order][:-1]
    out = np.zeros(len(order), dtype=bool)
    out[order[1:]] = same
    return out


def _scattered(docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys for rows that need not meet any other."""
    return mixed(mixed(docs.view(np.uint64)) + places.astype(np.uint64)).view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, owns = batch.column("_doc").to_numpy(), batch.column("_own").to_numpy()
        found = []
        for first, _, data, borders in text_parts(batch.column("_text"), PART_BYTES):
            text, start, count, key, mark, loop = stretches(data, borders)
            found.append((ids[first + text], owns[first + text], (start * 128 + count) * 2 + loop, key.view(np.int64), mark.view(np.int64)))
        if not found:
            continue
        doc, own, place, key, mark = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((place, own, doc))
        doc, own, place, key, mark = doc[order], own[order], place[order], key[order], mark[order]
        once = ~_later(doc, own, place, key, mark)  # a row that came twice is no copy of itself
        doc, own, place, key, mark = doc[once], own[once], place[once], key[once], mark[once]
        # Copies inside the batch are settled here, so that a common passage sends one row from each batch.
        again = _later(key, mark)
        key = np.where(again, _scattered(doc ^ own, place), key)
        yield pa.RecordBatch.from_pydict({
            "key": pa.array(key), "mark": pa.array(np.where(again, 0, mark)), "doc": pa.array(doc), "own": pa.array(own),
            "place": pa.array(place * 2 + again),
        })


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by key, mark, position: later equal ones are settled, lone ones drop out, the others stay open."""
    held: list[np.ndarray] = []  # columns of the key that goes on, until it is common
    common, last = None, None  # a common key, and its last mark

    def judged(rows: np.ndarray, common_key: bool, before: int | None = None) -> pa.RecordBatch:
        key, mark, doc, own, place = rows
        again = place & 1 == 1
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
        if before is not None and len(key) and mark[0] == before:
            new[0] = False
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.append(starts, len(key)))
        marks = np.add.reduceat(new.astype(np.int64), starts) if len(key) else sizes
        several = np.repeat(marks > 1, sizes) | common_key | (place & 2 == 2)
        many = np.repeat(marks > COMMON, sizes) | common_key
        # A row that was read twice (the same document and place) is no copy of itself.
        same = np.zeros(len(key), dtype=bool)
        same[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (own[1:] == own[:-1]) & (place[1:] == place[:-1])
        state = np.where(again | ~new, SETTLED, np.where(many, OPEN_COMMON, OPEN))
        kept = (again | ~new | several) & ~(same & ~again)
        return pa.RecordBatch.from_pydict({
            "key": pa.array(key[kept]), "doc": pa.array(doc[kept]), "own": pa.array(own[kept]), "place": pa.array(place[kept] >> 2), "state": pa.array(state[kept].astype(np.int32)),
        })

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy() for c in ("key", "mark", "doc", "own", "place")])
        if not rows.shape[1]:
            continue
        if common is not None:
            cut = int(np.searchsorted(rows[0], common, side="right"))
            if cut:
                yield judged(rows[:, :cut], True, last)
                last = rows[1, cut - 1]
                rows = rows[:, cut:]
            if not rows.shape[1]:
                continue
            common = None
        rows = np.concatenate([*held, rows], axis=1)
        cut = int(np.searchsorted(rows[0], rows[0, -1]))
        yield judged(rows[:, :cut], False)
        tail = rows[:, cut:]
        held = [tail]
        if len(np.unique(tail[1])) > COMMON:
            yield judged(tail, True)
            common, last, held = tail[0, -1], tail[1, -1], []
    if held:
        yield judged(np.concatenate(held, axis=1), False)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of open stretches; those of common hashes window by window."""
    for batch in batches:
        keys, docs, owns, starts, bodies, settled = [], [], [], [], [], []
        wide: list[tuple[int, int, int, bytes]] = []
        columns = (batch.column(c).to_pylist() for c in ("_doc", "_own", "_text", "open"))
        for doc, own, text, places in zip(*columns, strict=True):
            raw = (text or "").encode()
            for row in places:
                start, count = row["place"] >> 7, row["place"] & 127
                if row["state"] == OPEN_COMMON:
                    wide += [(doc, own, s, raw[s : s + LENGTH]) for s in range(start, start + count)]
                else:
                    keys.append(row["key"])
                    docs.append(doc)
                    owns.append(own)
                    starts.append(start)
                    bodies.append(raw[start : start + count + LENGTH - 1])
                    settled.append(False)
        first: dict[bytes, tuple[int, int, int]] = {}
        for doc, own, start, body in sorted(wide):
            digest = hashlib.blake2b(body, digest_size=16).digest()
            again = first.setdefault(digest, (doc, own, start)) != (doc, own, start)
            keys.append(hash((doc, own, start)) if again else int.from_bytes(digest[:8], "little", signed=True))
            docs.append(doc)
            owns.append(own)
            starts.append(start)
            bodies.append(b"" if again else body)
            settled.append(again)
        yield pa.RecordBatch.from_pydict({
            "key": pa.array(keys, type=pa.int64()), "doc": pa.array(docs, type=pa.int64()), "own": pa.array(owns, type=pa.int64()),
            "start": pa.array(starts, type=pa.int64()), "body": pa.array(bodies, type=pa.binary()), "settled": pa.array(settled, type=pa.bool_()),
        })


def previous_factors(places: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factor of every suffix, in suffix order.

    `places` are the positions of the suffixes in that order, `common[i]` is the common prefix of suffix i with the one
    before it. The nearest smaller position on either side has the longest match that starts earlier. All suffixes look
    for theirs at once: one whose neighbour starts later goes on from where that neighbour got to.
    """
    best = np.zeros(len(places), dtype=np.int64)
    for side in (1, -1):
        at = places[::side]
        near = np.arange(len(at)) - 1
        low = (common if side == 1 else np.append(0, common[:0:-1])).astype(np.int64).copy()
        while True:
            go = np.flatnonzero((near >= 0) & (low > 0) & (at[np.maximum(near, 0)] > at))
            if not len(go):
                break
            through = near[go]
            low[go] = np.minimum(low[go], low[through])
            near[go] = near[through]
        found = np.where(near >= 0, low, 0)
        best = np.maximum(best, found[::side])
    return best


def repeated_windows(keys: np.ndarray, bodies: list[bytes]) -> list[np.ndarray]:
    """For every body, which of its windows an earlier body of its key holds too (or it itself, earlier); in order of position."""
    data = np.frombuffer(b"".join(bodies) + bytes(LENGTH), dtype=np.uint8)
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    counts = np.maximum(sizes - LENGTH + 1, 0)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(bodies)), counts)
    start = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    # Suffix order to a depth of LENGTH by doubling: eight bytes as one number, then ranks of pairs.
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    rank = np.ascontiguousarray(words).view(">u8")[:, 0].astype(np.uint64)
    size = 8
    while size < 64:
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        rank = (rank[:-size] << np.uint64(32)) | rank[size:]
        size *= 2
    head, tail = rank[start], rank[start + LENGTH - 64]
    order = np.lexsort((tail, head, keys[owner]))
    common = np.zeros(len(order), dtype=np.int64)
    same = (head[order][1:] == head[order][:-1]) & (tail[order][1:] == tail[order][:-1]) & (keys[owner[order]][1:] == keys[owner[order]][:-1])
    common[1:] = same * LENGTH
    flags = np.zeros(len(order), dtype=bool)
    flags[order] = previous_factors(order, common) >= LENGTH
    return np.split(flags, np.cumsum(counts)[:-1])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bodies sorted by key and position: the runs of bytes that are repeated."""

    def spans(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        keys, docs, owns, starts = (rows.column(c).combine_chunks().to_numpy() for c in ("key", "doc", "own", "start"))
        bodies, settled = rows.column("body").to_pylist(), rows.column("settled").to_pylist()
        out_doc, out_own, out_start, out_end = [], [], [], []
        fresh = _fresh(keys, docs, owns, starts, settled)
        chosen = np.flatnonzero(fresh)
        for i, flags in zip(chosen, repeated_windows(keys[chosen], [bodies[i] for i in chosen]) if len(chosen) else [], strict=True):
            if flags.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                for s, e in zip(edges[::2], edges[1::2], strict=True):
                    out_doc.append(docs[i])
                    out_own.append(owns[i])
                    out_start.append(starts[i] + s)
                    out_end.append(starts[i] + e - 1 + LENGTH)
        for i in np.flatnonzero(settled):
            out_doc.append(docs[i])
            out_own.append(owns[i])
            out_start.append(starts[i])
            out_end.append(starts[i] + LENGTH)
        return pa.RecordBatch.from_pydict({
            "doc": pa.array(out_doc, type=pa.int64()), "own": pa.array(out_own, type=pa.int64()),
            "start": pa.array(out_start, type=pa.int64()), "end": pa.array(out_end, type=pa.int64()),
        })

    held, size = [], 0
    for batch in batches:
        keys = batch.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        at = 0
        while at < cut:  # whole keys, about SORT_BYTES at a time
            lengths = np.cumsum([len(b) for b in batch.column("body").slice(at, cut - at).to_pylist()]) + size
            most = int(np.searchsorted(lengths, SORT_BYTES)) + 1
            end = int(np.searchsorted(keys, keys[min(at + most, cut - 1)], side="right"))
            held.append(batch.slice(at, end - at))
            size += int(lengths[end - at - 1]) - size
            at = end
            if size >= SORT_BYTES:
                yield spans(held)
                held, size = [], 0
        held.append(batch.slice(cut))
        size += batch.slice(cut).nbytes
    if held:
        yield spans(held)


def _fresh(keys: np.ndarray, docs: np.ndarray, owns: np.ndarray, starts: np.ndarray, settled: list[bool]) -> np.ndarray:
    """Rows to compare: not settled, and not the row before read twice."""
    out = ~np.array(settled, dtype=bool)
    out[1:] &= (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]) | (owns[1:] != owns[:-1]) | (starts[1:] != starts[:-1])
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, spans, kept = [], [], [], []
        for text, runs in zip(batch.column("_text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            raw = (text or "").encode()
            sizes.append(len(raw))
            merged: list[int] = []
            for s, e in sorted((r["start"], min(r["end"], len(raw))) for r in runs or ()):
                if s >= e:
                    continue
                if merged and s <= merged[-1]:
                    merged[-1] = max(merged[-1], e)
                else:
                    merged += [s, e]
            edges = [0, *merged, len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            removed.append(len(raw) - len(kept[-1]))
            spans.append(merged)
        yield pa.RecordBatch.from_pydict({
            "_row": batch.column("_row"), "n_bytes": pa.array(sizes, type=pa.int64()), "n_removed": pa.array(removed, type=pa.int64()),
            "spans": pa.array(spans, type=pa.list_(pa.int64())), "kept": pa.array(kept, type=pa.binary()),
        })


def without_repeats(docs: DataFrame, carry: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_row: the columns `carry`, n_bytes, n_removed, spans, kept) for every row of `docs`.

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a document with a smaller key, or in the
    same one. `spans` has begin and end of the removed runs in turn, `kept` the bytes that stay. Strings are judged on
    the input. Texts are UTF-8 bytes; null and empty ones, and those below 100 bytes, lose nothing.

    A null key comes before all others. A document is a key and a hash of its text, for a null key of all its columns;
    documents of one key are in order of that hash. Rows that agree in both are one row read more than once, which is
    no copy of itself: what is removed from one of them is removed from all.

    Shuffled are about a thirtieth of all positions as (hash, mark, document, place), the texts once by their document, and the bytes
    around places where copies begin or end. Copies that agree as a whole are settled on their marks, inside a batch
    before the shuffle; a hash with over `COMMON` different stretches is spread window by window.
    """
    spark = docs.sparkSession
    ids = F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    own = F.when(F.col(key).isNull(), F.xxhash64(F.col(text), F.to_json(F.struct(*others)))).otherwise(F.xxhash64(F.col(text)))
    texts = docs.select(ids.alias("_doc"), own.alias("_own"), F.col(text).alias("_text"), F.struct(*carry).alias("_row"))
    rows = texts.select("_doc", "_own", "_text").mapInArrow(_anchor_rows, "key long, mark long, doc long, own long, place long")
    rows = rows.repartition("key").sortWithinPartitions("key", "mark", "doc", "own", "place")
    found = written(rows.mapInArrow(_settle, "key long, doc long, own long, place long, state int"), "stretches")

    by_doc = texts.repartition("_doc", "_own")  # both joins below use this one exchange
    opened = found.filter(F.col("state") != SETTLED).groupBy("doc", "own").agg(F.collect_list(F.struct("key", "place", "state")).alias("open"))
    this = (F.col("_doc") == F.col("doc")) & (F.col("_own") == F.col("own"))
    pairs = by_doc.join(opened, this, "left").filter("open is not null").select("_row", "_doc", "_own", "_text", "open")
    bodies = pairs.mapInArrow(_contexts, "key long, doc long, own long, start long, body binary, settled boolean")
    bodies = bodies.repartition("key").sortWithinPartitions("key", "doc", "own", "start")
    matches = bodies.mapInArrow(_match, "doc long, own long, start long, end long")

    settled = found.filter(F.col("state") == SETTLED).withColumn("start", F.shiftright("place", 7))
    settled = settled.select("doc", "own", "start", (F.col("start") + F.col("place").bitwiseAND(127) + LENGTH - 1).alias("end"))
    runs = matches.unionByName(settled).groupBy("doc", "own").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    both = by_doc.join(runs, this, "left").select("_row", "_text", "runs")
    kind = T.StructType([
        texts.schema["_row"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("kept", T.BinaryType()),
    ])
    return both.mapInArrow(_remove, kind)
