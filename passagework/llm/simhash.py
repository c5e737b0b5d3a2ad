"""SimHash near-duplicates: fingerprints of shingles, compared bit plane by bit plane."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from passagework.llm.base import mixed, text_parts, written
from passagework.llm.components import components

SEED = 42
#: Rows whose pairs a task compares at once.
BLOCK_ROWS = 8_192
#: Bits in which linked fingerprints may differ.
RADIUS = 3
#: Large buckets whose names may be broadcast, with 16 bytes each.
MAX_LARGE = 200_000
#: Fingerprints that share a bucket on average; more of them ask for longer keys.
BUCKET_ROWS = 64

#: The eight bits of a byte, one in each byte of a 64-bit number.
_LANES = np.array([sum(((v >> j) & 1) << (8 * j) for j in range(8)) for v in range(256)], dtype=np.uint64)
_GOLDENS = np.arange(64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


# Fingerprints ----------------------------------------------------------------------


def shingles(text: bytes, size: int) -> list[bytes]:
    """Runs of `size` words between blanks, A-Z made small, joined by a space; all words if there are fewer."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    return [joined[s : e - 1] for s, e in zip([0, *ends], ends[size - 1 :])]  # noqa: B905


def majorities(hashes: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of `words` 64-bit numbers for each text: the bits set in over half of its hashes.

    `hashes` holds those of all texts in a row, `counts` how many each has. The first number counts the hashes
    themselves, every further one a scrambling of them.
    """
    out = np.zeros((len(counts), words), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = np.concatenate([[0], np.cumsum(counts[full])])
    # Byte-wide lanes hold counts to 255, so texts are summed in runs of that length first.
    cuts = np.concatenate([np.arange(s, e, 255) for s, e in zip(starts[:-1], starts[1:], strict=True)])
    firsts = np.searchsorted(cuts, starts[:-1])
    for k in range(words):
        own = mixed(hashes + _GOLDENS[k]) if k else hashes
        lanes = np.add.reduceat(_LANES[own.astype("<u8").view(np.uint8).reshape(-1, 8)], cuts, axis=0)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(len(cuts), 64), firsts, axis=0, dtype=np.int64)
        bits = 2 * sums > counts[full][:, None]
        out[full, k] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _fingerprinter(size: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, borders in text_parts(batch.column("_text")):
                raw, digests, counts = data.tobytes(), [], []
                for s, e in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                    parts = shingles(raw[s:e], size)
                    counts.append(len(parts))
                    digests.extend([xxhash.xxh64_digest(p, SEED) for p in parts])
                hashes = np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64)
                prints = majorities(hashes, np.array(counts), words)
                node = prints[:, 0] if words == 1 else mixed(np.bitwise_xor.reduce(mixed(prints + _GOLDENS[:words]), axis=1))
                high = prints.astype(">u8").tobytes()
                yield pa.RecordBatch.from_pydict({
                    "_row": batch.column("_row").slice(first, end - first),
                    "node": pa.array(node.view(np.int64)),
                    "fingerprint": pa.array([high[i : i + 8 * words] for i in range(0, len(high), 8 * words)], type=pa.binary()),
                })

    return run


def fingerprints(docs: DataFrame, carry: list[str], size: int = 3, words: int = 1, text: str = "text") -> DataFrame:
    """(_row: the columns `carry`, node long, fingerprint binary) for every row of `docs`.

    A bit of the fingerprint is set if over half of the shingle hashes (XXH64, seed 42) have it. No words: all bits
    are 0. `node` names the fingerprint: its value as a long, or a hash of a wider one.
    Memory of a task: about 200 times its longest text.
    """
    rows = docs.select(F.struct(*carry).alias("_row"), F.col(text).alias("_text"))
    kind = rows.select("_row", F.lit(0).cast("long").alias("node"), F.lit(b"").alias("fingerprint")).schema
    return rows.mapInArrow(_fingerprinter(size, words), kind)


# Buckets ---------------------------------------------------------------------------


def shared_blocks(count: int, bits: int = 64, radius: int = 3) -> list[np.ndarray]:
    """Bit sets of which two fingerprints within `radius` share one whole: no link is lost.

    The bits lie in radius + s blocks; at most `radius` of them differ, so some s blocks agree. s grows with the
    number of fingerprints, so that buckets stay small.
    """
    kept = 1
    while kept < 4 and bits * kept / (radius + kept) < log2(max(count, 1) / BUCKET_ROWS + 1):
        kept += 1
    blocks = np.array_split(np.arange(bits), radius + kept)
    return [np.concatenate(chosen) for chosen in combinations(blocks, kept)]


def _bits(column: pa.Array) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1), axis=1)


def _keyed(tables: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _bits(batch.column("fingerprint")).astype(np.int64)
            for number, chosen in enumerate(tables):
                # The table's number is mixed in, so that equal bits of two tables fall apart.
                value = bits[:, chosen] @ (np.int64(1) << np.arange(len(chosen), dtype=np.int64))
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(value + (np.int64(number) << 40)),
                    "node": batch.column("node"),
                    "fingerprint": batch.column("fingerprint"),
                })

    return run


# Bit-sliced comparison -------------------------------------------------------------


def _vector(flags: np.ndarray) -> int:
    """Flags as the bits of one integer, the first one lowest."""
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _places(vector: int, count: int) -> np.ndarray:
    raw = np.frombuffer(vector.to_bytes((count + 7) // 8, "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(raw, count=count, bitorder="little"))


def near_lanes(planes: list[int], shift: int, lanes: int, radius: int, count: int) -> int:
    """Of the rows in `lanes`, those whose fingerprint differs from that of the row `shift` below in `radius` bits at most.

    A plane holds one bit of all rows as an integer. The differing bits of eight planes are added by carry-save
    adders, whose carries of weight eight ripple into the upper counter planes. All counters start so high that
    `radius` + 1 differences overflow them; once every lane has overflowed, the rest of the planes is left out.
    """
    levels = max(3, (radius + 1).bit_length())
    base, full = (1 << levels) - 1 - radius, (1 << count) - 1
    counter = [full if base >> k & 1 else 0 for k in range(levels)]
    over = 0

    def add(a: int, b: int, c: int) -> tuple[int, int]:
        half = a ^ b
        return half ^ c, (a & b) | (half & c)

    for at in range(0, len(planes), 8):
        x = [p ^ (p >> shift) for p in planes[at : at + 8]]
        x += [0] * (8 - len(x))
        ones, two_a = add(counter[0], x[0], x[1])
        ones, two_b = add(ones, x[2], x[3])
        twos, four_a = add(counter[1], two_a, two_b)
        ones, two_a = add(ones, x[4], x[5])
        ones, two_b = add(ones, x[6], x[7])
        twos, four_b = add(twos, two_a, two_b)
        fours, carry = add(counter[2], four_a, four_b)
        counter[:3] = ones, twos, fours
        for k in range(3, levels):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if not lanes & ~over:
            return 0
    return lanes & ~over


def _forest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row is linked to over any number of links."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked_rows(keys: np.ndarray, bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all rows of a key which differ in `radius` bits at most; rows are sorted by key.

    Buckets of like size are compared together: at shift d every row meets the one d below. A component of n rows
    gives n - 1 links, whatever the number of its pairs.
    """
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    per_row = np.repeat(sizes, sizes)
    left, right = [], []
    size = 2
    while size <= sizes.max(initial=0):
        chosen = np.flatnonzero((per_row >= size) & (per_row < 2 * size))
        size *= 2
        for at in range(0, len(chosen), BLOCK_ROWS) if size <= BLOCK_ROWS else [0] * bool(len(chosen)):
            # Small buckets go in blocks with what a bucket at their end may reach.
            rows = chosen[at : at + BLOCK_ROWS + size] if size <= BLOCK_ROWS else chosen
            key, n = keys[rows], len(rows)
            planes = [_vector(p) for p in bits[rows].T]
            a, b, found = [], [], 0
            for shift in range(1, min(size, n)):
                same = np.zeros(n, dtype=bool)
                same[: n - shift] = key[shift:] == key[:-shift]
                if not same.any():
                    break
                alive = near_lanes(planes, shift, _vector(same), radius, n)
                if alive:
                    hit = _places(alive, n)
                    a.append(hit)
                    b.append(hit + shift)
                    found += len(hit)
                if found > 4 * n:  # keep a spanning forest of what was found
                    label = _forest(n, np.concatenate(a), np.concatenate(b))
                    hung = np.flatnonzero(label != np.arange(n))
                    a, b, found = [hung], [label[hung]], len(hung)
            if a:
                label = _forest(n, np.concatenate(a), np.concatenate(b))
                hung = np.flatnonzero(label != np.arange(n))
                left.append(rows[hung])
                right.append(rows[label[hung]])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _linker(radius: int):
    def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        keys, nodes = (rows.column(c).combine_chunks().to_numpy() for c in ("key", "node"))
        a, b = linked_rows(keys, _bits(rows.column("fingerprint").combine_chunks()), radius)
        return pa.RecordBatch.from_pydict({"a": pa.array(nodes[a]), "b": pa.array(nodes[b])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            keys = batch.column("key").to_numpy()
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut and rows + cut >= BLOCK_ROWS:
                yield links([*held, batch.slice(0, cut)])
                held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += len(batch)
        if rows:
            yield links(held)

    return run


def dealt(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """`rows` with the rows of every key in `blocks` (key, blocks) dealt into so many blocks; each pair of blocks has a key.

    Any two rows of a key meet under at least one of the new keys, which hold two blocks; other keys stay as they are.
    """
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pair = lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j))
    keys = F.when(F.col("blocks").isNull(), F.array("key")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), pair))
    blocks = written(blocks, "blocks")
    # Above the bound the join is a shuffle, and adaptive execution splits its hot keys.
    both = rows.join(F.broadcast(blocks) if blocks.count() <= MAX_LARGE else blocks, "key", "left")
    return both.select(F.explode(keys).alias("key"), *[c for c in rows.columns if c != "key"])


def similar(prints: DataFrame, tables: list[np.ndarray], radius: int) -> DataFrame:
    """(node, root): the class of every fingerprint (node, fingerprint) that is not the first of its class.

    Each distinct fingerprint goes into one bucket for each bit set; only fingerprints of a bucket are compared. Copies
    of a fingerprint count once, so no group of copies fills a bucket. A bucket above `BLOCK_ROWS` rows is dealt into
    blocks, and each pair of blocks is compared in a task of its own.
    """
    keyed = prints.mapInArrow(_keyed(tables), "key long, node long, fingerprint binary")
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_ROWS)
    keyed = dealt(keyed, large.select("key", F.ceil(2 * F.col("n") / BLOCK_ROWS).cast("long").alias("blocks")))
    # Hash partitions keep a key whole, the sort puts it together.
    edges = keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_linker(radius), "a long, b long")
    return components(edges)


def rooted(found: DataFrame, least: Column) -> DataFrame:
    """(node, least, root) for every distinct fingerprint of `found` (node, fingerprint, and what the aggregate `least` reads).

    Copies of a fingerprint are pre-aggregated before the shuffle, so a hot one is no large group.
    """
    nodes = written(found.groupBy("node").agg(F.first("fingerprint").alias("fingerprint"), least), "nodes")
    roots = similar(nodes.select("node", "fingerprint"), shared_blocks(nodes.count(), radius=RADIUS), RADIUS)
    return nodes.drop("fingerprint").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as hex, component_id) for every row of `docs`: 64 bits over three-word shingles, radius 3.

    `component_id` is the smallest key that a document reaches over links, itself included; null keys are never the
    smallest, and a class of them alone has a null one. Texts without words have fingerprint 0 and link like any other.
    """
    found = written(fingerprints(docs.select(F.col(key).cast("long").alias("doc_id"), text), ["doc_id"], text=text), "prints")
    classed = rooted(found, F.min("_row.doc_id").alias("least"))
    firsts = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    classed = classed.join(firsts, "root").select("node", "component_id")
    rows = found.select(F.col("_row.doc_id").alias("doc_id"), "node", F.lower(F.hex("fingerprint")).alias("fingerprint"))
    return rows.join(classed, "node").select("doc_id", "fingerprint", "component_id")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id, with the columns it came with.

    Groups are the classes of `near_classes`: three-word shingles, fingerprints that differ in `RADIUS` bits at most, over
    any number of links; the bit distance alone decides. Null ids come last, repeated rows leave one, documents without
    words are one group. Texts move once, to meet the names of those that stay.
    """
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("mark"))
    marked = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64("text").alias("mark"))
    found = fingerprints(marked, ["doc_id", "mark"]).select("node", "fingerprint", "_row.*")
    kept = rooted(found, F.min(name).alias("least")).groupBy("root").agg(F.min("least").alias("kept")).select("kept")
    number = F.row_number().over(Window.partitionBy("this").orderBy(F.lit(1)))
    same = marked.select("row", name.alias("this")).join(kept, F.col("this").eqNullSafe(F.col("kept")))
    return same.select("row", number.alias("n")).filter("n = 1").select("row.*")
