"""Benchmark decontamination by winnowing: minimum k-gram hashes of sliding windows, joined and extended."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passagework.llm.base import mixed, text_parts

SPAN_WORDS = 13  # every shared span of so many words is found
GRAM_WORDS = 5
#: Benchmark text that is sent to the tasks at once; a larger benchmark goes through them block by block.
BLOCK_BYTES = 4 << 20

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_BYTES = np.arange(256)
_SMALL = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint64)
_IN_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 65) & (_BYTES <= 90)) | (_BYTES >= 128)


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of several texts as pairs of 64-bit hashes, and the text that each belongs to.

    A word is a run of digits, letters a-z (after A-Z became small) and characters beyond ASCII. Its hash is a
    polynomial of its bytes, taken from running sums; nothing is done word by word.
    """

    def __init__(self, data: np.ndarray, borders: np.ndarray):
        inside = _IN_WORD[data]
        before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        first, last = borders[:-1], borders[1:] - 1
        before[first[first < len(data)]] = False
        after[last[last >= 0]] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.text = np.searchsorted(borders, starts, side="right") - 1
        values = _SMALL[data] + np.uint64(1)
        self.hashes = []
        for base in _BASES:
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(values * _powers(base, len(data))[:-1], out=sums[1:])
            self.hashes.append(mixed((sums[ends] - sums[starts]) * _powers(inverse, len(data))[starts]))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places where windows of `size` words start inside one text, their first and second hash)."""
        n = len(self.text) - size + 1
        if n <= 0:
            return (np.zeros(0, dtype=np.int64), *[np.zeros(0, dtype=np.uint64)] * 2)
        at = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        return (at, *[mixed(_combined(h, base, size))[at] for h, base in zip(self.hashes, _BASES[::-1], strict=True)])

    def fingerprints(self, size: int) -> np.ndarray:
        """The smallest hash of a k-gram in the window of `size` words at every place."""
        k = min(GRAM_WORDS, size)
        grams = mixed(_combined(self.hashes[0], _BASES[0], k))
        width, smallest = 1, grams
        while width < size - k + 1:
            step = min(width, size - k + 1 - width)
            smallest = np.minimum(smallest[: max(0, len(smallest) - step)], smallest[step:])
            width += step
        return smallest


def _combined(hashes: np.ndarray, base: np.uint64, size: int) -> np.ndarray:
    """An order-sensitive sum of `size` hashes in a row, for every place."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k, power in enumerate(_powers(base, size)[1:]):
        out += hashes[k : k + n] * power
    return out


@dataclass
class Block:
    """Some items as sorted tables: by window size, the fingerprints, the windows, and the items of each window."""

    names: list[str]
    sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list) -> Block:
        rows = [(str(i), t.encode()) for i, t in rows]
        names = sorted({i for i, _ in rows})
        number = {name: k for k, name in enumerate(names)}
        item = np.array([number[i] for i, _ in rows], dtype=np.int64)
        borders = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])]).astype(np.int64)
        words = Words(np.frombuffer(b"".join(t for _, t in rows), dtype=np.uint8), borders)
        counts = np.bincount(words.text, minlength=len(rows))
        found: dict[int, list] = {}
        for size in {min(SPAN_WORDS, int(n)) for n in counts if n}:
            at, a, b = words.windows(size)
            # Shorter items are one window each.
            whole = np.ones(len(at), dtype=bool) if size == SPAN_WORDS else counts[words.text[at]] == size
            at, a, b = at[whole], a[whole], b[whole]
            if len(at):
                prints = np.unique(words.fingerprints(size)[at])
                pairs = np.unique(np.stack([a, b, item[words.text[at]].astype(np.uint64)], axis=1), axis=0)
                new = np.ones(len(pairs), dtype=bool)
                new[1:] = (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)
                begin = np.append(np.flatnonzero(new), len(pairs))
                found[size] = (prints, pairs[new, 0], pairs[new, 1], begin, pairs[:, 2].astype(np.int64))
        return Block(names, found)

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(hit: for every word, whether a window covers it; distinct pairs of text and item)."""
        edge = np.zeros(len(words.text) + 1, dtype=np.int64)
        pairs = [np.zeros((0, 2), dtype=np.int64)]
        for size, (prints, first, second, begin, items) in self.sizes.items():
            at, a, b = words.windows(size)
            smallest = words.fingerprints(size)[at]
            # Windows side by side mostly share their smallest gram: the join takes each run once.
            new = np.ones(len(at), dtype=bool)
            new[1:] = smallest[1:] != smallest[:-1]
            joined = _found(prints, smallest[new])[np.cumsum(new) - 1] if len(at) else new
            at, a, b = at[joined], a[joined], b[joined]
            # A joined fingerprint extends to the windows around it that are equal as a whole.
            k, end = np.searchsorted(first, a), len(first)
            same = np.zeros(len(at), dtype=bool)
            while len(k) and (live := (k < end) & (first[np.minimum(k, end - 1)] == a) & ~same).any():
                same |= live & (second[np.minimum(k, end - 1)] == b)
                k = np.where(live & ~same, k + 1, k)
            at, k = at[same], k[same]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            hit = np.unique(np.stack([words.text[at], k], axis=1), axis=0)
            counts = begin[hit[:, 1] + 1] - begin[hit[:, 1]]
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            pairs.append(np.stack([np.repeat(hit[:, 0], counts), items[np.repeat(begin[hit[:, 1]], counts) + within]], axis=1))
        return np.cumsum(edge[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def _found(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether values are in a sorted table."""
    at = np.searchsorted(table, values)
    return (at < len(table)) & (table[np.minimum(at, len(table) - 1)] == values)


def _runs(flags: np.ndarray) -> np.ndarray:
    """Begin and end of the runs of true values, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))


def _matcher(sent, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(*sent.value)
        for batch in batches:
            texts, old_runs, old_items = (batch.column(name) for name in ("_text", "runs", "items"))
            for first, end, data, borders in text_parts(texts):
                words = Words(data, borders)
                hit, pairs = block.matches(words)
                begin = np.searchsorted(words.text, np.arange(end - first + 1))
                near = np.searchsorted(pairs[:, 0], np.arange(end - first + 1))
                runs, items = [], []
                for r in range(end - first):
                    own = hit[begin[r] : begin[r + 1]]
                    was, had = old_runs[first + r].as_py(), old_items[first + r].as_py()
                    if was:
                        own = own.copy()
                        for s, e in zip(was[::2], was[1::2], strict=True):
                            own[s:e] = True
                    runs.append(_runs(own).tolist() if own.any() else [])
                    new = [block.names[i] for i in pairs[near[r] : near[r + 1], 1]]
                    items.append(sorted({*had, *new}) if had else new)
                columns = {
                    "_row": batch.column("_row").slice(first, end - first),
                    "n_words": pa.array(np.diff(begin), type=pa.int64()),
                    "runs": pa.array(runs, type=pa.list_(pa.int64())),
                    "items": pa.array(items, type=pa.list_(pa.string())),
                }
                if keep_text:
                    columns["_text"] = texts.slice(first, end - first)
                yield pa.RecordBatch.from_pydict(columns)

    return run


def matched(docs: DataFrame, items: DataFrame, carry: list[str], text: str = "text", keep_text: bool = False) -> DataFrame:
    """(_row: the columns `carry` as a struct, n_words, runs, items[, _text]) for every row of `docs`.

    `runs` has begin and end of every run of hit words in turn. A window is 13 words of an item, or the whole of a
    shorter one; a word of a document is hit if it lies in an occurrence of a window. Any shared window has the
    same smallest 5-gram hash on both sides, so the fingerprints of documents and items join there, and what joins
    is extended to whole windows, which are compared by 128 bits.

    The items go to the tasks in blocks of about `BLOCK_BYTES` of text, each checked and broadcast, and each block
    sees all documents; a document never leaves its task and nothing is shuffled, whatever passage is common.
    Memory of a task: about 100 times the larger of `CHUNK_BYTES` and the longest text of the part.

    Null texts have no words, null item ids or texts give no windows, item ids that repeat count once with all
    their texts. Repeated documents are judged one by one.
    """
    spark = docs.sparkSession
    used = items.select(F.col("item_id"), F.col("text")).filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = used.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    rows = docs.select(
        F.struct(*[f"`{c}`" for c in carry]).alias("_row"), F.col(text).alias("_text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<long>").alias("runs"), F.array().cast("array<string>").alias("items"),
    )
    kind = rows.select("_row", "n_words", "runs", "items", "_text").schema
    for number in range(blocks):
        part = used.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        block = Block.of(part.collect())
        sent = spark.sparkContext.broadcast((block.names, block.sizes))
        keep = keep_text or number + 1 < blocks
        rows = rows.mapInArrow(_matcher(sent, keep), kind if keep else kind[:4])
    return rows


def verdicts(found: DataFrame) -> DataFrame:
    """`matched` rows with n_hit, n_items, items_sha256 and contaminated (over a twentieth of the words are hit)."""
    n_hit = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")),
                        lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")), lambda a: a["n"])
    return found.withColumns({
        "n_hit": n_hit,
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.array_join("items", ","), 256),
    }).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    others = [c for c in docs.columns if c != "text"]
    rows = verdicts(matched(docs, items, others, keep_text=True)).filter(~F.col("contaminated"))
    return rows.select(*[F.col("_text").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
