"""Spelling variants: words one edit apart, found in a trie over the counts of their letters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from passagework.llm.base import LOWER, UPPER, text_or_empty, written

RUN = "[A-Za-z\\u00C0-\\u00FF]"
MIN_LETTERS, MIN_COUNT = 6, 5
#: One run of a document in so many loses a letter.
DROP = 199
#: A form is at least so many times as frequent.
TIMES = 5

#: Letter groups, from frequent letters to rare ones; the last one holds all that is not named.
GROUPS = ("e", "a", "i", "n", "r", "s", "t", "o", "l", "u", "d", "c", "m", "p", "gj", "hx", "bk", "fz", "vy", "wq")
#: Words in one part of the trie; a part with more is cut at the next letter group.
PART_WORDS = 20_000
#: Branches, and bytes of word pairs, that are worked on at once.
BRANCHES, PAIR_BYTES = 1 << 18, 1 << 23


def _group_table() -> np.ndarray:
    table = np.full(256, len(GROUPS), dtype=np.int64)
    for number, letters in enumerate(GROUPS):
        for letter in letters:
            table[ord(letter)] = number
    return table


GROUP_OF = _group_table()
WIDTH = len(GROUPS) + 1


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", drop: int = DROP) -> DataFrame:
    """(word, n) of the words of all texts: runs of letters with A-Z lower-cased, of six letters and five places or more.

    Where `drop` divides the checksum of `<key>:<run>`, the run loses the letter at the checksum modulo its length.
    Counting is partial in each task before anything is shuffled, so a word may fill the table. A null text has no
    words, a null key reads as nothing, and rows that repeat count again.
    """
    runs = F.regexp_extract_all(text_or_empty(f"`{text}`"), F.lit(f"({RUN}{{{MIN_LETTERS},}})"))
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"), runs.alias("runs"))
    rows = rows.select("id", F.explode("runs").alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    sums = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = sums.select(F.when(F.col("h") % drop == 0, shorter).otherwise(F.col("run")).alias("word"))
    counts = words.filter(F.length("word") >= MIN_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= MIN_COUNT)


def _counts(word: Column) -> Column:
    """The counts of the letter groups of a word, in order."""
    letters = [F.length(word) - F.length(F.translate(word, group, "")) for group in GROUPS]
    named = letters[0]
    for count in letters[1:]:
        named = named + count
    return F.array(*letters, F.length(word) - named)


def _depth(words: DataFrame) -> int:
    """The number of letter groups by which parts of the trie are told apart, so that none has over `PART_WORDS` words.

    Words alike in all groups stay together: they are compared in blocks.
    """
    for depth in range(WIDTH):
        part = words.groupBy("letters", F.slice("counts", 1, depth).alias("part")).agg(F.count(F.lit(1)).alias("n"))
        if (part.agg(F.max("n")).first()[0] or 0) <= PART_WORDS:
            return depth
    return WIDTH


def _asked_parts(depth: int) -> Column:
    """Parts in which words near this one may lie, with what is left to spend: <letters, part, more, fewer>.

    A near word of the same length has one letter group more and another fewer, or none; one letter longer, it
    has one more. (A shorter one asks for this word itself.)
    """
    own = F.slice("counts", 1, depth)

    def with_change(up: int | None, down: int | None) -> Column:
        return F.transform(own, lambda x, i: x + F.when(i == (-1 if up is None else up), 1).otherwise(0) - F.when(i == (-1 if down is None else down), 1).otherwise(0))

    def row(letters: int, up: int | None, down: int | None, more: int, fewer: int) -> Column:
        return F.struct(
            (F.col("letters") + letters).alias("letters"), with_change(up, down).alias("part"),
            F.lit(more).alias("more"), F.lit(fewer).alias("fewer"),
        )

    places = range(depth)
    same = [row(0, None, None, 1, 1), *[row(0, i, None, 0, 1) for i in places], *[row(0, None, i, 1, 0) for i in places]]
    same += [row(0, i, j, 0, 0) for i in places for j in places if i != j]
    longer = [row(1, None, None, 1, 0), *[row(1, i, None, 0, 0) for i in places]]
    return F.array(*same, *longer)


@dataclass
class Part:
    """The words of one part of the trie, sorted by the counts of the letter groups below it, level by level.

    At each level `keys` are the sorted (node, count) pairs of the branches, `first` the first row of each child.
    """

    letters: int
    words: np.ndarray  # rows of letters
    names: pa.Array
    n: np.ndarray
    keys: list[np.ndarray]
    first: list[np.ndarray]

    @staticmethod
    def of(letters: int, names: pa.Array, n: np.ndarray, depth: int) -> Part:
        words = _letters(names, letters)
        counts = _vectors(words)[:, depth:]
        order = np.lexsort(counts.T[::-1]) if counts.shape[1] else np.arange(len(words))
        words, counts = words[order], counts[order]
        node, keys, first = np.zeros(len(words), dtype=np.int64), [], []
        for level in range(counts.shape[1]):
            key = node * (letters + 3) + counts[:, level] + 1
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            first.append(np.flatnonzero(new))
            keys.append(key[first[-1]])
            node = np.cumsum(new) - 1
        return Part(letters, words, names.take(pa.array(order)), n[order], keys, first)

    def rows_of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the rows below leaves."""
        if not self.first:
            return np.zeros(len(nodes), dtype=np.int64), np.full(len(nodes), len(self.words))
        borders = np.append(self.first[-1], len(self.words))
        return borders[nodes], borders[nodes + 1]

    def search(self, counts: np.ndarray, more: np.ndarray, fewer: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asking words, leaves) whose counts differ by what may be spent, all of it.

        Depth first: the stack holds blocks of branches, the deepest is taken next, and a wide block is cut in two.
        """
        everyone = np.arange(len(counts))
        stack = [(0, everyone, np.zeros(len(counts), dtype=np.int64), more.copy(), fewer.copy())]
        while stack:
            level, who, node, up, down = stack.pop()
            if len(who) > BRANCHES:
                half = len(who) // 2
                stack += [(level, who[s], node[s], up[s], down[s]) for s in (slice(half, None), slice(half))]
                continue
            if level == len(self.keys):
                # A replaced letter may stay in its group: then neither is spent.
                done = up == down
                yield who[done], node[done]
                continue
            key = node * (self.letters + 3) + counts[who, level] + 1
            found = []
            for step, able in ((0, slice(None)), (1, up > 0), (-1, down > 0)):
                at = np.searchsorted(self.keys[level], key[able] + step)
                here = at < len(self.keys[level])
                here[here] = self.keys[level][at[here]] == (key[able] + step)[here]
                found.append((who[able][here], at[here], up[able][here] - (step > 0), down[able][here] - (step < 0)))
            nexts = [np.concatenate(column) for column in zip(*found, strict=True)]
            if len(nexts[0]):
                stack.append((level + 1, *nexts))


def _letters(names: pa.Array, letters: int) -> np.ndarray:
    """Words of so many letters as rows of their code points, which are all below 256."""
    joined = "".join(names.to_pylist()).encode("latin-1")
    return np.frombuffer(joined, dtype=np.uint8).reshape(len(names), letters)


def _vectors(words: np.ndarray) -> np.ndarray:
    """The counts of the letter groups of words of one length."""
    out = np.zeros((len(words), WIDTH), dtype=np.int64)
    step = max(1, (1 << 22) // max(1, words.shape[1]))
    for at in range(0, len(words), step):
        part = GROUP_OF[words[at : at + step]] + np.arange(min(step, len(words) - at))[:, None] * WIDTH
        out[at : at + step] = np.bincount(part.ravel(), minlength=out[at : at + step].size).reshape(-1, WIDTH)
    return out


def _near(asking: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether words of the same length, or one letter longer, are one edit from the asking words beside them."""
    size = asking.shape[1]
    if words.shape[1] == size:
        return (asking != words).sum(axis=1) == 1
    front, back = asking != words[:, :size], asking != words[:, 1:]
    # Equal up to the first difference, and from there on with one letter skipped.
    reach = np.where(front.any(axis=1), front.argmax(axis=1), size)
    last = np.where(back.any(axis=1), size - 1 - back[:, ::-1].argmax(axis=1), -1)
    return last < reach


def _pairs(part: Part, size: int, names: pa.Array, n: np.ndarray, more: np.ndarray, fewer: np.ndarray, depth: int) -> Iterator[pa.RecordBatch]:
    asking = _letters(names, size)
    counts = _vectors(asking)[:, depth:]
    most = max(1, PAIR_BYTES // part.letters)
    for who, leaves in part.search(counts, more, fewer):
        begin, end = part.rows_of(leaves)
        total = np.cumsum(end - begin)
        at = 0
        while at < len(who):
            # Some branches whole, or a part of the rows of one: never more than `most` pairs.
            taken = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
            for low in range(0, int((end - begin)[at:taken].max()) if taken == at + 1 else 1, most):
                starts = begin[at:taken] + low
                lengths = np.minimum(end[at:taken] - starts, most) if taken == at + 1 else end[at:taken] - starts
                a = np.repeat(who[at:taken], lengths)
                b = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
                same = _near(asking[a], part.words[b])
                a, b = a[same], b[same]
                if not len(a):
                    continue
                yield _links(names, n, part, a, b)
                if size != part.letters:
                    yield _links(part.names, part.n, None, b, a, names, n)
            at = taken


def _links(names: pa.Array, n: np.ndarray, part: Part | None, a: np.ndarray, b: np.ndarray, others: pa.Array | None = None, counts: np.ndarray | None = None) -> pa.RecordBatch:
    others, counts = (part.names, part.n) if part else (others, counts)
    return pa.RecordBatch.from_pydict({
        "word": names.take(pa.array(a)), "near": others.take(pa.array(b)), "near_n": pa.array(counts[b], type=pa.int64()),
    })


def _searcher(depth: int):
    """Rows by part: first the words that lie in it, then those that ask; the part is in memory, the asking pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, names, counts = None, None, [], []
        for batch in batches:
            parts = np.array(batch.column("place").to_pylist(), dtype=object)
            asks = np.asarray(batch.column("asks"))
            new = np.ones(len(parts), dtype=bool)
            new[1:] = (parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])
            begins = np.append(np.flatnonzero(new), len(parts))
            for begin, end in zip(begins[:-1], begins[1:], strict=True):
                rows = batch.slice(begin, end - begin)
                word, n = rows.column("word"), rows.column("n").to_numpy()
                if parts[begin] != place:
                    place, held, names, counts = parts[begin], None, [], []
                if not asks[begin]:
                    names.append(word)
                    counts.append(n)
                elif names or held:
                    if held is None:
                        held = Part.of(rows.column("letters")[0].as_py(), pa.concat_arrays(names), np.concatenate(counts), depth)
                        names, counts = [], []
                    sizes = rows.column("size").to_numpy()
                    for size in np.unique(sizes):
                        own = rows.filter(pa.array(sizes == size))
                        yield from _pairs(held, int(size), own.column("word"), own.column("n").to_numpy(),
                                          own.column("more").to_numpy().astype(np.int64), own.column("fewer").to_numpy().astype(np.int64), depth)

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for every word and each word one edit away, from distinct (word, n).

    The top of the trie is its partitioning: words lie by their length and the counts of the first letter groups,
    as many groups as keep parts small, and each word asks the parts that one surplus and one deficit reach. In a part
    the trie goes on over the other groups; a search spends what is left of its budget and verifies the words of the
    leaves it ends in. Words of any length do; all words of a length lie together, so none is padded.
    """
    base = words.select("word", "n", F.length("word").alias("letters"), _counts(F.col("word")).alias("counts"))
    base = written(base, "vectors")
    depth = _depth(base)
    place = lambda letters, part: F.concat_ws(",", letters.cast("string"), part.cast("array<string>"))
    lying = base.select(
        place(F.col("letters"), F.slice("counts", 1, depth)).alias("place"), "letters", F.lit(False).alias("asks"),
        "word", "n", F.col("letters").alias("size"), F.lit(0).alias("more"), F.lit(0).alias("fewer"),
    )
    asking = base.select("word", "n", F.col("letters").alias("size"), F.inline(_asked_parts(depth)))
    asking = asking.filter(~F.exists("part", lambda x: x < 0)).select(
        place(F.col("letters"), F.col("part")).alias("place"), "letters", F.lit(True).alias("asks"), "word", "n", "size", "more", "fewer",
    )
    rows = lying.unionByName(asking).repartition("place").sortWithinPartitions("place", "asks", "size")
    return rows.mapInArrow(_searcher(depth), "word string, near string, near_n long")


def _followed(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to their last. Each round doubles the steps; a step is at least `TIMES` in
    frequency, so a handful of rounds ends."""
    links = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        further = links.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved"))
        further = written(further, "roots")
        links = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return links


def spelling_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", drop: int = DROP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `word_counts`.

    The form of a word is its most frequent near word (of equals the smallest) if that is `TIMES` as frequent; the
    root is where forms lead. A word without near words is its own root. An empty table has no words.
    """
    words = written(word_counts(docs, key, text, drop), "words")
    near = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    )
    far = -F.col("best.minus") >= TIMES * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.minus")).alias("form_n"),
    )
    rows = written(rows, "near")
    roots = _followed(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
