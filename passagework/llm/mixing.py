"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from passagework.llm.base import blank_word_count, mixed, text_or_empty, written

#: Documents of a source that one task rounds together, and residuals that a node of the tree combines.
ROWS_PER_GROUP = 8_192
FAN_IN = 64
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size), one for each source.

    Sources in code point order, null last, weigh `weights` in turn. A source gets its share of all sizes by weight but
    no more than `most` times its size; what is over goes to the others by weight, again and again. That ends where
    every source has `min(most * size, level * weight)` for one level, and the level is read off the sources in the
    order in which they reach their limit. The windows hold one row for each source, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double").alias("_weight"))
    rows = rows.withColumn("_limit", F.lit(most) * F.col("source_size").cast("double"))
    filling = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "_full": F.coalesce(F.sum("_limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_open": F.sum("_weight").over(filling.rowsBetween(0, Window.unboundedFollowing)),
        "_total": F.sum("source_size").over(everything),
    })
    # The level if the sources before this one are full; the first that then stays below its limit sets it.
    rows = rows.withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open"))
    holds = F.when(F.col("_level") * F.col("_weight") <= F.col("_limit"), F.col("_level"))
    rows = rows.withColumn("_level", F.max(holds).over(everything))
    return rows.select("source", "source_size", F.least("_limit", F.coalesce(F.col("_level") * F.col("_weight"), F.col("_limit"))).alias("target"))


def pivot(chances: list[float], sizes: list[int], draws: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Round chances: (0 or 1 for each, the place left over or -1, its chance).

    Two fractional chances meet: one gains what the other loses in words, by a random direction that keeps either
    expectation, until one of them is 0 or 1. Partners come from one band of sizes, a factor of two wide, the long
    ones first. The chance a band leaves open meets all shorter documents at once, which share what it gains or
    loses, so that a long document does not stay open to the end. The sum of chance times size never changes.
    """
    p, words = np.array(chances, dtype=np.float64), np.array(sizes, dtype=np.int64)
    order = np.argsort(-words, kind="stable")
    bands = np.frexp(words[order].astype(np.float64))[1]
    borders = [0, *(np.flatnonzero(np.diff(bands)) + 1).tolist(), len(order)]
    left = -1
    for begin, end in zip(borders, borders[1:]):
        band = order[begin:end]
        left = _paired(band[(p[band] > 0) & (p[band] < 1)].tolist(), p, words, draws)
        if left < 0:
            continue
        random = np.random.default_rng(int(draws[left] * (1 << 53)))
        while 0 < p[left] < 1:
            shorter = order[end:]
            shorter = shorter[(p[shorter] > 0) & (p[shorter] < 1)]
            if not len(shorter):
                break
            # Each shorter one moves in proportion to its room to the nearer end, the same for either direction.
            room = np.minimum(p[shorter], 1 - p[shorter])
            size, most = float(words[left]), float(room @ words[shorter])
            up, down = min((1 - p[left]) * size, most), min(p[left] * size, most)
            gain = up if random.random() * (up + down) < down else -down
            p[left] += gain / size
            p[shorter] -= room * (gain / most)
            _snap(p, np.append(shorter, left))
        if 0 < p[left] < 1:  # all shorter ones are settled
            break
        left = -1
    out = np.rint(p).astype(np.int8)
    if left < 0:
        return out, -1, 0.0
    out[left] = 0
    return out, int(left), float(p[left])


def _snap(p: np.ndarray, places: np.ndarray) -> None:
    near = np.rint(p[places])
    p[places] = np.where(np.abs(p[places] - near) < 1e-12, near, p[places])


def _paired(places: list[int], p: np.ndarray, words: np.ndarray, draws: np.ndarray) -> int:
    """Let the chances at `places` meet in order, each with the one still open; the last open place or -1."""
    left, held = -1, 0.0
    for i in places:
        q = float(p[i])
        if left < 0:
            left, held = i, q
            continue
        a, b = float(words[left]), float(words[i])
        up = min((1 - held) * a, q * b)  # words the held document may gain
        down = min(held * a, (1 - q) * b)
        if draws[i] * (up + down) < down:
            held, q, by_held = held + up / a, q - up / b, (1 - held) * a <= q * b
        else:
            held, q, by_held = held - down / a, q + down / b, held * a <= (1 - q) * b
        if by_held:  # the held one became integral
            p[left] = round(held)
            left, held = i, q
        else:
            p[i] = round(q)
        if not 1e-12 < held < 1 - 1e-12:
            p[left] = round(held)
            left = -1
    if left >= 0:
        p[left] = held
    return left


def _draws(seed: int, marks: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for every mark, the same in every run."""
    return (mixed(marks.astype(np.uint64) ^ np.uint64(seed)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _rounder(seed: int, level: int):
    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "draw"], ascending=[False, True])
        draws = _draws(seed + level, pdf["draw"].to_numpy().view(np.uint64))
        out, left, p = pivot(pdf["chance"].tolist(), pdf["size"].tolist(), draws)
        pdf = pdf.assign(extra=out, chance=0.0, open=False)
        if left >= 0:
            pdf.iloc[left, [pdf.columns.get_loc("chance"), pdf.columns.get_loc("open")]] = [p, True]
        return pdf

    return rounded


def _mark(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def mixture(docs: DataFrame, seed: int = 7, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(doc_id, mark, size, source, source_size, target, copies) for every row of `docs`; `mark` hashes key and text.

    Every document of a source has the same number of expected copies, target by source size (at most 3). Its whole
    part is taken outright, the rest is a chance that pivotal rounding settles: documents of a source meet in groups
    of about `ROWS_PER_GROUP` by the hash of their key and text, each group leaves at most one open chance, and the
    open ones meet in a tree of `FAN_IN` until one is left for each source, which a draw settles. That one is short,
    unless the source holds next to nothing shorter than it: the words taken from a source miss its target by less
    than one document. Draws hang on rows and seed: reruns agree.

    A null source is a source of its own, a text that is null or has no words has size 0 and no copies. Repeated rows
    are counted first and then dealt by their number, so they spread over groups and are rounded one by one. Of a very
    long text only the word count moves on. No rows give no rows. Every level is written before the next reads it.
    """
    counts = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"), _mark(key, text).alias("mark"),
        blank_word_count(text_or_empty(text)).alias("size"),
    )
    # Equal rows travel as one row with a count and are unfolded in blocks, each in a task of its own.
    stacks = written(counts.groupBy("doc_id", "source", "mark", "size").agg(F.count(F.lit(1)).alias("_rows")), "mix-sizes")
    per_source = stacks.groupBy("source").agg(F.sum(F.col("size") * F.col("_rows")).alias("source_size"), F.sum("_rows").alias("_rows"))
    per_source = per_source.withColumn("_groups", F.ceil(F.col("_rows") / ROWS_PER_GROUP)).drop("_rows")
    groups = per_source.agg(F.max("_groups")).first()[0] or 1
    targets = source_targets(per_source.select("source", "source_size")).drop("source_size").withColumnRenamed("source", "_source")
    targets = targets.join(per_source, F.col("_source").eqNullSafe(F.col("source"))).drop("source")

    last = F.floor((F.col("_rows") - 1) / ROWS_PER_GROUP)
    blocks = stacks.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("doc_id", "mark", "_block")
    first_row = F.col("_block") * ROWS_PER_GROUP
    numbers = F.sequence(first_row, F.least(first_row + ROWS_PER_GROUP, F.col("_rows")) - 1)
    rows = blocks.withColumn("_number", F.explode(numbers)).withColumn("draw", F.xxhash64("mark", "_number")).drop("_rows", "_block", "_number")

    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    expected = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("chance", expected).withColumn("whole", F.floor("chance").cast("int"))
    rows = rows.withColumns({
        "chance": F.col("chance") - F.col("whole"),
        "group": F.pmod(F.col("draw"), F.col("_groups")).cast("int"),
        "home": F.pmod(F.col("draw"), F.col("_groups")).cast("int"),
        "extra": F.lit(0),
        "open": F.lit(False),
    }).drop("_groups")

    def met(waiting: DataFrame, level: int) -> DataFrame:
        return written(waiting.groupBy("source", "group").applyInPandas(_rounder(seed, level), waiting.schema), f"mix-{level}")

    first = met(rows, 0)
    settled, waiting, level = [], first.filter("open"), 0
    while groups > 1:
        level, groups = level + 1, -(-groups // FAN_IN)
        nodes = met(waiting.withColumn("group", F.floor(F.col("group") / FAN_IN).cast("int")), level)
        settled.append(nodes.filter(~F.col("open")))
        waiting = nodes.filter("open")
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    settled.append(waiting.withColumn("extra", (drawn < F.col("chance")).cast("int")))
    # A group of the first level has one open row at most, so its source and number name that row.
    late = reduce(DataFrame.unionByName, settled).select(
        F.col("source").alias("_source"), F.col("home").alias("_home"), F.col("extra").alias("_late")
    )
    done = first.join(late, F.col("source").eqNullSafe(F.col("_source")) & (F.col("home") == F.col("_home")), "left")
    extra = F.when(F.col("open"), F.col("_late")).otherwise(F.col("extra"))
    return done.select("doc_id", "mark", "size", "source", "source_size", "target", (F.col("whole") + extra).alias("copies"))


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns they came with."""
    # Equal rows are numbered on either side, so that each meets its own number of copies.
    same = ["id", "mark", "source"]
    number = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(1)))
    taken = mixture(docs, seed).select(F.col("doc_id").alias("id"), "mark", "source", "copies").filter("copies > 0")
    taken = taken.select(F.struct(*same, number.alias("n")).alias("taken"), "copies")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), _mark("doc_id", "text").alias("mark"), "source")
    rows = rows.select("row", F.struct(*same, number.alias("n")).alias("this"))
    found = rows.join(taken, F.col("this").eqNullSafe(F.col("taken")))
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
