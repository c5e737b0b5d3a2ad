"""What several operators share: word columns, written frames, texts of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from passagework.session import scratch_folder

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that are worked on at once inside a task.
CHUNK_BYTES = 1 << 20


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame, computed once: written to the shared folder and read again, so that its lineage ends there."""
    path = scratch_folder(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def trimmed(text: Column) -> Column:
    """The text without blanks at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def blank_split(text: Column) -> Column:
    """The words between blanks."""
    ends = trimmed(text)
    return F.when(F.length(ends) == 0, F.array().cast("array<string>")).otherwise(F.split(ends, "[ \\t-\\r]+"))


def blank_word_count(text: Column) -> Column:
    """The number of words between blanks, without making them."""
    spaced = F.regexp_replace(trimmed(text), "[ \\t-\\r]+", " ")
    return F.when(F.length(spaced) == 0, F.lit(0)).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "))) + 1).cast("long")


def text_parts(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of an Arrow column of texts with about `most` bytes: first row, end row, their bytes, and the borders of the texts.

    A text is never cut: one above `most` bytes comes alone. A null text is empty.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    borders = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(borders, borders[at] + most, side="right")) - 1)
        yield at, end, data[borders[at] : borders[end]], borders[at : end + 1] - borders[at]
        at = end


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    out = values ^ (values >> np.uint64(30))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out
