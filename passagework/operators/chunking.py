"""Cutting texts into windows of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from passagework.functions import frontmatter
from passagework.functions.let import let
from passagework.functions.text import has_ink

# Window and overlap in lines, and the window of the plain variant.
CHUNK_LINES, OVERLAP_LINES, PLAIN_LINES = 30, 10, 50


def window_plan(size: int, overlap: int = OVERLAP_LINES) -> tuple[int, int]:
    """Usable overlap and step for a window size."""
    if size < 1:
        raise ValueError("a chunk needs at least one line")
    if overlap >= size:
        overlap = size // 3
    return overlap, max(size - overlap, 1)


def line_windows(text: Column, size: int, step: int) -> Column:
    """Windows of `size` lines every `step` lines, up to the first that reaches the end."""

    def cut(lines: Column) -> Column:
        count = F.size(lines)
        further = F.when(count > size, F.ceil((count - size) / F.lit(step)).cast("int")).otherwise(F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), further),
            lambda w: F.array_join(F.slice(lines, w * step + 1, F.lit(size)), "\n"),
        )

    return let(F.split(text, "\n", -1), cut)


def kept_windows(text: Column, size: int = CHUNK_LINES, overlap: int = OVERLAP_LINES) -> Column:
    """The windows of a text that are not blank."""
    return F.filter(line_windows(text, size, window_plan(size, overlap)[1]), has_ink)


def cut_chunks(
    files: DataFrame,
    size: int = CHUNK_LINES,
    overlap: int = OVERLAP_LINES,
    text: str = "content",
    count_blank: bool = False,
    strip_frontmatter: bool = False,
) -> DataFrame:
    """One row per non-blank window: the other columns, `chunk_no` and `content`.

    `chunk_no` counts the windows kept, or all windows with `count_blank`.
    """
    _, step = window_plan(size, overlap)
    source = frontmatter.body(F.col(text)) if strip_frontmatter else F.col(text)
    windows = line_windows(source, size, step)
    others = [c for c in files.columns if c not in (text, "chunk_no", "content")]
    if count_blank:
        return files.select(*others, F.posexplode(windows).alias("chunk_no", "content")).filter(
            has_ink(F.col("content"))
        )
    return files.select(*others, F.posexplode(F.filter(windows, has_ink)).alias("chunk_no", "content"))


def cut_plain_chunks(files: DataFrame, size: int = PLAIN_LINES, text: str = "content") -> DataFrame:
    """Windows without overlap; the number is the window's place, gaps included."""
    return cut_chunks(files, size, 0, text, count_blank=True)
