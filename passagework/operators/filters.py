"""Filters on file rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from passagework.functions import files as P
from passagework.functions.text import ascii_lower

# Names that are always ignored.
DEFAULT_IGNORES = [".git", "node_modules", ".venv", "__pycache__", ".cache", "dist", ".next", ".nuxt"]

# Path parts excluded from a home folder scan.
NOISE_PARTS = [
    ".cache", ".local/share/Trash", ".local/share/baloo", "snap/", ".npm/_cacache",
    ".bun/install/cache", ".gradle/caches", "__pycache__", ".git/objects", ".git/modules",
    ".wine", ".steam", ".vscode-server", "node_modules/.cache",
]


def is_text_extension(extensions: Sequence[str] | None = None) -> Column:
    """Whether `extension` is one of text; `extensions` replaces the built-in list."""
    allowed = P.TEXT_EXTENSIONS if extensions is None else [P.dotted(e.lower()) for e in extensions]
    return F.lower("extension").isin(allowed)


def by_text_extension(files: DataFrame, extensions: Sequence[str] | None = None) -> DataFrame:
    """Text files only; `extensions` replaces the built-in list."""
    return files.filter(is_text_extension(extensions))


def by_size(files: DataFrame, max_bytes: int = P.MAX_TEXT_BYTES) -> DataFrame:
    return files.filter((F.col("size_bytes") > 0) & (F.col("size_bytes") <= max_bytes))


class IgnoreSet(NamedTuple):
    """Patterns of one ignore file and the folder it lies in, empty for the root; sets are independent of each other."""

    scope: str
    patterns: tuple[str, ...]


def ignore_set(patterns: Iterable[str], scope: str = "") -> IgnoreSet:
    kept = (p.strip() for p in patterns)
    return IgnoreSet(scope.strip("/"), tuple(p for p in kept if p and not p.startswith("#")))


def default_ignores(extra: Iterable[str] = ()) -> list[IgnoreSet]:
    """The built-in names, and user patterns as a second set."""
    extra = ignore_set(extra)
    return [ignore_set(DEFAULT_IGNORES)] + ([extra] if extra.patterns else [])


def pattern_regex(pattern: str) -> str:
    """One ignore pattern as a regular expression for a path or anything below it."""
    anchored = "/" in pattern.rstrip("/")
    folder_only = pattern.endswith("/")
    core = pattern.strip("/")
    if core.startswith(("\\!", "\\#")):  # an escaped mark is a plain character
        core = core[1:]
    # The longest wildcard first, so that `**/` is not taken for two stars.
    parts = re.split(r"(\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]+\])", core)
    wild = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(
        wild.get(part) or ("[" + part[1:-1].replace("!", "^", 1) + "]" if part.startswith("[") and part.endswith("]") else re.escape(part))
        for part in parts
        if part
    )
    head = "^" if anchored else "^(?:.*/)?"
    return head + body + ("/.*$" if folder_only else "(?:/.*)?$")


def is_ignored(path: Column, sets: Iterable[IgnoreSet]) -> Column:
    """True if any set drops the path; within a set the last matching pattern decides.

    A set sees paths below its folder only, relative to that folder.
    A dropped folder takes everything below it along, so a `!` pattern cannot bring
    back a file of such a folder.
    """

    whole = path

    def verdict(p: Column, patterns: Sequence[str]) -> Column:
        chain = None
        for pattern in reversed(patterns):
            keep = pattern.startswith("!")
            matched = p.rlike(pattern_regex(pattern.removeprefix("!")))
            chain = F.when(matched, F.lit(not keep)) if chain is None else chain.when(matched, F.lit(not keep))
        return chain.otherwise(F.lit(False))

    def one_set(scope: str, patterns: Sequence[str]) -> Column:
        if scope:
            below = F.substring(whole, len(scope) + 2, 1 << 30)
            return whole.startswith(scope + "/") & judged(below, patterns)
        return judged(whole, patterns)

    def judged(path: Column, patterns: Sequence[str]) -> Column:
        if not any(p.startswith("!") for p in patterns):
            return path.rlike("|".join(f"(?:{pattern_regex(p)})" for p in patterns))
        parts = F.split(path, "/")
        ancestors = F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda n: F.concat(
                F.array_join(F.slice(parts, F.lit(1), n), "/"),
                F.when(n < F.size(parts), F.lit("/")).otherwise(F.lit("")),
            ),
        )
        return F.exists(ancestors, lambda p: verdict(p, patterns))

    return reduce(lambda a, b: a | b, (one_set(s.scope, s.patterns) for s in sets if s.patterns), F.lit(False))


def drop_ignored(files: DataFrame, sets: Iterable[IgnoreSet], path: str = "path", root: str = "") -> DataFrame:
    """Files no ignore set drops; paths are matched relative to `root`."""
    relative = P.relative_path(F.col(path), root) if root else F.col(path)
    return files.filter(~is_ignored(relative, sets))


def drop_containing(files: DataFrame, parts: Sequence[str] = tuple(NOISE_PARTS), path: str = "path") -> DataFrame:
    """Files whose folder path (without its last slash) contains none of the literals."""
    folder = F.regexp_extract(path, r"^(?s)(.*)/[^/]*$", 1)
    return files.filter(~reduce(lambda a, b: a | b, (folder.contains(p) for p in parts)))


def is_noise_name(name: Column) -> Column:
    """Hidden names and the three folder names a listing leaves out."""
    return name.startswith(".") | name.isin("node_modules", "__pycache__", "dist")


def metadata_search(
    files: DataFrame,
    ext: str | None = None,
    lang: str | None = None,
    name: str | None = None,
    recent_days: int | None = None,
    as_of: datetime | None = None,
    limit: int | None = 30,
) -> DataFrame:
    """Files that meet every given condition, newest first."""
    out = files
    if ext is not None:
        out = out.filter(F.col("extension") == P.dotted(ext))
    if lang is not None:
        out = out.filter(F.col("lang") == lang)
    if name is not None:
        out = out.filter(ascii_lower(F.col("filename")).contains(ascii_lower(F.lit(name))))
    if recent_days is not None:
        if as_of is None:
            raise ValueError("recent_days needs as_of, so that a rerun gives the same rows")
        out = out.filter(F.col("modified") > F.lit(as_of - timedelta(days=recent_days)))
    out = out.orderBy(F.desc("modified"), "path")
    return out if limit is None else out.limit(limit)


def largest(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy(F.desc("size_bytes"), "path").limit(n)


def with_any_tag(rows: DataFrame, file_tags: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Rows of files that carry one of the tags; a second matching tag adds nothing."""
    return rows.join(file_tags.filter(F.col("tag").isin(list(tags))).select("file_id"), "file_id", "left_semi")
