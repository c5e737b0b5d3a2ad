"""Queries as a table of clauses, so that many queries run as one job.

A query is a list of groups; a chunk matches if any group does. A group is a list of
clauses; it matches if every `must` clause is found and no `must_not` clause is.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from passagework.functions import text as X
from passagework.operators.joins import bounded_rows
from passagework.schemas import CLAUSES

CLAUSE_KEY = ["query_id", "group_no", "clause_no"]


class Clause(NamedTuple):
    text: str
    form: str = "term"
    kind: str = "must"


def term(text: str) -> Clause:
    return Clause(text, "term")


def phrase(text: str) -> Clause:
    return Clause(text, "phrase")


def prefix(text: str) -> Clause:
    return Clause(text.rstrip("*"), "prefix")


def without(clause: Clause) -> Clause:
    return clause._replace(kind="must_not")


@dataclass(frozen=True)
class ClauseTable:
    """`frame` holds one row per clause with its folded words (`terms`).

    `rows` is a proven upper bound of clauses and of their words, or None;
    `one_group` says that no query has a second group, `one_word` that no clause has
    a second word; `forms` are the clause forms that can occur.
    """

    frame: DataFrame
    rows: int | None
    one_group: bool = False
    one_word: bool = False
    forms: frozenset[str] = frozenset({"term", "phrase", "prefix"})


def clause_table(spark: SparkSession, queries: Mapping[str, Sequence[Sequence[Clause]]]) -> ClauseTable:
    """Clauses of queries given in the program: {query_id: [group, ...]}."""
    rows = [
        (str(query_id), group_no, clause_no, c.kind, c.form, c.text)
        for query_id, groups in queries.items()
        for group_no, group in enumerate(groups)
        for clause_no, c in enumerate(group)
    ]
    # An Arrow table becomes a local relation of the plan: no task, no Python worker.
    columns = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows), CLAUSES.fields)]
    frame = spark.createDataFrame(pa.table(columns, names=CLAUSES.names), CLAUSES)
    return ClauseTable(
        _analysed(frame),
        # A text of n characters has at most n words.
        rows=sum(len(r[5]) + 1 for r in rows),
        one_group=all(len(groups) <= 1 for groups in queries.values()),
        one_word=all(r[5].isalnum() for r in rows),
        forms=frozenset(r[4] for r in rows),
    )


def all_of(spark: SparkSession, queries: Mapping[str, str]) -> ClauseTable:
    """Plain texts: every whitespace token is required."""
    return clause_table(spark, {q: [[term(t) for t in text.split()]] for q, text in queries.items()})


def any_of(spark: SparkSession, queries: Mapping[str, Iterable[str]]) -> ClauseTable:
    """Plain words per query: one is enough."""
    return clause_table(spark, {q: [[term(t)] for t in words] for q, words in queries.items()})


def from_texts(texts: DataFrame, match: str = "all", bag_of_words: bool = False) -> ClauseTable:
    """Clauses of a (query_id, text) frame of any size; equal tokens count once.

    `match` is "all" (every token required) or "any" (one group per token). Tokens
    are separated by whitespace, or are the folded words with `bag_of_words`.
    """
    if match not in ("all", "any"):
        raise ValueError(match)
    split = X.word_tokens if bag_of_words else X.query_tokens
    tokens = texts.select(
        F.col("query_id").cast("string").alias("query_id"),
        F.posexplode(F.array_distinct(split(F.col("text")))).alias("place", "text"),
    )
    group, clause = ("place", F.lit(0)) if match == "any" else (F.lit(0), "place")
    rows = tokens.select(
        "query_id",
        (F.col(group) if isinstance(group, str) else group).alias("group_no"),
        (F.col(clause) if isinstance(clause, str) else clause).alias("clause_no"),
        F.lit("must").alias("kind"),
        F.lit("term").alias("form"),
        "text",
    )
    return from_frame(rows, one_group=match == "all", one_word=bag_of_words, forms=("term",))


def from_frame(
    frame: DataFrame, one_group: bool = False, one_word: bool = False,
    forms: Iterable[str] = ("term", "phrase", "prefix"),
) -> ClauseTable:
    """A frame with the columns of `schemas.CLAUSES`; its size is checked once."""
    analysed = _analysed(frame)
    words = analysed.select(F.explode_outer("terms"))
    return ClauseTable(analysed, bounded_rows(words), one_group, one_word, frozenset(forms))


def _analysed(frame: DataFrame) -> DataFrame:
    return frame.withColumn("terms", X.word_tokens(F.col("text")))
