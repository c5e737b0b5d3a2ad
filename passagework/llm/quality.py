"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from passagework.functions.let import let
from passagework.llm.base import blank_split, text_or_empty, trimmed

# Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for on as was by at an or are this from "
    "de la le les et des en un une du que qui dans pour est pas par sur avec ou au "
    "der die das und den von zu mit ist ein eine im nicht auf für sich dem des auch "
    "el los las y se con por para su lo del no al una es como"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A row of the table: `metric / per` must lie between `low` and `high` for documents of `from_words` words or more."""

    name: str
    metric: str
    per: str | None = None
    low: float | None = None
    high: float | None = None
    from_words: int = 0

    def failed(self) -> Column:
        value = F.col(self.metric)
        # A product instead of a quotient: nothing is divided by zero.
        scale = F.col(self.per) if self.per else F.lit(1)
        tests = []
        if self.low is not None:
            tests.append(value < scale * F.lit(self.low))
        if self.high is not None:
            tests.append(value > scale * F.lit(self.high))
        return reduce(Column.__or__, tests) & (F.col("n_words") >= self.from_words)


#: The first two are the base: fewer than 10 words, or over a fifth of the words in repeated windows.
BASE_RULES = (
    Rule("few_words", "n_words", low=10),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.2),
)
METHOD_RULES = (
    Rule("word_length", "word_chars", "n_words", low=2, high=15),
    Rule("symbols", "n_symbols", "n_words", high=0.25),
    Rule("shouting", "n_upper", "n_letters", high=0.5, from_words=20),
    Rule("marks", "n_marks", "n_words", high=0.5, from_words=20),
    Rule("letters", "n_letters", "word_chars", low=0.5),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02, from_words=50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9, from_words=20),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.3, from_words=20),
)


def _count_of(text: str, characters: str) -> Column:
    """How many characters of a text are in a set, given as the inside of a regular expression's brackets."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def _windows(words: str, size: int) -> Column:
    """Every window of `size` words as one string; a word holds no blank, so that the strings tell all windows apart."""
    w, n = F.col(words), F.size(words)
    zipped = F.arrays_zip(*[F.slice(w, k + 1, n) for k in range(size)])
    return F.when(n >= size, F.slice(zipped, 1, n - size + 1).cast("array<string>")).otherwise(F.array().cast("array<string>"))


def _repeated_words(windows: str, size: int) -> Column:
    """Words under windows that an equal window stands elsewhere for."""
    places = F.sequence(F.lit(0), F.size(windows) - 1)
    ordered = F.sort_array(F.arrays_zip(F.col(windows).alias("w"), places.alias("p")))

    def twice(rows: Column) -> Column:
        same = lambda x, j: x["w"].eqNullSafe(F.get(rows, j)["w"])
        return F.sort_array(F.transform(F.filter(rows, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["p"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
    covered = F.aggregate(
        let(ordered, twice), start,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(size), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    # Most texts hold no window twice; a set of them tells that at once.
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(0)


def metrics(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """(_row, metrics): every row of `docs` as a struct, and the counts that the rules use as another.

    Words lie between blanks (space, tab to carriage return). A null or blank text has no words. `n_repeat_words`
    counts words in windows of `window` words that the text holds twice or more. Work and memory of a row grow with
    n log n of its words; rows never meet, so nothing is shuffled. Columns of `docs` may have any name.
    """
    ready = docs.select(F.struct("*").alias("_row"), text_or_empty(text).alias("_text"))
    # What is no small letter is a quarter of a text; the character counts are taken on that.
    rest = F.regexp_replace("_text", "\\p{Ll}+", "").alias("_rest")
    ready = ready.select("_row", F.length("_text").alias("_length"), rest, blank_split(F.col("_text")).alias("_words"), F.split("_text", "\n").alias("_all_lines"))
    ready = ready.select("_row", "_length", "_rest", "_words", _windows("_words", window).alias("_windows"),
                         F.filter("_all_lines", lambda x: F.length(trimmed(x)) > 0).alias("_lines"))
    starts = lambda signs: F.size(F.filter("_lines", lambda x: F.substring(trimmed(x), 1, 1).isin(*signs)))
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.col("_length") - _count_of("_rest", " \\t-\\r"),
        "n_symbols": _count_of("_rest", SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeated_words("_windows", window),
        "n_lines": F.size("_lines"),
        "n_upper": _count_of("_rest", "A-Z"),
        "n_letters": F.col("_length") - F.length("_rest") + _count_of("_rest", "\\p{L}"),
        "n_marks": _count_of("_rest", "!?"),
        "n_stop_words": F.size(F.filter("_words", lambda x: F.lower(x).isin(*STOP_WORDS))),
        "n_bullet_lines": starts(["-", "*", "•", "‣"]),
        "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
    }
    made = F.struct(*[c.cast("long").alias(k) for k, c in counts.items()])
    # One row in, one row out; no later filter on a count passes this step and computes the counts again.
    return ready.select("_row", F.explode_outer(F.array(made)).alias("metrics"))


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = METHOD_RULES) -> DataFrame:
    """(_row, the counts, base_failed, failed: names of the failed rules, kept) for every row of `docs`.

    `_row` is the input row as a struct, so that its columns cannot clash with the counts. A document without
    words fails `few_words`. Repeated rows are judged one by one, an empty table gives no rows.
    """
    rows = metrics(docs, text).select("_row", "metrics.*")
    table = BASE_RULES + tuple(rules)
    names = F.array_compact(F.array(*[F.when(rule.failed(), F.lit(rule.name)) for rule in table]))
    base = F.arrays_overlap(F.col("failed"), F.array(*[F.lit(rule.name) for rule in BASE_RULES]))
    return rows.withColumn("failed", names).withColumn("base_failed", base).withColumn("kept", F.size("failed") == 0)


def good_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass every rule, with the columns they came with."""
    return judged(docs, text).filter("kept").select("_row.*")
