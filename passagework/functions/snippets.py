"""Short highlighted fragments of the chunks that made it into a result."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from passagework.functions.let import let
from passagework.functions.text import WORD_PATTERN, fold_grams, fold_words

# Hit markers, gap mark and fragment length in tokens.
OPEN, CLOSE, GAP, WIDTH = ">>>", "<<<", "...", 40


def word_snippet(
    content: Column, terms: Column, prefixes: Column, width: int = WIDTH,
    opening: str = OPEN, closing: str = CLOSE, gap: str = GAP,
) -> Column:
    """The `width` word window with most distinct hits, the earliest of equals.

    `terms` are folded words, `prefixes` folded word beginnings.
    """

    def hit_of(word: Column) -> Column:
        """The query word a text word stands for, NULL if none."""
        return F.when(F.array_contains(terms, word), word).otherwise(
            F.get(F.filter(prefixes, lambda p: word.startswith(p)), F.lit(0))
        )

    def fragment(words: Column, gaps: Column, hits: Column) -> Column:
        last = F.greatest(F.size(words) - width, F.lit(0))
        windows = F.transform(
            F.sequence(F.lit(0), last),
            lambda at: F.struct(
                F.size(F.array_distinct(F.filter(F.slice(hits, at + 1, F.lit(width)), lambda h: h.isNotNull()))).alias("hits"),
                (-at).alias("back"),
            ),
        )

        def render(start: Column) -> Column:
            end = F.least(start + width, F.size(words)) - 1
            pieces = F.transform(
                F.sequence(start, end),
                lambda i: F.concat(
                    F.when(i == start, F.lit("")).otherwise(F.get(gaps, i)),
                    F.when(F.get(hits, i).isNotNull(), F.concat(F.lit(opening), F.get(words, i), F.lit(closing)))
                    .otherwise(F.get(words, i)),
                ),
            )
            head = F.when(start > 0, F.lit(gap)).otherwise(F.get(gaps, F.lit(0)))
            tail = F.when(end + 1 < F.size(words), F.lit(gap)).otherwise(F.get(gaps, end + 1))
            return F.concat(head, F.array_join(pieces, ""), tail)

        return let(-F.array_max(windows)["back"], render)

    def on_words(words: Column) -> Column:
        folded = F.transform(words, fold_words)
        return let(
            F.split(content, WORD_PATTERN, -1),
            lambda gaps: let(F.transform(folded, hit_of), lambda hits: fragment(words, gaps, hits)),
        )

    words = F.regexp_extract_all(content, F.lit(WORD_PATTERN), F.lit(0))
    return F.when(content.rlike(WORD_PATTERN), let(words, on_words)).otherwise(content)


def gram_snippet(
    content: Column, parts: Column, width: int = WIDTH,
    opening: str = OPEN, closing: str = CLOSE, gap: str = GAP,
) -> Column:
    """`width` + 2 characters around the first occurrence of one of the folded `parts`."""
    span = width + 2
    folded = fold_grams(content)
    found = F.filter(
        F.transform(parts, lambda p: F.struct(F.position(p, folded).alias("at"), F.char_length(p).alias("len"))),
        lambda h: h["at"] > 0,
    )

    def render(hit: Column) -> Column:
        start = F.greatest(hit["at"] - F.lit(span // 4), F.lit(1))
        stop = F.least(F.greatest(start + span, hit["at"] + hit["len"]), F.char_length(content) + 1)
        return F.concat(
            F.when(start > 1, F.lit(gap)).otherwise(F.lit("")),
            F.substring(content, start, hit["at"] - start),
            F.lit(opening), F.substring(content, hit["at"], hit["len"]), F.lit(closing),
            F.substring(content, hit["at"] + hit["len"], stop - hit["at"] - hit["len"]),
            F.when(stop <= F.char_length(content), F.lit(gap)).otherwise(F.lit("")),
        )

    return let(F.array_min(found), render)
