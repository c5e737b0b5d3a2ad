"""Text expressions: folding, word and gram tokens, scripts, previews."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# A word is a run of letters, digits or private-use characters.
WORD_PATTERN = r"[\p{L}\p{N}\p{Co}]+"
# What a word may hold before it is folded (ASCII first: found soonest), and the marks that folding drops.
UNFOLDED, MARKS = r"a-z0-9\p{L}\p{N}\p{Co}", r"\u0300-\u0331"
CJK_CLASS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
INK_PATTERN = r"(?U)\S"
SPACE_PATTERN = r"(?U)\s+"
# Characters of a gram.
GRAM = 3
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _latin_folds() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their bare letter, then the marks to drop."""
    marked, bare = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        base, *marks = unicodedata.normalize("NFD", letter)
        if letter.islower() and marks and base in ASCII_LOWER and all(map(unicodedata.combining, marks)):
            marked.append(letter)
            bare.append(base)
    combining = "".join(map(chr, range(0x0300, 0x0332)))
    return "".join(marked) + combining, "".join(bare)


FOLD_FROM, FOLD_TO = _latin_folds()
# The same for `str.translate`.
FOLDS = str.maketrans(FOLD_FROM[:len(FOLD_TO)], FOLD_TO, FOLD_FROM[len(FOLD_TO):])


def fold_words(text: Column) -> Column:
    """Lower case without Latin diacritics; other scripts keep their marks.

    Pure ASCII text (same length in bytes and characters) skips the letter table.
    """
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.char_length(text), low).otherwise(
        F.translate(low, FOLD_FROM, FOLD_TO)
    )


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold_words(text), F.lit(WORD_PATTERN), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of `word_tokens`. Folding changes no word into two or none, so it is left out."""
    return F.size(F.regexp_extract_all(F.lower(text), F.lit(f"[{UNFOLDED}][{UNFOLDED}{MARKS}]*"), F.lit(0)))


def spaced_words(text: Column) -> Column:
    """The words of `word_tokens` before their folding by `FOLDS`, and what folds to nothing, with single spaces between."""
    return F.regexp_replace(F.lower(text), f"[^{UNFOLDED}{MARKS}]+", " ")


def fold_grams(text: Column) -> Column:
    return F.lower(text)


def char_grams(folded: Column, size: int = GRAM) -> Column:
    """Every run of `size` characters of an already folded text, overlapping."""
    return F.regexp_extract_all(folded, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))


def gram_count(text: Column, size: int = GRAM) -> Column:
    return F.greatest(F.char_length(text) - (size - 1), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower case for A to Z only, the case rule of the substring branch."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def has_ink(text: Column) -> Column:
    """True unless the text is blank in the Unicode sense."""
    return text.rlike(INK_PATTERN)


def query_tokens(text: Column) -> Column:
    """Whitespace separated tokens of a query."""
    return F.filter(F.split(text, SPACE_PATTERN), lambda t: t != "")


def contains_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK_CLASS}]")


def cjk_count(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{CJK_CLASS}]", ""))


def needs_substring_scan(text: Column) -> Column:
    """True if a token of the query holds one or two CJK characters."""
    return F.exists(query_tokens(text), lambda t: contains_cjk(t) & (cjk_count(t) < 3))


def overlapping_count(text: Column, part: Column) -> Column:
    """How many positions of `text` start an occurrence of `part`."""
    quoted = F.concat(F.lit("\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.regexp_count(text, F.concat(F.lit("(?="), quoted, F.lit(")")))


def one_line(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def preview(text: Column, width: int = 120) -> Column:
    """One line, cut at `width` characters with an ellipsis if something was cut."""
    line = one_line(text)
    return F.when(F.char_length(line) > width, F.concat(F.substring(line, 1, width), F.lit("..."))).otherwise(line)


def leading(text: Column, width: int) -> Column:
    """One line cut at `width` characters, for display."""
    return F.substring(one_line(text), 1, width)


def valid_text(raw: Column) -> Column:
    """Bytes to text; broken sequences become the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))
