"""Front matter of Markdown files, read with JVM expressions only.

A block lies between a leading `---` and the next line that starts with `---`. It is cut
into entries at the lines that begin without a blank; every entry is a key and the text
up to the next one. Understood are

* keys: plain (also with dots and blanks) or quoted;
* `title` and `description`: plain or quoted, over several lines, with anchors or types
  before them, and as folded (`>`) or literal (`|`) text with `-` and `+`;
* `tags`: a flow list over any lines or a block list; comments anywhere.

A block gives nothing at all, and stays in the text, if a line outside of an entry is no
mapping, a key occurs twice, a one-line value holds a second mapping, `title` or
`description` is a list or mapping, `tags` is a scalar, or one of these three has a
quoted value that does not end or an escape other than `\\" \\\\ \\/ \\n \\t`. Lines of folded text that are
indented further are folded like all others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from passagework.functions.let import let

BLOCK = r"(?s)\A---(.*?)\n---"
# A new entry: a line that begins neither with a blank, a comment, a list item nor the end of a flow list.
NEXT_ENTRY = r"\n(?=[^\s#\-\]}]|-\S)"
DOUBLE = r'"(?:[^"\\]++|\\.)*+"'
SINGLE = r"'(?:[^']++|'')*+'"
ENTRY = rf"""(?s)\A({DOUBLE}|{SINGLE}|[^\s"'\[\]{{}}#&*!|>%@`,](?:[^\n:]|:(?=\S))*+):(?=\s|\z)(.*)\z"""
PROPERTIES = r"\A\s*(?:[&!]\S*(?:\s+|\z))*"
NESTED_COLON = r"""\A[^\s"'\[{|>#][^\n]*?:(?:[ \t]|\n|\z)"""
BLOCK_SCALAR = r"(?s)\A([|>])([-+0-9]*)[ \t]*(?:#[^\n]*)?(?:\n(.*))?\z"
COMMENT_LINE = r"(?m)^[ \t]*#.*$"
# A comment begins with a mark after a blank, outside quotes.
COMMENT = r"""(?m)^((?:[^"'#\n]|(?<![ \t\n])#|(?<![^ \t\[,\n])"(?:[^"\\\n]|\\.)*"|(?<![^ \t\[,\n])'[^'\n]*'|(?<=[^ \t\[,\n])["'])*?)[ \t]+#.*$"""
FLOW = r"(?s)\A\[(.*)\]\s*\z"
FLOW_ITEM = rf"""\s*({DOUBLE}|{SINGLE}|[^,]*)\s*(?:,|\z)"""
LISTED = r"\A(?:\s*\n)?[ \t]*-(?:[ \t\n]|\z)"
LIST_ITEM = r"(?m)^[ \t]*-[ \t]+(.*(?:\n[ \t]+(?!-[ \t])\S.*)*)"
MAPPING = r"\A[^\n]*?:(?:[ \t]|\n|\z)"
NULLS = ["", "~", "null", "Null", "NULL"]
# Stands for a backslash while escapes are read.
KEPT = "\x00"


def has_block(content: Column) -> Column:
    return content.startswith("---") & content.rlike(BLOCK)


def body(content: Column) -> Column:
    """Text after a readable block; the whole text if there is none."""
    return F.when(parse(content).isNotNull(), F.regexp_replace(content, BLOCK, "")).otherwise(content)


def _replaced(text: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda t, step: F.regexp_replace(t, *step), steps, text)


def _joined_lines(text: Column) -> Column:
    """Lines as one: a line end is a blank, each empty line a line end."""
    return _replaced(text, (r"[ \t]*\n[ \t]*", "\n"), (r"(?<!\n)\n(?!\n)", " "), (r"\n(\n+)", "$1"))


def _inner(quoted: Column) -> Column:
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def _scalar_text(value: Column) -> Column:
    """A quoted or plain scalar as text; NULL for an empty plain one, or where a quoted one is not understood."""

    def of(text: Column) -> Column:
        double = F.replace(_replaced(
            F.replace(_inner(text), F.lit("\\\\"), F.lit(KEPT)), (r'\\(["/])', "$1"), (r"\\n", "\n"), (r"\\t", "\t"),
        ), F.lit(KEPT), F.lit("\\"))
        return (
            F.when(text.rlike(rf"\A{DOUBLE}\z") & ~F.replace(text, F.lit("\\\\"), F.lit("")).rlike(r'\\[^"/nt]'), double)
            .when(text.rlike(rf"\A{SINGLE}\z"), F.replace(_inner(text), F.lit("''"), F.lit("'")))
            .when(~text.rlike(r"""\A["']""") & ~text.isin(NULLS), text)
        )

    return let(F.regexp_replace(_joined_lines(F.btrim(value, F.lit(" \t\n"))), PROPERTIES, ""), of)


def _block_text(value: Column) -> Column:
    """The text of a folded or literal scalar: indented as its first line, ended as its sign says."""
    style, sign = F.regexp_extract(value, BLOCK_SCALAR, 1), F.regexp_extract(value, BLOCK_SCALAR, 2)

    def of(lines: Column) -> Column:
        indent = F.length(F.regexp_extract(lines, r"\A(?:[ \t]*\n)*( +)", 1))
        flat = F.array_join(F.transform(F.split(lines, "\n"), lambda line: F.substring(line, indent + 1, F.length(line))), "\n")
        text = F.regexp_replace(flat, r"\n+\z", "")
        folded = F.when(style == ">", _replaced(text, (r"(?<!\n)\n(?!\n)", " "), (r"\n(\n+)", "$1"))).otherwise(text)
        end = F.when(sign.contains("-") | (text == ""), "").when(sign.contains("+"), F.concat(F.regexp_extract(flat, r"(\n*)\z", 1), F.lit("\n")))
        return F.concat(folded, end.otherwise("\n"))

    return let(F.regexp_extract(value, BLOCK_SCALAR, 3), of)


def _entries(block: Column) -> Column:
    """array<struct<key, value, text, is_text, nested>>; a key is NULL where an entry is no mapping.

    `text` is the value as a scalar, `is_text` whether it is one or empty.
    """

    def entry(cut: Column) -> Column:
        clean, is_block = cut["clean"], cut["value"].rlike(BLOCK_SCALAR)
        one_line = cut["raw"].rlike(r"\A[ \t]+[^\s#]")

        def judged(text: Column) -> Column:
            quoted = clean.rlike(r"""\A["']""")
            other = clean.rlike(r"\A[\[{]|\A-(?:\s|\z)") | (~quoted & clean.rlike(MAPPING))
            return F.struct(
                F.when(cut["key"] != "", _scalar_text(cut["key"])).alias("key"), clean.alias("value"), text.alias("text"),
                (is_block | (~other & (~quoted | text.isNotNull()))).alias("is_text"),
                (~is_block & one_line & clean.rlike(NESTED_COLON)).alias("nested"),
            )

        return let(F.when(is_block, _block_text(cut["value"])).otherwise(_scalar_text(clean)), judged)

    def cut(text: Column) -> Column:
        raw = F.regexp_extract(text, ENTRY, 2)
        value = F.regexp_replace(raw, PROPERTIES, "")
        clean = F.btrim(_replaced(value, (COMMENT_LINE, ""), (COMMENT, "$1")), F.lit(" \t\n"))
        return F.struct(F.regexp_extract(text, ENTRY, 1).alias("key"), raw.alias("raw"), value.alias("value"), clean.alias("clean"))

    # What precedes the first key holds comments and indented lines at most.
    return F.transform(F.transform(F.slice(F.split(block, NEXT_ENTRY), 2, 1 << 30), cut), entry)


def _text(entries: Column, key: str) -> Column:
    """struct<text, ok> of a scalar entry; no entry is an empty one."""
    found = F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))
    return let(found, lambda e: F.struct(e["text"].alias("text"), F.coalesce(e["is_text"], F.lit(True)).alias("ok")))


def _tags(entries: Column) -> Column:
    """struct<tags, ok>; an empty list and no value are no tags."""
    found = F.get(F.filter(entries, lambda e: e["key"] == "tags"), F.lit(0))

    def of(e: Column) -> Column:
        value = e["value"]
        is_flow, is_list, none = value.rlike(FLOW), value.rlike(LISTED), e.isNull() | value.isin(NULLS)
        flow = F.regexp_extract_all(F.regexp_extract(value, FLOW, 1), F.lit(FLOW_ITEM), F.lit(1))
        items = F.when(is_flow, flow).when(is_list, F.regexp_extract_all(value, F.lit(LIST_ITEM), F.lit(1)))
        texts = F.transform(F.filter(items, lambda t: F.btrim(t, F.lit(" \t\n")) != ""), lambda t: F.struct(t.alias("raw"), _scalar_text(t).alias("text")))

        def judged(pairs: Column) -> Column:
            understood = F.forall(pairs, lambda p: p["text"].isNotNull() | ~p["raw"].rlike(r"""\A\s*["']"""))
            tags = F.filter(F.transform(pairs, lambda p: p["text"]), lambda t: t.isNotNull() & (t != ""))
            return F.struct(F.when(F.size(tags) > 0, tags).alias("tags"), (none | ((is_flow | is_list) & understood)).alias("ok"))

        return let(texts, judged)

    return let(found, lambda e: of(e))


def parse(content: Column) -> Column:
    """struct<title, description, tags>, NULL without a readable block."""

    def fields(block: Column) -> Column:
        keys = F.transform(block["entries"], lambda e: e["key"])
        mapping = (
            F.forall(block["entries"], lambda e: e["key"].isNotNull() & ~e["nested"])
            & (F.size(F.array_distinct(keys)) == F.size(keys)) & ~block["head"].rlike(r"(?m)^-")
        )

        def chosen(parts: Column) -> Column:
            ok = mapping & parts["title"]["ok"] & parts["description"]["ok"] & parts["tags"]["ok"]
            return F.when(ok, F.struct(
                parts["title"]["text"].alias("title"), parts["description"]["text"].alias("description"), parts["tags"]["tags"].alias("tags"),
            ))

        entries = block["entries"]
        return let(F.struct(
            _text(entries, "title").alias("title"), _text(entries, "description").alias("description"), _tags(entries).alias("tags"),
        ), chosen)

    block = F.regexp_extract(content, BLOCK, 1)
    cut = F.struct(_entries(block).alias("entries"), F.get(F.split(block, NEXT_ENTRY), F.lit(0)).alias("head"))
    return F.when(has_block(content), let(cut, fields))
