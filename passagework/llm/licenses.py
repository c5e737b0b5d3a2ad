"""License scan: ordered signature rules behind a keyword filter, overlaps resolved by priority and containment."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from passagework.functions.let import let
from passagework.llm.base import LOWER, UPPER, text_or_empty

# Phrases that are found wherever their words stand in a row, and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Signature:
    """A rule: `pattern` is tried on texts with `keyword`, which every match holds; a lower `priority` number wins over a higher one."""

    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


# Families: label, keyword, the ways to write the name, versions. Patterns see small words with one space between them;
# "2.0" reads "2 0" there.
_FAMILIES = [
    ("gpl", "general public licen", ["(?:the )?gnu general public licen[cs]e"], ["1", "2", "3"]),
    ("gpl", "gpl", ["gnu gpl"], ["1", "2", "3"]),
    ("lgpl", "general public licen", ["(?:the )?gnu (?:lesser|library) general public licen[cs]e"], ["2", "2.1", "3"]),
    ("agpl", "affero", ["(?:the )?gnu affero general public licen[cs]e"], ["1", "3"]),
    ("gpl", "gpl", ["gpl"], ["1", "2", "3"]),
    ("lgpl", "lgpl", ["(?:gnu )?lgpl"], ["2", "2.1", "3"]),
    ("agpl", "agpl", ["(?:gnu )?agpl"], ["1", "3"]),
    ("gfdl", "free documentation licen", ["(?:the )?gnu free documentation licen[cs]e"], ["1.1", "1.2", "1.3"]),
    ("apache", "apache", ["(?:the )?apache (?:software )?licen[cs]e"], ["1.0", "1.1", "2.0"]),
    ("apache", " asl ", ["asl"], ["1.0", "1.1", "2.0"]),
    ("mpl", "mozilla public licen", ["(?:the )?mozilla public licen[cs]e"], ["1.0", "1.1", "2.0"]),
    ("epl", "eclipse public licen", ["(?:the )?eclipse public licen[cs]e"], ["1.0", "2.0"]),
    ("cddl", "common development and distribution", ["(?:the )?common development and distribution licen[cs]e"], ["1.0", "1.1"]),
    ("cpl", "common public licen", ["(?:the )?common public licen[cs]e"], ["1.0"]),
    ("eupl", "european union public licen", ["(?:the )?european union public licen[cs]e"], ["1.0", "1.1", "1.2"]),
    ("afl", "academic free licen", ["(?:the )?academic free licen[cs]e"], ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("osl", "open software licen", ["(?:the )?open software licen[cs]e"], ["1.0", "2.0", "2.1", "3.0"]),
    ("artistic", "artistic licen", ["(?:the )?(?:perl )?artistic licen[cs]e"], ["1.0", "2.0"]),
    ("boost", "boost software licen", ["(?:the )?boost software licen[cs]e"], ["1.0"]),
    ("ofl", "open font licen", ["(?:the )?(?:sil )?open font licen[cs]e"], ["1.0", "1.1"]),
    ("zpl", "zope public licen", ["(?:the )?zope public licen[cs]e"], ["2.0", "2.1"]),
    ("psf", "python software foundation licen", ["(?:the )?python software foundation licen[cs]e"], ["2"]),
    ("php", "php licen", ["(?:the )?php licen[cs]e"], ["3.0", "3.01"]),
    ("ms-pl", "microsoft public licen", ["(?:the )?microsoft public licen[cs]e"], []),
    ("ms-rl", "microsoft reciprocal licen", ["(?:the )?microsoft reciprocal licen[cs]e"], []),
    ("isc", "isc licen", ["(?:the )?isc licen[cs]e"], []),
    ("zlib", "zlib", ["(?:the )?zlib(?: libpng)? licen[cs]e"], []),
    ("odbl", "open database licen", ["(?:the )?open database licen[cs]e"], ["1.0"]),
    ("odc-by", "open data commons", ["open data commons attribution licen[cs]e"], ["1.0"]),
    ("pddl", "open data commons", ["open data commons public domain dedication and licen[cs]e"], ["1.0"]),
    ("mit", "mit licen", ["(?:the )?mit licen[cs]e"], []),
    ("mit", "expat licen", ["(?:the )?expat licen[cs]e"], []),
    ("wtfpl", "what the fuck", ["do what the fuck you want to public licen[cs]e"], ["1", "2"]),
]
_CC_PARTS = {
    "by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:s|ative|atives)",
    "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:s|ative|atives)",
}
_CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
_BSD = {"2": "two|2|simplified", "3": "three|3|new|revised", "4": "four|4|original"}
# Sentences of license texts and notices.
_SENTENCES = [
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 1, 0.9),
    ("isc", "hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1, 0.9),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 1, 0.85),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it", 1, 0.85),
    ("public-domain", "public domain", "(?:dedicated|released|placed|is) (?:to|into|in) the public domain", 2, 0.7),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1, 0.95),
    ("unlicense", "unlicense", "(?:the )?unlicense", 2, 0.8),
    ("all-rights-reserved", "rights reserved", "all rights reserved", 3, 0.5),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 4, 0.3),
    ("license-notice", "ed under", "(?:licensed|released|distributed) under", 4, 0.2),
]


def _version(text: str) -> str:
    whole, _, part = text.partition(".")
    if not part:
        return f"{whole}(?: 0)?(?! [1-9])"
    return f"{whole}(?: 0)?(?! [1-9])" if part == "0" else f"{whole} {part}"


def signatures() -> list[Signature]:
    """All rules in order: for every family the versions with and without "or later", then the bare name."""
    out: list[Signature] = []

    def add(label: str, keyword: str, pattern: str, priority: int, score: float) -> None:
        out.append(Signature(label, keyword, f"(?<= ){pattern}(?= )", priority, score))

    for family, keyword, names, versions in _FAMILIES:
        for name in names:
            for version in versions:
                named = f"{name}(?: as published by the free software foundation either)? (?:(?:version|v) ?)?{_version(version)}"
                add(f"{family}-{version}-or-later", keyword, f"{named} or (?:\\(? ?at your option ?\\)? )?(?:any )?(?:later|newer|above)(?: version)?", 1, 0.95)
                add(f"{family}-{version}", keyword, f"{named}(?: only)?", 2, 0.9)
            add(family, keyword, name, 3, 0.75)
    for code, words in _CC_PARTS.items():
        short = code.replace("-", " ")
        for version in _CC_VERSIONS:
            add(f"cc-{code}-{version}", " cc ", f"cc {short} {_version(version)}", 2, 0.9)
            add(f"cc-{code}-{version}", "creative commons", f"creative commons {words}(?: (?:unported|international|generic))? (?:licen[cs]e )?(?:version )?{_version(version)}", 2, 0.9)
        add(f"cc-{code}", " cc ", f"cc {short}(?! (?:sa|nd|nc))", 3, 0.75)
        add(f"cc-{code}", "creative commons", f"creative commons {words}", 3, 0.75)
    for keyword, zero in ((" cc0 ", "cc0"), (" cc ", "cc zero"), ("creative commons", "creative commons zero")):
        add("cc0-1.0", keyword, f"{zero}(?: (?:version )?1(?: 0)?)?", 2, 0.9)
    for clauses, words in _BSD.items():
        add(f"bsd-{clauses}", " bsd ", f"(?:the )?(?:{words}) (?:clause )?bsd(?: licen[cs]e)?", 2, 0.9)
        add(f"bsd-{clauses}", " bsd ", f"(?:the )?bsd {clauses} clause(?: licen[cs]e)?", 2, 0.9)
    add("bsd", " bsd ", "(?:the )?(?:modified )?bsd(?: style)? licen[cs]e", 3, 0.75)
    for name in sorted({r.label for r in out}):
        words = name.replace("-", " ").replace(".", " ")
        add(name, "spdx", f"spdx licen[cs]e identifier {words}(?! (?:only|or|[0-9]))", 1, 1.0)
    for label, keyword, pattern, priority, score in _SENTENCES:
        add(label, keyword, pattern, priority, score)
    return out


def gate(text: Column, rules: list[Signature]) -> Column:
    """Whether a spaced text may hold a rule's keyword or a base phrase; other texts are not looked into.

    All letters are made small here, not A to Z alone, so the gate lets too much through but never too little.
    """
    words = {r.keyword for r in rules} | set(BASE_PHRASES)
    least = sorted(w for w in words if not any(x != w and x in w for x in words))
    return let(F.lower(F.concat(F.lit(" "), text, F.lit(" "))), lambda t: reduce(or_, [t.contains(w) for w in least]))


LEVELS = 4
# Detections that are compared with each other; what lies before a block is known by one number for each priority.
BLOCK = 64
# Never in a spaced text, where they stand around a match.
BEGIN, END = "\x01", "\x02"


def _table(rules: list[Signature]) -> Column:
    # One constant: a tree of thousands of literals takes the analyzer seconds.
    return F.from_json(F.lit(json.dumps([asdict(r) for r in rules])), "array<struct<label:string,keyword:string,pattern:string,priority:int,score:double>>")


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _found(norm: Column, rule: Column) -> Column:
    """The matches of a rule as detections: marks are put around them, and the marked words tell where they stand."""

    def of(words: Column) -> Column:
        starts = F.array_compact(F.transform(words, lambda w, i: F.when(w.startswith(BEGIN), i)))
        ends = F.array_compact(F.transform(words, lambda w, i: F.when(w.endswith(END), i + 1)))
        return F.zip_with(starts, ends, lambda start, end: F.struct(
            start.alias("start"), (-end).alias("order"), rule["priority"].alias("priority"),
            rule["label"].alias("label"), rule["score"].alias("score"),
        ))

    marked = F.regexp_replace(norm, rule["pattern"], F.lit(f"{BEGIN}$0{END}"))
    return let(marked, lambda m: F.when(m.contains(BEGIN), let(F.split(F.btrim(m), " "), of)))


def _resolved(detections: Column) -> Column:
    """Detections that no other one contains whose priority is as good or better.

    In order of begin, and the longest first (`order` is the end, negated), only what came before can contain a
    detection. One number for each priority, the furthest end so far, tells for all blocks before; the own block is
    looked through. So the time follows the number of detections.
    """
    levels = range(1, LEVELS + 1)

    def furthest(block: Column) -> Column:
        ends = [F.array_max(F.transform(F.filter(block, lambda d: d["priority"] <= k), lambda d: -d["order"])) for k in levels]
        return F.array(*[F.coalesce(e, F.lit(-1)) for e in ends])

    def before(blocks: Column) -> Column:
        begin = F.struct(F.array(*[F.lit(-1)] * LEVELS).alias("ends"), F.array().cast("array<array<int>>").alias("out"))
        return F.aggregate(
            F.transform(blocks, furthest), begin,
            lambda a, ends: F.struct(F.zip_with(a["ends"], ends, lambda x, y: F.greatest(x, y)).alias("ends"), F.array_append(a["out"], a["ends"]).alias("out")),
            lambda a: a["out"],
        )

    def inside(d: Column, i: Column, block: Column, ends: Column) -> Column:
        here = F.exists(F.slice(block, 1, i), lambda e: (e["priority"] <= d["priority"]) & (e["order"] <= d["order"]))
        return (F.get(ends, d["priority"] - 1) >= -d["order"]) | here

    def kept(blocks: Column) -> Column:
        return let(before(blocks), lambda known: F.flatten(F.transform(
            blocks, lambda block, n: F.filter(block, lambda d, i: ~inside(d, i, block, F.get(known, n))))))

    def cut(ordered: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(ordered) - 1) / BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda n: F.slice(ordered, n * BLOCK + 1, BLOCK))

    found = let(let(F.sort_array(detections), cut), kept)
    return F.transform(found, lambda d: F.struct(d["start"], (-d["order"]).alias("end"), d["label"], d["priority"], d["score"]))


def _places(norm: Column) -> Column:
    """Where the words of a base phrase stand in a row, as word numbers in order."""

    def starts(words: Column, i: Column) -> Column:
        return F.coalesce(reduce(or_, [
            reduce(and_, [F.get(words, i + k) == word for k, word in enumerate(phrase.split())]) for phrase in BASE_PHRASES
        ]), F.lit(False))

    def of(words: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: starts(words, i))

    return let(F.split(F.btrim(norm), " "), of)


def scanned(docs: DataFrame, text: str = "text", rules: list[Signature] | None = None) -> DataFrame:
    """(_row, found) for every row of `docs`: the row as a struct, and n_words, places, base_labels and detections.

    Words are runs of digits, letters a-z (A-Z made small) and characters beyond ASCII. `places` are word numbers of
    the base phrases; a detection has begin and end in words, label, priority and score. Everything happens inside
    the row: nothing is shuffled or collected, and a very long text, also one of very many notices, takes time in
    proportion to its length. Null and empty texts have no words and no detections, repeated rows have the same ones, columns of `docs` may have any name.
    """
    rules = signatures() if rules is None else rules
    rows = docs.select(F.struct("*").alias("_row"), text_or_empty(text).alias("_text"))
    rows = rows.select("_row", F.btrim(F.regexp_replace("_text", SEPARATORS, " "), F.lit(" ")).alias("_spaced"))
    # Only texts behind the gate are made small and looked into.
    rows = rows.withColumn("_norm", F.when(gate(F.col("_spaced"), rules), F.concat(F.lit(" "), F.translate("_spaced", UPPER, LOWER), F.lit(" "))))
    norm = F.col("_norm")
    phrases = F.array_compact(F.array(*[F.when(norm.contains(f" {p} "), F.lit(label)) for p, label in BASE_PHRASES.items()]))
    rows = rows.withColumn("_labels", phrases)
    table = _table(rules)
    active = F.filter(table, lambda r: norm.contains(r["keyword"]))
    detections = F.when(norm.isNotNull(), _resolved(F.flatten(F.array_compact(F.transform(active, lambda r: _found(norm, r))))))
    found = F.struct(
        F.when(F.length("_spaced") == 0, F.lit(0)).otherwise(_blanks(F.col("_spaced")) + 1).cast("long").alias("n_words"),
        F.when(F.size("_labels") > 0, _places(norm)).alias("places"),
        F.array_sort(F.array_distinct("_labels")).alias("base_labels"),
        detections.alias("detections"),
    )
    return rows.select("_row", F.explode_outer(F.array(found)).alias("found"))


def license_labels(docs: DataFrame, text: str = "text") -> DataFrame:
    """`scanned` with counts and labels: n_base, first_word, last_word, base_labels, labels, score from 0 to 1."""
    rows = scanned(docs, text).select("_row", "found.*")
    places = F.coalesce(F.col("places"), F.array().cast("array<int>"))
    seen = F.coalesce(F.col("detections"), F.array().cast(rows.schema["detections"].dataType))
    # A base phrase is a sure sign of its family, though of no version.
    base_score = F.when(F.size("base_labels") > 0, 0.75).otherwise(0.0)
    labels = F.array_sort(F.array_union("base_labels", F.transform(seen, lambda d: d["label"])))
    return rows.select(
        "_row", "n_words", F.size(places).cast("long").alias("n_base"),
        F.get(places, F.lit(0)).cast("long").alias("first_word"), F.get(places, F.size(places) - 1).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(base_score, F.coalesce(F.array_max(F.transform(seen, lambda d: d["score"])), F.lit(0.0))).alias("score"),
        seen.alias("detections"),
    )
