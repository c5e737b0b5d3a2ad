"""Queries that SQL cannot express, against plain Python over the smallest tables and over odd rows."""

import glob
import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from passagework.llm import contamination, licenses, mixing, personal, repeats, shards, simhash
from passagework.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def rows_of(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


# Decontamination --------------------------------------------------------------------


def contaminated(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        words = WORD.findall(small(text))
        if item is None:
            continue
        size = min(13, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[k : k + size])].add(str(item))
    sizes = {len(w) for w in windows}
    for doc, text, *_ in docs:
        words, hit, found = WORD.findall(small(text)), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if items_of := windows.get(tuple(words[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= items_of
        yield doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words)


VERDICT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_contamination_of_documents(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = rows_of(QUERIES["op3_winnowing"](spark, SF), *VERDICT)
    assert got == sorted(contaminated(documents, items), key=repr)
    assert any(r[-1] for r in got)


@pytest.mark.parametrize("block", [4 << 20, 40])
def test_contamination_of_odd_rows(spark, docs_of, odd_rows, monkeypatch, block):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", block)
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (2, "beta, GAMMA"), (2, "same"),
             (3, None), (None, "alpha"), (4, "..."), (5, "eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"),
             (6, "beta gamma"), (7, "delta0 epsilon0 zeta0 eta0 theta0 iota0")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = contamination.verdicts(contamination.matched(docs_of(odd_rows), table, ["doc_id"]))
    got = rows_of(found.select("_row.doc_id", *VERDICT[1:]), *VERDICT)
    assert got == sorted(contaminated(odd_rows, items), key=repr)


def test_contamination_without_items_or_documents(spark, docs_of, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.clean_documents(docs_of(odd_rows), none).count() == len(odd_rows)
    assert contamination.clean_documents(docs_of([]), none).columns == docs_of([]).columns


@pytest.mark.parametrize("size", range(1, 14))
def test_fingerprints_of_short_parts(size):
    for count in range(31):
        text = " ".join(f"w{i}" for i in range(count)).encode()
        words = contamination.Words(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
        k = min(5, size)
        grams = contamination.mixed(contamination._combined(words.hashes[0], contamination._BASES[0], k)).tolist()
        assert words.fingerprints(size).tolist() == [min(grams[i : i + size - k + 1]) for i in range(count - size + 1)]


# Personal data ----------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and personal.luhn(digits(m))]
    return spans + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


@pytest.mark.parametrize("text", [
    "a@b.c_d@e.f x@y @z.w a@b..c a.b@c-d.e.", "é1@x.yz,2@x.yz@q.rs", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 1.2.3", "1.2.3.4@a.b",
    "4111 1111 1111 1111 4111-1111-1111-1112 4 4", "+1 (555) 123-4567 +12 +1(((((9 ++49 30 1234567)", "0" * 500 + "." + "9" * 500, "",
])
def test_base_spans(text):
    assert personal.base_spans(text) == base(text)


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "a." * 150_000, "1" * 300_000, "1." * 150_000, "+1(" * 100_000, "a@" * 100_000):
        personal.base_spans(text)


def test_personal_spans_of_documents(spark, documents):
    got = rows_of(QUERIES["op4_weak_supervision"](spark, SF), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = []
    for doc, text, _ in documents:
        spans = base(text or "")
        counts = [sum(s[0] == k for s in spans) for k in personal.BASE_KINDS]
        want.append((doc, *counts, sha(",".join(f"{k}:{s}:{e}" for k, s, e in spans))))
    assert got == sorted(want, key=repr)


def test_method_adds_secrets_and_keeps_the_base(spark, docs_of):
    rows = [(i, f'mail me: user{i}@mail.example.com or +1 (555) 555-{i:04d}, token = "{i:08x}9c3f77aa12bd4e60"', "s") for i in range(40)]
    out = personal.personal_spans(docs_of([*rows, (50, None, None)]), ["doc_id"]).collect()
    assert all({s.kind for s in r.base} == {"email", "phone"} and [s.kind for s in r.added] == ["secret"] for r in out if r._row.doc_id < 50)
    assert personal.personal_spans(docs_of([]), ["doc_id"]).collect() == []


@pytest.mark.parametrize("size", [7, 8, 128, 129, 200, 100_000])
def test_secrets_of_any_length(size):
    text = "api_key = " + ("a1b2" * size)[:size]
    assert [s for s in personal.candidates(text, []) if s[0] == "secret"] == ([("secret", 10, 10 + size)] if size >= 8 else [])


def test_reliabilities_find_the_truth():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.6
    votes = np.stack([np.where(rng.random(4000) < right, truth, ~truth) * 2 - 1 for right in (0.95, 0.8, 0.7, 0.6)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    chances, chance = personal.reliabilities(patterns, counts.astype(float))
    assert chances[0, 1, 2] > chances[1, 1, 2] > chances[2, 1, 2] > chances[3, 1, 2]
    of = {tuple(p): c for p, c in zip(patterns, chance, strict=True)}
    assert np.mean([(of[tuple(v)] > 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.93


# Licenses ---------------------------------------------------------------------------


def license_base(text):
    words, places, labels = WORD.findall(small(text)), [], set()
    for i in range(len(words)):
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.split()
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), *((places[0], places[-1]) if places else (None, None)), ",".join(sorted(labels))


LICENSE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def test_licenses_of_documents(spark, documents):
    got = rows_of(QUERIES["op6_license_rules"](spark, SF), *LICENSE)
    assert got == sorted(((d, *license_base(t)) for d, t, _ in documents), key=repr)


def test_license_rules(spark, docs_of, odd_rows):
    texts = {
        20: ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0,license-notice"),
        21: ("This is under the GNU General Public License, version 3 or later.", "gpl,gpl-3-or-later"),
        22: ("the GNU Affero General Public License v3; MIT license MIT License", "agpl-3,mit"),
        23: ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
        24: ("Apache License 2.0 and apache license", "apache,apache-2.0"),
        25: ("a licence for fishing", ""),
        26: ("mit  LICENSE " * 3000, "mit"),
        27: ("the license is mit", ""),
    }
    rows = [*odd_rows, *[(i, t, "a") for i, (t, _) in texts.items()]]
    out = licenses.license_labels(docs_of(rows)).select("_row.doc_id", "*")
    assert rows_of(out, *LICENSE) == sorted(((i, *license_base(t)) for i, t, _ in rows), key=repr)
    found = {r.doc_id: r for r in out.filter("doc_id >= 20").collect()}
    assert {i: found[i].labels for i in texts} == {i: labels for i, (_, labels) in texts.items()}
    assert all(0 <= r.score <= 1 for r in found.values())
    spans = [(d.start, d.end, d.label) for d in found[22].detections]
    assert spans == [(0, 7, "agpl-3"), (7, 9, "mit"), (9, 11, "mit")]
    assert licenses.license_labels(docs_of([])).count() == 0


def license_detections(text):
    """Every match of every rule, without those that a match of a priority as good or better contains."""
    norm = " " + " ".join(WORD.findall(small(text))) + " "
    found = []
    for rule in licenses.signatures():
        if rule.keyword in norm:
            for m in re.finditer(rule.pattern, norm):
                start = norm.count(" ", 0, m.start()) - 1
                found.append((start, start + m[0].count(" ") + 1, rule.priority, rule.label, rule.score))
    found.sort(key=lambda d: (d[0], -d[1], *d[2:]))
    return [d for i, d in enumerate(found) if not any(e[2] <= d[2] and e[0] <= d[0] and e[1] >= d[1] for e in found[:i])]


@pytest.mark.parametrize("block", [2, 64])
def test_license_labels_score_and_suppression(spark, docs_of, odd_rows, monkeypatch, block):
    monkeypatch.setattr(licenses, "BLOCK", block)
    notices = ["GNU GPL v3 or later", "the GNU Lesser General Public License version 2.1", "Apache License 2.0", "apache", "under the MIT license",
               "All rights reserved. Copyright (c) 2019", "SPDX-License-Identifier: MPL-2.0", "CC BY-SA 4.0", "CC BY", "two clause BSD license",
               "This program is free software; you can redistribute it and/or modify it", "licensed under", "GPL 2", "\x01mit license\x02", "x"]
    picks = np.random.default_rng(5)
    rows = odd_rows + [(100 + n, " ".join(picks.choice(notices, n)), "a") for n in range(0, 160, 8)]
    out = licenses.license_labels(docs_of(rows)).select("_row.doc_id", "_row.text", "base_labels", "labels", "score", "detections").collect()
    assert len(out) == len(rows)
    for r in out:
        want = license_detections(r.text)
        assert sorted((d.start, d.end, d.priority, d.label, d.score) for d in r.detections) == sorted((a, b, p, x, s) for a, b, p, x, s in want)
        assert set(filter(None, r.labels.split(","))) == {d[3] for d in want} | set(filter(None, r.base_labels.split(",")))
        assert r.score == max([d[4] for d in want] + [0.75 if r.base_labels else 0.0])


def test_very_many_notices_in_one_text(docs_of):
    n = 60_000
    row = licenses.license_labels(docs_of([(1, "MIT license x " * n, "a")])).selectExpr("n_base", "last_word", "labels", "size(detections) n").first()
    assert tuple(row) == (n, 3 * n - 3, "mit", n)


def samples(pattern):
    """Texts that a pattern matches: with and without optional parts, and one for each way of a choice."""

    def of(parts):
        out = [""]
        for op, value in parts:
            name = str(op)
            if name == "LITERAL":
                ways = [chr(value)]
            elif name == "IN":
                ways = [chr(x) if str(o) == "LITERAL" else chr(x[0]) for o, x in value]
            elif name == "BRANCH":
                ways = [x for branch in value[1] for x in of(branch)]
            elif name == "SUBPATTERN":
                ways = of(value[3])
            elif name == "MAX_REPEAT":
                ways = [x * value[0] for x in of(value[2])[:1]] + of(value[2])
            else:
                ways = [""]  # looks around
            out = [out[n % len(out)] + ways[n % len(ways)] for n in range(max(len(out), len(ways)))]
        return out

    return of(re._parser.parse(pattern))


def test_every_signature_fires_on_its_own_match(spark, docs_of):
    rules = licenses.signatures()
    texts = [(n, t) for n, r in enumerate(rules) for t in samples(r.pattern) if re.search(r.pattern, f" {t} ")]
    assert {n for n, _ in texts} == set(range(len(rules)))
    assert [(rules[n].keyword, t) for n, t in texts if rules[n].keyword not in f" {t} "] == []
    out = licenses.license_labels(docs_of([(n, t.upper(), "s") for n, t in texts])).select("_row.doc_id", "_row.text", "labels", "score").collect()
    assert [r for r in out if not r.labels or not r.score] == []
    notices = {"3-clause BSD": "bsd-3", "This program is free software; you can redistribute it and/or modify it": "gpl", "Expat License": "mit", "ASL 2.0": "apache-2.0",
               "a BSD-style license": "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd", "released under": "license-notice"}
    found = licenses.license_labels(docs_of([(n, t, "s") for n, t in enumerate(notices)])).select("_row.text", "labels").collect()
    assert {r.text: r.labels for r in found} == notices


# SimHash ----------------------------------------------------------------------------


def near(docs):
    prints = {}
    for n, (_, text, *_) in enumerate(docs):
        words = small(text).encode().split()
        parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        prints[n] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[find(b)] = find(a)
    least = defaultdict(lambda: None)
    for n, (doc, *_) in enumerate(docs):
        if doc is not None:
            least[find(n)] = doc if least[find(n)] is None else min(least[find(n)], doc)
    return sorted(((d[0], f"{prints[n]:016x}", least[find(n)]) for n, d in enumerate(docs)), key=repr)


def test_simhash_of_documents(spark, documents):
    assert rows_of(QUERIES["op7_simhash"](spark, SF), "doc_id", "fingerprint", "component_id") == near(documents)


def test_simhash_of_odd_rows(spark, docs_of, odd_rows):
    assert rows_of(simhash.near_classes(docs_of(odd_rows)), "doc_id", "fingerprint", "component_id") == near(odd_rows)
    assert simhash.near_classes(docs_of([])).collect() == []


@pytest.mark.parametrize("count", [10, 10**8, 10**11])
def test_blocks_lose_no_link(count):
    rng = np.random.default_rng(3)
    tables = simhash.shared_blocks(count)
    for _ in range(300):
        flipped = rng.choice(64, 3, replace=False)
        assert any(not set(chosen) & set(flipped) for chosen in tables)


@pytest.mark.parametrize("radius", [0, 3, 20])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    bits = (rng.random((60, 64)) < 0.5).astype(np.uint8)
    bits[30:] = bits[:30] ^ (rng.random((30, 64)) < radius / 80).astype(np.uint8)
    planes = [simhash._vector(p) for p in bits.T]
    for shift in (1, 7, 30):
        got = simhash._places(simhash.near_lanes(planes, shift, (1 << 60 - shift) - 1, radius, 60), 60)
        assert got.tolist() == [i for i in range(60 - shift) if (bits[i] != bits[i + shift]).sum() <= radius]


def test_large_buckets_leave_a_forest():
    rng = np.random.default_rng(5)
    bits = np.repeat((rng.random((3, 64)) < 0.5).astype(np.uint8), 300, axis=0)
    a, b = simhash.linked_rows(np.zeros(900, dtype=np.int64), bits, 3)
    assert len(a) == 897 and set(b) == {0, 300, 600}


def test_large_buckets_are_dealt_over_tasks(spark, documents, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    linker = simhash._linker
    folder = simhash.written(spark.range(0), "buckets").inputFiles()[0].rsplit("/", 1)[0]

    def counted(radius):
        run = linker(radius)

        def links(batches):
            import os
            import uuid
            from collections import Counter

            held = list(batches)
            sizes = Counter(k for batch in held for k in batch.column("key").to_pylist())
            with open(os.path.join(folder.removeprefix("file:"), f"{uuid.uuid4().hex}.size"), "w") as out:
                out.write(str(max(sizes.values(), default=0)))
            yield from run(iter(held))

        return links

    monkeypatch.setattr(simhash, "_linker", counted)
    # Fingerprints that differ in few of the last bits share all other blocks.
    prints = [(1 << 62) | sum(1 << b for b in chosen) for n in range(4) for chosen in itertools.combinations(range(12), n)]
    nodes = spark.createDataFrame([(p, p.to_bytes(8, "big")) for p in prints], "node long, fingerprint binary")
    roots = {r.node: r.root for r in simhash.similar(nodes, simhash.shared_blocks(len(prints)), 3).collect()}
    assert roots == {p: min(prints) for p in prints if p != min(prints)}
    seen = [int(open(p).read()) for p in glob.glob(folder.removeprefix("file:") + "/*.size")]
    assert max(seen) <= 48 < len(prints) == 299


def test_large_buckets_are_dealt_without_a_broadcast(spark, monkeypatch):
    rows = spark.range(400).selectExpr("id % 3 AS key", "id AS node", "encode(cast(id AS string), 'utf-8') AS fingerprint")
    blocks = spark.createDataFrame([(0, 4), (1, 2)], "key long, blocks long")
    expected = sorted(map(tuple, simhash.dealt(rows, blocks).collect()))
    monkeypatch.setattr(simhash, "MAX_LARGE", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = simhash.dealt(rows, blocks)
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, out.collect())) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def first_of_each_group(docs):
    """Ids that `near` gives as the first of their group, a null one for a group without any other."""
    return sorted({c for _, _, c in near(docs)}, key=str)


def test_one_document_of_each_near_group_stays(spark, docs_of):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(40)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    for i, t in enumerate(texts):  # few changed words move few bits, many move more than three
        words = t.split()
        for k in rng.choice(400, i // 4, replace=False):
            words[k] = "changed"
        rows.append((100 + i, " ".join(words), "s"))
    rows += [(200 + i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, texts[1], "s"), (300, None, "s"), (301, "", "s")]
    rows += [(None, "an id of its own is missing here", "s")] * 2
    out = simhash.without_near_copies(docs_of(rows))
    assert out.columns == docs_of([]).columns
    kept = first_of_each_group(rows)
    assert 41 < len(kept) < 82 and None in kept and {300, *range(40)} <= set(kept)
    assert sorted((r.doc_id for r in out.collect()), key=str) == kept


def test_first_documents_of_the_table_stay(spark, documents, docs_of):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted((r.doc_id for r in simhash.without_near_copies(docs).collect()), key=str) == first_of_each_group(documents)


# Repeated passages ------------------------------------------------------------------


def repeated(docs):
    seen = set()
    for doc, text, *_ in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = bytes([1]) * 100
            seen.add(raw[s : s + 100])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        yield doc, len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), sha(kept)


def digest(found):
    return rows_of(found.select("_row.doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("int").alias("n"), F.sha2("kept", 256).alias("sha")),
                   "doc_id", "n_bytes", "n_removed", "n", "sha")


@pytest.mark.parametrize("common", [2_048, 2])
def test_repeats_of_documents(spark, documents, monkeypatch, common):
    monkeypatch.setattr(repeats, "COMMON", common)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert digest(repeats.without_repeats(docs, ["doc_id"])) == sorted(repeated(documents), key=repr)


@pytest.mark.parametrize("common", [2_048, 1])
def test_repeats_of_odd_rows(spark, docs_of, odd_rows, monkeypatch, common):
    monkeypatch.setattr(repeats, "COMMON", common)
    rows = [r for r in odd_rows if r[0] not in (9, 1, None)] + [(None, odd_rows[0][1], "a"), (1, odd_rows[0][1], "a"), (10, odd_rows[8][1][:30_000] + " end", "a")]
    out = repeats.without_repeats(docs_of(rows), ["doc_id"])
    assert digest(out) == sorted(repeated(rows), key=repr)
    # A row that came twice is no copy of itself.
    twice = repeats.without_repeats(docs_of([rows[0], rows[0]]), ["doc_id"]).collect()
    assert [r.n_removed for r in twice] == [0, 0]
    assert repeats.without_repeats(docs_of(odd_rows), ["doc_id"]).count() == len(odd_rows)
    assert repeats.without_repeats(docs_of([]), ["doc_id"]).count() == 0


@pytest.mark.parametrize("common", [2_048, 1])
def test_repeats_of_null_and_repeated_keys(spark, docs_of, monkeypatch, common):
    monkeypatch.setattr(repeats, "COMMON", common)
    rng = np.random.default_rng(6)
    fresh = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    passage, whole, other = fresh(150), fresh(300), fresh(150)
    heads, tails = [fresh(n) for n in (40, 110, 230, 60, 90)], [fresh(120) for _ in range(5)]
    # A sign of its own before and after the passage, so that no copy is longer than it.
    texts = [f"{h}{n}{passage}{n}{t}" for n, (h, t) in enumerate(zip(heads, tails, strict=True))]
    rows = [(None, t, "s") for t in texts[:3]] + [(9, t, "s") for t in texts[3:]]
    rows += [(None, whole, "s"), (None, whole, "another source"), (7, other, "s"), (7, other, "s"), (8, other, "s")]
    out = repeats.without_repeats(docs_of(rows), ["doc_id", "text"]).collect()
    kept = {r._row.text: bytes(r.kept).decode() for r in out if r._row.text in texts}
    left = [t for t in texts if kept[t] == t]
    assert len(left) == 1 and left[0] in texts[:3]
    assert all(kept[t] == t.replace(passage, "") for t in texts if t != left[0])
    assert sorted(r.n_removed for r in out if r._row.text == whole) == [0, 300]
    assert sorted((r._row.doc_id, r.n_removed) for r in out if r._row.text == other) == [(7, 0), (7, 0), (8, 150)]


def test_previous_factors():
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("ab"), 200))
    common = lambda i, j: next((k for k in range(200) if max(i, j) + k >= 200 or text[i + k] != text[j + k]), 200)
    order = sorted(range(200), key=lambda i: text[i:])
    near_ones = np.array([0, *[common(a, b) for a, b in zip(order, order[1:], strict=False)]])
    got = repeats.previous_factors(np.array(order), near_ones)
    assert got.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in order]


# Shards -----------------------------------------------------------------------------


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("rows_per_counter", [50_000, 7])
def test_shards(spark, docs_of, odd_rows, documents, monkeypatch, rows_per_counter):
    monkeypatch.setattr(shards, "ROWS_PER_COUNTER", rows_per_counter)
    for rows in (odd_rows, documents):
        out = shards.sharded(docs_of(rows)).collect()
        assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in out if r.doc_id is not None) == sorted(
            (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump(d, 16), jump(d, 17)) for d, t, *_ in rows if d is not None)
        assert len(out) == len(rows) and all(r.grown_shard in (r.shard, 16) and r.law == "key" for r in out)
        for shard in range(16):
            assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    assert shards.sharded(docs_of([])).count() == 0


def test_written_shards(spark, docs_of, odd_rows, tmp_path):
    shards.write_shards(docs_of(odd_rows), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(odd_rows)
    assert all(r.shard == jump(r.doc_id or 0, 16) for r in back.collect())


def accumulator_of_lists():
    from pyspark.accumulators import AccumulatorParam

    class Lists(AccumulatorParam):
        def zero(self, value):
            return []

        def addInPlace(self, a, b):
            return a + b

    return Lists()


# Mix --------------------------------------------------------------------------------


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest, open_ = total - sum(full.values()), [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s: 3 * sizes[s] for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return full | share
        full |= over


@pytest.mark.parametrize("group", [8_192, 16])
def test_mix(spark, docs_of, odd_rows, documents, monkeypatch, group):
    monkeypatch.setattr(mixing, "ROWS_PER_GROUP", group)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    for rows in (odd_rows, documents, [(i, "w " * (i % 50 + 1), "big" if i % 3 else f"s{i % 7}") for i in range(600)]):
        out = mixing.mixture(docs_of(rows)).collect()
        assert sorted(((r.doc_id, r.size) for r in out), key=repr) == sorted(((d, len(BLANK.findall(t or ""))) for d, t, *_ in rows), key=repr)
        sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
        for d, t, s, *_ in rows:
            n = len(BLANK.findall(t or ""))
            sizes[s] += n
            largest[s] = max(largest[s], n)
        want = targets(sizes)
        for r in out:
            taken[r.source] += r.copies * r.size
            assert 0 <= r.copies <= 3 and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        for s in sizes:
            assert abs(taken[s] - want[s]) <= largest[s]
        assert rows_of(mixing.mixture(docs_of(rows)), "doc_id", "size", "copies") == sorted(((r.doc_id, r.size, r.copies) for r in out), key=repr)
    assert mixing.mixture(docs_of([])).collect() == []


def test_long_documents_do_not_move_the_mix(docs_of):
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(n), f"s{i % 4}") for i, n in enumerate(rng.lognormal(4, 1.5, 2400))]
    rows += [(9000 + i, "w " * 12_000, f"s{i}") for i in range(4)]
    taken, target = defaultdict(int), {}
    for r in mixing.mixture(docs_of(rows)).collect():
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    for source, want in target.items():
        assert abs(taken[source] - want) <= 0.001 * want


def test_repeated_rows_spread_over_groups(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_GROUP", 100)
    groups, rounder = spark.sparkContext.accumulator(0), mixing._rounder
    most = spark.sparkContext.accumulator([], accumulator_of_lists())

    def counted(seed, level):
        rounded = rounder(seed, level)

        def of(pdf):
            groups.add(1)
            most.add([len(pdf)])
            return rounded(pdf)

        return of

    monkeypatch.setattr(mixing, "_rounder", counted)
    out = mixing.mixture(docs_of([(1, "same words here", "a")] * 3000 + [(2, "some other words", "b")] * 50)).collect()
    assert len(out) == 3050 and groups.value >= 31 and max(most.value) < 200
    for source in "ab":
        mine = [r for r in out if r.source == source]
        assert abs(sum(r.copies for r in mine) * 3 - mine[0].target) <= 3


def test_mixed_documents_repeat(spark, docs_of, odd_rows):
    out = mixing.mixed_documents(docs_of(odd_rows))
    copies = sum(r.copies for r in mixing.mixture(docs_of(odd_rows)).collect())
    assert out.count() == copies and out.columns == docs_of([]).columns


def test_pivot_keeps_the_sum_and_the_chances():
    rng = np.random.default_rng(4)
    sizes, chances = rng.integers(1, 90, 40).tolist(), rng.random(40).tolist()
    seen = np.zeros(40)
    for seed in range(3000):
        out, left, p = mixing.pivot(chances, sizes, np.random.default_rng(seed).random(40))
        seen += out
        rest = p * sizes[left] if left >= 0 else 0
        assert (out * sizes).sum() + rest == pytest.approx(np.dot(chances, sizes))
        if left >= 0:
            seen[left] += p
    assert np.abs(seen / 3000 - chances).max() < 0.05
