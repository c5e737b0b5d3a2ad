"""Chat, lines and quality rules on odd rows, and the pipeline."""

import json
import re
from collections import defaultdict

import corpus_pipeline
from passagework.llm import chat, lines, quality


def test_quality_of_odd_rows(docs_of, odd_rows):
    out = quality.judged(docs_of(odd_rows)).collect()
    assert len(out) == len(odd_rows)
    by_text = {r._row.text: r for r in out}
    for _, text, _ in odd_rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen = defaultdict(list)
        for i in range(len(words) - 4):
            seen[tuple(words[i : i + 5])].append(i)
        covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
        full = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = by_text[text]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(covered), len(full) - len(set(full)))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r.base_failed and r.kept)
    kept = quality.good_documents(docs_of(odd_rows))
    assert kept.columns == docs_of([]).columns and 0 < kept.count() < len(odd_rows)
    assert quality.good_documents(docs_of([])).count() == 0


def test_lines_of_odd_rows(docs_of):
    common = "  shared line  "
    rows = [(i, f"own {i}\n{common}\n\nlast {i}", f"s{i}") for i in range(8)] + [(20, None, None), (21, "", "s1"), (22, "shared line", None), (22, "shared line", None)]
    rows += [(30 + i, "twice on one site\nx", "s1") for i in range(9)]
    out = {r._row.doc_id: r for r in lines.without_boilerplate(docs_of(rows), ["doc_id"]).collect()}
    assert out[3].kept == "own 3\n\nlast 3" and (out[3].n_lines, out[3].n_removed) == (4, 1)
    assert out[20].kept == "" and out[22].kept == "" and out[22].n_removed == 1
    assert out[33].kept == "twice on one site\nx"
    assert lines.without_boilerplate(docs_of([]), ["doc_id"]).count() == 0


CALLS = "conv_id long, call_id string, turn long, tool string, arguments string, after string"
RESULTS = "conv_id long, call_id string, turn long, content string"


def test_tool_links(spark):
    call = lambda i, turn, tool="search", arguments='{"query": "a", "limit": 2}', after=None, conv=1: (conv, i, turn, tool, arguments, after)
    calls = [
        call("a", 1), call("b", 2, after="a"), call("c", 3, after="b"), call("lost", 4, after="nowhere"), call("dup", 5), call("dup", 6, "translate"),
        call("x", 7, after="y"), call("y", 8, after="x"), call("self", 8, after="self"), call(None, 9), call("bad", 10, arguments="{"), call("none", 10, arguments=None),
        call("list", 10, arguments="[1]"), call("what", 10, tool="unheard"), call("no tool", 10, tool=None),
        call("types", 11, arguments='{"limit": "3", "more": 1}'), call("style", 12, "summarise", '{"text":"é\\n","style":"loud"}'), call("a", 1, conv=2), call("e", 20, conv=None),
    ]
    results = [(1, "a", 2, 'said "so"'), (1, "c", 1, "early"), (1, "dup", 7, "first"), (1, "dup", 9, "second"), (1, "ghost", 3, None), (None, "a", 1, "t"), (1, None, 2, "u")]
    rows = chat.linked_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), chat.SCHEMAS).collect()
    of = {(r.conv_id, r.call_id): r for r in rows}
    state = {k[1]: r.state for k, r in of.items() if k[0] == 1}
    assert state["a"] == "linked" and state["b"] == "unanswered" and state["c"] == "early" and state["ghost"] == "orphan"
    assert [of[1, c].depth for c in ("a", "b", "c", "lost", "x", "y", "self", "ghost")] == [0, 1, 2, 0, None, None, None, None]
    assert (of[1, "dup"].n_calls, of[1, "dup"].n_results, of[1, "dup"].turn) == (2, 2, 5) and '"first"' in of[1, "dup"].json
    assert len(rows) == 21
    found = {c: of[1, c].problems for c in ("a", "bad", "none", "list", "what", "no tool", "types", "style")}
    assert found == {"a": "", "bad": "not JSON", "none": "no arguments", "list": "not an object", "what": "unknown tool", "no tool": "unknown tool",
                     "types": "unknown argument; limit: not long; query: missing", "style": "style: not allowed"}
    assert of[1, "a"].json == '{"arguments":{"limit":2,"query":"a"},"id":"a","result":"said \\"so\\"","tool":"search"}'
    for r in rows:
        if '"arguments":null' not in r.json:
            assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    none = chat.linked_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), chat.SCHEMAS)
    assert none.collect() == []


def test_every_call_and_result_stays(spark):
    calls = [(1, "d", 5, "search", "{}", None), (1, "d", 6, "translate", '{"text":"x"}', None), (1, "d", 6, "translate", '{"text":"x"}', None),
             (1, "d", 5, "search", "{}", None), (1, "v", 4, "search", "{}", None), (None, "n", 1, "search", "{}", None)]
    results = [(1, "d", 7, "first"), (1, "d", 9, "second"), (1, "v", 2, "too early"), (1, "v", 8, "valid"), (1, "g", 3, "ghost"), (1, "g", 4, None)]
    rows = chat.every_call(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), chat.SCHEMAS).collect()
    got = sorted((str(r.call_id), r.state, r.turn, str(r.tool), json.loads(r.json)["result"] or "", r.n_calls, r.n_results) for r in rows)
    assert got == sorted([
        ("d", "linked", 5, "search", "first", 4, 2), ("d", "repeated", 5, "search", "", 4, 2), ("d", "repeated", 6, "translate", "", 4, 2),
        ("d", "repeated", 6, "translate", "", 4, 2), ("d", "repeated", 9, "None", "second", 4, 2), ("v", "linked", 4, "search", "valid", 1, 2),
        ("v", "repeated", 2, "None", "too early", 1, 2), ("g", "orphan", 3, "None", "ghost", 0, 2), ("g", "repeated", 4, "None", "", 0, 2),
        ("n", "unanswered", 1, "search", "", 1, 0)])
    assert next(r.problems for r in rows if r.state == "repeated" and r.turn == 5) == "limit: missing; query: missing"


def test_long_chain(spark):
    calls = spark.range(300).selectExpr("1L conv_id", "cast(id as string) call_id", "id turn", "'search' tool", "'{}' arguments", "cast(id - 1 as string) after")
    depth = {r.call_id: r.depth for r in chat.ordered(calls.select("conv_id", "call_id", "after")).collect()}
    assert depth == {str(i): i for i in range(300)}


def test_pipeline(spark, docs_of):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "source mix", "shards"]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if number < 4:
            assert out.columns == start
        if number < 3:
            assert out.count() <= docs.count() and out.select("doc_id").distinct().count() == out.count()
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.columns == [*start, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert docs.select("shard", "slot").distinct().count() == docs.count()
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_take_odd_and_no_rows(spark, docs_of, odd_rows):
    sf = "/root/testdata/sf0.001"
    for rows in (odd_rows, []):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs_of(rows), sf).collect()
