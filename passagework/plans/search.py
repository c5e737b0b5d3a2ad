"""Batches of queries from clauses to result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from passagework.functions import snippets, text as X
from passagework.operators import bags, filters, matching, ranking
from passagework.operators.clauses import ClauseTable
from passagework.operators.joins import MAX_BROADCAST_ROWS, bounded_join
from passagework.operators.leaders import leaders
from passagework.plans.corpus import Corpus, attach_texts
from passagework.schemas import CHUNK_KEY

# Score of a substring hit, default result sizes, candidates per result.
SUBSTRING_SCORE = 0.01
LIMIT, CHUNK_LIMIT, OVERFETCH = 10, 30, 3


def routes(table: ClauseTable) -> ClauseTable:
    """Clauses with the branches their query takes besides words.

    `use_grams`: the query holds CJK text. `use_substring`: one of its tokens holds
    only one or two CJK characters.
    """
    query = Window.partitionBy("query_id")
    text = F.col("text")
    frame = table.frame.withColumns({
        "use_grams": F.max(X.contains_cjk(text)).over(query),
        "use_substring": F.max(X.needs_substring_scan(text)).over(query),
    })
    return ClauseTable(frame, table.rows, table.one_group, table.one_word, table.forms)


def _where(table: ClauseTable, flag: str) -> ClauseTable:
    return ClauseTable(table.frame.filter(flag), table.rows, table.one_group, table.one_word, table.forms)


def word_matches(corpus: Corpus, table: ClauseTable) -> DataFrame:
    """query_id, file_id, chunk_no, score of chunks that match on words."""
    bag = bags.bag_of(table)
    if bag is not None:
        rows = matching.bag_postings(corpus, table, bag)
        return bags.queries_met(ranking.score_postings(rows, corpus.stats, "avg_words", len(bag.terms)), bag)
    hits = ranking.score_hits(matching.word_hits(corpus, table), corpus.stats, "avg_words", table.rows)
    return matching.combine(hits, table.one_group)


def gram_matches(corpus: Corpus, table: ClauseTable) -> DataFrame:
    hits = ranking.score_hits(matching.gram_hits(corpus, table), corpus.stats, "avg_grams", table.rows)
    return matching.combine(hits, table.one_group)


def substring_matches(corpus: Corpus, table: ClauseTable) -> DataFrame:
    hits = matching.combine(matching.substring_hits(corpus, table), table.one_group)
    return hits.withColumn("score", F.lit(SUBSTRING_SCORE))


def routed_matches(corpus: Corpus, table: ClauseTable) -> DataFrame:
    """Hits of all branches with their `branch`; scores are compared as they are.

    A bounded table is looked at first: a branch that no query takes is not in the plan.
    """
    routed = routes(table)
    use_grams, use_substring = _branches(table)
    hits = word_matches(corpus, routed).withColumn("branch", F.lit("word"))
    if use_grams:
        hits = hits.unionByName(gram_matches(corpus, _where(routed, "use_grams")).withColumn("branch", F.lit("gram")))
    if use_substring:
        found = substring_matches(corpus, _where(routed, "use_substring"))
        hits = hits.unionByName(found.withColumn("branch", F.lit("substring")))
    return hits


def _branches(table: ClauseTable) -> tuple[bool, bool]:
    """Whether some query may take the gram and the substring branch."""
    if table.rows is None:
        return True, True
    text = F.col("text")
    found = table.frame.agg(F.max(X.contains_cjk(text)), F.max(X.needs_substring_scan(text))).first()
    return bool(found[0]), bool(found[1])


def best_branch(hits: DataFrame) -> DataFrame:
    """One row per query and chunk: the branch with the best score."""
    order = Window.partitionBy("query_id", *CHUNK_KEY).orderBy(F.desc("score"), "branch")
    return hits.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def top_files(
    hits: DataFrame, k: int = LIMIT, file_tags: DataFrame | None = None, tags: Sequence[str] = (),
    overfetch: int | None = None,
) -> DataFrame:
    """The k best files per query by their best chunk, with `rank`.

    All hits compete by default. `overfetch=3` keeps only the 3k best chunks before
    files are told apart, which may leave fewer than k files.
    """
    if tags:
        hits = filters.with_any_tag(hits, file_tags, tags)
    if overfetch is not None:
        hits = ranking.top_k(leaders(hits, k * overfetch), k * overfetch).drop("rank")
    else:
        hits = leaders(hits, k, per_file=True)
    return ranking.top_k(ranking.best_per_file(hits), k)


def top_chunks(
    hits: DataFrame, k: int = CHUNK_LIMIT, file_tags: DataFrame | None = None, tags: Sequence[str] = ()
) -> DataFrame:
    """The k best chunks per query; a file may appear more than once."""
    if tags:
        hits = filters.with_any_tag(hits, file_tags, tags)
    tie = ("file_id", "chunk_no", "branch") if "branch" in hits.columns else ("file_id", "chunk_no")
    return ranking.top_k(leaders(hits, k, tie), k, tie)


def result_rows(table: ClauseTable, k: int) -> int | None:
    """Proven bound of the rows of a top-k result: no more queries than clauses."""
    return None if table.rows is None else table.rows * k


def with_files(
    results: DataFrame, files: DataFrame, rows: int | None, columns: Sequence[str] = ("path", "title", "tags")
) -> DataFrame:
    """Result rows with columns of their file."""
    found = files.select("file_id", *columns)
    if rows is not None and rows <= MAX_BROADCAST_ROWS:
        return found.join(F.broadcast(results), "file_id")
    return found.join(results, "file_id")


def with_content(results: DataFrame, corpus: Corpus, rows: int | None) -> DataFrame:
    """Result rows with the whole text of their chunk, read after the cut to k."""
    return attach_texts(results, corpus, rows)


def query_words(table: ClauseTable) -> DataFrame:
    """Per query what a snippet marks: words, word beginnings and text parts."""
    must = F.col("kind") == "must"
    is_prefix = F.col("form") == "prefix"
    gather = lambda value, when: F.array_distinct(F.flatten(F.collect_list(F.when(when, value))))
    return table.frame.groupBy("query_id").agg(
        gather(F.col("terms"), must & ~is_prefix).alias("words"),
        gather(F.col("terms"), must & is_prefix).alias("beginnings"),
        gather(F.array(X.fold_grams(F.col("text"))), must).alias("parts"),
    )


def with_snippets(
    results: DataFrame, corpus: Corpus, table: ClauseTable, rows: int | None, width: int = snippets.WIDTH
) -> DataFrame:
    """Result rows with a highlighted fragment; substring hits have none."""
    texts = with_content(results, corpus, rows)
    marked = bounded_join(texts, query_words(table), ["query_id"], table.rows, [F.col(c) for c in CHUNK_KEY])
    by_word: Column = snippets.word_snippet(F.col("content"), F.col("words"), F.col("beginnings"), width)
    if "branch" in results.columns:
        by_gram = snippets.gram_snippet(F.col("content"), F.col("parts"), width)
        snippet = F.when(F.col("branch") == "word", by_word).when(F.col("branch") == "gram", by_gram).otherwise(F.lit(""))
    else:
        snippet = by_word
    return marked.withColumn("snippet", snippet).drop("content", "words", "beginnings", "parts")
