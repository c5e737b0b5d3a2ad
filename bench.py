"""Headline timings as one JSON line; BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from passagework.operators import clauses as C, semantic  # noqa: E402
from passagework.plans import search, store as stores  # noqa: E402
from passagework.session import local_session, scratch_folder, spread  # noqa: E402
from passagework.workload import tables  # noqa: E402
from passagework.workload.spark_queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REGISTERED = ["chunk_lines", "corpus_stats", "stats_totals", "bm25_term", "search_routed", "related_files", "incremental_apply"]


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.time()
    action()
    return round(time.time() - start, 3)


def query_texts(spark, count: int) -> dict[str, str]:
    """Two-word queries: neighbouring words of the benchmark texts."""
    pairs = []
    for row in tables.read(spark, SF_DIR, "benchmark").orderBy("item_id").select("text").collect():
        words = re.findall(r"\w+", row.text.lower())
        pairs += [f"{a} {b}" for a, b in zip(words, words[1:])]
    pairs = list(dict.fromkeys(pairs))
    return {str(i): pairs[i * len(pairs) // count] for i in range(count)}


def main() -> None:
    spark = local_session(CPUS, int(CPUS) if CPUS.isdigit() else 8)
    times: dict[str, float] = {}

    def build(label: str, with_grams: bool = False) -> stores.Store:
        made = stores.Store(scratch_folder(spark, label), buckets=16, segments=16, with_grams=with_grams)
        stores.write_batch(made, tables.files(tables.texts(spark, SF_DIR)), all_files=True)
        return made

    build("warm")  # a running application has compiled its stages
    start = time.time()
    place = build("bench")
    times["index_build"] = round(time.time() - start, 3)
    corpus = stores.open_corpus(place, spark)
    chunks = corpus.chunks.count()
    for count in (1, 100, 1000):
        texts = query_texts(spark, count)

        def batch() -> None:
            table = C.all_of(spark, texts)
            top = search.top_files(search.word_matches(corpus, table), 10)
            run(search.with_files(top, corpus.files, search.result_rows(table, 10)))

        batch()
        times[f"search_{count}"] = timed(batch)
    start = time.time()
    full = build("full", with_grams=True)
    times["index_build_grams"] = round(time.time() - start, 3)
    kana = C.all_of(spark, {"a": "認証 the", "b": "tion", "c": "und 提案"})
    routed = lambda: run(search.top_files(search.best_branch(search.routed_matches(stores.open_corpus(full, spark), kana)), 10))
    routed()
    times["stored_routed"] = timed(routed)
    # A hundredth of the files changes, as a second batch of the store.
    listed = tables.files(tables.texts(spark, SF_DIR)).withColumn(
        "modified", F.when(F.col("file_id") % 100 == 0, F.col("modified") + F.expr("interval 1 day")).otherwise(F.col("modified"))
    )
    times["store_update"] = timed(lambda: stores.update(place, listed, all_files=True))
    corpus = stores.open_corpus(place, spark)
    batch()
    times["search_1000_two_batches"] = timed(batch)
    vectors = spread(tables.vectors(spark, SF_DIR), "chunk_no")
    asked = vectors.select(vectors.chunk_no.cast("string").alias("query_id"), "embedding")
    near = lambda: run(semantic.nearest_files(asked, vectors, 10))
    near()
    times["semantic_top"] = timed(near)
    pairs = vectors.count() ** 2
    for name in REGISTERED:
        times[name] = timed(lambda: run(QUERIES[name](spark, SF_DIR)))
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "chunks": chunks,
        "index_chunks_per_sec": round(chunks / times["index_build"]),
        "queries_per_sec": {str(n): round(n / times[f"search_{n}"], 1) for n in (1, 100, 1000)},
        "vector_pairs_per_sec": round(pairs / times["semantic_top"]),
    }))


if __name__ == "__main__":
    main()
