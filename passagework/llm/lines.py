"""Line dedup by distinct-site spread: sketches per line, exact counts near the threshold, boilerplate removal."""

from __future__ import annotations

from math import ceil, floor, sqrt

from pyspark.sql import Column, DataFrame, functions as F

from passagework.llm.base import text_or_empty, trimmed, written

#: Lines on so many sites are boilerplate.
SITES = 6
SKETCH_BITS = 11
#: Deviations of the sketch inside which a line is counted exactly.
MARGIN = 6


def numbered_lines(docs: DataFrame, key: Column, text: str, site: str) -> DataFrame:
    """(key, site, line_no, line: hash of the line without blanks at its ends) for every line with a word."""
    rows = docs.select(key.alias("key"), F.col(site).alias("site"), F.split(text_or_empty(text), "\n").alias("_lines"))
    rows = rows.select("key", "site", F.posexplode("_lines").alias("line_no", "_line")).withColumn("_line", trimmed(F.col("_line")))
    return rows.filter(F.length("_line") > 0).select("key", "site", "line_no", F.xxhash64("_line").alias("line"))


def widespread(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(line) of the lines that stand on `sites` different sites or more; a null site is a site of its own.

    A HyperLogLog sketch of the sites is kept for each line: tasks sketch their own rows first, so a line sends
    one sketch from each task however common it is, and sketches merge by line. Estimates within `MARGIN` deviations
    of the threshold are not trusted: the sites of those lines are counted exactly.
    """
    error = 1.04 / sqrt(2**SKETCH_BITS)
    low, high = floor(sites * (1 - MARGIN * error)), ceil(sites * (1 + MARGIN * error))
    named = lines.select("line", F.coalesce(F.concat(F.lit("s"), F.col("site").cast("string")), F.lit("")).alias("_site"))
    spread = named.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(SKETCH_BITS))).alias("n"))
    spread = written(spread.filter(F.col("n") >= low), "spread")
    near = spread.filter(F.col("n") <= high).select("line")
    exact = named.join(near, "line", "left_semi").distinct().groupBy("line").count().filter(F.col("count") >= sites)
    return written(spread.filter(F.col("n") > high).select("line").unionByName(exact.select("line")), "widespread")


def without_boilerplate(docs: DataFrame, carry: list[str], key: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES) -> DataFrame:
    """(_row: the columns `carry`, n_lines, n_removed, kept) for every row of `docs`; `kept` is the text without its widespread lines.

    A line is compared without blanks at its ends; blank lines are never removed. Null and empty texts have one
    empty line. Rows that repeat are judged alike; rows with the same key and another text are told apart by
    the text's hash. Only line hashes are shuffled, and each text once, by key, to meet its line numbers.
    """
    marked = docs.select(
        F.struct(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("hash")).alias("key"),
        F.col(text).alias("_text"), F.col(site).alias("_site"), F.struct(*carry).alias("_row"),
    )
    lines = numbered_lines(marked, F.col("key"), "_text", "_site")
    common = widespread(lines, sites)
    hit = lines.join(common, "line", "left_semi").groupBy("key").agg(F.collect_set("line_no").alias("_numbers"))
    hit = hit.select(F.col("key").alias("_key"), F.array_sort("_numbers").alias("_numbers"))
    rows = marked.join(hit, F.col("key").eqNullSafe(F.col("_key")), "left")
    rows = rows.withColumn("_lines", F.split(text_or_empty("_text"), "\n"))
    # What stays is the stretches between removed lines: one slice for each, whatever the number of lines.
    edges = F.concat(F.array(F.lit(-1)), "_numbers", F.array(F.size("_lines")))
    between = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_numbers")), lambda k: F.slice(
        F.col("_lines"), F.get("_edges", k) + 2, F.get("_edges", k + 1) - F.get("_edges", k) - 1)))
    kept = F.when(F.col("_numbers").isNull(), F.col("_lines")).otherwise(between)
    rows = rows.withColumn("_edges", edges)
    rows = rows.select("_row", F.size("_lines").cast("long").alias("n_lines"), kept.alias("_kept"))
    return rows.select("_row", "n_lines", (F.col("n_lines") - F.size("_kept")).alias("n_removed"), F.array_join("_kept", "\n").alias("kept"))
