"""Words and character grams of chunks, as occurrences and as postings.

Nothing here shuffles: a chunk is one row, so its tokens are grouped inside the task.
A stored index holds words as lists (`word_lists`), many postings in a row.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from passagework.functions import text as X
from passagework.schemas import CHUNK_KEY

# Tasks get the functions of this module themselves and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Tokeniser = Callable[[Column], Column]
# Tokens that are grouped at once, and words that are put into lists at once.
GROUPED, LISTED = 1 << 20, 1 << 21
# Values below it are numbered by tables.
FLAGS = 1 << 24
FOLDS = X.FOLDS
# The columns of `word_lists`.
LISTS = ["term", "file_ids", "chunk_nos", "dls", "ends", "positions"]


def words_of(content: Column) -> Column:
    return X.word_tokens(content)


def grams_of(content: Column) -> Column:
    return X.char_grams(X.fold_grams(content))


def with_lengths(chunks: DataFrame) -> DataFrame:
    """Chunks with their size in words and in grams, needed for ranking."""
    return chunks.withColumns({
        "n_words": X.word_count(F.col("content")),
        "n_grams": X.gram_count(X.fold_grams(F.col("content"))),
    })


def word_occurrences(chunks: DataFrame) -> DataFrame:
    """file_id, chunk_no, dl, pos, term: one row per word."""
    return _occurrences(chunks, words_of)


def gram_occurrences(chunks: DataFrame) -> DataFrame:
    return _occurrences(chunks, grams_of)


def _occurrences(chunks: DataFrame, tokens: Tokeniser) -> DataFrame:
    # The outer form keeps Spark from adding a `size(tokens) > 0` filter below, which
    # would cut every text into tokens twice.
    return (
        _tokenised(chunks, tokens)
        .select(*CHUNK_KEY, "dl", F.posexplode_outer("tokens").alias("pos", "term"))
        .filter(F.col("term").isNotNull())
    )


def _tokenised(chunks: DataFrame, tokens: Tokeniser) -> DataFrame:
    """Chunks as token lists. The length is a column of its own, so that exploding the
    list does not carry the list along in every row."""
    return chunks.select(*CHUNK_KEY, tokens(F.col("content")).alias("tokens")).select(
        *CHUNK_KEY, F.size("tokens").alias("dl"), "tokens"
    )


def word_postings(chunks: DataFrame, by_term: bool = False) -> DataFrame:
    """term, file_id, chunk_no, dl, tf, positions: one row per word and chunk.

    With `by_term` the rows of a word in one Arrow batch follow each other, which spares much of a later sort by word.
    """
    return _postings(chunks, words_of, by_term)


def gram_postings(chunks: DataFrame) -> DataFrame:
    return _postings(chunks, grams_of)


def word_lists(chunks: DataFrame) -> DataFrame:
    """term, file_ids, chunk_nos, dls, ends, positions: one row for each word and Arrow batch, with lists of its postings.

    `positions` are those of all postings one after the other, and `ends` tells where those of each
    end. Lists of numbers are a fraction of the rows and bytes of `word_postings`, which counts
    where they are shuffled, sorted and written. Texts are cut by Spark; of each word that differs
    one is folded.
    """
    rows = chunks.select(*CHUNK_KEY, X.spaced_words(F.col("content")).alias("words"))
    return rows.mapInArrow(_listed, lists_schema(rows.schema["file_id"].dataType))


def lists_of(postings: DataFrame) -> DataFrame:
    """Postings of words gathered to lists, as many as come together."""
    rows = postings.select("term", *CHUNK_KEY, "dl", "positions")
    return rows.mapInArrow(_gathered, lists_schema(rows.schema["file_id"].dataType))


def lists_schema(id_type: T.DataType) -> T.StructType:
    numbers = T.ArrayType(T.IntegerType())
    fields = [T.StructField(n, numbers) for n in ("chunk_nos", "dls", "ends", "positions")]
    return T.StructType([T.StructField("term", T.StringType()), T.StructField("file_ids", T.ArrayType(id_type)), *fields])


def postings_of(lists: DataFrame) -> DataFrame:
    """The rows of `word_postings` again, with the other columns of the lists. Lists that are not asked for are not read."""
    others = [c for c in lists.columns if c not in LISTS]
    at, before = F.col("_at"), F.when(F.col("_at") == 0, 0).otherwise(F.get("ends", F.col("_at") - 1))
    tf = (F.col("_end") - before).cast("int")
    return lists.select("*", F.posexplode("ends").alias("_at", "_end")).select(
        "term", *[F.get(name, at).alias(one) for one, name in zip((*CHUNK_KEY, "dl"), LISTS[1:4], strict=True)],
        tf.alias("tf"), F.slice("positions", before + 1, tf).alias("positions"), *others,
    )


def list_stats(lists: DataFrame) -> DataFrame:
    """`term_stats` of lists; only their ends are read."""
    last = F.get("ends", F.size("ends") - 1)
    return lists.groupBy("term").agg(F.sum(F.size("ends")).alias("df"), F.sum(last).alias("cf"))


def gram_presence(chunks: DataFrame) -> DataFrame:
    """term, places: which grams a chunk holds, one row for each gram and Arrow batch with a list of file_id and chunk_no.

    All a gram lookup needs, as candidates are checked on their text; far smaller than
    `gram_postings`. A text too short for a gram is a gram itself, so every text can be
    found by any part of it.
    """
    rows = chunks.select(*CHUNK_KEY, X.fold_grams(F.col("content")).alias("folded"))
    places = T.ArrayType(T.StructType([rows.schema[c] for c in CHUNK_KEY]))
    return rows.mapInArrow(_grams_held, T.StructType([T.StructField("term", T.StringType()), T.StructField("places", places)]))


def _grams_held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch["folded"]))
        ends = np.cumsum(pc.utf8_length(batch["folded"]).to_numpy().astype(np.int64))
        for at, end in _portions(ends, GROUPED):
            yield from _held(batch.slice(at, end - at))


def _held(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Grams as numbers made of their characters' numbers; sorted by gram and chunk, so that equal ones meet."""
    texts = rows["folded"].to_pylist()
    size = np.array([len(t) for t in texts], np.int64)
    letters, own = _numbered(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
    n = len(letters)
    chunk = np.repeat(np.arange(len(size)), size)
    starts = np.arange(max(len(own) - X.GRAM + 1, 0))
    starts = starts[chunk[starts] == chunk[starts + X.GRAM - 1]]
    code = np.zeros(len(starts), np.int64)
    for step in range(X.GRAM):
        code = code * n + own[starts + step]
    # Three of up to 2^20 letters make 2^60; numbering them leaves room for the chunk.
    grams, code = _numbered(code)
    key = _distinct(code * len(size) + chunk[starts])
    held, places = key // max(len(size), 1), key % max(len(size), 1)
    names = np.stack([letters[grams // n ** (X.GRAM - 1 - step) % n] for step in range(X.GRAM)], axis=1) if len(grams) else np.zeros((0, X.GRAM), np.uint32)
    text = names.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    terms = [text[i:i + X.GRAM] for i in range(0, len(text), X.GRAM)]
    begins = np.flatnonzero(np.diff(held, prepend=-1))
    # Texts that are too short, each with the one row that holds it.
    short = np.flatnonzero(size < X.GRAM)
    terms += [texts[i] for i in short]
    offsets = np.concatenate([begins, len(held) + np.arange(len(short) + 1)])
    taken = pa.array(np.concatenate([places, short]))
    fields = pa.StructArray.from_arrays([rows[c].take(taken) for c in CHUNK_KEY], names=CHUNK_KEY)
    if terms:
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), fields)], names=["term", "places"])


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a table of flags takes a fraction of the time of sorting."""
    if not len(values) or (top := int(values.max())) >= FLAGS:
        return np.unique(values)
    there = np.zeros(top + 1, bool)
    there[values] = True
    return np.flatnonzero(there)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and for each value its number among them."""
    kept = _distinct(values)
    if len(kept) and (top := int(kept[-1])) < FLAGS:
        number = np.zeros(top + 1, np.int64)
        number[kept] = np.arange(len(kept))
        return kept, number[values]
    return kept, np.searchsorted(kept, values)


def gram_parts(dictionary: DataFrame) -> DataFrame:
    """part, term, df: the runs of one and two characters in every gram of a dictionary.

    A shorter part than a gram is found through the grams that hold it.
    """
    parts = F.concat(*(X.char_grams(F.col("term"), n) for n in range(1, X.GRAM)))
    return dictionary.select(F.explode(F.array_distinct(parts)).alias("part"), "term", "df")


def _postings(chunks: DataFrame, tokens: Tokeniser, by_term: bool = False) -> DataFrame:
    """Tokens are cut by Spark and grouped in Arrow batches: sorting them as structs inside a row takes several times as long."""
    rows = _tokenised(chunks, tokens)
    counts = [T.StructField("dl", T.IntegerType()), T.StructField("tf", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]
    kind = T.StructType([T.StructField("term", T.StringType()), *(rows.schema[c] for c in CHUNK_KEY), *counts])
    return rows.mapInArrow(partial(_group, by_term=by_term), kind)


def _group(batches: Iterable[pa.RecordBatch], by_term: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end in _portions(np.cumsum(_sizes(batch["tokens"])), GROUPED):
            yield from _grouped(batch.slice(at, end - at), by_term)


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def _portions(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """As many chunks as hold so many tokens; one that holds more is taken alone."""
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, end
        at = end


def _grouped(rows: pa.RecordBatch, by_term: bool) -> Iterator[pa.RecordBatch]:
    """One row per token and chunk with its places. Tokens get numbers; a stable sort by chunk and number keeps places in order."""
    size = _sizes(rows["tokens"])
    coded = rows["tokens"].flatten().dictionary_encode()
    if not len(coded):
        return
    first, chunk, code = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size), coded.indices.to_numpy().astype(np.int64)
    key = code * len(size) + chunk if by_term else chunk * len(coded.dictionary) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    leads = order[begins]
    own = chunk[leads]
    offsets = np.append(begins, len(key)).astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(offsets), pa.array((order - first[chunk[order]]).astype(np.int32)))
    columns = {"term": coded.dictionary.take(pa.array(code[leads]))}
    columns |= {name: rows[name].take(pa.array(own)) for name in (*CHUNK_KEY, "dl")}
    columns |= {"tf": pa.array(np.diff(offsets)), "positions": positions}
    yield pa.RecordBatch.from_pydict(columns)


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pc.split_pattern(batch["words"], " ")
        for at, end in _portions(np.cumsum(_sizes(words)), LISTED):
            yield from _lists(batch.slice(at, end - at), words.slice(at, end - at))


def _lists(rows: pa.RecordBatch, words: pa.ListArray) -> Iterator[pa.RecordBatch]:
    """Words get numbers; a stable sort by number leaves chunks and places in order."""
    size = _sizes(words)
    terms, code = _folded(words.flatten())
    chunk = np.repeat(np.arange(len(size), dtype=np.int32), size)
    # What is left of a text before its first or after its last word, and of marks alone, is no word.
    empty = pc.index(terms, "").as_py()
    if empty >= 0:
        kept = code != empty
        code, chunk = code[kept], chunk[kept]
        size = np.bincount(chunk, minlength=len(size))
    if not len(code):
        return
    order = _order(code)
    positions = (order - (np.cumsum(size) - size)[chunk[order]]).astype(np.int32)
    code, chunk = code[order], chunk[order]
    begins = np.flatnonzero(_begins(code, chunk))
    sized = rows.select(CHUNK_KEY).append_column("dl", pa.array(size.astype(np.int32)))
    yield _in_lists(terms, code[begins], sized, chunk[begins], np.diff(np.append(begins, len(code))), positions)


def _folded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, folded, and the number of each word among them."""
    coded = words.dictionary_encode()
    kept, code = coded.dictionary, coded.indices.to_numpy()
    marked = pc.invert(pc.string_is_ascii(kept))
    if not pc.any(marked).as_py():
        return kept, code
    folded = pa.array([word.translate(FOLDS) for word in kept.filter(marked).to_pylist()], pa.string())
    again = pc.replace_with_mask(kept, marked, folded).dictionary_encode()
    return again.dictionary, again.indices.to_numpy()[code]


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, tokens = [], 0
    for batch in batches:
        held.append(batch)
        tokens += len(batch["positions"].flatten())
        if tokens >= GROUPED:
            yield _gather(held)
            held, tokens = [], 0
    if tokens:
        yield _gather(held)


def _gather(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).combine_chunks().to_batches(max_chunksize=None)[0]
    coded = rows["term"].dictionary_encode()
    order = _order(coded.indices.to_numpy())
    positions = rows["positions"].take(pa.array(order))
    tf = pc.list_value_length(positions).to_numpy()
    return _in_lists(coded.dictionary, coded.indices.to_numpy()[order], rows, order, tf, positions.flatten().to_numpy())


def _order(code: np.ndarray) -> np.ndarray:
    """A stable order by number, by halves of it: short numbers are sorted without comparing them."""
    order = np.argsort((code & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((code >> 16).astype(np.uint16)[order], kind="stable")]


def _begins(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def _in_lists(terms: pa.Array, code: np.ndarray, rows: pa.RecordBatch, own: np.ndarray, tf: np.ndarray, positions: np.ndarray) -> pa.RecordBatch:
    """Rows of lists from postings sorted by the number of their term: `own` is the row of each, `tf` the number of its positions."""
    starts, ends = np.flatnonzero(_begins(code)), np.cumsum(tf)
    before = (ends - tf)[starts]
    offsets, places = np.append(starts, len(code)), np.append(before, len(positions))
    own_ends = (ends - np.repeat(before, np.diff(offsets))).astype(np.int32)
    of = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
    taken = pa.array(own)
    columns = [of(offsets, rows[name].take(taken)) for name in (*CHUNK_KEY, "dl")]
    columns += [of(offsets, pa.array(own_ends)), of(places, pa.array(positions))]
    return pa.RecordBatch.from_arrays([terms.take(pa.array(code[starts])), *columns], names=LISTS)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunk count, token totals and mean lengths. Needs `with_lengths`."""
    return chunks.agg(
        F.count("*").alias("n_chunks"),
        F.coalesce(F.sum("n_words"), F.lit(0)).alias("total_words"),
        F.coalesce(F.sum("n_grams"), F.lit(0)).alias("total_grams"),
        F.avg("n_words").alias("avg_words"),
        F.avg("n_grams").alias("avg_grams"),
    )


def term_stats(postings: DataFrame) -> DataFrame:
    """Chunks (and occurrences, where counted) per term: the dictionary of an index."""
    counts = [F.count("*").alias("df")]
    if "tf" in postings.columns:
        counts.append(F.sum("tf").alias("cf"))
    return postings.groupBy("term").agg(*counts)
