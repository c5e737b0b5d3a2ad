"""Finding the chunks of clauses: by word, by character gram, by substring.

Every branch yields clause hits, one row per clause and chunk with its frequency
`tf` and the chunk length `dl`; `combine` turns them into query hits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from passagework.functions import text as X
from passagework.operators import bags, joins, postings
from passagework.operators.clauses import CLAUSE_KEY, ClauseTable
from passagework.operators.joins import bounded_join, bounded_rows
from passagework.plans.corpus import Corpus, any_of, attach_texts
from passagework.schemas import CHUNK_KEY
from passagework.session import written

GROUP = ["query_id", "group_no"]
HIT = [*CLAUSE_KEY, "kind", "n_must", "scored"]
# Up to this many clauses every text is tested against each; beyond it by shared grams.
DIRECT_CLAUSES = 256
GRAM = X.GRAM
# Rarest grams of a part whose postings are intersected; the text decides in the end.
RAREST = 4
CAPITAL_SIGMA = "\u03a3"
# A part is looked up beside the rarest one of its group if it costs up to so many times as much, and so many rows.
ANCHOR_TIMES, ANCHOR_ROWS = 8, 1000
# Rows of a lookup that are kept as part of the plan.
LOCAL_ROWS = 10_000
# Up to this many prefixes are ranges of the dictionary scan.
PREFIX_RANGES = 256
# Up to this many terms are listed in the scan of their postings.
LISTED_TERMS = 1000


# Words ---------------------------------------------------------------------------


def word_hits(corpus: Corpus, table: ClauseTable) -> DataFrame:
    """Clause hits on words: term, phrase and prefix clauses."""
    units = _word_units(table)
    if corpus.words is None:
        return _counted(_scan_words(corpus.chunks, units, table), table.one_word)
    if not table.one_word:
        # Only phrases need places, which are long: single words are looked up and counted without them.
        single = _lookup_words(corpus, units.filter("n_terms = 1"), table)
        phrases = _lookup_words(corpus, units.filter("n_terms > 1"), table)
        return _counted(single, True).unionByName(_counted(phrases, False))
    found = _lookup_words(corpus, units, table)
    if "prefix" not in table.forms:
        # One posting is one hit. Placed by chunk for `combine`, counting and scoring
        # share this shuffle and the postings are read once.
        return found.select(*HIT, *CHUNK_KEY, "dl", "tf").repartition(*CHUNK_KEY)
    return _counted(found, True)


def _counted(found: DataFrame, one_word: bool) -> DataFrame:
    """Clause hits from the words found, with the frequency of the word or phrase."""
    grouped = found.groupBy(*HIT, "n_terms", *CHUNK_KEY, "dl")
    if one_word:
        hits = grouped.agg(F.sum("tf").cast("int").alias("tf"))
    else:
        hits = grouped.agg(
            F.sum("tf").cast("int").alias("total"),
            F.sort_array(F.flatten(F.collect_list("starts"))).alias("starts"),
        ).withColumn("tf", F.when(F.col("n_terms") == 1, F.col("total")).otherwise(_phrase_count()))
    return hits.filter(F.col("tf") > 0).select(*HIT, *CHUNK_KEY, "dl", "tf")


def word_chunks(corpus: Corpus, table: ClauseTable) -> DataFrame:
    """query_id, file_id, chunk_no of the chunks that meet a group on words, with a score of 0."""
    bag = bags.bag_of(table)
    if bag is None:
        return combine(word_hits(corpus, table), table.one_group)
    return bags.queries_met(bag_postings(corpus, table, bag).withColumn("value", F.lit(0.0)), bag)


def bag_postings(corpus: Corpus, table: ClauseTable, bag: bags.Bag) -> DataFrame:
    """The postings of the words of a bag, placed by file; the bound of the table is the bound of its words."""
    numbers = bag.numbers(corpus.chunks.sparkSession)
    if corpus.words is None:
        counts = postings.word_postings(corpus.chunks).select("term", *CHUNK_KEY, "dl", "tf")
        return bags.placed(counts.join(F.broadcast(numbers), "term"), repeated=True)
    stored = _read_words(corpus, numbers, table.rows)
    return bags.placed(corpus.alive(stored.join(F.broadcast(numbers), "term")), repeated=False)


def _word_units(table: ClauseTable) -> DataFrame:
    """One row per word of a clause: its place in the phrase and the key to look up."""
    usable = table.frame.filter(F.size("terms") > 0).select(
        *CLAUSE_KEY, "kind", "form", "terms", _musts(F.lit(True)).alias("n_must"), F.lit(True).alias("scored")
    )
    return usable.select(
        *HIT, F.size("terms").alias("n_terms"), "form", F.posexplode("terms").alias("offset", "key")
    ).withColumn("is_prefix", (F.col("form") == "prefix") & (F.col("offset") == F.col("n_terms") - 1)).drop("form")


def _musts(condition: Column) -> Column:
    wanted = (F.col("kind") == "must") & condition
    return F.sum(wanted.cast("int")).over(Window.partitionBy(*GROUP)).cast("int")


def _scan_words(chunks: DataFrame, units: DataFrame, table: ClauseTable) -> DataFrame:
    occurrences = postings.word_occurrences(chunks)
    if "prefix" in table.forms:
        # Only beginnings as long as some query prefix are worth a row.
        lengths = units.filter("is_prefix").agg(F.collect_set(F.char_length("key"))).scalar()
        beginnings = F.transform(
            F.filter("lengths", lambda n: n <= F.char_length("term")),
            lambda n: F.struct(F.lit(True).alias("is_prefix"), F.col("term").substr(F.lit(1), n).alias("key")),
        )
        whole = F.array(F.struct(F.lit(False).alias("is_prefix"), F.col("term").alias("key")))
        keyed = occurrences.withColumn("lengths", lengths).select(
            *CHUNK_KEY, "dl", "pos", F.inline(F.concat(whole, beginnings))
        )
        on = ["is_prefix", "key"]
    else:
        keyed = occurrences.withColumnRenamed("term", "key")
        units = units.drop("is_prefix")
        on = ["key"]
    found = bounded_join(keyed, units, on, table.rows, [F.col(c) for c in CHUNK_KEY])
    return found.withColumns({"tf": F.lit(1), "starts": F.array(F.col("pos") - F.col("offset"))})


def _lookup_words(corpus: Corpus, units: DataFrame, table: ClauseTable) -> DataFrame:
    terms = units.filter(~F.col("is_prefix")).withColumnRenamed("key", "term").drop("is_prefix")
    rows = table.rows
    wanted = table.frame.select(F.explode("terms").alias("term")) if table.one_word else terms
    if "prefix" in table.forms:
        expanded, extra = expand_prefixes(corpus.vocabulary, units.filter("is_prefix"), table.rows)
        rows = None if rows is None or extra is None else rows + extra
        terms = terms.unionByName(expanded)
        wanted = terms
    found = bounded_join(_read_words(corpus, wanted, rows), terms, ["term"], rows, [F.col(c) for c in CHUNK_KEY])
    return corpus.alive(found).withColumn("starts", F.transform("positions", lambda p: p - F.col("offset"))).drop("positions")


def expand_prefixes(vocabulary: DataFrame, units: DataFrame, rows: int | None) -> tuple[DataFrame, int | None]:
    """Prefix units as one unit per dictionary word that starts with the prefix, and their number if it is small.

    Few prefixes become ranges of the scan: a dictionary in order of its words is read
    where they lie. It is read once; what it gave is written or, if small, kept.
    """
    if rows is not None and rows <= PREFIX_RANGES:
        keys = sorted({r.key for r in units.select("key").collect()})
        vocabulary = vocabulary.filter(any_of([F.col("term").startswith(k) for k in keys]))
    lengths = units.agg(F.collect_set(F.char_length("key"))).scalar()
    beginnings = vocabulary.select("term").distinct().withColumn("lengths", lengths).select(
        "term",
        F.explode(
            F.transform(
                F.filter("lengths", lambda n: n <= F.char_length("term")),
                lambda n: F.col("term").substr(F.lit(1), n),
            )
        ).alias("key"),
    )
    return _settled(bounded_join(beginnings, units, ["key"], rows, [F.col("term")]).drop("key", "is_prefix"))


def _settled(frame: DataFrame) -> tuple[DataFrame, int | None]:
    """The frame, evaluated once, and its number of rows if it is small: kept here up to that number, written beyond it."""
    spark = frame.sparkSession
    first = frame.limit(LOCAL_ROWS + 1).toArrow()
    if first.num_rows <= LOCAL_ROWS:
        return spark.createDataFrame(first, frame.schema), first.num_rows
    kept = written(frame, "settled")
    return kept, bounded_rows(kept)


def _read_words(corpus: Corpus, terms: DataFrame, rows: int | None) -> DataFrame:
    """Stored postings of words; lists of other words are left out before any is dealt out."""
    if corpus.word_lists is None:
        return read_buckets(corpus.words, terms, corpus.buckets, rows)
    return postings.postings_of(read_buckets(corpus.word_lists, terms, corpus.buckets, rows))


def read_buckets(stored: DataFrame, terms: DataFrame, buckets: int | None, rows: int | None = None) -> DataFrame:
    """Stored postings of the buckets the terms fall in (at most `buckets` numbers); of a bounded number of terms only their own."""
    if buckets is None:
        return stored
    needed = terms.select(bucket_of(F.col("term"), buckets).alias("b"), "term")
    small = rows is not None and rows <= joins.MAX_BROADCAST_ROWS
    few = rows is not None and rows <= LISTED_TERMS
    found = (needed if few else needed.select("b") if small else needed.select("b").distinct()).collect()
    read = stored.filter(F.col("bucket").isin(sorted({r.b for r in found}))).drop("bucket")
    if few:
        own = sorted({r.term for r in found if r.term is not None})
        # A long list reaches the scan as a range only, single values pass over the pages between.
        read = read.filter(F.col("term").isin(own))
        return read.filter(any_of([F.col("term") == t for t in own])) if len(own) <= PREFIX_RANGES else read
    return read.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi") if small else read


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _phrase_count() -> Column:
    """Starts that every word of the phrase agrees on.

    A start occurs once per place in the phrase, so equal neighbours in the sorted
    list make a full phrase exactly when `n_terms` of them stand in a row.
    """
    back = F.col("n_terms") - 1
    ends = F.filter(
        F.sequence(F.lit(0), F.size("starts") - 1),
        lambda i: (i >= back) & (F.get("starts", i) == F.get("starts", i - back)),
    )
    return F.size(ends)


# Character grams and substrings ----------------------------------------------------


def gram_hits(corpus: Corpus, table: ClauseTable) -> DataFrame:
    """Clause hits on case-folded text parts.

    A group needs a required clause of three or more characters; shorter clauses
    are checked as well but carry no score.
    """
    long = F.char_length("part") >= GRAM
    parts = (
        table.frame.withColumn("part", X.fold_grams(F.col("text")))
        .filter(F.col("part") != "")
        .select(
            *CLAUSE_KEY, "kind", "part",
            _musts(F.lit(True)).alias("n_must"), _musts(long).alias("n_long"), long.alias("scored"),
        )
        .filter(F.col("n_long") > 0)
        .drop("n_long")
    )
    if corpus.grams is None:
        return _parts_in_chunks(corpus, parts, table.rows, X.fold_grams)
    return _lookup_parts(corpus, parts, table.rows, X.fold_grams, ranked=True)


def substring_hits(corpus: Corpus, table: ClauseTable) -> DataFrame:
    """Clause hits of every token of the required clauses as a plain substring.

    Case counts except for the letters A to Z; wildcards have no meaning. On an index,
    candidates come from its folded grams. Folding goes letter by letter but for one, the
    capital sigma, whose small form depends on its place: a token that holds it is sought
    in the texts themselves.
    """
    parts = (
        table.frame.filter(F.col("kind") == "must")
        .select(*GROUP, "kind", F.explode(X.query_tokens(F.col("text"))).alias("token"))
        .select(*GROUP, "kind", X.ascii_lower(F.col("token")).alias("part"))
        .distinct()
        .withColumn("clause_no", F.row_number().over(Window.partitionBy(*GROUP).orderBy("part")))
        .select(*CLAUSE_KEY, "kind", "part", _musts(F.lit(True)).alias("n_must"), F.lit(False).alias("scored"))
    )
    if corpus.grams is None:
        return _parts_in_chunks(corpus, parts, table.rows, X.ascii_lower)
    bent = table.frame.filter(F.contains("text", F.lit(CAPITAL_SIGMA)))
    if not bent.isEmpty():
        return _parts_in_chunks(corpus, parts, table.rows, X.ascii_lower)
    return _lookup_parts(corpus, parts, table.rows, X.ascii_lower, ranked=False)


def _parts_in_chunks(corpus: Corpus, parts: DataFrame, rows: int | None, fold: Callable[[Column], Column]) -> DataFrame:
    texts = corpus.chunks.select(*CHUNK_KEY, fold(F.col("content")).alias("folded"))
    holds_part = F.contains(F.col("folded"), F.col("part"))
    if rows is not None and rows <= DIRECT_CLAUSES:
        # A short list of parts is a constant of the scan: no join, no shuffle.
        wanted = parts.agg(F.collect_list(F.struct(*HIT, "part"))).scalar()
        found = texts.withColumn("wanted", wanted).select(
            *CHUNK_KEY, "folded", F.inline(F.filter("wanted", lambda p: F.contains(F.col("folded"), p["part"])))
        )
        return _measured(found)
    grams = F.array_distinct(F.concat(*(X.char_grams(F.col("folded"), n) for n in range(1, GRAM + 1))))
    anchored = parts.withColumn("gram", F.substring("part", 1, GRAM))
    if rows is not None and rows <= joins.MAX_BROADCAST_ROWS:
        keyed = texts.select(*CHUNK_KEY, "folded", F.explode(grams).alias("gram"))
        return _measured(keyed.join(F.broadcast(anchored), "gram").filter(holds_part))
    # Too many parts to broadcast: only chunk keys and grams are shuffled, and the text
    # comes back once for the candidates.
    keyed = texts.select(*CHUNK_KEY, F.explode(grams).alias("gram"))
    candidates = bounded_join(keyed, anchored, ["gram"], None, [F.col(c) for c in CHUNK_KEY]).drop("gram")
    checked = attach_texts(candidates, corpus, None).withColumn("folded", fold(F.col("content")))
    return _measured(checked.filter(holds_part))


def _lookup_parts(corpus: Corpus, parts: DataFrame, rows: int | None, fold: Callable[[Column], Column], ranked: bool) -> DataFrame:
    """Clause hits by stored grams; a text is read only where its grams say that a hit may be.

    A group is anchored by some of its required parts. Where hits are `ranked`, all
    long ones are anchors and all their hits are found, as their number is part of the
    score; otherwise the rarest parts are. The other clauses are tested where all anchors of
    their group may stand.
    """
    must = (F.col("kind") == "must") & (F.col("scored") if ranked else F.lit(True))
    musts = parts.filter(must).select(*CLAUSE_KEY, X.fold_grams(F.col("part")).alias("sought"))
    long = F.char_length("sought") >= GRAM
    grams = _rarest(corpus, musts.filter(long), rows)
    if not ranked:
        grams = grams.unionByName(_holders(corpus, musts.filter(~long), rows))
    grams, small = _settled(_anchors(grams, every=ranked))
    stored = read_buckets(corpus.grams, grams, corpus.buckets, small).select("term", *CHUNK_KEY, "batch")
    postings = corpus.alive(bounded_join(stored, grams, ["term"], small, [F.col(c) for c in CHUNK_KEY]))
    # All grams of a long part, any of a short one; then all anchors of the group.
    clauses = postings.groupBy(*CLAUSE_KEY, "n_terms", "n_anchors", *CHUNK_KEY).agg(F.count(F.lit(1)).alias("n")).filter("n >= n_terms")
    clauses = written(clauses.select(*CLAUSE_KEY, "n_anchors", *CHUNK_KEY), "candidates")
    both = clauses.groupBy(*GROUP, "n_anchors", *CHUNK_KEY).agg(F.count(F.lit(1)).alias("n")).filter("n = n_anchors").select(*GROUP, *CHUNK_KEY)
    wanted, spread_by = parts.select(*HIT, "part"), [F.col(c) for c in CHUNK_KEY]
    if ranked:
        own = bounded_join(clauses.drop("n_anchors"), wanted.filter(must), CLAUSE_KEY, rows, spread_by)
        asked = own.unionByName(bounded_join(both, wanted.filter(~must), GROUP, rows, spread_by).select(own.columns))
        chunks = clauses.select(*CHUNK_KEY).distinct()
    else:
        asked = bounded_join(both, wanted, GROUP, rows, spread_by)
        chunks = both.select(*CHUNK_KEY).distinct()
    texts = attach_texts(chunks, corpus, None).withColumn("folded", fold(F.col("content"))).drop("content")
    return _measured(asked.join(texts, CHUNK_KEY).filter(F.contains("folded", "part")))


def _anchors(grams: DataFrame, every: bool) -> DataFrame:
    """The grams of the parts that are worth a lookup: in each group the rarest part and those not much more frequent, or every one."""
    clause, group = Window.partitionBy(*CLAUSE_KEY), Window.partitionBy(*GROUP)
    cost = F.when(F.col("all"), F.min("df").over(clause)).otherwise(F.sum("df").over(clause))
    kept = grams
    if not every:
        priced = grams.withColumn("cost", cost).withColumn("least", F.min("cost").over(group))
        kept = priced.filter(F.col("cost") <= ANCHOR_TIMES * F.col("least") + ANCHOR_ROWS)
    n_terms = F.when(F.col("all"), F.count(F.lit(1)).over(clause)).otherwise(F.lit(1).cast("long"))
    return kept.select(*CLAUSE_KEY, "term", n_terms.alias("n_terms"), F.size(F.collect_set("clause_no").over(group)).alias("n_anchors"))


def _rarest(corpus: Corpus, parts: DataFrame, rows: int | None) -> DataFrame:
    """The rarest grams of long parts, all of which a text must hold; one that is not in the dictionary is the rarest."""
    grams = parts.select(*CLAUSE_KEY, F.explode(F.array_distinct(X.char_grams(F.col("sought")))).alias("term"))
    terms = grams.select("term").distinct()
    known = bounded_join(corpus.gram_vocabulary, terms, ["term"], rows, [F.col("term")]).groupBy("term").agg(F.sum("df").alias("df"))
    ranked = grams.join(known, "term", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("long")))
    place = F.row_number().over(Window.partitionBy(*CLAUSE_KEY).orderBy("df", "term"))
    return ranked.withColumn("place", place).filter(F.col("place") <= RAREST).select(*CLAUSE_KEY, "term", "df", F.lit(True).alias("all"))


def _holders(corpus: Corpus, parts: DataFrame, rows: int | None) -> DataFrame:
    """The grams that hold a short part, one of which is enough; a part that none holds has one row without a gram."""
    wanted = parts.withColumnRenamed("sought", "part")
    known = bounded_join(corpus.gram_parts, wanted.select("part").distinct(), ["part"], rows, [F.col("term")])
    sums = known.groupBy("part", "term").agg(F.sum("df").alias("df"))
    found = wanted.join(sums, "part", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("long")))
    return found.select(*CLAUSE_KEY, "term", "df", F.lit(False).alias("all"))


def _measured(found: DataFrame) -> DataFrame:
    """Clause hits with frequency and length, placed by chunk.

    `combine` groups by chunk next; placing the hits already here gives counting and
    scoring one shuffle to share instead of two scans of the texts.
    """
    return found.select(
        *HIT, *CHUNK_KEY,
        X.gram_count(F.col("folded")).alias("dl"),
        X.overlapping_count(F.col("folded"), F.col("part")).cast("int").alias("tf"),
    ).repartition(*CHUNK_KEY)


# From clauses to queries -------------------------------------------------------------


def combine(hits: DataFrame, one_group: bool = False) -> DataFrame:
    """query_id, file_id, chunk_no, score of the chunks that meet a group.

    The score sums over the clauses of all groups met; it is 0 without a `score`
    column. AND and NOT are counted in one pass.
    """
    score = F.col("score") if "score" in hits.columns else F.lit(0.0)
    groups = (
        hits.groupBy(*GROUP, "n_must", *CHUNK_KEY)
        .agg(
            F.sum((F.col("kind") == "must").cast("int")).alias("found"),
            F.sum((F.col("kind") == "must_not").cast("int")).alias("banned"),
            F.sum(score).alias("score"),
        )
        .filter((F.col("found") == F.col("n_must")) & (F.col("banned") == 0))
    )
    if one_group:
        return groups.select("query_id", *CHUNK_KEY, "score")
    return groups.groupBy("query_id", *CHUNK_KEY).agg(F.sum("score").alias("score"))
