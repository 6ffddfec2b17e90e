"""Line expressions against small automata written from their descriptions."""

import random
import re

from pyspark.sql import functions as F

from riskloom.functions import text as X


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", make(F.col("t")).alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


def cut_comment(line):
    quote, i = "", 0
    while i < len(line):
        c = line[i]
        if c == "\\":
            i += 2
            continue
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "#" or line[i : i + 2] in ("//", "--"):
            return line[:i].rstrip()
        i += 1
    return line


def test_inline_comments_equal_an_automaton(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choice("ab '\"`\\#/-x") for _ in range(rng.randrange(24))) for _ in range(4000)] + ["x" * 200_000 + " # y"]
    assert column(spark, lines, X.strip_inline_comment) == [cut_comment(x) for x in lines]


def test_mask_keeps_four_characters_at_both_ends(spark):
    rng = random.Random(2)
    lines = ["".join(rng.choice("abcXYZ09_- =") for _ in range(rng.randrange(50))) for _ in range(2000)]
    want = [re.sub(r"[A-Za-z0-9_\-]{12,}", lambda m: m[0][:4] + "..." + m[0][-4:], x) for x in lines]
    assert column(spark, lines, X.mask) == want
    assert column(spark, ["k = " + "a" * 200], X.snippet) == ["k = aaaa...aaaa"]


def test_lines_are_those_of_splitlines(spark):
    texts = ["", "a", "a\n", "a\n\nb", "\r\n", "a\rb\x0bc\x1cd\x85e f\n", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in X.lines(df, "t", "i").orderBy("i", "line_num").collect():
        got.setdefault(r["i"], []).append(r["line"])
    assert [got.get(i, []) for i in range(len(texts))] == [t.splitlines() for t in texts]
    assert column(spark, texts, X.line_count) == [len(t.splitlines()) for t in texts]


def test_comment_lines(spark):
    lines = ["# a", "// a", "/* a", "*/", "* a", "<!-- a", "-->", "-- a", "; a", "REM a", "rem a", "  ", "", "x # a", "REMx", "eval(x)"]
    assert column(spark, lines, X.is_comment_line) == [True] * 13 + [False] * 3


def test_strip_knows_unicode_space(spark):
    assert column(spark, ["\t a  ", "　b "], X.strip) == ["a", "b"]


def test_texts_of_numbers_and_places(spark):
    rows = spark.createDataFrame([(0.29, 9.5, 0, None), (0.99, 0.0, 3, None), (7.0, None, 3, 4)], "c double, s double, l int, k int")
    got = rows.select(X.confidence_text(F.col("c")), X.score_text(F.col("s")), X.location(F.lit("f"), F.col("l"), F.col("k"))).collect()
    assert [tuple(r) for r in got] == [("28%", "9.5", "f"), ("99%", "N/A", "f:3"), ("7.0%", "N/A", "f:3:4")]


def test_severities(spark):
    assert column(spark, ["info", "CRITICAL", "none"], X.severity_rank) == [0, 4, 1]
    assert column(spark, ["high", "none"], X.severity_of) == ["HIGH", "LOW"]
    assert column(spark, ["<a href=\"x\">'&"], X.escape_html) == ["&lt;a href=&quot;x&quot;&gt;&#x27;&amp;"]
