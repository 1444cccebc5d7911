import pytest
from pyspark.sql import functions as F

from tracewarden.dialect import Pattern, quote, replacement

CASES = [
    # pattern, flags, text, expected first match or None
    (r"\bcat\b", "", "concat cat", "cat"),
    (r"\babc", "", "éabc", "abc"),  # ASCII boundary beside an accented letter
    (r"a\sb", "", "a b", "a b"),
    (r"[\s]x", "", "　x", "　x"),
    (r"a.b", "", "a b", None),
    (r"a.b", "", "a\u0085b", "a\u0085b"),
    (r"b$", "", "b\n", None),
    (r"b$", "m", "b\nc", "b"),
    (r"^c", "m", "b c", "c"),
    (r"^c", "", "b\nc", None),
    (r"[[]x", "", "[x", "[x"),
    (r"[a&&b]+", "", "&&", "&&"),
    (r"É", "i", "é", "é"),
    (r"AB", "i", "xab", "ab"),
    (r"\d{0,2}\b-", "", "a -", None),
    (r"[\s\S]+", "", "　\n", "　\n"),
]


@pytest.mark.parametrize("source,flags,text,expected", CASES)
def test_rewritten_pattern_matches_like_the_original(spark, source, flags, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(
        F.rlike("t", F.lit(Pattern(source, flags).java)).alias("hit"),
        F.regexp_extract("t", Pattern(source, flags).java, 0).alias("m"),
    ).head()
    assert (row.m if row.hit else None) == expected


def test_groups_are_counted_without_classes_and_lookarounds():
    assert Pattern(r"(a)(?:b)[(]\((?=c)(?<!d)").groups == 1


def test_quote_and_replacement_are_literal(spark):
    banned = "X5O!P%@AP[4\\PZX54(P^)7CC)7}$+H*"
    df = spark.createDataFrame([("a" + banned + "b",)], "t string")
    java = Pattern(quote(banned)).java
    assert df.select(F.regexp_replace("t", java, replacement("$1\\x"))).head()[0] == "a$1\\xb"
