from pyspark.sql import functions as F

from tracewarden.functions import text as T


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(column).collect()]


def test_lengths_count_utf16_units(spark):
    assert one(spark, T.utf16_length(F.col("v")), "abc", "a😀", "é", "") == [3, 3, 1, 0]


def test_snippet_is_cut_at_120_units(spark):
    long = "x" * 121
    assert one(spark, T.snippet(F.col("v")), "x" * 120, long, "😀" * 61) == [
        "x" * 120, "x" * 117 + "...", "😀" * 58 + "...",
    ]


def test_entropy(spark):
    got = one(spark, F.round(T.shannon_entropy(F.col("v")), 6), "aab1", "aaaa", "", "abcd")
    assert got == [1.5, 0.0, 0.0, 2.0]


def test_token_estimate(spark):
    assert one(spark, T.text_tokens(F.col("v")), "", "abcd", "abcde", None) == [0, 1, 2, 0]


def test_fixed_decimals_round_on_the_binary_value(spark):
    values = [1.25, 1.15, 0.0005, 1.005, 0.0, 999.95, 2.675]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r) for r in df.select(T.to_fixed(F.col("v"), 1), T.to_fixed(F.col("v"), 2), T.to_fixed(F.col("v"), 3)).collect()]
    assert [g[0] for g in got] == ["1.3", "1.1", "0.0", "1.0", "0.0", "1000.0", "2.7"]
    assert [g[1] for g in got] == ["1.25", "1.15", "0.00", "1.00", "0.00", "999.95", "2.67"]
    assert got[2][2] == "0.001"


def test_running_starts_cross_block_borders(spark):
    n = 300
    df = spark.range(1).select(T.running_starts(F.sequence(F.lit(1), F.lit(n))).alias("s"))
    expected = [i * (i + 1) // 2 for i in range(n)]
    assert df.head().s == expected


def test_offsets_of_all_matches(spark):
    text = "😀a1b22c" + "x7" * 200
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(
        T.located_all([T.match_parts(F.col("t"), r"\d+", 0, k=F.lit(5))], ("k",)).alias("f")
    ).head().f
    units = text.encode("utf-16-le")
    for m in found:
        piece = units[2 * m.offset : 2 * (m.offset + m.length)].decode("utf-16-le")
        assert piece == m.match and m.k == 5
    assert len(found) == 202
