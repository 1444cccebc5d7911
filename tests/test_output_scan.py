import pytest

from tracewarden.operators import output_scan as O


def test_banned_strings_ignore_case_unless_told(texts):
    df = texts(["dan: and DAN: x", "(\U0001F513developer mode output)", "clean"])
    rows = O.scan_banned(df, keys=["id"]).orderBy("id", "offset").collect()
    assert [(r.id, r["index"], r.offset) for r in rows] == [(0, 1, 0), (0, 1, 9), (1, 8, 0)]
    exact = O.scan_banned(df, keys=["id"], case_sensitive=True).collect()
    assert [(r.id, r.offset) for r in exact] == [(0, 9)]


def test_custom_patterns(texts):
    df = texts(["concat CAT cat", "dog"])
    rows = O.scan_patterns(df, ["(bad", r"\bcat\b"], keys=["id"]).orderBy("offset").collect()
    assert [(r["index"], r.pattern, r.severity, r.offset) for r in rows] == [(1, "regex_1", "medium", 7), (1, "regex_1", "medium", 11)]
    missing = O.scan_required(df, ["cat"], keys=["id"]).collect()
    assert [(r.id, r.match, r.length) for r in missing] == [(1, "(required pattern not found: cat)", 0)]
    done = O.redact_patterns(df, [r"\bcat\b"]).orderBy("id").collect()
    assert done[0].redacted == "concat [REDACTED] [REDACTED]"
    with pytest.raises(ValueError):
        O.scan_patterns(df, ["a*"], keys=["id"])


def test_urls(spark, texts):
    long = "https://ok.example/" + "a" * 20000
    df = texts(["see https://a.evil.com/x#y and http://U@EVIL.com:80/~z", "http://notevil.com http://a_b.evil.com", long])
    urls = [r.url for r in O.extract_urls(df, keys=["id"]).orderBy("id", "ord").collect()]
    assert urls == ["https://a.evil.com/x", "http://U@EVIL.com:80/", "http://notevil.com", "http://a_b.evil.com", long]
    rows = O.blocked_urls(df, keys=["id"]).orderBy("id", "index").collect()
    assert [(r.id, r["index"], r.offset, r.match) for r in rows] == [
        (0, 0, 4, "https://a.evil.com/x"), (0, 1, 31, "http://U@EVIL.com:80/"), (1, 1, 19, "http://a_b.evil.com")]
    listed = spark.createDataFrame([("evil.com",), ("other.org",)], "domain string")
    by_table = O.blocked_urls_by_table(df, listed, keys=["id"]).collect()
    assert sorted((r.id, r["index"]) for r in by_table) == [(0, 0), (0, 1), (1, 1)]


def test_code(texts):
    rows = O.scan_code(texts(["eval( atob('x'))\nos.system ('ls')", "open('/etc/shadow')", "evaluate(a)"]), keys=["id"]).collect()
    assert [(r.id, r.pattern, r.severity) for r in rows] == [
        (0, "shell_exec", "high"), (0, "shell_exec", "medium"), (1, "fs_access", "high")]


def test_switches_and_verdicts(texts):
    df = texts(["DAN: eval(atob(1)) http://evil.com", "fine"])
    count = lambda **k: O.scan_output(df, keys=["id"], **k).count()
    assert (count(), count(banned=False), count(banned=[]), count(urls=False), count(code=False)) == (3, 2, 2, 2, 2)
    assert count(patterns=["fine"]) == 4
    assert [(r.id, r.alerts, r.is_safe) for r in O.output_verdicts(df, keys=["id"]).orderBy("id").collect()] == [(0, 3, False), (1, 0, True)]
