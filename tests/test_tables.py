"""The stored capture table: pruning, joins without a shuffle, retention in place; and near-linear folds."""

import glob
import json
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tracewarden.functions.text import fold_in_blocks
from tracewarden.operators import redact as R
from tracewarden.operators import reversible as V
from tracewarden.operators import sessions as S
from tracewarden.operators import usage as U
from tracewarden.sources.tables import CaptureTable


@pytest.fixture
def stored(spark, tmp_path):
    """Captures of ten sessions over four days; the first session lies on the first day alone."""
    def row(i):
        session = None if i % 7 == 0 else f"{i % 10:08x}"
        day = 1 if i % 10 == 1 else 2 + i % 3
        stamp = 1735689600000 + day * 86_400_000 + i * 1000 + (i % 10) * 10**7
        name = "_".join(x for x in ("src", session, f"{stamp}-{i:06d}.json") if x)
        return (i, name, session, session, f"2025-01-0{day}T00:00:00.000Z")

    rows = spark.createDataFrame([row(i) for i in range(200)], "capture_id long, file string, session_id string, file_session string, ts string")
    table = CaptureTable(spark, f"captures_{uuid.uuid4().hex}", str(tmp_path / "table"), buckets=4)
    table.append(rows)
    yield rows, table
    spark.sql(f"DROP TABLE IF EXISTS {table.name}")


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def with_conf(spark, key, value, run):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        return run()
    finally:
        spark.conf.set(key, before)


def test_days_and_sessions_prune(spark, stored):
    rows, table = stored
    late = table.since("2025-01-03 00:00:00")
    assert "day" in plan(late).split("PartitionFilters:")[1].split("]")[0]
    assert late.count() == rows.filter("ts >= '2025-01-03'").count()
    mine = table.of_session("00000003")
    # The buckets that a scan picks are only told where it reads bucket by bucket.
    told = with_conf(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false", lambda: plan(mine))
    assert "SelectedBucketsCount: 1 out of 4" in told
    assert mine.count() == rows.filter("session_id = '00000003'").count()


def test_tables_of_one_layout_join_without_a_shuffle(spark, stored):
    _, table = stored
    joined = lambda: table.rows().alias("a").join(table.rows().alias("b"), "bucket_key").select("a.file", F.col("b.file").alias("other"))
    text = with_conf(spark, "spark.sql.autoBroadcastJoinThreshold", "-1", lambda: plan(joined()))
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_retention_rewrites_only_what_it_must(stored):
    rows, table = stored
    files = lambda: {os.path.relpath(f, table.folder) for f in glob.glob(f"{table.folder}/day=*/*.parquet")}
    expected = {r.capture_id for r in S.retained(rows, 9).collect()}
    dropped = {r.ts[:10] for r in rows.collect() if r.capture_id not in expected}
    before = files()
    days = table.retain(9)
    assert set(days) == dropped and len(dropped) < 4
    after = files()
    untouched = {f for f in before if f.split("/")[0][4:] not in dropped}
    assert untouched and untouched == {f for f in after if f.split("/")[0][4:] not in dropped}
    assert {r.capture_id for r in table.rows().collect()} == expected
    assert table.retain(9) == [] and files() == after
    assert table.retain(0) == []


def test_a_day_without_any_kept_session_goes(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "s_aaaaaaaa_1735689600000-000000.json", "aaaaaaaa", "aaaaaaaa", "2025-01-01T00:00:00Z"),
         (2, "s_bbbbbbbb_1735789600000-000001.json", "bbbbbbbb", "bbbbbbbb", "2025-01-02T00:00:00Z")],
        "capture_id long, file string, session_id string, file_session string, ts string")
    table = CaptureTable(spark, f"captures_{uuid.uuid4().hex}", str(tmp_path / "t"), buckets=2)
    table.append(rows)
    assert table.retain(1) == ["2025-01-01"]
    assert [r.capture_id for r in table.rows().collect()] == [2]
    assert glob.glob(f"{table.folder}/day=2025-01-01/*.parquet") == []
    spark.sql(f"DROP TABLE {table.name}")


def _two_sessions_a_day(spark, folder, days):
    """A kept and a dropped session on each of so many days, and one day with the dropped one alone."""
    rows = spark.range(2 * days + 1).select(
        F.col("id").alias("capture_id"),
        F.when(F.col("id") % 2 == 0, "aaaaaaaa").otherwise("bbbbbbbb").alias("session_id"),
        F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), F.floor(F.col("id") / 2).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'").alias("ts"),
    )
    stamp = F.when(F.col("session_id") == "aaaaaaaa", "1735689600000").otherwise("1735789600000")
    rows = rows.withColumns({"file_session": F.col("session_id"), "file": F.concat(F.lit("s_"), "session_id", F.lit("_"), stamp, F.lit("-000000.json"))})
    table = CaptureTable(spark, f"captures_{uuid.uuid4().hex}", folder, buckets=2)
    table.append(rows)
    return table


def test_retention_writes_all_days_in_one_go(spark, tmp_path):
    """The number of jobs does not follow the number of days."""
    jobs = []
    for days in (3, 40):
        table = _two_sessions_a_day(spark, str(tmp_path / str(days)), days)
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "retention")
        try:
            assert len(table.retain(1)) == days + 1
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        assert sorted(r.capture_id for r in table.rows().collect()) == list(range(1, 2 * days, 2))
        assert len(glob.glob(f"{table.folder}/day=*")) == days
        spark.sql(f"DROP TABLE {table.name}")
    # Listing many folders is a job or two of its own.
    assert jobs[1] <= jobs[0] + 8


def test_retention_of_captures_without_a_day(spark, tmp_path):
    schema = "capture_id long, file string, session_id string, file_session string, ts string"
    old, new = ("s_aaaaaaaa_1735689600000-000000.json", "aaaaaaaa", "aaaaaaaa"), ("s_bbbbbbbb_1735789600000-000001.json", "bbbbbbbb", "bbbbbbbb")
    for extra, left in (([], [2]), ([(3, *new, None)], [2, 3])):
        rows = [(1, *old, None), (2, *new, "2025-01-02T00:00:00Z"), *extra]
        table = CaptureTable(spark, f"captures_{uuid.uuid4().hex}", str(tmp_path / f"t{len(rows)}"), buckets=2)
        table.append(spark.createDataFrame(rows, schema))
        assert table.retain(1) == [None]
        assert sorted(r.capture_id for r in table.rows().collect()) == left
        spark.sql(f"DROP TABLE {table.name}")


# --- folds --------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_fold_in_blocks(spark, n):
    step = lambda s, i: F.struct((s + i).alias("state"), (s * 2).alias("out"))
    df = spark.range(1).select(fold_in_blocks(F.lit(n), F.lit(0), "int", step).alias("x"))
    out, state = [], 0
    for i in range(n):
        out.append(state * 2)
        state += i
    assert df.first().x == out


def took(run):
    began = time.time()
    result = run()
    return time.time() - began, result


def test_many_literals_take_time_in_proportion(spark):
    policy = R.compile_policy({"rules": [{"id": "w", "pattern": r"\bsecret\b", "replacement": "<W>"}], "paths": {"only": ["a[*].b"]}})

    def run(n):
        body = json.dumps({"a": [{"b": "secret", "c": "secret"}] * n})
        df = spark.createDataFrame([(1, body)], "k int, b string")
        return R.redact_json(df, policy, "b").first().b

    took(lambda: run(100))
    small, _ = took(lambda: run(5_000))
    large, text = took(lambda: run(50_000))
    assert text.count("<W>") == text.count("secret") == 50_000
    assert large < 25 * small + 5


def test_long_streams_take_time_in_proportion(spark):
    """Also where an open bracket keeps all text waiting."""
    book = spark.createDataFrame([("s", "[N_1]", "name")], "session_id string, placeholder string, original string")

    def run(n, first):
        line = lambda t: 'data: {"type":"text_delta","text":"%s"}' % t
        body = "\n".join([line(first), *[line("word [N_1] word")] * n, line("tail")])
        df = spark.createDataFrame([(1, "s", body)], "k long, session_id string, response_body string")
        return V.rehydrate_streams(df, book, "k").first().rehydrated

    took(lambda: run(10, "x"))
    for first in ("x", "[open"):
        small, _ = took(lambda f=first: run(4_000, f))
        large, text = took(lambda f=first: run(40_000, f))
        assert text.count("name") == 40_000 and "[N_1]" not in text
        assert large < 25 * small + 5


def test_many_serials_take_time_in_proportion(spark):
    policy = R.compile_policy({"rules": [{"id": "w", "pattern": r"\bw\d+\b", "replacement": "[W]"}]})

    def run(n):
        df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "k long, text string")
        return V.with_stand_ins(df, policy).first()

    took(lambda: run(100))
    small, _ = took(lambda: run(5_000))
    large, row = took(lambda: run(50_000))
    assert len(row.hits) == 50_000 and row.redacted.count("_50000") == 1
    assert large < 25 * small + 5


def test_price_tables_meet_names_on_pieces(spark):
    table = spark.createDataFrame(
        [(i, k, 1) for i, k in enumerate(["gpt-4.1", "gpt-4", "o1", "x", "", "claude-3.5"])], "ord int, key string, context_limit int"
    )
    names = ["gpt-4.1-mini", "gpt-4-1", "my-gpt-4", "foo1", "ax", "claude-3-5-b", "zzz", ""]
    df = spark.createDataFrame([(n,) for n in [*names, None, names[0]]], "model string")
    out = U.resolve_models(df, table)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert {r.model: r.key for r in out.collect()} == {
        "gpt-4.1-mini": "gpt-4.1", "gpt-4-1": "gpt-4.1", "my-gpt-4": "gpt-4", "foo1": "o1", "ax": "x",
        "claude-3-5-b": "", "zzz": "", "": "", None: None,
    }
