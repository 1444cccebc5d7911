import json

from pyspark.sql import functions as F

from tracewarden.operators import sessions as S
from tracewarden.operators.ranking import numbered, order_slices
from tracewarden.operators.redact import preset
from tracewarden.operators.transforms import ResponseStep, fail_open, notify, observed, redact_then_log, response_chain
from tracewarden.plans.derived import raw_captures_of
from tracewarden.sources import captures as C


def record(source, session, second, body, provider="anthropic", response='{"usage":{"input_tokens":1000,"output_tokens":500}}'):
    return {
        "timestamp": f"2025-01-01T12:00:{second:02d}.000Z", "sessionId": session, "method": "POST", "path": "/v1/messages",
        "source": source, "provider": provider, "apiFormat": "x", "targetUrl": "u", "requestHeaders": {"Cookie": "a", "accept": "b"},
        "requestBody": body, "requestBytes": 1, "responseStatus": 200, "responseHeaders": {}, "responseBody": response,
        "responseIsStreaming": False, "responseBytes": 1, "timings": {"send_ms": 1, "wait_ms": 200, "receive_ms": 10, "total_ms": 211}}


def write(folder, name, content):
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))


def fill(folder):
    body = {"model": "claude-sonnet-4", "system": [{"type": "text", "text": "You are"}, "here"], "messages": [{"role": "user", "content": "hello you"}],
            "tools": [{"name": "t", "description": "does it", "input_schema": {"properties": {"a": {}, "b": {}}}}, {"description": 5}]}
    write(folder, "claude_aabb0011_1735732800000-000000.json", record("claude", "aabb0011", 1, body))
    write(folder, "aider_ccdd0022_1735732900000-000001.json", record("aider", "ccdd0022", 5, {"model": "gpt-4o", "messages": [{"role": "developer", "content": None}, {"role": "system", "content": "late"}], "functions": [{"name": "f", "parameters": {"properties": {"x": {}}}}]}, "openai"))
    write(folder, "aider_ccdd0022_1735732700000-000002.json", record("aider", "ccdd0022", 0, None, "openai", "data: x"))
    write(folder, "my_tool_eeff0033_1735732700000-000003.json", record("my_tool", "eeff0033", 3, {"systemInstruction": {"parts": [{"text": "sys"}]}, "tools": [{"functionDeclarations": [{"name": "g"}]}]}, "gemini"))
    write(folder, "broken.json", '{"timestamp": "2025')
    write(folder, "ignored.json.tmp", "{}")


def test_scan_and_reports(spark, tmp_path):
    fill(tmp_path)
    caps = C.scan_captures(spark, str(tmp_path)).cache()
    rows = {r.file: r for r in caps.collect()}
    assert len(rows) == 4 and rows["my_tool_eeff0033_1735732700000-000003.json"].file_session is None
    assert rows["claude_aabb0011_1735732800000-000000.json"].file_session == "aabb0011"

    listed = S.session_list(caps).collect()
    # First and last follow the file names, not the clock.
    assert [(r.session_id, r.source, r.requests, r.first_time[-9:-5], r.last_time[-9:-5]) for r in listed] == [
        ("ccdd0022", "aider", 2, "0:00", "0:05"), ("aabb0011", "claude", 1, "0:01", "0:01"), ("eeff0033", "my_tool", 1, "0:03", "0:03")]
    assert S.latest_session_id(caps).head()[0] == "eeff0033"
    assert S.latest_session(caps, source="aider").count() == 2
    assert [r.file[:5] for r in S.session_captures(caps, "ccdd0022").collect()] == ["aider", "aider"]
    kept = {r.file[:6] for r in S.retained(caps, 1).collect()}
    assert kept == {"aider_", "my_too"} and S.retained(caps, 0).count() == 4

    keys = ["file"]
    prompts = {r.file[:6]: r.system_prompt for r in S.system_prompts(caps, keys).collect() if "2700000-000002" not in r.file}
    assert prompts == {"claude": "You are\nhere", "aider_": None, "my_too": "sys"}
    tools = {(r.file[:6], r.tool_ord): (r.name, r.description, r.param_count) for r in S.tool_table(caps, keys).collect()}
    assert tools == {("claude", 0): ("t", "does it", 2), ("claude", 1): ("?", "", 0), ("aider_", 0): ("f", "", 1), ("my_too", 0): ("g", "", 0)}
    users = {r.file[:6]: r.first_user_message for r in S.first_user_messages(caps, keys).collect()}
    assert users["claude"] == "hello you" and users["my_too"] is None
    over = {r.file[:6]: (r.system_tokens, r.tool_tokens, r.first_user_tokens, r.overhead_pct) for r in S.context_overhead(caps, keys).collect()}
    assert over["claude"] == (3, 2, 3, "62.5")

    ledger = S.request_ledger(caps, keys).cache()
    row = {r.file: r for r in ledger.collect()}["claude_aabb0011_1735732800000-000000.json"]
    assert (row.time, row.model, row.latency, row.tokens, row.cost) == ("12:00:01", "claude-sonnet-4", "211ms", "1k/500", "$0.01")
    total = S.ledger_totals(ledger).head()
    assert (total.sessions, total.requests, total.tokens_in, total.tokens_out) == (3, 4, 3000, 1500)


def test_live_source_sees_new_files_once(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    fill(source)
    run = lambda: C.start_capture_sink(C.stream_captures(spark, str(source)), out, check).awaitTermination()
    run()
    assert spark.read.parquet(out).count() == 4
    write(source, "zed_00000001_1735732999999-000009.json", record("zed", "00000001", 9, {}))
    run()
    assert spark.read.parquet(out).count() == 5


def test_write_and_read_back(spark, tmp_path):
    fill(tmp_path)
    caps = C.scan_captures(spark, str(tmp_path))
    logged = redact_then_log(preset("pii"))(caps)
    C.write_captures(logged, str(tmp_path / "table"), ("source",))
    assert spark.read.parquet(str(tmp_path / "table")).filter("source = 'aider'").count() == 2
    C.write_capture_json(logged, str(tmp_path / "json"))
    raw = spark.read.json(str(tmp_path / "json"))
    assert raw.count() == 4 and [r.requestHeaders.asDict() for r in raw.select("requestHeaders").collect()] == [{"accept": "b"}] * 4


def test_file_keys_number_all_captures_in_write_order(spark):
    df = spark.range(500).select(
        F.col("id").alias("capture_id"), (F.lit(1735689600000) + (F.col("id") * 7919 % 500) * 60000).alias("written_ms"),
        F.when(F.col("id") % 2 == 0, "a b/c").alias("source"), F.lit(None).cast("string").alias("session_id"))
    rows = C.with_file_keys(df).orderBy("written_ms", "capture_id").collect()
    assert [r.file[-11:-5] for r in rows] == [f"{i:06d}" for i in range(500)]
    assert {r.file.rsplit("_", 1)[0] for r in rows} == {"a_b_c", "unknown"}


def test_file_keys_of_one_hour_and_of_one_moment_are_numbered_in_slices(spark):
    for spread in (3_600_000, 3, 1):
        df = spark.range(900).select(
            F.col("id").alias("capture_id"), (F.lit(1735689600000) + F.col("id") * 7919 % spread).alias("written_ms"),
            F.lit("s").alias("source"), F.lit(None).cast("string").alias("session_id"))
        rows = C.with_file_keys(df, slices=6).orderBy("written_ms", "capture_id").collect()
        assert [r.file[-11:-5] for r in rows] == [f"{i:06d}" for i in range(900)]
        buckets = df.groupBy(order_slices(df, "written_ms", "capture_id", 6).alias("b")).count().collect()
        assert max(r["count"] for r in buckets) <= 900 / 2


def test_retention_reads_serials_of_any_length(spark):
    rows = [("a_aabb0011_1735732800000-999999.json", "aabb0011"), ("a_ccdd0022_1735732900000-1000000.json", "ccdd0022")]
    df = spark.createDataFrame(rows, "file string, file_session string")
    assert [r.file_session for r in S.retained(df, 1).collect()] == ["ccdd0022"]


def test_requests_hold_every_earlier_turn(spark):
    turns = [(5, i, "system" if i == 0 else "user" if i % 2 else "assistant", f"turn {i}.") for i in range(13)]
    rows = raw_captures_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    last = json.loads(max(rows, key=lambda r: r.turn).request_body)
    assert [m["content"] for m in last["messages"]] == [f"turn {i}." for i in range(1, 12)]
    assert "turn 0." in json.dumps(last["system"])


def test_numbering_equals_row_number_on_a_hot_key(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * 31 % 2000).alias("o"))
    rows = numbered(df, ["k"], [F.col("o")], F.floor(F.col("o") / 100)).collect()
    hot = sorted((r.o, r.n) for r in rows if r.k == "hot")
    assert [n for _, n in hot] == list(range(1, len(hot) + 1)) and all(r.n == 1 for r in rows if r.k != "hot")


def test_recent_and_spans(spark):
    assert [S.parse_last(x) for x in ("30s", "5m", "2h", "x", "5d", "", "m")] == [30, 300, 7200, None, None, None, None]
    df = spark.createDataFrame([(0,), (100,), (3600,)], "age int").withColumn("modified", F.expr("timestamp'2025-01-01 12:00:00' - make_interval(0,0,0,0,0,0,age)"))
    now = F.lit("2025-01-01 12:00:00").cast("timestamp")
    assert [S.recent(df, x, now).count() for x in ("2m", "1h", "zzz", "0s")] == [2, 3, 3, 3]


def test_fail_open_and_observers(spark, capsys):
    df = spark.createDataFrame([("{}",), ("bad",), (None,)], "body string")
    rows = fail_open("body", lambda b: F.to_json(F.try_parse_json(b)))(df).collect()
    assert [(r.body, r.transform_failed) for r in rows] == [("{}", False), ("bad", True), (None, False)]
    table, seen = observed(df, "o", rows=F.count(F.lit(1)))
    table.collect()
    assert seen.get == {"rows": 3}
    calls = []
    def broken(batch, i):
        raise ValueError("x")
    notify([broken, lambda b, i: calls.append(i)])(df, 4)
    assert calls == [4] and "failed" in capsys.readouterr().out


def test_response_steps_run_in_order_and_fail_open(spark):
    rows = [(1, "a", False), (2, "bad", False), (3, "a\nbad\nc", True), (4, None, True), (5, "", None)]
    df = spark.createDataFrame(rows, "i int, response_body string, response_is_streaming boolean")
    steps = [
        ResponseStep("up", body=lambda b: F.when(b != "bad", F.upper(b)), line=lambda x: F.when(x != "bad", F.upper(x)),
                     end=lambda lines: F.concat(F.lit("n"), F.size(lines))),
        ResponseStep("tag", body=lambda b: F.concat(b, F.lit("!")), line=lambda x: F.concat(x, F.lit("?"))),
        ResponseStep("none"),
    ]
    got = {r.i: (r.response_body, r.failed_steps) for r in response_chain(df, steps).collect()}
    assert got == {1: ("A!", []), 2: ("bad!", ["up"]), 3: ("A?\nbad?\nC?\nn3?", ["up"]), 4: (None, []), 5: ("!", [])}
