import json
import random

from pyspark.sql import functions as F

from tracewarden.operators import reversible as V
from tracewarden.operators.redact import compile_policy, preset
from tracewarden.plans.queries import _collected, _with_rocksdb
from tracewarden.streaming.pseudonymise import pseudonymise_stream
from tracewarden.streaming.rehydrate import rehydrate_chunks

ROWS = [
    (0, "s1", 0, "mail a@b.co and c@d.co"),
    (1, "s1", 1, "again c@d.co, ssn 111-11-1111 and 222-22-2222"),
    (2, "s2", 2, "c@d.co [EMAIL_1] stays"),
    (3, None, 3, "x@y.zz"),
    (4, "", 4, "x@y.zz q@y.zz"),
    (5, "s1", 5, "nothing"),
]


def table(spark):
    return spark.createDataFrame(ROWS, "row_id long, session_id string, seq long, text string")


def test_dictionary_numbers_by_first_use_and_gated_rules_from_the_right(spark):
    done, book = V.pseudonymise(table(spark), preset("pii"), key="row_id")
    names = {(r.session_id, r.original): r.placeholder for r in book.collect()}
    assert names == {
        ("s1", "a@b.co"): "[EMAIL_1]", ("s1", "c@d.co"): "[EMAIL_2]", ("s1", "222-22-2222"): "[SSN_1]", ("s1", "111-11-1111"): "[SSN_2]",
        ("s2", "c@d.co"): "[EMAIL_1]", ("__default__", "x@y.zz"): "[EMAIL_1]", ("__default__", "q@y.zz"): "[EMAIL_2]"}
    texts = {r.row_id: r.pseudonymised for r in done.collect()}
    assert texts[1] == "again [EMAIL_2], ssn [SSN_2] and [SSN_1]" and texts[4] == "[EMAIL_1] [EMAIL_2]" and texts[5] == "nothing"

    back = {r.row_id: r.rehydrated for r in V.rehydrate(done, book, "row_id", text="pseudonymised").collect()}
    assert {i: t for i, _, _, t in ROWS if i != 2} == {i: t for i, t in back.items() if i != 2}
    inventory = {(r.session_id, r.rule): (r.entries, r.session_size) for r in V.dictionary_inventory(book).collect()}
    assert inventory[("s1", "ssn")] == (2, 4)


def test_an_original_keeps_the_name_its_first_rule_gave(spark):
    policy = compile_policy({"rules": [{"id": "a-x", "pattern": "foo(?= first)", "replacement": "."}, {"id": "b", "pattern": "foo", "replacement": "."}]})
    df = spark.createDataFrame([(0, "s", 0, "foo second"), (1, "s", 1, "foo first foo")], "row_id long, session_id string, seq long, text string")
    done, _ = V.pseudonymise(df, policy, key="row_id")
    assert [r.pseudonymised for r in done.orderBy("row_id").collect()] == ["[B_1] second", "[B_1] first [B_1]"]


def test_originals_are_inserted_literally(spark):
    book = spark.createDataFrame([("s", "[E_1]", 'a"b\\c$1\nd'), ("s", "[E_10]", "ten")], "session_id string, placeholder string, original string")
    df = spark.createDataFrame([(0, "s", "x [E_1] [E_10] [E_2]"), (1, "t", "[E_1]")], "k long, session_id string, text string")
    rows = {r.k: r for r in V.rehydrate(df, book, "k").collect()}
    assert rows[0].rehydrated == 'x a"b\\c$1\nd ten [E_2]' and rows[1].rehydrated == "[E_1]"
    escaped = {r.k: r.rehydrated for r in V.rehydrate(df, book, "k", escape=True).collect()}
    assert json.loads('"' + escaped[0] + '"') == rows[0].rehydrated
    found = V.reverse_lookup(df.select("session_id").withColumn("placeholder", F.lit("[E_1]")), book).collect()
    assert {r.session_id: r.original for r in found} == {"s": 'a"b\\c$1\nd', "t": None}


# --- event streams ------------------------------------------------------------

NAMES = {"[EMAIL_1]": 'jo"e@x.org', "[EMAIL_12]": "z\\z@x.org"}


def delta(text, shape):
    return "data: " + json.dumps({
        "anthropic": {"type": "content_block_delta", "delta": {"type": "text_delta", "text": text}},
        "thinking": {"delta": {"type": "thinking_delta", "thinking": text}},
        "openai": {"choices": [{"delta": {"content": text}}]},
        "gemini": {"candidates": [{"content": {"parts": [{"text": text}]}}]},
    }[shape])


def spoken(body):
    out = ""
    for line in body.split("\n"):
        if line.startswith("data: {"):
            e = json.loads(line[6:])
            d = e.get("delta") or {}
            if "choices" in e:
                d = {"text": e["choices"][0]["delta"]["content"]}
            if "candidates" in e:
                d = e["candidates"][0]["content"]["parts"][0]
            out += d.get("text", d.get("thinking", ""))
    return out


BODIES = [
    "\n\n".join([delta("hi [EMA", "anthropic"), delta("IL_1] and [", "anthropic"), delta("EMAIL_12] é", "anthropic"), "data: [DONE]", ""]),
    "\n\n".join([delta("to [EMAIL_1", "openai"), delta("2]!", "openai"), delta(" [unknown_1] [x", "openai")]),
    "\n".join([delta("[EMAIL", "anthropic"), "event: ping", delta("_1]", "anthropic"), ""]),
    "\n".join([delta('say "[EMAIL_1]"\n', "gemini"), 'data: {"usage":1}', delta("[EMAIL_1]", "thinking"), "", ""]),
    "\n".join([": comment", delta("plain \\ text", "openai"), ""]),
]
EXPECTED = [
    'hi jo"e@x.org and z\\z@x.org é', "to z\\z@x.org! [unknown_1] [x", "[EMAIL_1]", 'say "jo"e@x.org"\njo"e@x.org', "plain \\ text",
]


def streams(spark):
    df = spark.createDataFrame([(i, "s", b) for i, b in enumerate(BODIES)], "k long, session_id string, response_body string")
    book = spark.createDataFrame([("s", p, o) for p, o in NAMES.items()], "session_id string, placeholder string, original string")
    return df, book


def test_batch_streams(spark):
    df, book = streams(spark)
    rows = V.rehydrate_streams(df, book, "k").orderBy("k").collect()
    assert [spoken(r.rehydrated) for r in rows] == EXPECTED
    assert [r.rehydrated.count("\n") for r in rows] == [b.count("\n") for b in BODIES]
    assert rows[4].rehydrated == BODIES[4] and rows[2].rehydrated == BODIES[2]
    answers = V.sse_text(df, "response_body", ["k"]).orderBy("k").collect()
    assert [a.answer for a in answers] == [spoken(b) for b in BODIES]


def test_chunked_streams_equal_the_batch_whatever_the_cut(spark, tmp_path):
    df, book = streams(spark)
    batch = {r.k: r.rehydrated for r in V.rehydrate_streams(df, book, "k").collect()}
    rng = random.Random(3)
    rows = []
    for cut in range(3):
        for k, body in enumerate(BODIES):
            stream = f"{cut}-{k}"
            rows += [(stream, 0, "name", p, o) for p, o in NAMES.items()]
            seq = 1
            while body:
                n = rng.randint(1, (1, 7, 200)[cut])
                rows.append((stream, seq, "chunk", None, body[:n]))
                body, seq = body[n:], seq + 1
            rows.append((stream, seq, "end", None, None))
    chunks = spark.createDataFrame(rows, "stream_id string, seq long, kind string, placeholder string, payload string")
    # Two files arrive one after the other: state carries over between micro-batches.
    source = str(tmp_path / "in")
    chunks.filter("seq <= 3").coalesce(1).write.mode("append").parquet(source)
    chunks.filter("seq > 3").coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = _with_rocksdb(spark, lambda: _collected(spark, rehydrate_chunks(arriving), "test")).collect()
    joined = {}
    for r in sorted(out, key=lambda r: r.seq):
        joined.setdefault(r.stream_id, []).append(r.text)
    for stream, pieces in joined.items():
        text = "\n".join(pieces)
        assert spoken(text) == spoken(batch[int(stream[-1])]), stream
        assert text.count("\n") == batch[int(stream[-1])].count("\n"), stream


def test_streaming_names_match_the_batch_dictionary(spark, tmp_path):
    table(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(table(spark).schema).parquet(str(tmp_path / "in"))
    done = _with_rocksdb(spark, lambda: _collected(spark, pseudonymise_stream(arriving, preset("pii"), "row_id", idle_minutes=None), "test"))
    batch, _ = V.pseudonymise(table(spark), preset("pii"), key="row_id")
    assert {r.row_key: r.pseudonymised for r in done.collect()} == {r.row_id: r.pseudonymised for r in batch.collect()}
