"""Live assembly, response chains, keyed tables and spread dictionaries, over several runs of a query."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewarden.operators.redact import compile_policy
from tracewarden.operators.transforms import response_chain
from tracewarden.plans.queries import RESPONSE_STEPS, STREAM_STEPS, _with_rocksdb
from tracewarden.streaming.assembly import assemble_stream, first_responses
from tracewarden.streaming.chain import Liner, StreamStep, chain_bodies, chain_lines
from tracewarden.streaming.live import ChangeTable, run_changes
from tracewarden.streaming.pseudonymise import pseudonymise_spread


def runs(spark, folder, tables, build):
    """Output of a query that starts anew for every batch of rows; ``tables`` maps names to (schema, batches)."""
    out = None
    for i in range(max(len(batches) for _, batches in tables.values())):
        streams = {}
        for name, (schema, batches) in tables.items():
            if i < len(batches):
                spark.createDataFrame(batches[i], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
            streams[name] = spark.readStream.schema(schema).parquet(f"{folder}/{name}")
        out = build(streams)
        (
            out.writeStream.format("parquet")
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/check")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


ASKED = "request_id long, request_headers map<string,string>, start_ms double, sent_ms double"
ANSWERED = "request_id long, response_headers map<string,string>, response_body string, first_ms double, end_ms double"


def test_requests_meet_responses_in_any_order(spark, tmp_path):
    minute = 60_000.0
    ask = lambda i, at: (i, {"Cookie": "c", "a": "b"}, at * minute, None)
    answer = lambda i, at: (i, {"s": "t"}, "body", None, at * minute)
    asked = [[ask(1, 10), ask(2, 11)], [ask(3, 12)], [ask(99, 300)], [ask(98, 600)]]
    answered = [[answer(3, 13), answer(7, 12)], [answer(1, 11)], [answer(97, 300)], [answer(96, 600)]]
    tables = {"asked": (ASKED, asked), "answered": (ANSWERED, answered)}
    got = runs(
        spark, str(tmp_path), tables, lambda s: assemble_stream(s["asked"], s["answered"], lateness="20 minutes", patience="30 minutes")
    )
    rows = {r.request_id: r for r in got if r.request_id < 90}
    assert len(rows) == len([r for r in got if r.request_id < 90])
    assert {i: r.response_body for i, r in rows.items()} == {1: "body", 2: None, 3: "body"}
    assert (rows[1].total_ms, rows[2].total_ms, rows[2].send_ms) == (60_000, None, None)
    assert rows[2].request_headers == {"a": "b"}


def test_each_response_id_comes_once(spark, tmp_path):
    body = lambda i: '{"id":"r%d"}' % i
    schema = "k long, response_body string, at long"
    batches = [[(1, body(1), 100), (2, body(1), 101), (3, None, 102), (4, "{}", 103)], [(5, body(1), 104), (6, body(2), 105), (3, None, 102)]]
    got = runs(
        spark, str(tmp_path), {"in": (schema, batches)},
        lambda s: first_responses(s["in"].withColumn("at", F.timestamp_seconds("at")), "k", "at", within="1 hour"),
    )
    assert sorted((r.response_id or "", r.k) for r in got if r.k > 2) == [("", 3), ("", 4), ("r2", 6)]
    assert [r.response_id for r in got if r.k <= 2] == ["r1"]


BODIES = ['data: {"text":"a"}\n\ndata: {broken\nlast', "", "\n", 'one\n"text":"x"\n', "no newline " * 40]
CHUNKS = "stream_id string, seq long, kind string, payload string"


def test_chain_equals_the_batch_for_every_cut(spark, tmp_path):
    """Chunks of all sizes, out of order, some twice, over three runs of the query."""
    rng = random.Random(2)
    rows = []
    for cut in range(4):
        for k, body in enumerate(BODIES):
            pieces, at = [], 0
            while at < len(body):
                n = rng.randint(1, (1, 3, 40, 1000)[cut])
                pieces.append(body[at : at + n])
                at += n
            stream = f"{cut}-{k}"
            rows += [(stream, i, "chunk", p) for i, p in enumerate(pieces)] + [(stream, len(pieces), "end", None)]
    rng.shuffle(rows)
    third = len(rows) // 3
    batches = [rows[:third], rows[third : 2 * third] + rows[:20], rows[2 * third :] + rows[:20]]
    got = _with_rocksdb(
        spark, lambda: runs(spark, str(tmp_path), {"in": (CHUNKS, batches)}, lambda s: chain_lines(s["in"], STREAM_STEPS))
    )
    lines = spark.createDataFrame(got)
    done = {r.stream_id: (r.body, r.failed_steps) for r in chain_bodies(lines, STREAM_STEPS).collect()}
    whole = spark.createDataFrame([(i, b, True) for i, b in enumerate(BODIES)], "i int, response_body string, response_is_streaming boolean")
    batch = {r.i: (r.response_body, r.failed_steps) for r in response_chain(whole, RESPONSE_STEPS).collect()}
    assert done == {f"{cut}-{k}": batch[k] for cut in range(4) for k in range(len(BODIES))}


class Calls:
    """A state handle that counts how often it is asked."""

    def __init__(self):
        self.n, self.value, self.map = 0, None, {}

    def getValueState(self, *_):
        return self.Value(self)

    def getMapState(self, *_):
        return self.Map(self)

    class Value:
        def __init__(self, calls):
            self.calls = calls

        def get(self):
            self.calls.n += 1
            return self.calls.value

        def exists(self):
            return self.get() is not None

        def update(self, value):
            self.calls.n, self.calls.value = self.calls.n + 1, value

    class Map:
        def __init__(self, calls):
            self.calls = calls

        def getValue(self, key):
            self.calls.n += 1
            return self.calls.map.get(key)

        def containsKey(self, key):
            return self.getValue(key) is not None

        def updateValue(self, key, value):
            self.calls.n += 1
            self.calls.map[key] = value

        def removeKey(self, key):
            self.calls.n += 1
            del self.calls.map[key]


@pytest.mark.parametrize("seed", range(5))
def test_waiting_chunks_share_entries_of_the_state(seed):
    n, rng, calls = 1000, random.Random(seed), Calls()
    body = "".join(rng.choice("ab\n") for _ in range(n))
    chunks = [(i, "chunk", c) for i, c in enumerate(body)] + [(n, "end", None)]
    rng.shuffle(chunks)
    liner, out = Liner(None), []
    liner.init(calls)
    for at in range(0, n + 1, 300):
        batch = chunks[at : at + 300] + chunks[: at // 30]
        frame = pd.DataFrame(batch, columns=["seq", "kind", "payload"])
        for lines in liner.handleInputRows(("s",), iter([frame]), None):
            out += list(zip(lines["line_no"], lines["kind"], lines["text"], strict=True))
    whole = body.split("\n")
    assert out == [*((i, "line", t) for i, t in enumerate(whole)), (len(whole), "end", None)]
    assert calls.map == {} and calls.n < n / 5


def test_steps_that_fail_keep_the_stream(spark, tmp_path):
    def bad_end(known):
        raise ValueError("no")

    steps = (
        StreamStep("sees", start=[], see=lambda known, line: [*known, int(line)], end=lambda known: str(sum(known))),
        StreamStep("ends", start=0, end=bad_end),
        StreamStep("drops", line=lambda x: F.when(x != "3", x)),
    )
    rows = [("s", 0, "chunk", "1\nx\n3"), ("s", 1, "end", None), ("open", 0, "chunk", "1\n")]
    got = _with_rocksdb(spark, lambda: runs(spark, str(tmp_path), {"in": (CHUNKS, [rows])}, lambda s: chain_lines(s["in"], steps)))
    (done,) = chain_bodies(spark.createDataFrame(got), steps).collect()
    assert (done.stream_id, done.body, done.failed_steps) == ("s", "1\nx\n3\n4", ["sees", "ends", "drops"])


def test_change_table_writes_what_changed(spark, tmp_path):
    schema = "k string, n long"
    folder, source = str(tmp_path / "t"), str(tmp_path / "in")
    table = None
    for batch in ([("a", 1), ("b", 2)], [("a", 5)], [("c", 1), ("a", 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        sums = spark.readStream.schema(schema).parquet(source).groupBy("k").agg(F.sum("n").alias("n"))
        table = ChangeTable(folder, ["k"], sums.schema)
        run_changes(sums, table)
    written = [sorted(r.k for r in spark.read.parquet(f"{folder}/changes/{i}").collect()) for i in range(3)]
    assert written == [["a", "b"], ["a"], ["a", "c"]]
    expected = {"a": 7, "b": 2, "c": 1}
    assert {r.k: r.n for r in table.current(spark).collect()} == expected
    for _ in range(2):
        table.compact(spark)
        assert os.listdir(f"{folder}/folded") == ["2"] and os.listdir(f"{folder}/changes") == []
        assert {r.k: r.n for r in table.current(spark).collect()} == expected
    spark.createDataFrame([("b", 10)], schema).coalesce(1).write.mode("append").parquet(source)
    run_changes(spark.readStream.schema(schema).parquet(source).groupBy("k").agg(F.sum("n").alias("n")), table)
    assert {r.k: r.n for r in table.current(spark).collect()} == {**expected, "b": 12}
    assert ChangeTable(str(tmp_path / "none"), ["k"], sums.schema).current(spark).collect() == []


@pytest.mark.parametrize("slices", [1, 8])
def test_a_spread_dictionary_names_each_original_once(spark, tmp_path, slices):
    policy = compile_policy({"rules": [{"id": "word", "pattern": r"\bw\d+\b", "replacement": "[W]"}, {"id": "num", "pattern": r"\b\d+\b", "replacement": "[N]"}]})
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "s1"]), " ".join(rng.choice(["w1", "w2", "w77", "12", "x"]) for _ in range(i % 7))) for i in range(60)]
    schema = "id long, session_id string, text string"
    got = _with_rocksdb(
        spark,
        lambda: runs(
            spark, str(tmp_path), {"in": (schema, [rows[:30], rows[30:]])}, lambda s: pseudonymise_spread(s["in"], policy, "id", slices=slices)
        ),
    )
    assert sorted(r.row_key for r in got) == list(range(60))
    texts = {i: t for i, _, t in rows}
    known: dict[tuple[str, str], str] = {}
    for r in got:
        assert r.session_id == (rows[r.row_key][1] or "__default__")
        for word, name in zip(texts[r.row_key].split(), r.pseudonymised.split(), strict=True):
            label = {"w": "WORD", "x": None}.get(word[0], "NUM")
            assert name == word if label is None else name.startswith(f"[{label}_")
            assert known.setdefault((r.session_id, word), name) == name
    for session in ("__default__", "s1"):
        names = [n for (s, w), n in known.items() if s == session and w != "x"]
        assert len(names) == len(set(names)) == 4
