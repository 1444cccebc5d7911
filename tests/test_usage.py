import json

from pyspark.sql import functions as F

from tracewarden.operators import tokens as T
from tracewarden.operators import usage as U


def sse(*events):
    return "\n".join("data: " + (e if isinstance(e, str) else json.dumps(e)) for e in events) + "\n"


# body, (input, output, cache read, cache write, thinking), model, reasons, stream
CASES = [
    (json.dumps({"model": "m", "usage": {"prompt_tokens": 100, "completion_tokens": 50, "prompt_tokens_details": {"cached_tokens": 30}, "completion_tokens_details": {"reasoning_tokens": 12}}, "choices": [{"finish_reason": "stop"}, {"finish_reason": None}, {"finish_reason": "length"}]}), (100, 50, 30, 0, 12), "m", ["stop", "length"], False),
    (json.dumps({"usage": {"input_tokens": 200, "output_tokens": 100, "cache_read_input_tokens": 50, "cache_creation_input_tokens": 25}, "stop_reason": "end_turn"}), (200, 100, 50, 25, 0), None, ["end_turn"], False),
    (json.dumps({"usageMetadata": {"promptTokenCount": 300, "candidatesTokenCount": 60, "cachedContentTokenCount": 100, "thoughtsTokenCount": 7}, "modelVersion": "g"}), (200, 60, 100, 0, 7), "g", [], False),
    (json.dumps({"response": {"usageMetadata": {"promptTokenCount": 100, "totalTokenCount": 160, "cachedContentTokenCount": 120}, "modelVersion": "w", "candidates": [{"finishReason": "STOP"}]}}), (0, 60, 120, 0, 0), "w", ["STOP"], False),
    (json.dumps({"usage": {"input_tokens": "5", "output_tokens": 0, "completion_tokens": 3}}), (0, 3, 0, 0, 0), None, [], False),
    (sse({"type": "message_start", "message": {"model": "c", "usage": {"input_tokens": 100, "cache_read_input_tokens": 50, "output_tokens": 1}}}, {"type": "message_delta", "delta": {"stop_reason": "end_turn"}, "usage": {"output_tokens": 75}}, "[DONE]"), (100, 75, 50, 0, 0), "c", ["end_turn"], True),
    (sse({"type": "response.created", "response": {"model": "r"}}, {"type": "response.completed", "response": {"model": "r", "usage": {"input_tokens": 6968, "output_tokens": 406, "output_tokens_details": {"reasoning_tokens": 384}}}}), (6968, 406, 0, 0, 384), "r", [], True),
    (sse({"response": {"usageMetadata": {"promptTokenCount": 28393, "candidatesTokenCount": 4, "cachedContentTokenCount": 18000}, "modelVersion": "g2"}}), (10393, 4, 18000, 0, 0), "g2", [], True),
    ("event: x\ndata:" + json.dumps({"usage": {"prompt_tokens": 100, "completion_tokens": 12}, "model": "o"}) + "\ndata: nonsense\ndata: [1]\n", (100, 12, 0, 0, 0), "o", [], True),
    (json.dumps({"streaming": True, "chunks": sse({"usage": {"prompt_tokens": 4}})}), (4, 0, 0, 0, 0), None, [], True),
    ("not json", (0, 0, 0, 0, 0), None, [], False),
    ("[1]", (0, 0, 0, 0, 0), None, [], False),
    (None, (0, 0, 0, 0, 0), None, [], False),
]


def test_usage_of_all_body_shapes(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, response_body string")
    rows = U.usage_ledger(df).orderBy("i").collect()
    got = [(tuple(r[c] for c in U.COUNTS), r.model, r.finish_reasons, r.stream or False) for r in rows]
    assert got == [c[1:] for c in CASES]


def test_provider_strict_streams(spark):
    chat = sse({"usage": {"prompt_tokens": 9}}, {"choices": [{"finish_reason": "stop"}], "usage": {"prompt_tokens": 5, "completion_tokens": 2}})
    claude = sse({"type": "message_start", "message": {"model": "c", "usage": {"input_tokens": 3}}}, {"type": "message_delta", "delta": {}, "usage": {"output_tokens": 0}})
    df = spark.createDataFrame(
        [(0, "openai", chat), (1, "anthropic", chat), (2, "vertex", chat), (3, "anthropic", claude), (4, "gemini", chat)],
        "i int, provider string, response_body string")
    rows = U.provider_stream_usage(df).orderBy("i").collect()
    assert [(r.i, r.input_tokens, r.output_tokens, r.model, r.finish_reasons) for r in rows] == [
        (0, 5, 2, None, ["stop"]), (3, 3, 0, "c", [])]


def test_response_ids(spark):
    bodies = ['{"id":"resp_123"}', '{"response_id":"resp_456"}', sse({"type": "response.created", "response": {"id": "resp_789"}}),
              json.dumps({"streaming": True, "chunks": sse({"type": "response.completed", "id": 7})}), '{"id":""}', "x"]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, response_body string")
    got = [r.response_id for r in U.response_index(df).orderBy("i").collect()]
    assert got == ["resp_123", "resp_456", "resp_789", "7", None, None]


def test_costs_and_limits(spark):
    rows = [("claude-sonnet-4-20250514", 1000, 500, 0, 0), ("claude-sonnet-4-20250514", 1000, 500, 100, 50), ("gpt-4o-mini-x", 1000, 500, 99, 0),
            ("who", 1, 1, 0, 0), ("openai/gpt-5.2-pro", 1, 0, 0, 0), ("claude-opus-4-6-20251101", 1, 0, 0, 0), ("minimax-m2.5-fast", 1000, 0, 0, 0)]
    df = spark.createDataFrame(rows, "model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long").withColumn("thinking_tokens", F.lit(0))
    got = [(r.model_key, r.cost_usd, r.context_limit) for r in U.cost_ledger(df).collect()]
    assert got == [("claude-sonnet-4", 0.0105, 1000000), ("claude-sonnet-4", 0.010718, 1000000), ("gpt-4o-mini", 0.00045, 128000),
                   (None, None, 128000), ("gpt-5.2-pro", 0.000021, 272000), ("claude-opus-4.6", 0.000005, 1000000), ("minimax-m2.5", 0.0008, 1000000)]
    table = U.model_table(spark)
    named = {r.model: r.key for r in U.resolve_models(df, table).collect()}
    assert named == {m[0]: g[0] for m, g in zip(rows, got)}


def test_json_tokens_and_images(spark):
    image = {"type": "image", "source": {"data": "A" * 5000}}
    values = [image, [{"type": "text", "text": "hello"}, image], {"type": "tool_result", "content": [image, image]},
              {"parts": [{"inlineData": {"data": "A" * 99}}, {"text": "x"}]}, "abcde", None, [],
              [[image]], {"content": [image]}]
    df = spark.createDataFrame([(i, json.dumps(v, separators=(",", ":"))) for i, v in enumerate(values)], "i int, b string")
    got = [tuple(r) for r in df.select(T.image_count(F.try_parse_json("b")), T.json_tokens(F.try_parse_json("b"))).orderBy("i").collect()]
    strip = {"type": "image", "_image": True}
    size = lambda v: -(-len(json.dumps(v, separators=(",", ":"))) // 4)
    assert got == [
        (1, 1600), (1, size([{"type": "text", "text": "hello"}, strip]) + 1600), (2, size({"type": "tool_result", "content": [strip, strip]}) + 3200),
        (1, size({"parts": [strip, {"text": "x"}]}) + 1600), (0, 2), (0, 0), (0, 1), (1, size([[strip]]) + 1600), (0, size(values[-1]))]


def test_images_are_found_at_any_depth(spark):
    def nested(n, value):
        for _ in range(n):
            value = [{"type": "tool_result", "content": [value, {"type": "text", "text": "t"}]}]
        return value

    image = {"type": "image", "source": {"data": "A" * 5000}}
    depths = [0, 1, 4, 5, 12, 40]
    df = spark.createDataFrame([(n, json.dumps(nested(n, image), separators=(",", ":"))) for n in depths], "n int, b string")
    rows = df.select("n", T.image_count(F.try_parse_json("b")).alias("i"), T.json_tokens(F.try_parse_json("b")).alias("t")).collect()
    strip = {"type": "image", "_image": True}
    for r in rows:
        text = len(json.dumps(nested(r.n, strip), separators=(",", ":")))
        assert (r.i, r.t) == (1, 1600 + (-(-text // 4) if r.n else 0))
