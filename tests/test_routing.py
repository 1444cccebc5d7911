from pyspark.sql import functions as F

from tracewarden.operators import routing as R
from tracewarden.operators.headers import scrub_headers, trusted_headers

SOURCES = [
    ("/claude/v1/messages", "claude", None, "/v1/messages"),
    ("/claude/a1b2c3d4/v1/messages", "claude", "a1b2c3d4", "/v1/messages"),
    ("/claude/A1B2C3D4/v1/messages", "claude", None, "/A1B2C3D4/v1/messages"),
    ("/claude/a1b2c3d4", "claude", None, "/a1b2c3d4"),
    ("/claude", None, None, "/claude"),
    ("/v1/messages", None, None, "/v1/messages"),
    ("/codex/responses", None, None, "/codex/responses"),
    ("/my%20tool/v1/x", "my tool", None, "/v1/x"),
    ("/a+b/v1/x", "a+b", None, "/v1/x"),
    ("/a%2Fb/v1/x", None, None, "/a%2Fb/v1/x"),
    ("/%2e%2e/v1/x", None, None, "/%2e%2e/v1/x"),
    ("/bad%zz/v1/x", "bad%zz", None, "/v1/x"),
    ("/bad%E9/v1/x", "bad%E9", None, "/v1/x"),
    ("/", None, None, "/"),
]
KINDS = [
    ("/v1/messages", {}, "anthropic", "anthropic-messages"),
    ("/v1/complete", {}, "anthropic", "unknown"),
    ("/x", {"anthropic-version": "1"}, "anthropic", "unknown"),
    ("/x", {"anthropic-version": ""}, "unknown", "unknown"),
    ("/api/x", {}, "chatgpt", "chatgpt-backend"),
    ("/v1/projects/p/locations/l/publishers/google/models/g:generateContent", {}, "vertex", "gemini"),
    ("/v1beta/models/g", {}, "gemini", "gemini"),
    ("/v1/models", {"x-goog-api-key": "k"}, "gemini", "gemini"),
    ("/v1/models", {}, "openai", "unknown"),
    ("/v1/responses", {}, "openai", "responses"),
    ("/v1/chat/completions", {}, "openai", "chat-completions"),
    ("/x", {"authorization": "Bearer sk-1"}, "openai", "unknown"),
    ("/x", {}, "unknown", "unknown"),
]
TARGETS = [
    ("/v1/messages", "?b=1", {}, "https://api.anthropic.com/v1/messages?b=1"),
    ("/codex/responses", None, {}, "https://chatgpt.com/backend-api/codex/responses"),
    ("/api/x", None, {}, "https://chatgpt.com/api/x"),
    ("/responses", None, {}, "https://api.openai.com/v1/responses"),
    ("/what", None, {}, "https://api.openai.com/what"),
    ("/v1internal:x", None, {}, "https://cloudcode-pa.googleapis.com/v1internal:x"),
    ("/v1beta/models/g", None, {}, "https://generativelanguage.googleapis.com/v1beta/models/g"),
    ("/v1/projects/p/locations/eu/publishers/google/models/g", None, {}, "https://eu-aiplatform.googleapis.com/v1/projects/p/locations/eu/publishers/google/models/g"),
    ("/v1/projects/p/locations/global/publishers/google/models/g", None, {}, "https://us-central1-aiplatform.googleapis.com/v1/projects/p/locations/global/publishers/google/models/g"),
    ("/v1/messages", None, {"x-target-url": "https://o.example/z"}, "https://o.example/z"),
    ("/v1/messages", "?q", {"x-target-url": "o.example"}, "o.example/v1/messages?q"),
]


def test_attribution(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(SOURCES)], "i int, path string")
    rows = R.attribute(df).orderBy("i").collect()
    assert [(r.path, r.source, r.session_id, r.clean_path) for r in rows] == SOURCES


def test_classification(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(KINDS)], "i int, clean_path string, headers map<string,string>")
    rows = R.classify(df).orderBy("i").collect()
    assert [(r.clean_path, r.headers, r.provider, r.api_format) for r in rows] == KINDS


def test_targets(spark):
    df = spark.createDataFrame([(i, *c[:3], "::1") for i, c in enumerate(TARGETS)], "i int, path string, query string, headers map<string,string>, peer string")
    # No source tags in these paths: classify and resolve the path as it is.
    kinds = R.classify(df, path="path")
    rows = kinds.withColumn("url", R.target_url(F.col("path"), F.col("query"), F.col("headers"), F.col("provider"))).orderBy("i").collect()
    assert [r.url for r in rows] == [c[3] for c in TARGETS]


def test_headers(spark):
    df = spark.createDataFrame([({"Authorization": "a", "X-API-Key": "b", "accept": "c", "none": None, "x-target-url": "u"}, "10.0.0.1")], "h map<string,string>, p string")
    trust = lambda allow, peer: F.map_contains_key(trusted_headers(F.col("h"), F.lit(peer), allow), "x-target-url")
    row = df.select(scrub_headers(F.col("h")).alias("s"), trust(True, "10.0.0.1").alias("far"), trust(True, "127.0.0.1").alias("near"), trust(False, "127.0.0.1").alias("off")).head()
    assert (row.s, row.far, row.near, row.off) == ({"accept": "c"}, False, True, False)
