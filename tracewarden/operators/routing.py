"""Traffic attribution: source and session from paths, provider and format, target URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.text import let
from tracewarden.operators.headers import header, trusted_headers
from tracewarden.rules.routing import API_SEGMENTS, UPSTREAMS

_HEAD = r"^/([^/]+)(/.*)?\z"


def _decoded(segment: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone and keeps malformed input as it is."""
    guarded = F.replace(segment, F.lit("+"), F.lit("%2B"))
    decoded = F.try_url_decode(guarded)
    bad = decoded.isNull() | F.contains(decoded, F.lit("\ufffd")) & ~F.contains(
        F.upper(segment), F.lit("%EF%BF%BD")
    ) & ~F.contains(segment, F.lit("\ufffd"))
    return F.when(bad, segment).otherwise(decoded)


def attribution(path: Column) -> Column:
    """struct<source, session_id, clean_path> of a request path."""
    nothing = F.lit(None).cast("string")
    untagged = F.struct(
        nothing.alias("source"), nothing.alias("session_id"), path.alias("clean_path")
    )

    def tagged(p: Column) -> Column:
        rest = p["rest"]
        session = F.regexp_extract(rest, r"^/([a-f0-9]{8})(/.*)\z", 1)
        return F.when(
            F.contains(p["source"], F.lit("/"))
            | F.contains(p["source"], F.lit("\\"))
            | F.contains(p["source"], F.lit("..")),
            untagged,
        ).otherwise(
            F.struct(
                p["source"].alias("source"),
                F.nullif(session, F.lit("")).alias("session_id"),
                F.when(session == "", rest)
                .otherwise(F.substring(rest, 10, 2147483647))
                .alias("clean_path"),
            )
        )

    segment = F.regexp_extract(path, _HEAD, 1)
    rest = F.regexp_extract(path, _HEAD, 2)
    has_tag = (rest != "") & ~segment.isin(*API_SEGMENTS)
    return F.when(
        has_tag,
        let(F.struct(_decoded(segment).alias("source"), rest.alias("rest")), tagged),
    ).otherwise(untagged)


def classification(path: Column, headers: Column) -> Column:
    """struct<provider, api_format>; the first test that holds decides."""

    def kind(provider: str, api_format: str) -> Column:
        return F.struct(F.lit(provider).alias("provider"), F.lit(api_format).alias("api_format"))

    def has(piece: str) -> Column:
        return F.contains(path, F.lit(piece))

    gemini_path = (
        has(":generateContent")
        | has(":streamGenerateContent")
        | path.rlike(r"/v1(beta|alpha)/models/")
        | has("/v1internal:")
    )
    vertex_path = path.rlike(
        r"/v1[^/]*/projects/[^/]+/locations/[^/]+/publishers/google/models/"
    )
    bearer = F.coalesce(F.startswith(header(headers, "authorization"), F.lit("Bearer sk-")), F.lit(False))
    return (
        F.when(path.rlike(r"^/(api|backend-api|codex)/"), kind("chatgpt", "chatgpt-backend"))
        .when(has("/v1/messages"), kind("anthropic", "anthropic-messages"))
        .when(has("/v1/complete"), kind("anthropic", "unknown"))
        .when(header(headers, "anthropic-version").isNotNull(), kind("anthropic", "unknown"))
        .when(vertex_path, kind("vertex", "gemini"))
        .when(gemini_path | header(headers, "x-goog-api-key").isNotNull(), kind("gemini", "gemini"))
        .when(has("/responses"), kind("openai", "responses"))
        .when(has("/chat/completions"), kind("openai", "chat-completions"))
        .when(path.rlike(r"/(models|embeddings)"), kind("openai", "unknown"))
        .when(bearer, kind("openai", "unknown"))
        .otherwise(kind("unknown", "unknown"))
    )


def target_url(
    path: Column, query: Column, headers: Column, provider: Column, upstreams: dict[str, str] | None = None
) -> Column:
    """The upstream URL of a classified request."""
    up = {**UPSTREAMS, **(upstreams or {})}
    qs = F.coalesce(query, F.lit(""))
    override = header(headers, "x-target-url")
    location = F.regexp_extract(path, r"/locations/([^/]+)/", 1)
    regional = (location != "") & (location != "global")
    to = lambda base, p: F.concat(F.lit(base), p, qs)
    chatgpt_path = F.when(path.rlike(r"^/(api|backend-api)/"), path).otherwise(
        F.concat(F.lit("/backend-api"), path)
    )
    resolved = (
        F.when(provider == "chatgpt", to(up["chatgpt"], chatgpt_path))
        .when(provider == "anthropic", to(up["anthropic"], path))
        .when(
            (provider == "gemini") & F.contains(path, F.lit("/v1internal")),
            to(up["gemini_code_assist"], path),
        )
        .when(provider == "gemini", to(up["gemini"], path))
        .when(
            (provider == "vertex") & regional,
            F.concat(F.lit("https://"), location, F.lit("-aiplatform.googleapis.com"), path, qs),
        )
        .when(provider == "vertex", to(up["vertex"], path))
        .when(path == "/responses", to(up["openai"], F.lit("/v1/responses")))
        .otherwise(to(up["openai"], path))
    )
    return (
        F.when(override.isNull(), resolved)
        .when(F.startswith(override, F.lit("http")), override)
        .otherwise(F.concat(override, path, qs))
    )


def attribute(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds source, session_id and clean_path."""
    got = attribution(F.col(path))
    return (
        df.withColumn("_a", got)
        .withColumns({f: F.col(f"_a.{f}") for f in ("source", "session_id", "clean_path")})
        .drop("_a")
    )


def classify(df: DataFrame, path: str = "clean_path", headers: str = "headers") -> DataFrame:
    """Adds provider and api_format."""
    got = classification(F.col(path), F.col(headers))
    return (
        df.withColumn("_c", got)
        .withColumns({f: F.col(f"_c.{f}") for f in ("provider", "api_format")})
        .drop("_c")
    )


def route(
    df: DataFrame,
    path: str = "path",
    query: str = "query",
    headers: str = "headers",
    peer: str = "peer",
    allow_override: bool = False,
    upstreams: dict[str, str] | None = None,
) -> DataFrame:
    """Source, session, provider, format and target of every logged request."""
    tagged = attribute(df, path).withColumn(
        "_trusted", trusted_headers(F.col(headers), F.col(peer), allow_override)
    )
    return (
        classify(tagged, headers="_trusted")
        .withColumn(
            "target_url",
            target_url(
                F.col("clean_path"), F.col(query), F.col("_trusted"), F.col("provider"), upstreams
            ),
        )
        .drop("_trusted")
    )


def traffic_by_provider(classified: DataFrame) -> DataFrame:
    return classified.groupBy("provider", "api_format").agg(F.count("*").alias("requests"))
