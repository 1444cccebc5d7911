"""From raw request and response logs to captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.operators.headers import scrub_headers


def ingest_requests(log: DataFrame, body: str = "body") -> DataFrame:
    """POST requests only, with the body kept when it is JSON and null otherwise."""
    posts = log.filter(F.col("method") == "POST")
    return posts.withColumn(
        "request_body", F.when(F.try_parse_json(F.col(body)).isNotNull(), F.col(body))
    ).withColumn("request_bytes", F.octet_length(body).cast("long")).drop(body)


def timings(start: Column, sent: Column, first: Column, end: Column) -> Column:
    """send, wait, receive and total in whole milliseconds.

    A missing ``sent`` falls back to the first byte for sending and to the start for
    waiting; a missing first byte falls back to the end.
    """
    seen = F.coalesce(first, end)
    whole = lambda x: F.floor(x + F.lit(0.5)).cast("long")
    zero = F.lit(0.0)
    return F.struct(
        whole(F.greatest(zero, F.coalesce(sent, seen) - start)).alias("send_ms"),
        whole(F.greatest(zero, seen - F.coalesce(sent, start))).alias("wait_ms"),
        whole(end - seen).alias("receive_ms"),
        whole(end - start).alias("total_ms"),
    )


def assemble_captures(requests: DataFrame, responses: DataFrame, key: str = "request_id") -> DataFrame:
    """Captures from routed requests and their responses, joined on the request id.

    Request ids are unique on both sides, so the join shuffles evenly.
    """
    return captures_of(requests.join(responses, key))


def captures_of(joined: DataFrame) -> DataFrame:
    """Captures from rows that hold a request and its response, or nulls for one that never came."""
    spent = timings(F.col("start_ms"), F.col("sent_ms"), F.col("first_ms"), F.col("end_ms"))
    return (
        joined.withColumn("_t", spent)
        .withColumns(
            {
                "request_headers": scrub_headers(F.col("request_headers")),
                "response_headers": scrub_headers(F.col("response_headers")),
                "response_bytes": F.octet_length("response_body").cast("long"),
                **{t: F.col(f"_t.{t}") for t in ("send_ms", "wait_ms", "receive_ms", "total_ms")},
            }
        )
        .drop("_t", "start_ms", "sent_ms", "first_ms", "end_ms")
    )
