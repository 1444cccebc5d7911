"""Composition: request and response transform chains, observers, user rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracewarden.operators.redact import Policy, redact_json
from tracewarden.operators.headers import scrub_table

Transform = Callable[[DataFrame], DataFrame]


def apply_chain(df: DataFrame, *steps: Transform) -> DataFrame:
    """Each transform receives the table that the previous one returned."""
    for step in steps:
        df = df.transform(step)
    return df


def fail_open(column: str, attempt: Callable[[Column], Column], flag: str = "transform_failed") -> Transform:
    """A row-level step that keeps the old value where ``attempt`` yields null, and flags the row.

    ``attempt`` should be built from ``try_*`` functions, which turn a bad row into null.
    """

    def step(df: DataFrame) -> DataFrame:
        old = F.col(column)
        tried = df.withColumn("_tried", attempt(old))
        failed = F.col("_tried").isNull() & old.isNotNull()
        if flag in df.columns:
            failed = failed | F.col(flag)
        return tried.withColumns(
            {column: F.coalesce(F.col("_tried"), old), flag: failed}
        ).drop("_tried")

    return step


@dataclass(frozen=True)
class ResponseStep:
    """One member of a response chain; each part is optional.

    ``body`` changes a buffered response, ``line`` a line of an event stream, and ``end`` adds a
    line once the stream is over. A null result stands for a failure.
    """

    name: str
    body: Callable[[Column], Column] | None = None
    line: Callable[[Column], Column] | None = None
    end: Callable[[Column], Column] | None = None


def response_chain(
    df: DataFrame, steps: Sequence[ResponseStep], body: str = "response_body", streamed: str = "response_is_streaming"
) -> DataFrame:
    """Responses after all steps in order; ``failed_steps`` names those that failed on a row.

    Each step receives what the one before it returned, and a failure keeps that: of a stream the
    line that failed, of a buffered response the whole. Lines stay inside their row, in order, and
    end lines see the stream as it is by then and pass through the later steps.
    """
    stream = F.coalesce(F.col(streamed), F.lit(False))
    out = df.withColumn("failed_steps", F.array().cast("array<string>"))
    out = out.withColumn("_lines", F.when(stream, F.split(F.col(body), "\n")))
    for step in steps:
        failed = F.lit(False)
        if step.body:
            tried = F.when(~stream, step.body(F.col(body)))
            out = out.withColumn("_tried", tried)
            failed = failed | (~stream & F.col("_tried").isNull() & F.col(body).isNotNull())
            out = out.withColumn("_failed", failed).withColumn(body, F.coalesce("_tried", body)).drop("_tried")
            failed = F.col("_failed")
        if step.line:
            out = out.withColumn("_new", F.transform("_lines", step.line))
            failed = failed | F.coalesce(F.exists("_new", lambda x: x.isNull()), F.lit(False))
            kept = F.zip_with("_new", "_lines", lambda new, old: F.coalesce(new, old))
            out = out.withColumn("_now", failed).withColumn("_lines", kept).drop("_new")
            failed = F.col("_now")
        if step.end:
            ended = F.when(stream, step.end(F.col("_lines")))
            out = out.withColumn("_lines", F.when(ended.isNull(), F.col("_lines")).otherwise(F.array_append("_lines", ended)))
        marked = F.when(failed, F.array_append("failed_steps", F.lit(step.name))).otherwise(F.col("failed_steps"))
        out = out.withColumn("failed_steps", marked).drop("_failed", "_now")
    return out.withColumn(body, F.when(stream, F.array_join("_lines", "\n")).otherwise(F.col(body))).drop("_lines")


def redact_bodies(policy: Policy, body: str = "request_body") -> Transform:
    return lambda df: redact_json(df, policy, body)


def redact_then_log(policy: Policy) -> Transform:
    """What a capture sink should see: redacted bodies and scrubbed headers."""
    return lambda df: scrub_table(
        redact_json(df, policy, "request_body"), "request_headers", "response_headers"
    )


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Attach metrics that are filled in while the table is written anyway."""
    observation = Observation(name)
    return df.observe(observation, *[m.alias(n) for n, m in metrics.items()]), observation


def notify(observers: Sequence[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that calls every observer and survives their errors."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        for observer in observers:
            try:
                observer(batch, batch_id)
            except Exception as error:  # an observer never stops the stream
                print(f"observer {getattr(observer, '__name__', observer)!r} failed: {error}")

    return handle
