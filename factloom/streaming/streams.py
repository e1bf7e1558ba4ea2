"""Structured Streaming over append-only inputs: heartbeats, sticky dedupe, captures, bursts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import candidates
from ..sources.jsonl import transcript_messages


def transcript_stream(spark: SparkSession, folder: str) -> DataFrame:
    """User messages of JSON lines as they are appended; broken lines are dropped."""
    return transcript_messages(spark.readStream.text(folder, recursiveFileLookup=True))


def heartbeats(events: DataFrame, event: str = "event_type", at: str = "ts") -> DataFrame:
    """Invocations and the last time of each event kind (update or complete mode)."""
    return events.groupBy(F.col(event).alias("event")).agg(F.count(F.lit(1)).alias("invocations"), F.max(at).alias("last_at"))


def sticky(candidates: DataFrame, at: str | None = None, horizon: str = "30 days") -> DataFrame:
    """First of each fingerprint; with ``at`` the state is bounded by a watermark of ``horizon``."""
    if at is None:
        return candidates.dropDuplicates(["fingerprint"])
    return candidates.withWatermark(at, horizon).dropDuplicatesWithinWatermark(["fingerprint"])


def captures(messages: DataFrame, threshold: int = X.THRESHOLD) -> DataFrame:
    """Scored clauses of a message stream, under the same rules as those of a batch."""
    rows = candidates.clauses(messages, keep=["session_id"])
    return rows.where(F.col("dropped").isNull() & (F.col("score") >= threshold)).withColumn("fingerprint", X.fingerprint(F.col("unit")))


def dispatched(handlers: dict[str, Callable[[DataFrame], None]], *, event: str = "event", budget_seconds: float = 8.0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each event kind's rows go to its handler, in the order of the handlers, within a
    budget of time. Outcomes are kept in ``outcomes``: ok, error, over budget or ignored; none stops the stream."""
    outcomes: list[tuple[int, str, str]] = []

    def run(batch: DataFrame, number: int) -> None:
        started = time.monotonic()
        kinds = {r[0] for r in batch.select(event).distinct().collect()}  # event kinds are a closed list
        for kind in [*handlers, *sorted(k for k in kinds if k not in handlers and k is not None)]:
            if kind not in kinds:
                continue
            if kind not in handlers:
                outcomes.append((number, kind, "ignored"))
            elif time.monotonic() - started > budget_seconds:
                outcomes.append((number, kind, "over budget"))
            else:
                try:
                    handlers[kind](batch.where(F.col(event) == kind))
                    outcomes.append((number, kind, "ok"))
                except Exception as error:  # an event is never worth the stream
                    outcomes.append((number, kind, f"error: {type(error).__name__}"))

    run.outcomes = outcomes
    return run


def bursts(events: DataFrame, key: str, at: str = "ts", gap: str = "90 seconds", late: str = "10 minutes") -> DataFrame:
    """Debounced events: a session of each key ends after ``gap`` of silence."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, "session_window.*", "n")


def windows(events: DataFrame, kind: str, at: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Event-time windows: an extension, not part of the behaviour that is matched."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n"))
