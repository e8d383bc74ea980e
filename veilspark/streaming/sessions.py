"""Streams: the outbound core on a stream of documents, and sessions with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import Detector
from ..operators.obfuscate import obfuscate
from ..schema import Policy


def obfuscate_stream(docs: DataFrame, keys: DataFrame, policy: Policy | None = None, detector: Detector | None = None) -> DataFrame:
    """:func:`obfuscate` of a streaming table: the same row-local plan, and a join with static keys."""
    out = obfuscate(docs, keys, policy, detector)
    return out.select("session_id", "doc_id", "obfuscated_text", "route_to_human", F.size("entities").alias("entities"))


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of activity per user: (user_id, started, ended, n); ``ended`` is the last event plus
    the gap. Works on streams with a watermark of ``late``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def requests(spark: SparkSession, path: str, task: str = "Summarize this document.") -> DataFrame:
    """A stream of requests from JSON lines {text, task, doc_id}: a missing task is the default, a
    missing doc_id the hash of the line, so a replayed batch has the same ids."""
    rows = spark.readStream.text(path).select("value", F.from_json("value", "text string, task string, doc_id string").alias("r"))
    made = F.concat(F.lit("req_"), F.substring(F.sha2("value", 256), 1, 12))
    return rows.select("r.text", F.coalesce("r.task", F.lit(task)).alias("task"), F.coalesce("r.doc_id", made).alias("doc_id"))


def session_states(requests: DataFrame, ttl_seconds: int = 3600, late: str = "10 minutes", drain_seconds: int = 10) -> DataFrame:
    """(session_id, state, requests) updates of a stream (session_id, ts, and optionally kind): ACTIVE with
    each batch of requests; DRAINING from a row of kind ``drain`` on, after which requests no longer
    count; DESTROYED once the watermark is a time to live past the first request, or
    ``drain_seconds`` past the drain."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n = state.get[0]
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "state": ["DESTROYED"], "requests": [n]})
            return
        n, ends, drains = state.get if state.exists else (0, None, None)
        millis = lambda ts: int(ts.timestamp() * 1000)
        for f in frames:
            stops = f.loc[f["kind"] == "drain", "ts"]
            if len(stops):
                drains = millis(stops.min()) if drains is None else min(drains, millis(stops.min()))
            asked = f[f["kind"] != "drain"]
            n += int((asked["ts"].map(millis) < drains).sum()) if drains is not None else len(asked)
            first = millis(f["ts"].min()) + ttl_seconds * 1000
            ends = first if ends is None else min(ends, first)
        if drains is not None:
            ends = min(ends, drains + drain_seconds * 1000)
        state.update((n, ends, drains))
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": [key[0]], "state": ["ACTIVE" if drains is None else "DRAINING"], "requests": [n]})

    kind = F.coalesce(F.col("kind"), F.lit("request")) if "kind" in requests.columns else F.lit("request")
    rows = requests.withWatermark("ts", late).select("session_id", "ts", kind.alias("kind"))
    return rows.groupBy("session_id").applyInPandasWithState(update, "session_id string, state string, requests long", "n long, ends long, drains long", "update", "EventTimeTimeout")
