"""Structured Streaming: ingest with touched-key recomputation, change feed, metric rollup, whole-run sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from eventloom.operators import baselines
from eventloom.operators.insights import GAP_SECONDS
from eventloom.operators.lifecycle import COOLDOWN_SECONDS
from eventloom.operators.projections import PROVENANCE, TERMINAL
from eventloom.operators.sampling import IDLE_SECONDS
from eventloom.schema import present
from eventloom.streaming.store import KEYS as KEYS
from eventloom.streaming.store import Store as Store

FEED_BYTES, WAITING = 7000, 10_000


def start(stream: DataFrame, store: Store, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    return stream.writeStream.foreachBatch(write or store.ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_feed(runs: DataFrame, episodes: DataFrame, incidents: DataFrame) -> DataFrame:
    """STR-4: one notice for each changed row; a long one says only that it is time to look."""

    def notice(kind: str, df: DataFrame, key: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("body"), F.col(key).alias("key"))

    rows = notice("run.changed", runs, "run_id").union(notice("insight.opened", episodes.where("state = 'open'"), "insight_id"))
    rows = rows.union(notice("incident.updated", incidents, "first_event"))
    long = F.octet_length("body") > FEED_BYTES
    return rows.select(F.when(long, "refresh").otherwise(F.col("kind")).alias("kind"), "key", F.when(long, F.lit(None)).otherwise(F.col("body")).alias("body"))


def metric_rollup(stream: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """STR-5: tumbling minutes of metric samples, put out once their time is over, with the columns of the batch's summaries."""
    rows = stream.where(F.col("event").startswith("metric.")).where("value IS NOT NULL").withColumn("at", F.col("observed_at").cast("timestamp")).withWatermark("at", lateness)
    return baselines.summarised(rows.groupBy(F.window("at", "60 seconds").alias("w"), *baselines.series(rows)))


class TailSampler(StatefulProcessor):
    """STR-6: a run's events wait for its terminal event; they go out if it failed or was slow, or once the run has been idle for an hour.

    More than WAITING events go out at once. A verdict holds for late events until the run has been idle for that long too.
    """

    def __init__(self, slow_ms: float):
        self.slow_ms = slow_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id string")
        self.count = handle.getValueState("count", "n long")
        self.verdict = handle.getValueState("verdict", "keep boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for df in rows:
            end = df[df["event"].isin(TERMINAL) & (df["outcome"] != "unknown")].sort_values(["at", "event_id"])
            if len(end):
                last = end.iloc[-1]
                self.verdict.update((bool(last["outcome"] == "failure" or (last["duration_ms"] or 0) >= self.slow_ms),))
            self.waiting.appendList([(e,) for e in df["event_id"]])
            self.count.update(((self.count.get()[0] if self.count.exists() else 0) + len(df),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + IDLE_SECONDS * 1000)
        if self.verdict.exists():
            yield from self.release(key, self.verdict.get()[0])
        elif self.count.exists() and self.count.get()[0] > WAITING:
            yield from self.release(key, True)

    def release(self, key: tuple, keep: bool) -> Iterator[pd.DataFrame]:
        ids = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        self.count.clear()
        if keep and ids:
            yield pd.DataFrame({"run_id": [key[0]] * len(ids), "event_id": ids})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        keep = self.verdict.get()[0] if self.verdict.exists() else True
        self.verdict.clear()
        yield from self.release(key, keep)

    def close(self) -> None:
        pass


def tail_sampled(stream: DataFrame, slow_ms: float, lateness: str = "10 minutes") -> DataFrame:
    """STR-6: run_id, event_id of the events that stay. Those without a run have no run to wait for and go straight through."""
    at = F.col("observed_at").cast("timestamp").alias("at")
    rows = stream.where(present("run_id").isNotNull()).select("run_id", "event_id", "event", "outcome", "duration_ms", at).withWatermark("at", lateness)
    kept = rows.groupBy("run_id").transformWithStateInPandas(TailSampler(slow_ms), "run_id string, event_id string", outputMode="Append", timeMode="EventTime")
    return kept.union(stream.where(present("run_id").isNull()).select("run_id", "event_id"))


class Cooldown(StatefulProcessor):
    """RULE-11: what was sent last for a key is kept until the cooldown is over, then the key has no state."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        at = sorted(x for df in rows for x in df["at"])
        last, sent = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None, []
        for x in at:
            sent.append(last is None or (x - last).total_seconds() >= self.seconds)
            last = x if sent[-1] else last
        if any(sent):
            self.last.update((last.to_pydatetime(),))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.seconds * 1000)
        yield pd.DataFrame({"key": [key[0]] * len(at), "at": at, "sent": sent})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def alert_stream(stream: DataFrame, cooldown: int = COOLDOWN_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """RULE-11: rows(key, at) -> key, at, sent, as lifecycle.alerts gives them for rows that arrive in order.

    A row that is older than the last one sent is not sent. State goes when the watermark passes the cooldown's end.
    """
    rows = stream.where("at IS NOT NULL").select("key", F.col("at").cast("timestamp").alias("at")).withWatermark("at", lateness)
    return rows.groupBy("key").transformWithStateInPandas(Cooldown(cooldown), "key string, at timestamp, sent boolean", outputMode="Append", timeMode="EventTime")


def incident_stream(findings: DataFrame, gap: int = GAP_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """RULE-8, WIN-2: incidents of a stream of findings, each put out once no finding can join it any more.

    A session takes in what is at most gap apart, to the millisecond; late findings that bridge two sessions make them one. Its
    findings from the first critical one on are the incident; without one there is none. A session's findings are its state.
    """
    rows = findings.where("severity IN ('error', 'critical')").withColumns({"who": F.coalesce("entity", F.col("event_id")), "at": F.col("observed_at").cast("timestamp")}).withWatermark("at", lateness)
    one = F.struct("observed_at", "event_id", "severity", "summary", "entity")
    out = rows.groupBy(F.session_window("at", f"{gap * 1000 + 1} milliseconds").alias("session"), "who").agg(F.array_sort(F.collect_list(one)).alias("all"))
    first = F.element_at(F.filter("all", lambda x: x["severity"] == "critical"), 1)
    out = out.where(F.exists("all", lambda x: x["severity"] == "critical")).withColumn("first", first)
    since = F.struct("first.observed_at", "first.event_id")
    members = F.filter("all", lambda x: F.struct(x["observed_at"], x["event_id"]) >= since)
    out = out.select("who", members.alias("m"), F.col("first.entity").alias("entity"), F.col("first.summary").alias("title"), F.col("first.observed_at").alias("started_at"), F.col("first.event_id").alias("first_event"))
    ids = F.transform(F.slice("m", 1, PROVENANCE), lambda x: x["event_id"])
    return out.select(
        "who", "entity", "title", "started_at", F.element_at("m", -1)["observed_at"].alias("last_at"), F.size("m").cast("long").alias("members"), "first_event", ids.alias("member_events"), F.lit("critical").alias("severity"),
    )
