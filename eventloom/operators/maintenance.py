"""Rebuilds, gaps, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators import baselines, insights, lifecycle, projections
from eventloom.schema import present

EVENT_DAYS, RUN_DAYS = 90, 365
TERMINAL_STATES = ("resolved", "suppressed", "expired")


def rebuild(ev: DataFrame) -> dict[str, DataFrame]:
    """STR-7: every projection from the whole log."""
    found = insights.findings(ev)
    return {
        "runs": projections.runs(ev), "entities": projections.entities(ev), "relationships": projections.relationships(ev), "assets": projections.assets(ev),
        "baselines": baselines.baselines(baselines.observations(ev)), "insights": insights.episodes(found, ev), "incidents": insights.incidents(found),
    }


def touched_assets(ev: DataFrame, runs: DataFrame) -> DataFrame:
    """JOIN-14, STR-8: assets of the given runs, derived again from all their events."""
    keys = ev.join(runs.select("run_id"), "run_id", "left_semi").where(present("asset_key").isNotNull()).select(F.concat(F.lit("asset://"), "asset_key").alias("entity_id")).distinct()
    # Assets are folded before the shuffle; their events would not be.
    return projections.assets(ev).join(keys, "entity_id", "left_semi")


def reprocess(ev: DataFrame, since: str, until: str) -> DataFrame:
    """STR-9: entities seen in a window of arrival, derived again from all their events."""
    window = ev.where(F.col("received_at").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")))
    keys = projections.with_entities(window).select("entity_id").distinct()
    rows = projections.with_entities(ev).join(keys, "entity_id", "left_semi")
    return rows.groupBy("entity_id").agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count("*").alias("sightings"))


def gap_status(gaps: DataFrame) -> DataFrame:
    """AGG-15: gaps(failure_id, occurred_at, event_ids) -> number, events behind, the oldest, status."""
    out = gaps.agg(F.count("*").alias("gaps"), F.coalesce(F.sum(F.size("event_ids")), F.lit(0)).alias("events"), F.min("occurred_at").alias("oldest"))
    return out.withColumn("status", F.when(F.col("gaps") > 0, "degraded").otherwise("current"))


def lost_evidence(gaps: DataFrame, ev: DataFrame) -> DataFrame:
    """JOIN-15, STR-10: events that a gap names and the log lacks; any blocks a repair."""
    return gaps.select("failure_id", F.explode("event_ids").alias("event_id")).join(ev.select("event_id"), "event_id", "left_anti")


def repaired(gaps: DataFrame, ev: DataFrame) -> DataFrame:
    """STR-10: the gaps that a rebuild clears: those whose events are all there."""
    return gaps.join(lost_evidence(gaps, ev).select("failure_id").distinct(), "failure_id", "left_anti")


def retained(ev: DataFrame, as_of: Column, days: int = EVENT_DAYS, by: str = "received_at") -> Column:
    """STR-11: whether a row is younger than so many days."""
    return F.col(by) > F.timestamp_add("DAY", F.lit(-days), as_of)


#: STR-11: by table the time that counts, the days that a row stays after it, and the states that may go (none: any).
POLICY = {
    "raw": ("expires_at", 0, None), "events": ("received_at", EVENT_DAYS, None), "runs": ("updated_at", RUN_DAYS, None),
    "insights": ("last_observed_at", RUN_DAYS, TERMINAL_STATES), "incidents": ("last_at", RUN_DAYS, ("resolved", "suppressed")),
    "journal": ("at", RUN_DAYS, None), "quarantine": ("received_at", RUN_DAYS, None), "analyses": ("created_at", RUN_DAYS, None),
}


def retention(tables: dict[str, DataFrame], as_of: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """STR-11: what stays of each table, and the rows by table that go and stay. A row without the time that counts stays, and so does an open one.

    Decisions on insights and incidents that stay do so too, however old.
    """
    judged = {}
    for name, df in tables.items():
        by, days, states = POLICY[name]
        stays = F.coalesce(retained(df, as_of, days, by), F.lit(True))
        judged[name] = df.withColumn("_stays", stays if states is None else ~F.col("state").isin(*states) | stays)
    if "journal" in judged:
        open_ids = [judged[t].where("_stays").select(F.col(k).alias("target")) for t, k in (("insights", "insight_id"), ("incidents", "first_event")) if t in judged]
        for ids in open_ids:
            ids = ids.distinct().withColumn("_open", F.lit(True))
            judged["journal"] = judged["journal"].join(ids, "target", "left").withColumn("_stays", F.col("_stays") | F.coalesce("_open", F.lit(False))).drop("_open")
    report = None
    for name, df in judged.items():
        row = df.agg(F.count_if("_stays").alias("stay"), F.count_if(~F.col("_stays")).alias("go")).select(F.lit(name).alias("name"), "stay", "go")
        report = row if report is None else report.union(row)
    return {name: df.where("_stays").drop("_stays") for name, df in judged.items()}, report


def rebuilt_insights(fresh: DataFrame, old: DataFrame, journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STR-7, RULE-10, JOIN-16: insights made again, with the ids and decisions that the old ones had, and the ambiguous matches.

    Where the second result has rows the rebuild must stop. Decided insights whose evidence is gone stay as they were.
    """
    shape = lambda df: df.select(F.col("insight_id").alias("id"), "rule", "dedupe_key", "entity", F.col("evidence").alias("events"))
    pairs = lifecycle.carried_ids(shape(old), shape(fresh))
    kept = fresh.join(pairs.where("NOT ambiguous").select("old_id", F.col("new_id").alias("insight_id")), "insight_id", "left")
    kept = kept.withColumn("insight_id", F.coalesce("old_id", "insight_id")).drop("old_id").select(*fresh.columns)
    decided = journal.where("status = 'moved'").select("target").distinct()
    gone = old.join(pairs.select(F.col("old_id").alias("insight_id")), "insight_id", "left_anti").join(decided, F.col("insight_id") == F.col("target"), "left_semi")
    return lifecycle.overlay(kept.unionByName(gone.select(*fresh.columns)), journal, "insight_id"), pairs.where("ambiguous")


def retention_report(ev: DataFrame, runs: DataFrame, episodes: DataFrame, as_of: Column) -> DataFrame:
    """STR-11: rows by table that go and stay. Open insights always stay."""
    rows = ev.select(F.lit("events").alias("name"), retained(ev, as_of).alias("stays"))
    rows = rows.union(runs.select(F.lit("runs"), retained(runs, as_of, RUN_DAYS, "updated_at")))
    rows = rows.union(episodes.select(F.lit("insights"), ~F.col("state").isin(*TERMINAL_STATES) | retained(episodes, as_of, RUN_DAYS, "last_observed_at")))
    return rows.groupBy("name").agg(F.count_if("stays").alias("stay"), F.count_if(~F.col("stays")).alias("go"))
