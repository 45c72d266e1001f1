"""Lifecycle, rebuild and retention over the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.staging import staged
from eventloom.operators import insights as i
from eventloom.operators import lifecycle as lc
from eventloom.operators import maintenance as m
from eventloom.operators import projections as p
from eventloom.plans.common import SEEN, over_events, over_silver
from eventloom.plans.graph_queries import ASSETS, ROLES, RUNS
from eventloom.plans.insight_queries import EPISODES, FOUND, INCIDENTS
from eventloom.schema import flat, sql

AS_OF = "1998-06-01"


def _now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _requests(ev):
    """Each asset's checks as requests: failure reopens, success resolves, others acknowledge."""
    to = F.when(F.col("outcome") == "failure", "open").when(F.col("outcome") == "success", "resolved").otherwise("acknowledged")
    return ev.where("event = 'quality.check'").select(F.col("asset_key").alias("target"), F.col("observed_at").alias("at"), F.dense_rank().over(W.partitionBy("asset_key", "observed_at").orderBy("event_id")).alias("seq"), to.alias("to"))


def _carried(episodes):
    """Insights against older rows of them, with other ids and a part of the evidence."""
    shape = lambda df: df.select("id", "rule", "dedupe_key", "entity", "events")
    # Both sides are made of the insights: they are derived once.
    episodes = staged(episodes.select("insight_id", "rule", "dedupe_key", "entity", "findings", "evidence"), "insights")
    fresh = episodes.withColumns({"id": F.col("insight_id"), "events": F.col("evidence")})
    old = episodes.where("findings >= 2").withColumns({"id": F.concat(F.lit("old-"), "insight_id"), "events": F.slice("evidence", 2, 2)})
    return lc.carried_ids(shape(old), shape(fresh))


def _runs(ev):
    """Runs of events that have the columns for status and updated_at alone: the other columns are not to be read."""
    return p.runs(flat(ev)).select("run_id", "status", "updated_at")


def _raw(ev):
    return ev.where("event = 'pipeline.run'").select(F.timestamp_add("DAY", F.lit(14), "received_at").alias("expires_at"))


def _gaps(ev):
    g = ev.where("event = 'pipeline.run' AND outcome = 'failure'").groupBy(F.col("job_id").alias("failure_id")).agg(F.min("observed_at").alias("occurred_at"), F.collect_list("event_id").alias("event_ids"))
    return g.withColumn("event_ids", F.when(F.col("failure_id").endswith("7"), F.concat("event_ids", F.array(F.lit("gone")))).otherwise(F.col("event_ids")))


#: RULE-9 in SQL: each target's requests, one after the other.
MOVED = """
req AS (SELECT asset_key AS target, observed_at AS at, CASE outcome WHEN 'failure' THEN 'open' WHEN 'success' THEN 'resolved' ELSE 'acknowledged' END AS "to",
 row_number() OVER (PARTITION BY asset_key ORDER BY observed_at, event_id) AS k FROM ev WHERE event = 'quality.check'),
may AS (SELECT * FROM (VALUES ('open', 'acknowledged'), ('open', 'resolved'), ('acknowledged', 'open'), ('acknowledged', 'resolved'), ('resolved', 'open')) t(a, b)),
moved AS (WITH RECURSIVE m AS (
 SELECT target, k, 'open' AS "from", "to", CASE WHEN "to" = 'open' THEN 'same' ELSE 'moved' END AS status, "to" AS state FROM req WHERE k = 1 UNION ALL
 SELECT r.target, r.k, m.state, r."to", CASE WHEN r."to" = m.state THEN 'same' WHEN may.a IS NOT NULL THEN 'moved' ELSE 'rejected' END, CASE WHEN may.a IS NOT NULL THEN r."to" ELSE m.state END
 FROM m JOIN req r ON r.target = m.target AND r.k = m.k + 1 LEFT JOIN may ON may.a = m.state AND may.b = r."to") SELECT * FROM m)"""


QUERIES = {
    "rule9_transitions": (
        over_events(lambda ev: lc.transitions(_requests(ev)).groupBy("from", "to", "status").agg(F.count("*").alias("n"))),
        sql('SELECT "from", "to", status, count(*) AS n FROM moved GROUP BY ALL', MOVED),
    ),
    "rule10_lifecycle_overlay": (
        over_events(lambda ev: lc.overlay(
            p.assets(ev).select("entity_id", F.lit("open").alias("state")),
            lc.transitions(_requests(ev)).withColumn("target", F.concat(F.lit("asset://"), "target")), "entity_id",
        ).select("entity_id", "state")),
        sql("""SELECT 'asset://' || a.asset_key AS entity_id, coalesce(d.decided, 'open') AS state FROM (SELECT DISTINCT asset_key FROM ev WHERE asset_key IS NOT NULL) a
            LEFT JOIN (SELECT target, arg_max("to", k) AS decided FROM moved WHERE status = 'moved' GROUP BY target) d ON d.target = a.asset_key""", MOVED),
    ),
    "rule11_alert_cooldown": (
        over_silver(lambda ev: lc.alerts(i.findings(ev, {k: i.RULES[k] for k in ("run-failure", "quality-failure")}).select(F.concat("kind", F.lit(":"), "event").alias("key"), F.col("observed_at").alias("at")), 86400 * 3), SEEN),
        sql("""SELECT key, ts(tm) AS at, sent FROM (WITH RECURSIVE o AS (SELECT kind || ':' || event AS key, observed_at AS tm, row_number() OVER (PARTITION BY kind || ':' || event ORDER BY observed_at) AS k FROM found WHERE rule IN ('run-failure', 'quality-failure')),
            w AS (SELECT key, tm, k, tm AS last, true AS sent FROM o WHERE k = 1 UNION ALL SELECT o.key, o.tm, o.k, CASE WHEN o.tm - w.last >= INTERVAL 3 DAY THEN o.tm ELSE w.last END, o.tm - w.last >= INTERVAL 3 DAY FROM w JOIN o ON o.key = w.key AND o.k = w.k + 1) SELECT * FROM w)""", FOUND),
    ),
    "agg17_collapse_open": (
        over_silver(lambda ev: lc.collapse_open(i.episodes(i.findings(ev), ev).withColumn("dedupe_key", F.substring("dedupe_key", 1, 3)).select("insight_id", "dedupe_key", "observed_at", "state", "findings")), SEEN),
        sql("""SELECT insight_id, dedupe_key, CASE WHEN state = 'open' AND insight_id <> keeper THEN 'suppressed' ELSE state END AS state, CASE WHEN state = 'open' AND insight_id <> keeper THEN keeper END AS merged_into, CAST(CASE WHEN state = 'open' AND insight_id = keeper THEN total ELSE findings END AS BIGINT) AS findings FROM (
            SELECT *, arg_min(insight_id, (observed_at, insight_id)) FILTER (state = 'open') OVER (PARTITION BY dedupe_key) AS keeper, sum(findings) FILTER (state = 'open') OVER (PARTITION BY dedupe_key) AS total FROM (
            SELECT sha256(dedupe_key || '|' || first_event) AS insight_id, substr(dedupe_key, 1, 3) AS dedupe_key, observed_at, CASE WHEN resolved_by IS NULL THEN 'open' ELSE 'resolved' END AS state, findings FROM epi))""", EPISODES),
    ),
    "join14_touched_assets": (
        over_silver(lambda ev: m.touched_assets(ev, _runs(ev).where("status = 'failure'")), ("event_id", "event", "outcome", "observed_at", "run_id", "asset_key", "sla_seconds")),
        sql("SELECT entity_id, ts(last_event_at) AS last_event_at, ts(last_materialized_at) AS last_materialized_at, sla_seconds, status FROM asset WHERE entity_id IN (SELECT 'asset://' || asset_key FROM ev WHERE run_id IN (SELECT run_id FROM run WHERE status = 'failure'))", RUNS + "," + ASSETS),
    ),
    "str9_reprocess_window": (
        over_events(lambda ev: m.reprocess(ev, "1997-01-01", "1997-01-31")),
        sql("SELECT entity_id, strftime(min(observed_at), '%Y-%m-%d %H:%M:%S.%g') AS first_seen, strftime(max(observed_at), '%Y-%m-%d %H:%M:%S.%g') AS last_seen, count(*) AS sightings FROM roles WHERE entity_id IN (SELECT entity_id FROM roles WHERE received_at BETWEEN '1997-01-01' AND '1997-01-31') GROUP BY entity_id", ROLES),
    ),
    "agg15_gap_status": (
        over_events(lambda ev: m.gap_status(_gaps(ev))),
        sql("SELECT count(DISTINCT job_id) AS gaps, CAST(count(*) + count(DISTINCT job_id) FILTER (job_id LIKE '%7') AS BIGINT) AS events, strftime(min(observed_at), '%Y-%m-%d %H:%M:%S.%g') AS oldest, 'degraded' AS status FROM ev WHERE event = 'pipeline.run' AND outcome = 'failure'"),
    ),
    "join15_lost_evidence": (over_silver(lambda ev: m.lost_evidence(_gaps(ev), ev), ("event_id", "event", "outcome", "observed_at", "job_id")), sql("SELECT DISTINCT job_id AS failure_id, 'gone' AS event_id FROM ev WHERE event = 'pipeline.run' AND outcome = 'failure' AND job_id LIKE '%7'")),
    "str10_repaired_gaps": (over_silver(lambda ev: m.repaired(_gaps(ev), ev).select("failure_id"), ("event_id", "event", "outcome", "observed_at", "job_id")), sql("SELECT DISTINCT job_id AS failure_id FROM ev WHERE event = 'pipeline.run' AND outcome = 'failure' AND job_id NOT LIKE '%7'")),
    "str11_retention": (
        over_silver(lambda ev: m.retention_report(ev, _runs(ev), i.episodes(i.findings(ev), ev), _now()), (*SEEN, "received_at")),
        sql(f"""SELECT 'events' AS name, count(*) FILTER (received_at > TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) AS stay, count(*) FILTER (received_at <= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) AS go FROM ev UNION ALL
            SELECT 'runs', count(*) FILTER (updated_at > TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY), count(*) FILTER (updated_at <= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY) FROM run UNION ALL
            SELECT 'insights', count(*) FILTER (resolved_by IS NULL OR last_observed_at > TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY), count(*) FILTER (resolved_by IS NOT NULL AND last_observed_at <= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY) FROM epi""", EPISODES + "," + RUNS),
    ),
    "join16_carried_ids": (
        over_silver(lambda ev: _carried(i.episodes(i.findings(ev), ev)), SEEN),
        sql("SELECT 'old-' || sha256(dedupe_key || '|' || first_event) AS old_id, sha256(dedupe_key || '|' || first_event) AS new_id, false AS ambiguous FROM epi WHERE findings >= 2", EPISODES),
    ),
    "str11_retained": (
        over_silver(lambda ev: m.retention({"events": ev, "runs": _runs(ev), "insights": i.episodes(i.findings(ev), ev), "incidents": i.incidents(i.findings(ev)).withColumn("state", F.lit("resolved")), "raw": _raw(ev)}, _now())[1], (*SEEN, "received_at")),
        sql(f"""SELECT 'events' AS name, count(*) FILTER (received_at > TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) AS stay, count(*) FILTER (received_at <= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) AS go FROM ev UNION ALL
            SELECT 'runs', count(*) FILTER (updated_at > TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY), count(*) FILTER (updated_at <= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY) FROM run UNION ALL
            SELECT 'insights', count(*) FILTER (resolved_by IS NULL OR last_observed_at > TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY), count(*) FILTER (resolved_by IS NOT NULL AND last_observed_at <= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY) FROM epi UNION ALL
            SELECT 'incidents', count(*) FILTER (t > TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY), count(*) FILTER (t <= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY) FROM (SELECT max(observed_at) AS t FROM isl GROUP BY entity, island) UNION ALL
            SELECT 'raw', count(*) FILTER (received_at + INTERVAL 14 DAY > TIMESTAMP '{AS_OF}'), count(*) FILTER (received_at + INTERVAL 14 DAY <= TIMESTAMP '{AS_OF}') FROM ev WHERE event = 'pipeline.run'""", EPISODES + INCIDENTS[len(FOUND):] + "," + RUNS),
    ),
}
