"""The questions over the given tables, for all runs and assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import insights as i
from eventloom.operators import projections as p
from eventloom.operators import questions as q
from eventloom.operators.correlate import canonical
from eventloom.plans.common import SEEN, over_events, over_silver, texted
from eventloom.plans.graph_queries import ASSETS, EDGES, ROLES, RUNS
from eventloom.plans.insight_queries import EPISODES, FOUND, INCIDENTS
from eventloom.schema import from_tables, sql, stamp

#: Columns that runs' starts and changes are made of.
CHANGED = ("event_id", "event", "category", "observed_at", "started_at", "run_id")
#: Columns that runs, changes and edges are made of.
INVESTIGATED = (
    *CHANGED, "ended_at", "outcome", "severity", "error_message", "duration_ms", "trigger", "service", "environment", "producer", "job_id", "asset_key", "branch", "table_name", "snapshot_id", "entities",
)
CHANGES = (
    RUNS
    + """,
chg AS (SELECT * FROM ev WHERE category IN ('infrastructure', 'storage') OR verb IN ('deploy', 'commit', 'create', 'migrate', 'release', 'upgrade')),
rc AS (SELECT run_id, coalesce(started_at, updated_at) AS start, event_id AS change_id, event AS change, chg.observed_at AS changed_at, status FROM (SELECT * FROM run) r JOIN (SELECT event_id, event, observed_at FROM chg) chg ON chg.observed_at BETWEEN coalesce(r.started_at, r.updated_at) - INTERVAL 24 HOUR AND coalesce(r.started_at, r.updated_at)),
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY changed_at DESC, change_id) AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM rc),
cmp AS (SELECT a.run_id, b.run_id AS other, row_number() OVER (PARTITION BY a.run_id ORDER BY b.updated_at DESC, b.run_id) AS place, a.job_name FROM run a JOIN run b ON a.job_name = b.job_name AND a.run_id <> b.run_id QUALIFY place <= 5)"""
)

def _analyses(spark, sf_dir):
    """An analysis of each failed order; every other one names an event that isn't there."""
    key = F.col("o_orderkey").cast("string")
    gone = F.when(F.col("o_orderkey") % 2 != 0, F.concat(F.lit("o-"), key, F.lit("x")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'P'").select(
        F.concat(F.lit("a-"), key).alias("analysis_id"), F.concat(F.lit("run://orders/run-"), key).alias("subject"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        F.lit("m").alias("model"), F.lit("1").alias("template"), F.array_compact(F.array(F.concat(F.lit("o-"), key), gone)).alias("evidence"),
    )


QUERIES = {
    "qry1_search": (
        over_events(lambda ev: q.page(q.search(ev, "FAILED AT", since="1996-01-01", until="1997-12-31"), 1000).select("event_id", "observed_at", "error_message")),
        sql("SELECT event_id, ts(observed_at) AS observed_at, error_message FROM ev WHERE contains(lower(error_message), 'failed at') AND observed_at BETWEEN '1996-01-01' AND '1997-12-31' ORDER BY ev.observed_at, event_id LIMIT 1000"),
    ),
    "top2_event_page_after_cursor": (
        over_events(lambda ev: q.page(ev, 500, q.cursor("1997-06-01 00:00:00", "l-5")).select("event_id", "observed_at")),
        sql("SELECT event_id, ts(observed_at) AS observed_at FROM ev WHERE (ev.observed_at, event_id) > (TIMESTAMP '1997-06-01 00:00:00', 'l-5') ORDER BY ev.observed_at, event_id LIMIT 500"),
    ),
    "qry3_events_by_asset": (over_events(lambda ev: q.search(ev, asset_key="part-7").select("event_id", "event")), sql("SELECT event_id, event FROM ev WHERE asset_key = 'part-7'")),
    "qry5_timelines": (
        over_events(q.timeline),
        sql("""SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY observed_at, event_id) AS INTEGER) AS rn, event_id, ts(observed_at) AS observed_at,
            CASE split_part(event, '.', 1) WHEN 'pipeline' THEN 'pipeline' WHEN 'asset' THEN 'asset' WHEN 'quality' THEN 'quality' WHEN 'table' THEN 'table' WHEN 'wap' THEN 'wap' ELSE 'other' END AS phase,
            CASE event WHEN 'pipeline.run' THEN 'Run' WHEN 'quality.check' THEN 'Check' WHEN 'wap.branch.create' THEN 'Create branch' ELSE upper(verb[1]) || verb[2:] END AS label, coalesce(error_message, CASE WHEN event = 'quality.check' THEN 'failed' WHEN event = 'wap.promote' THEN CASE WHEN branch IS NOT NULL AND target IS NOT NULL THEN branch || ' -> ' || target ELSE branch END
            WHEN event = 'wap.branch.create' THEN 'branch ' || branch WHEN event = 'pipeline.run' THEN job_id ELSE coalesce(asset_key, table_name) END) AS summary, false AS truncated FROM ev WHERE run_id IS NOT NULL"""),
    ),
    "qry6_run_failures": (over_events(q.failures), sql("SELECT run_id, event_id, event, outcome, error_message, ts(observed_at) AS observed_at FROM ev WHERE run_id IS NOT NULL AND (outcome = 'failure' OR error_message IS NOT NULL)")),
    "qry7_run_changes": (
        over_silver(lambda ev: q.changes(p.run_spans(ev), ev, shown=stamp), CHANGED),
        sql("SELECT run_id, strftime(start, '%Y-%m-%d %H:%M:%S.%g') AS start, change_id, change, ts(changed_at) AS changed_at, CAST(rn AS INTEGER) AS rn, n > 1000 AS truncated FROM rk WHERE rn <= 1000", CHANGES),
    ),
    "join12_comparable_runs": (over_events(lambda ev: q.comparable(p.runs(ev))), sql("SELECT run_id, other, CAST(place AS INTEGER) AS place, job_name FROM cmp", CHANGES)),
    "qry9_compare_runs": (
        over_events(lambda ev: (lambda r: q.compared(r, q.comparable(r, 1).select("run_id", "other")))(p.runs(ev))),
        sql("SELECT c.run_id, other, b.duration_ms - a.duration_ms AS duration_delta_ms, a.status <> b.status AS status_changed, b.error_count - a.error_count AS error_delta FROM cmp c JOIN run a ON a.run_id = c.run_id JOIN run b ON b.run_id = c.other WHERE place = 1", CHANGES),
    ),
    "qry10_investigations": (
        over_silver(lambda ev: q.investigation(ev, p.runs(ev)), INVESTIGATED),
        sql("""SELECT r.run_id, r.job_name, n.events, coalesce(failures, 0) AS failures, failed_stage, first_failure, coalesce(failure_ids, '') AS failure_ids, coalesce(warning_ids, '') AS warning_ids, coalesce(changes, '') AS changes, coalesce(comparables, '') AS comparables,
            coalesce(impact, '') AS impact, coalesce(cut, false) AS truncated, concat_ws(',', first_failure, top) AS causes,
            array_to_string(list_sort(list_distinct(list_concat(coalesce(fl, []), coalesce(wl, []), coalesce(cl, [])))), ',') AS evidence
            FROM (SELECT * FROM run WHERE status = 'failure') r
            LEFT JOIN (SELECT run_id, count(*) AS events FROM ev GROUP BY run_id) n USING (run_id)
            LEFT JOIN (SELECT run_id, count(*) AS failures, arg_max(event, (observed_at, event_id)) AS failed_stage, arg_min(event_id, (observed_at, event_id)) AS first_failure, string_agg(event_id, ',' ORDER BY observed_at, event_id) AS failure_ids, list(event_id) AS fl FROM ev WHERE outcome = 'failure' OR error_message IS NOT NULL GROUP BY run_id) f USING (run_id)
            LEFT JOIN (SELECT run_id, string_agg(event_id, ',' ORDER BY observed_at, event_id) AS warning_ids, list(event_id) AS wl FROM ev WHERE severity IN ('warn', 'error') GROUP BY run_id) w USING (run_id)
            LEFT JOIN (SELECT run_id, string_agg(change_id, ',' ORDER BY rn) AS changes, list(change_id) AS cl, string_agg(change_id, ',' ORDER BY rn) FILTER (rn <= 3) AS top, max(n) > 1000 AS cut FROM rk WHERE rn <= 1000 GROUP BY run_id) c USING (run_id)
            LEFT JOIN (SELECT run_id, string_agg(other, ',' ORDER BY place) AS comparables FROM cmp GROUP BY run_id) m USING (run_id)
            LEFT JOIN (SELECT split_part(src, '/', -1) AS run_id, string_agg(DISTINCT type || ' ' || dst, ',' ORDER BY type || ' ' || dst) AS impact FROM edge WHERE src LIKE 'run://%' GROUP BY 1) e USING (run_id)""", CHANGES + "," + EDGES),
    ),
    "set1_run_entities": (
        over_events(lambda ev: q.run_entities(p.edges(ev))),
        sql("SELECT split_part(src, '/', -1) AS run_id, dst AS entity_id FROM edge WHERE src LIKE 'run://%' UNION SELECT split_part(dst, '/', -1), src FROM edge WHERE dst LIKE 'run://%'", EDGES),
    ),
    "join8_lineage": (
        over_events(lambda ev: q.lineage(p.relationships(ev))),
        sql("SELECT DISTINCT dst AS entity_id, 'upstream' AS direction, src AS neighbour, type, 'runtime' AS kind, false AS truncated FROM edge WHERE dst LIKE 'asset://%'", EDGES),
    ),
    "qry11_asset_health": (
        over_events(lambda ev: q.asset_health(p.assets(ev), F.lit("2001-01-01").cast("timestamp_ntz"))),
        sql("SELECT entity_id, ts(last_event_at) AS last_event_at, ts(last_materialized_at) AS last_materialized_at, sla_seconds, status, (epoch_ms(TIMESTAMP '2001-01-01') - epoch_ms(last_materialized_at)) / 1000.0 AS age_seconds, coalesce((epoch_ms(TIMESTAMP '2001-01-01') - epoch_ms(last_materialized_at)) / 1000.0 > sla_seconds, false) AS breached FROM asset", ASSETS),
    ),
    "join9_asset_insights": (
        over_silver(lambda ev: q.asset_insights(p.assets(ev).select("entity_id", "status"), i.episodes(i.findings(ev), ev)), SEEN),
        sql("SELECT entity_id, a.status, insights, coalesce(n, 0) AS open_insights FROM asset a LEFT JOIN (SELECT entity, count(*) AS n, string_agg(sha256(dedupe_key || '|' || first_event), ',' ORDER BY sha256(dedupe_key || '|' || first_event)) AS insights FROM epi WHERE resolved_by IS NULL GROUP BY entity) e ON e.entity = a.entity_id", EPISODES + "," + ASSETS),
    ),
    "join11_provenance": (
        over_events(lambda ev: q.provenance(ev)),
        sql("SELECT event_id, 'run' AS kind, run_id AS listed_by FROM ev WHERE run_id IS NOT NULL UNION SELECT event_id, 'entity', entity_id FROM roles UNION SELECT event_id, 'edge', src || ' -[' || type || ']-> ' || dst FROM edge", ROLES + "," + EDGES),
    ),
    "qry13_entities_by_kind": (over_events(lambda ev: p.entities(ev).where("kind = 'branch'").select("entity_id", "display_name")), sql("SELECT DISTINCT entity_id, split_part(entity_id, '://', -1) AS display_name FROM roles WHERE role = 'branch'", ROLES)),
    "top3_run_page": (
        over_events(lambda ev: q.run_page(p.runs(ev), 500, "run-3", status="failure").select("run_id", "job_name", "status")),
        sql("SELECT run_id, job_name, status FROM run WHERE status = 'failure' AND run_id > 'run-3' ORDER BY run_id LIMIT 500", RUNS),
    ),
    "qry11_asset_history": (
        over_events(lambda ev: q.asset_history(ev, 5)),
        sql("""SELECT asset_key, CAST(rn AS INTEGER) AS rn, event_id, event, outcome, ts(observed_at) AS observed_at, n > 5 AS truncated FROM (
            SELECT *, row_number() OVER (PARTITION BY asset_key ORDER BY observed_at DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY asset_key) AS n FROM ev WHERE asset_key IS NOT NULL) WHERE rn <= 5"""),
    ),
    "top5_newest_insights": (
        over_silver(lambda ev: q.newest(i.episodes(i.findings(ev), ev), "observed_at", "insight_id", 300, state="open").select("insight_id", "rule", "entity", "observed_at"), SEEN),
        sql("""SELECT sha256(dedupe_key || '|' || first_event) AS insight_id, rule, entity, ts(observed_at) AS observed_at FROM epi WHERE resolved_by IS NULL
            ORDER BY epi.observed_at DESC, 1 LIMIT 300""", EPISODES),
    ),
    "qry12_newest_incidents": (
        over_silver(lambda ev: q.newest(i.incidents(i.findings(ev)), "last_at", "first_event", 200).select("first_event", "entity", "last_at", "members"), SEEN),
        sql("""SELECT arg_min(event_id, (observed_at, event_id)) AS first_event, entity, strftime(max(observed_at), '%Y-%m-%d %H:%M:%S.%g') AS last_at, count(*) AS members FROM isl
            GROUP BY entity, island ORDER BY max(observed_at) DESC, 1 LIMIT 200""", INCIDENTS),
    ),
    "join10_incident_insights": (
        over_silver(i.behind_incidents, SEEN),
        sql("""SELECT DISTINCT n.incident, sha256(dedupe_key || '|' || first_event) AS insight_id, rule, CASE WHEN resolved_by IS NULL THEN 'open' ELSE 'resolved' END AS state, ts(e.observed_at) AS observed_at
            FROM (SELECT incident, unnest(members) AS event_id FROM (SELECT arg_min(event_id, (observed_at, event_id)) AS incident, list(event_id ORDER BY observed_at, event_id)[:64] AS members FROM isl GROUP BY entity, island)) n
            JOIN (SELECT *, unnest(evidence) AS event_id FROM epi) e USING (event_id)""", EPISODES + INCIDENTS[len(FOUND):]),
    ),
    "qry15_analyses": (
        lambda spark, sf_dir: texted(q.analyses(_analyses(spark, sf_dir), canonical(from_tables(spark, sf_dir))).select("analysis_id", "subject", "missing", "sound")),
        sql("""SELECT 'a-' || o_orderkey AS analysis_id, 'run://orders/run-' || o_orderkey AS subject, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'o-' || (o_orderkey || 'x') END AS missing, o_orderkey % 2 = 0 AS sound FROM orders WHERE o_orderstatus = 'P'"""),
    ),
}
