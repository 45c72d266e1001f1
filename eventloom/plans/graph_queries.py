"""Runs, entities, edges, assets over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import projections as p
from eventloom.plans.common import over_events
from eventloom.schema import sql

RUNS = """
bad AS (SELECT *, error_message IS NOT NULL OR severity IN ('error', 'critical') AS bad, event = 'pipeline.run' AS term FROM ev WHERE run_id IS NOT NULL),
runs AS (SELECT run_id, count(*) AS event_count, count(*) FILTER (bad) AS error_count, count(*) FILTER (NOT bad AND severity = 'warn') AS warning_count,
 arg_max(branch, (observed_at, event_id)) FILTER (branch IS NOT NULL) AS branch, arg_max(job_id, (observed_at, event_id)) FILTER (job_id IS NOT NULL) AS job_name, arg_max(service, (observed_at, event_id)) AS service,
 max(CASE WHEN term AND outcome = 'failure' THEN 5 WHEN term AND outcome = 'success' THEN 4 ELSE 1 END) AS rank,
 max(coalesce(ended_at, observed_at)) FILTER (term AND outcome <> 'unknown') AS ended_at, arg_max(duration_ms, (observed_at, event_id)) FILTER (term AND duration_ms IS NOT NULL) AS duration_ms,
 arg_max(trigger, (observed_at, event_id)) FILTER (term AND trigger IS NOT NULL) AS trigger, min(started_at) AS ms, arg_min(observed_at, (observed_at, event_id)) AS fo, arg_min(started_at IS NULL, (observed_at, event_id)) AS fn, max(observed_at) AS updated_at
 FROM bad GROUP BY run_id),
run AS (SELECT * EXCLUDE (rank, ms, fo, fn), CASE rank WHEN 5 THEN 'failure' WHEN 4 THEN 'success' ELSE 'running' END AS status, CASE WHEN fn THEN least(ms, fo) ELSE ms END AS started_at FROM runs)"""

ROLES = """
roles AS (
SELECT *, 'run' AS role, 'run://' || producer || '/' || run_id AS entity_id FROM ev WHERE run_id IS NOT NULL UNION ALL
SELECT *, 'asset', 'asset://' || asset_key FROM ev WHERE asset_key IS NOT NULL UNION ALL
SELECT *, 'table', 'table://' || table_name FROM ev WHERE table_name IS NOT NULL UNION ALL
SELECT *, 'branch', 'branch://' || producer || '/' || branch FROM ev WHERE branch IS NOT NULL UNION ALL
SELECT *, 'snapshot', 'snapshot://' || coalesce(table_name, 'unknown') || '/' || snapshot_id FROM ev WHERE snapshot_id IS NOT NULL UNION ALL
SELECT *, 'service', 'service://' || service FROM ev WHERE service IS NOT NULL)"""

EDGES = """
typed AS (SELECT *, 'run://' || producer || '/' || run_id AS r, CASE WHEN verb IN ('read', 'scan', 'query', 'extract') THEN 'reads_from' WHEN verb IN ('write', 'load', 'commit') THEN 'writes_to'
 WHEN verb IN ('materialize', 'materialized', 'produce', 'execute') THEN 'produces' WHEN verb IN ('validate', 'check', 'test') THEN 'validates' WHEN verb IN ('promote', 'publish') THEN 'promotes' ELSE 'part_of' END AS t FROM ev WHERE run_id IS NOT NULL),
edge AS (
SELECT event_id, observed_at, 'service://' || service AS src, r AS dst, 'executes' AS type FROM typed UNION ALL
SELECT event_id, observed_at, r, 'asset://' || asset_key, t FROM typed WHERE asset_key IS NOT NULL UNION ALL
SELECT event_id, observed_at, r, 'table://' || table_name, t FROM typed WHERE table_name IS NOT NULL UNION ALL
SELECT event_id, observed_at, r, 'snapshot://' || coalesce(table_name, 'unknown') || '/' || snapshot_id, t FROM typed WHERE snapshot_id IS NOT NULL UNION ALL
SELECT event_id, observed_at, r, 'branch://' || producer || '/' || branch, 'writes_to' FROM typed WHERE branch IS NOT NULL)"""

ASSETS = """
ast AS (SELECT 'asset://' || asset_key AS entity_id, max(observed_at) AS last_event_at, max(observed_at) FILTER (outcome = 'success' AND verb = 'materialize') AS last_materialized_at,
 max(observed_at) FILTER (outcome = 'success') AS s, max(observed_at) FILTER (outcome = 'failure') AS f, arg_max(sla_seconds, (observed_at, event_id)) FILTER (sla_seconds IS NOT NULL) AS sla_seconds FROM ev WHERE asset_key IS NOT NULL GROUP BY 1),
asset AS (SELECT * EXCLUDE (s, f), CASE WHEN s IS NULL AND f IS NULL THEN 'unknown' WHEN f IS NULL THEN 'healthy' WHEN s IS NULL OR f >= s THEN 'failing' ELSE 'recovering' END AS status FROM ast)"""

TS_RUN = "SELECT * REPLACE (ts(started_at) AS started_at, ts(ended_at) AS ended_at, ts(updated_at) AS updated_at)"

QUERIES = {
    "qry_failed_runs": (
        over_events(lambda ev: p.runs(ev).where("status = 'failure'").select("run_id", "job_name", "started_at", "ended_at", "error_count")),
        sql("SELECT run_id, job_name, ts(started_at) AS started_at, ts(ended_at) AS ended_at, error_count FROM run WHERE status = 'failure'", RUNS),
    ),
    "agg1_runs": (over_events(lambda ev: p.runs(ev).drop("environment")), sql(f"{TS_RUN} FROM run", RUNS)),
    "agg3_run_assets": (
        over_events(p.run_assets),
        sql("SELECT run_id, string_agg(asset_key, ',' ORDER BY asset_key) AS assets, count(*) AS asset_count FROM (SELECT DISTINCT run_id, asset_key FROM ev WHERE run_id IS NOT NULL AND asset_key IS NOT NULL) GROUP BY run_id"),
    ),
    "agg4_event_entities": (
        over_events(lambda ev: p.with_entities(ev).groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"))),
        sql("SELECT role, count(*) AS n, count(DISTINCT entity_id) AS entities FROM roles GROUP BY role", ROLES),
    ),
    "agg5_entities": (
        over_events(p.entities),
        sql("SELECT entity_id, arg_min(role, (observed_at, event_id, role)) AS kind, ts(min(observed_at)) AS first_seen, ts(max(observed_at)) AS last_seen, count(*) AS sightings, split_part(entity_id, '://', -1) AS display_name FROM roles GROUP BY entity_id".replace("ts(min(observed_at))", "strftime(min(observed_at), '%Y-%m-%d %H:%M:%S.%g')").replace("ts(max(observed_at))", "strftime(max(observed_at), '%Y-%m-%d %H:%M:%S.%g')"), ROLES),
    ),
    "top1_entity_sources": (
        over_events(p.entity_sources),
        sql("SELECT entity_id, string_agg(event_id, ',' ORDER BY observed_at, event_id) AS source_ids FROM (SELECT entity_id, event_id, observed_at FROM roles QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY observed_at, event_id) <= 64) GROUP BY entity_id", ROLES),
    ),
    "agg6_branches": (
        over_events(p.branches),
        sql("""SELECT entity_id, field, arg_max(coalesce(value, chr(0)), (observed_at, event_id)) AS value FROM (
            SELECT entity_id, observed_at, event_id, 'state' AS field, CASE WHEN verb = 'create' THEN 'open' WHEN outcome = 'success' THEN 'promoted' ELSE 'promotion_failed' END AS value FROM roles WHERE role = 'branch' AND verb IN ('create', 'promote') UNION ALL
            SELECT entity_id, observed_at, event_id, CASE verb WHEN 'create' THEN 'created_at' ELSE 'promoted_at' END, ts(observed_at) FROM roles WHERE role = 'branch' AND verb IN ('create', 'promote') UNION ALL
            SELECT entity_id, observed_at, event_id, CASE verb WHEN 'create' THEN 'base_branch' ELSE 'target' END, CASE verb WHEN 'create' THEN base_branch ELSE target END FROM roles WHERE role = 'branch' AND verb IN ('create', 'promote')) GROUP BY entity_id, field""", ROLES),
    ),
    "agg7_edges": (
        over_events(lambda ev: p.edges(ev).select("event_id", "src", "dst", "type")),
        sql("SELECT event_id, src, dst, type FROM edge", EDGES),
    ),
    "agg8_relationships": (
        over_events(p.relationships),
        sql("SELECT src, dst, type, 1.0::DOUBLE AS confidence, 'explicit' AS method, count(*) AS events, strftime(min(observed_at), '%Y-%m-%d %H:%M:%S.%g') AS first_seen, strftime(max(observed_at), '%Y-%m-%d %H:%M:%S.%g') AS last_seen FROM edge GROUP BY src, dst, type", EDGES),
    ),
    "top1_edge_sources": (
        over_events(p.edge_sources),
        sql("SELECT src, dst, type, string_agg(event_id, ',' ORDER BY observed_at, event_id) AS source_ids FROM (SELECT * FROM edge QUALIFY row_number() OVER (PARTITION BY src, dst, type ORDER BY observed_at, event_id) <= 32) GROUP BY src, dst, type", EDGES),
    ),
    "agg9_assets": (over_events(p.assets), sql("SELECT entity_id, ts(last_event_at) AS last_event_at, ts(last_materialized_at) AS last_materialized_at, sla_seconds, status FROM asset", ASSETS)),
    "agg16_impact": (
        over_events(p.impact),
        sql("""SELECT src, type, targets, evidence, evidence_ids FROM (SELECT src, type, string_agg(DISTINCT dst, ',' ORDER BY dst) AS targets, count(DISTINCT event_id) AS evidence FROM edge WHERE src LIKE 'run://%' GROUP BY src, type)
            JOIN (SELECT src, type, string_agg(event_id, ',' ORDER BY observed_at, event_id) AS evidence_ids FROM (SELECT DISTINCT src, type, event_id, observed_at FROM edge WHERE src LIKE 'run://%'
              QUALIFY dense_rank() OVER (PARTITION BY src, type ORDER BY observed_at, event_id) <= 64) GROUP BY src, type) USING (src, type)""", EDGES),
    ),
}
