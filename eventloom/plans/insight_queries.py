"""Baselines, rules, episodes, incidents over the given tables."""

from __future__ import annotations

from eventloom.operators import baselines as b
from eventloom.operators import insights as i
from eventloom.plans.common import SEEN, over_events, over_silver
from eventloom.schema import sql

SAMPLES = """
obs AS (SELECT *, CASE WHEN event LIKE 'metric.%' THEN metric WHEN event = 'pipeline.run' AND coalesce(duration_ms, 0) <> 0 THEN 'run.duration_ms' WHEN coalesce(rows_written, row_count) IS NOT NULL THEN 'rows' END AS base,
 CASE WHEN event LIKE 'metric.%' THEN value WHEN event = 'pipeline.run' THEN duration_ms ELSE coalesce(rows_written, row_count) END AS v,
 CASE WHEN event = 'pipeline.run' THEN 'job://' || producer || '/' || job_id ELSE coalesce('asset://' || asset_key, 'run://' || producer || '/' || run_id, 'service://' || service) END AS entity FROM ev),
smp AS (SELECT * EXCLUDE (metric), base || CASE WHEN partition_key IS NULL THEN '' ELSE '|' || partition_key END AS metric FROM obs WHERE base IS NOT NULL AND v IS NOT NULL AND entity IS NOT NULL),
win AS (SELECT *, median(v) OVER w AS pm, count(v) OVER w AS pn FROM smp WINDOW w AS (PARTITION BY entity, metric ORDER BY observed_at, event_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))"""

FOUND = (
    SAMPLES
    + """,
fresh AS (SELECT *, max(CASE WHEN outcome = 'success' AND verb = 'materialize' THEN observed_at END) OVER (PARTITION BY asset_key ORDER BY observed_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mb FROM ev WHERE asset_key IS NOT NULL),
fnd AS (
SELECT 'run-failure' AS rule, 'run://' || producer || '/' || run_id AS entity, 'critical' AS severity, CASE WHEN retry_of IS NULL THEN 'failure' ELSE 'recurring_failure' END AS kind, coalesce(error_message, event || ' failed') AS summary, event, producer, event_id, observed_at FROM ev WHERE event = 'pipeline.run' AND outcome = 'failure' UNION ALL
SELECT 'quality-failure', coalesce('asset://' || asset_key, 'run://' || producer || '/' || run_id), 'warning', 'quality', coalesce(error_message, 'quality check failed'), event, producer, event_id, observed_at FROM ev WHERE event = 'quality.check' AND outcome = 'failure' UNION ALL
SELECT 'duration-regression', entity, 'warning', 'regression', 'slow: ' || metric, event, producer, event_id, observed_at FROM win WHERE base = 'run.duration_ms' AND pn >= 5 AND pm <> 0 AND v > 2 * pm UNION ALL
SELECT 'volume-spike', entity, 'warning', 'anomaly', 'many: ' || metric, event, producer, event_id, observed_at FROM win WHERE base = 'rows' AND pn >= 5 AND pm > 0 AND v > 3 * pm UNION ALL
SELECT 'freshness-breach', 'asset://' || asset_key, 'warning', 'freshness', 'stale before this event', event, producer, event_id, observed_at FROM fresh WHERE sla_seconds IS NOT NULL AND epoch_ms(observed_at) - epoch_ms(mb) > sla_seconds * 1000),
found AS MATERIALIZED (SELECT *, substr(sha256('["' || rule || '","' || entity || '","' || event || '","' || producer || '"]'), 1, 32) AS dedupe_key FROM fnd)"""
)

EPISODES = (
    FOUND
    + """,
res AS (SELECT 'run-failure' AS rule, 'run://' || producer || '/' || run_id AS entity, event_id AS rid, observed_at AS rat FROM ev WHERE event = 'pipeline.run' AND outcome = 'success' UNION ALL
 SELECT 'quality-failure', coalesce('asset://' || asset_key, 'run://' || producer || '/' || run_id), event_id, observed_at FROM ev WHERE event = 'quality.check' AND outcome = 'success'),
far AS (SELECT rule, entity, event_id, observed_at, NULL AS rid FROM found UNION ALL SELECT rule, entity, NULL, rat, rid FROM res),
nxt AS MATERIALIZED (SELECT rule, event_id, r FROM (SELECT rule, event_id, min(CASE WHEN rid IS NOT NULL THEN (observed_at, rid) END) OVER (PARTITION BY rule, entity ORDER BY observed_at DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM far) WHERE event_id IS NOT NULL),
fr AS (SELECT f.*, r[1] AS resolved_at, r[2] AS resolved_by FROM found f LEFT JOIN nxt USING (rule, event_id)),
epi AS (SELECT dedupe_key, resolved_by, any_value(rule) AS rule, any_value(entity) AS entity, any_value(resolved_at) AS resolved_at, arg_min(severity, (observed_at, event_id)) AS severity, arg_min(kind, (observed_at, event_id)) AS kind, arg_min(summary, (observed_at, event_id)) AS summary,
 arg_min(event_id, (observed_at, event_id)) AS first_event, min(observed_at) AS observed_at, max(observed_at) AS last_observed_at, count(*) AS findings, list(event_id ORDER BY observed_at, event_id)[:64] AS evidence FROM fr GROUP BY dedupe_key, resolved_by)"""
)

INCIDENTS = (
    FOUND
    + """,
crit AS (SELECT *, CASE WHEN epoch_ms(observed_at) - epoch_ms(lag(observed_at) OVER w) > 1800000 OR lag(observed_at) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM found WHERE severity = 'critical' WINDOW w AS (PARTITION BY entity ORDER BY observed_at, event_id)),
isl AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY observed_at, event_id) AS island FROM crit)"""
)

QUERIES = {
    "agg10_observations": (over_events(lambda ev: b.observations(ev).select("event_id", "entity", "metric", "base", "v")), sql("SELECT event_id, entity, metric, base, v FROM smp", SAMPLES)),
    "win1_rolling_baseline": (
        over_events(lambda ev: i.judged(ev, columns=i.SAMPLE).select("event_id", "entity", "metric", "v", "prior_median", "prior_n")),
        sql("SELECT event_id, entity, metric, v, pm AS prior_median, pn AS prior_n FROM win", SAMPLES),
    ),
    "agg11_baselines": (
        over_events(lambda ev: b.baselines(b.observations(ev))),
        sql("""SELECT entity, metric, any_value(total) AS count, any_value(m) AS median, median(abs(v - m)) AS mad, avg(v) AS mean, list_sort(list(v))[CAST(round_even(0.1 * (count(*) - 1), 0) AS BIGINT) + 1] AS p10, list_sort(list(v))[CAST(round_even(0.9 * (count(*) - 1), 0) AS BIGINT) + 1] AS p90
            FROM (SELECT *, median(v) OVER (PARTITION BY entity, metric) AS m FROM (SELECT *, count(*) OVER (PARTITION BY entity, metric) AS total FROM smp QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY observed_at DESC, event_id DESC) <= 200)) GROUP BY entity, metric""", SAMPLES),
    ),
    "agg12_metric_summaries": (
        over_events(b.summaries),
        sql("""SELECT strftime(date_trunc('minute', observed_at), '%Y-%m-%d %H:%M:%S.%g') AS slot, metric, service, count(*) AS count, round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean,
            list_sort(list(value))[greatest(1, CAST(ceil(0.5 * count(*)) AS BIGINT))] AS p50, list_sort(list(value))[greatest(1, CAST(ceil(0.95 * count(*)) AS BIGINT))] AS p95, list_sort(list(value))[greatest(1, CAST(ceil(0.99 * count(*)) AS BIGINT))] AS p99, run_id, asset_key, CAST(NULL AS VARCHAR) AS dimensions, CAST(NULL AS VARCHAR) AS entities, CAST(NULL AS VARCHAR) AS tags
            FROM ev WHERE event LIKE 'metric.%' AND value IS NOT NULL GROUP BY date_trunc('minute', observed_at), metric, service, run_id, asset_key"""),
    ),
    "rule1_5_findings": (over_silver(lambda ev: i.findings(ev), SEEN), sql("SELECT * REPLACE (ts(observed_at) AS observed_at) FROM found", FOUND)),
    "join3_freshness_lookup": (
        over_events(lambda ev: i.freshness(ev).select("event_id", "asset_key", "materialized_before")),
        sql("SELECT event_id, asset_key, ts(mb) AS materialized_before FROM fresh", FOUND),
    ),
    "join5_finding_resolver": (
        over_silver(lambda ev: i.with_resolver(i.findings(ev), ev).select("rule", "event_id", "resolved_at", "resolved_by"), SEEN),
        sql("SELECT rule, event_id, ts(resolved_at) AS resolved_at, resolved_by FROM fr", EPISODES),
    ),
    "rule7_episodes": (
        over_silver(lambda ev: i.episodes(i.findings(ev), ev), SEEN),
        sql("""SELECT * REPLACE (ts(resolved_at) AS resolved_at, ts(observed_at) AS observed_at, ts(last_observed_at) AS last_observed_at, array_to_string(evidence, ',') AS evidence), CASE WHEN resolved_by IS NULL THEN 'open' ELSE 'resolved' END AS state,
            strftime(lag(resolved_at) OVER (PARTITION BY dedupe_key ORDER BY resolved_at NULLS LAST, resolved_by), '%Y-%m-%d %H:%M:%S.%g') AS open_from, sha256(dedupe_key || '|' || first_event) AS insight_id FROM epi""", EPISODES),
    ),
    "rule8_incidents": (
        over_silver(lambda ev: i.incidents(i.findings(ev)), SEEN),
        sql("""SELECT entity AS who, entity, arg_min(summary, (observed_at, event_id)) AS title, strftime(min(observed_at), '%Y-%m-%d %H:%M:%S.%g') AS started_at, strftime(max(observed_at), '%Y-%m-%d %H:%M:%S.%g') AS last_at, max(severity) AS severity, count(*) AS members, arg_min(event_id, (observed_at, event_id)) AS first_event, array_to_string(list(event_id ORDER BY observed_at, event_id)[:64], ',') AS member_events FROM isl GROUP BY entity, island""", INCIDENTS),
    ),
}
