"""The canonical wide event, and the given tables as canonical events."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Enumerations of the envelope, and severities' ranks.
CATEGORIES = ("application", "pipeline", "data", "quality", "wap", "query", "storage", "infrastructure", "security", "observer", "metric", "lineage", "insight", "incident", "other")
OUTCOMES = ("success", "failure", "cancelled", "partial", "unknown")
SEVERITY_RANK = {"trace": 10, "debug": 20, "info": 30, "warn": 40, "error": 50, "critical": 60}
DELIVERIES = ("debug", "telemetry", "critical")
CORRELATION = ("trace_id", "span_id", "parent_span_id", "run_id", "job_id", "invocation_id", "asset_key", "partition_key", "branch", "table", "snapshot_id", "pipeline", "experiment_id", "request_id")

_S, _D, _TS = T.StringType(), T.DoubleType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: The nested envelope, as sources parse it.
ENVELOPE = _struct(
    event_id=_S, schema_version=_S, event=_S, category=_S, outcome=_S, severity=_S, delivery=_S, started_at=_S, ended_at=_S, duration_ms=_D, observed_at=_S,
    service=_struct(name=_S, version=_S, instance_id=_S, environment=_S, host=_S),
    correlation=_struct(**{k: _S for k in CORRELATION}),
    attributes=_S,
    error=_struct(code=_S, message=_S, why=_S, fix=_S, exception_type=_S, retryable=T.BooleanType(), stacktrace=_S, details=_S),
    source=_struct(producer=_S, producer_version=_S, kind=_S, raw_ref=_S, adapter=_S),
    entities=T.MapType(_S, _S), tags=T.MapType(_S, _S),
    contract=_struct(name=_S, version=T.IntegerType(), schema_id=_S, schema_hash=_S),
)

#: Columns of the flat event that the operators work on, with types.
FLAT = {
    "event_id": "string", "event": "string", "category": "string", "outcome": "string", "severity": "string", "observed_at": "timestamp_ntz", "received_at": "timestamp_ntz",
    "started_at": "timestamp_ntz", "ended_at": "timestamp_ntz", "duration_ms": "double", "service": "string", "environment": "string", "producer": "string", "run_id": "string", "job_id": "string",
    "trace_id": "string", "invocation_id": "string", "asset_key": "string", "partition_key": "string", "branch": "string", "table_name": "string", "snapshot_id": "string", "pipeline": "string",
    "error_message": "string", "rows_written": "double", "row_count": "double", "metric": "string", "value": "double", "sla_seconds": "double", "retry_of": "string", "trigger": "string",
    "base_branch": "string", "target": "string", "entities": "map<string,string>", "attributes": "string", "tags": "map<string,string>", "error": "string", "contract_id": "string", "contract_version": "int",
    "span_id": "string", "parent_span_id": "string", "experiment_id": "string", "request_id": "string", "service_version": "string", "service_instance": "string", "host": "string",
    "producer_version": "string", "source_kind": "string", "raw_ref": "string", "adapter": "string",
}


#: Columns of the envelope's service and source sections, with the section's field; the name and the producer stand apart.
SERVICE = {"environment": "environment", "service_version": "version", "service_instance": "instance_id", "host": "host"}
SOURCE = {"producer_version": "producer_version", "source_kind": "kind", "raw_ref": "raw_ref", "adapter": "adapter"}


def flat(df: DataFrame) -> DataFrame:
    """df with exactly the flat columns, those that it lacks null."""
    return df.select(*[(F.col(k) if k in df.columns else F.lit(None)).cast(t).alias(k) for k, t in FLAT.items()])


def pos() -> Column:
    """The total order of events."""
    return F.struct("observed_at", "event_id")


#: Flat columns that come from attributes, with the attribute's name.
LIFTED = {
    "rows_written": "rows_written", "row_count": "row_count", "metric": "metric", "value": "value", "sla_seconds": "freshness_sla_seconds",
    "retry_of": "retry_of", "trigger": "trigger", "base_branch": "base_branch", "target": "target",
}


def lifted(attributes: Column) -> dict[str, Column]:
    """The flat columns that an event's attributes (JSON text) hold. A summary's mean stands for its value."""
    doc = F.try_parse_json(attributes)
    kind = lambda c: "double" if FLAT[c] == "double" else "string"
    out = {c: F.try_variant_get(doc, f"$.{a}", kind(c)) for c, a in LIFTED.items()}
    out["value"] = F.coalesce(out["value"], F.try_variant_get(doc, "$.mean", "double"))
    # What is there but null or no number hides the other.
    written = F.get_json_object(attributes, "$.rows_written")
    out["row_count"] = F.when(written.isNull(), out["row_count"])
    return out


def present(c: str | Column) -> Column:
    """Null for empty strings, which count as missing."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def stamp(c: str | Column) -> Column:
    """A time as text with milliseconds."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")


def seconds_between(a: str | Column, b: str | Column) -> Column:
    """b - a in seconds, to the millisecond."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.timestamp_diff("MILLISECOND", a, b) / 1000.0


def plus_ms(c: Column, ms: Column) -> Column:
    return F.timestamp_add("MILLISECOND", ms.cast("int"), c)


def from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as terminal run events, lineitem as asset, quality, table and branch events, events as metric samples."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    o = read("orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    at = plus_ms(F.col("o_orderdate").cast("timestamp_ntz"), (key % 86400) * 1000)
    runs = o.select(
        text("o-", key).alias("event_id"), F.lit("pipeline.run").alias("event"), F.lit("pipeline").alias("category"),
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "failure").otherwise("unknown").alias("outcome"),
        F.when(F.col("o_orderstatus") == "P", "error").otherwise("info").alias("severity"),
        at.alias("observed_at"), plus_ms(at, F.lit(60000)).alias("received_at"),
        F.when(key % 5 != 0, plus_ms(at, -F.floor("o_totalprice"))).alias("started_at"), F.when(key % 7 != 0, at).alias("ended_at"), F.floor("o_totalprice").cast("double").alias("duration_ms"),
        text("svc-", cust % 10).alias("service"), F.lit("orders").alias("producer"), text("run-", key).alias("run_id"), text("job-", cust % 100).alias("job_id"), text("trace-", key).alias("trace_id"),
        text("b-", key % 20).alias("branch"), F.when(F.col("o_orderstatus") == "P", text("failed at ", F.col("o_orderpriority"))).alias("error_message"),
        F.when((F.col("o_orderstatus") == "P") & (key % 3 == 0), text("run-", key - 1)).alias("retry_of"), F.col("o_orderpriority").alias("trigger"),
    )
    n = F.col("l_linenumber")
    at = plus_ms(F.col("l_shipdate").cast("timestamp_ntz"), (F.col("l_orderkey") % 86400) * 1000 + n)
    name = F.when(n == 4, "quality.check").when(n == 6, "wap.promote").when(n == 7, "table.read").when((n == 2) & (F.col("l_partkey") % 4 == 0), "wap.branch.create").otherwise("asset.materialize")
    lines = read("lineitem").select(
        F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("event_id"), name.alias("event"),
        F.when(n == 4, "quality").when(n == 6, "storage").when(n == 7, "query").otherwise("data").alias("category"),
        F.when(F.col("l_returnflag") == "R", "failure").when(F.col("l_returnflag") == "A", "success").otherwise("unknown").alias("outcome"),
        F.when(F.col("l_returnflag") == "R", "warn").otherwise("info").alias("severity"),
        at.alias("observed_at"), plus_ms(at, F.lit(120000)).alias("received_at"),
        text("svc-", F.col("l_suppkey") % 10).alias("service"), F.lit("lines").alias("producer"),
        F.when(F.col("l_suppkey") % 3 != 0, text("run-", F.col("l_orderkey"))).alias("run_id"), text("trace-", F.col("l_orderkey")).alias("trace_id"),
        text("part-", F.col("l_partkey")).alias("asset_key"), F.col("l_linestatus").alias("partition_key"),
        F.when(n.isin(2, 6), text("b-", F.col("l_partkey") % 200)).alias("branch"), F.when(n >= 6, text("t-", F.col("l_suppkey"))).alias("table_name"), F.when(n == 6, text("s-", F.col("l_orderkey"))).alias("snapshot_id"),
        F.when(n % 2 == 1, F.col("l_quantity")).alias("rows_written"), F.col("l_quantity").alias("row_count"),
        F.when(F.col("l_partkey") % 2 == 0, F.lit(30 * 86400.0)).alias("sla_seconds"), F.when(n == 6, F.lit("main")).alias("target"), F.when(n == 2, F.lit("main")).alias("base_branch"),
    )
    at = F.date_trunc("MILLISECOND", F.col("ts")).cast("timestamp_ntz")
    samples = read("events").select(
        text("e-", F.col("event_id")).alias("event_id"), F.concat(F.lit("metric."), "event_type").alias("event"), F.lit("metric").alias("category"), F.lit("unknown").alias("outcome"),
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("severity"), at.alias("observed_at"), plus_ms(at, F.lit(1000)).alias("received_at"),
        text("app-", F.col("user_id") % 5).alias("service"), F.lit("app").alias("producer"), text("user-", F.col("user_id")).alias("trace_id"),
        F.col("event_type").alias("metric"), F.col("value"), F.when(F.col("event_type") == "error", F.concat(F.lit("error "), "props")).alias("error_message"),
    )
    return flat(runs).union(flat(lines)).union(flat(samples))


#: The same mapping in SQL, for the queries' twins: a list of common table expressions that ends with `ev`.
SQL = """
o AS (SELECT *, o_orderdate::TIMESTAMP + to_milliseconds((o_orderkey % 86400) * 1000) AS tm FROM orders),
l AS (SELECT *, l_shipdate::TIMESTAMP + to_milliseconds((l_orderkey % 86400) * 1000 + l_linenumber) AS tm FROM lineitem),
e AS (SELECT *, date_trunc('millisecond', ts)::TIMESTAMP AS tm FROM events),
raw AS (
SELECT 'o-' || o_orderkey AS event_id, 'pipeline.run' AS event, 'pipeline' AS category, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failure' ELSE 'unknown' END AS outcome,
 CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'info' END AS severity, tm AS observed_at, tm + INTERVAL 60 SECOND AS received_at,
 CASE WHEN o_orderkey % 5 <> 0 THEN tm - to_milliseconds(CAST(floor(o_totalprice) AS BIGINT)) END AS started_at, CASE WHEN o_orderkey % 7 <> 0 THEN tm END AS ended_at, floor(o_totalprice) AS duration_ms,
 'svc-' || (o_custkey % 10) AS service, 'orders' AS producer, 'run-' || o_orderkey AS run_id, 'job-' || (o_custkey % 100) AS job_id, 'trace-' || o_orderkey AS trace_id,
 NULL AS asset_key, NULL AS partition_key, 'b-' || (o_orderkey % 20) AS branch, NULL AS table_name, NULL AS snapshot_id, CASE WHEN o_orderstatus = 'P' THEN 'failed at ' || o_orderpriority END AS error_message,
 CAST(NULL AS DOUBLE) AS rows_written, CAST(NULL AS DOUBLE) AS row_count, NULL AS metric, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS sla_seconds,
 CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'run-' || (o_orderkey - 1) END AS retry_of, o_orderpriority AS trigger, NULL AS base_branch, NULL AS target FROM o
UNION ALL
SELECT concat_ws('-', 'l', l_orderkey, l_linenumber, l_partkey, l_suppkey), CASE WHEN l_linenumber = 4 THEN 'quality.check' WHEN l_linenumber = 6 THEN 'wap.promote' WHEN l_linenumber = 7 THEN 'table.read'
  WHEN l_linenumber = 2 AND l_partkey % 4 = 0 THEN 'wap.branch.create' ELSE 'asset.materialize' END, CASE l_linenumber WHEN 4 THEN 'quality' WHEN 6 THEN 'storage' WHEN 7 THEN 'query' ELSE 'data' END,
 CASE l_returnflag WHEN 'R' THEN 'failure' WHEN 'A' THEN 'success' ELSE 'unknown' END, CASE WHEN l_returnflag = 'R' THEN 'warn' ELSE 'info' END, tm, tm + INTERVAL 120 SECOND, NULL, NULL, NULL,
 'svc-' || (l_suppkey % 10), 'lines', CASE WHEN l_suppkey % 3 <> 0 THEN 'run-' || l_orderkey END, NULL, 'trace-' || l_orderkey, 'part-' || l_partkey, l_linestatus,
 CASE WHEN l_linenumber IN (2, 6) THEN 'b-' || (l_partkey % 200) END, CASE WHEN l_linenumber >= 6 THEN 't-' || l_suppkey END, CASE WHEN l_linenumber = 6 THEN 's-' || l_orderkey END, NULL,
 CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END, l_quantity, NULL, NULL, CASE WHEN l_partkey % 2 = 0 THEN 2592000.0 END, NULL, NULL, CASE WHEN l_linenumber = 2 THEN 'main' END, CASE WHEN l_linenumber = 6 THEN 'main' END FROM l
UNION ALL
SELECT 'e-' || event_id, 'metric.' || event_type, 'metric', 'unknown', CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END, tm, tm + INTERVAL 1 SECOND, NULL, NULL, NULL, 'app-' || (user_id % 5), 'app', NULL, NULL,
 'user-' || user_id, NULL, NULL, NULL, NULL, NULL, CASE WHEN event_type = 'error' THEN 'error ' || props END, NULL, NULL, event_type, value, NULL, NULL, NULL, NULL, NULL FROM e
),
dedup AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_at, outcome, row_count) = 1),
link AS (SELECT trace_id, min(run_id) AS linked FROM dedup WHERE trace_id IS NOT NULL AND run_id IS NOT NULL GROUP BY trace_id),
ev AS (SELECT d.* REPLACE (coalesce(d.run_id, link.linked) AS run_id), split_part(event, '.', -1) AS verb FROM dedup d LEFT JOIN link USING (trace_id))
"""


def sql(body: str, ctes: str = "") -> str:
    """A twin: the mapping, further common table expressions, the query. ts(x) in them is a time as text."""
    text = f"WITH {SQL}{', ' + ctes if ctes else ''} {body}"
    return re.sub(r"\bts\(([^()]*)\)", r"strftime(\1, '%Y-%m-%d %H:%M:%S.%g')", text)
