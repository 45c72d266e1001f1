"""Arrival, validation, privacy and sampling over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import json_values as j
from eventloom.operators import baselines as b
from eventloom.operators import correlate as c
from eventloom.operators import privacy as pv
from eventloom.operators import projections as p
from eventloom.operators import sampling as s
from eventloom.operators import validate as v
from eventloom.plans.common import over_events, texted
from eventloom.plans.graph_queries import ROLES
from eventloom.schema import from_tables, sql

ORDERS_TWICE = "raw2 AS (SELECT * FROM raw UNION ALL SELECT * REPLACE (received_at + INTERVAL 5 SECOND AS received_at) FROM raw WHERE event = 'pipeline.run' UNION ALL SELECT * REPLACE (received_at + INTERVAL 9 SECOND AS received_at, 'cancelled' AS outcome) FROM raw WHERE event = 'pipeline.run' AND outcome = 'failure')"


def _redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, runs delivered twice, failed runs a third time with another outcome."""
    ev = from_tables(spark, sf_dir)
    runs = ev.where("event = 'pipeline.run'")
    late = lambda df, k: df.withColumn("received_at", F.timestamp_add("SECOND", F.lit(k), "received_at"))
    return ev.union(late(runs, 5)).union(late(runs.where("outcome = 'failure'").withColumn("outcome", F.lit("cancelled")), 9).select(ev.columns))


def odd_entities(ev: DataFrame) -> DataFrame:
    """Ids that don't conform, or are of no known namespace, made of the tables' names."""
    forms = F.array(*[F.concat(F.lit(a), F.col("table_name"), F.lit(b)) for a, b in (("zzz://", ""), ("my-ns://", ""), ("table://", " x"), ("Table://", ""), ("", ""))])
    return ev.where("table_name IS NOT NULL").select("producer", F.explode(forms).alias("entity_id"))


def odd_urls(n: Column, url: Column) -> Column:
    """URLs with credentials, secret and harmless query names, a password with signs, a bad port, a user alone."""
    bare = F.regexp_replace(url, r"[?#].*", "")
    user = lambda who: F.regexp_replace(bare, "://", f"://{who}@")
    forms = (
        F.concat(user("user:pw"), F.lit("?access_token=abc&tokenizer=a")), F.concat(bare, F.lit("?q=a%20b&Api-Key=x&empty=&#part")), F.concat(bare, F.lit("?")), user("user:p:w@x"),
        F.regexp_replace(bare, "^(https?://[^/]+)", "$1:abc"), F.concat(user("me"), F.lit("?secretary=z")),
    )
    out = forms[-1]
    for k, form in enumerate(forms[:-1]):
        out = F.when(n % len(forms) == k, form).otherwise(out)
    return out


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-2, AGG-13: status counts by producer."""
    return c.arrivals(_redelivered(spark, sf_dir)).groupBy("producer", "status").agg(F.count("*").alias("n"))


def docs_column(f) -> object:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-9 over orders as JSON: the status is a number, a text of digits, null or not there, by the key; the price may be an int or a float."""
    key = F.col("o_orderkey")
    status = F.when(key % 6 == 0, '"n":5,').when(key % 6 == 1, '"n":"123",').when(key % 6 == 2, '"n":null,').when(key % 6 == 3, "").when(key % 6 == 4, '"n":1.5,').otherwise('"n":7,')
    body = F.when(key % 11 == 0, F.lit("[1]")).otherwise(F.concat(F.lit("{"), status, F.lit('"s":"5","price":'), F.when(key % 2 == 0, "12").otherwise("12.25"), F.lit("}")))
    ev = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.cast("string").alias("event_id"), F.lit("order").alias("event"), body.alias("attributes"), F.when(key % 4 == 3, 1).alias("contract_version"))
    rows = [("order", 1, "s", "string", True), ("order", 2, "n", "int", True), ("order", 2, "s", "string", True), ("order", 2, "price", "float", False), ("order", 2, "tax", "float", False)]
    table = spark.createDataFrame(rows, "event string, version int, field string, type string, required boolean")
    return texted(v.contract_violations(ev, table).select("event_id", "violations"))


def _drifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-12 for each of seven groups of suppliers: lines with status F as the old version, with status O as the new one."""
    old, new = F.col("l_linestatus") == "F", F.col("l_linestatus") == "O"
    tax = F.when(new, "0.5").otherwise("0")
    flag = F.when(F.col("l_returnflag") != "R", F.concat(F.lit(',"flag":"'), "l_returnflag", F.lit('"'))).otherwise("")
    big = F.when(new & (F.col("l_quantity") > 25), ',"big":true').otherwise("")
    odd = F.col("l_quantity") % 2 == 1
    mixed = lambda side: F.when(side & odd, '"x"').otherwise("1")
    unions = F.concat(F.lit(',"wider":'), mixed(new), F.lit(',"narrower":'), mixed(old))
    body = F.concat(F.lit('{"quantity":'), F.col("l_quantity").cast("long").cast("string"), F.lit(',"tax":'), tax, unions, flag, big, F.lit("}"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(old | new)
    seen = v.observed_fields(rows.select(F.concat_ws("|", (F.col("l_suppkey") % 7).cast("string"), "l_linestatus").alias("event"), body.alias("attributes")))
    seen = seen.select(F.concat_ws("|", F.split_part("event", F.lit("|"), F.lit(1)), "field").alias("field"), F.split_part("event", F.lit("|"), F.lit(2)).alias("version"), "type", "required")
    out = v.drift(seen.where("version = 'F'"), seen.where("version = 'O'"))
    return out.select(F.split_part("field", F.lit("|"), F.lit(1)).alias("mode"), F.split_part("field", F.lit("|"), F.lit(2)).alias("field"), "change", "breaking")


def _spoilt(ev: DataFrame) -> DataFrame:
    """Events of which every twelfth, by the number in its id, breaks one rule, the next one another."""
    k = F.coalesce(F.split_part("event_id", F.lit("-"), F.lit(2)).try_cast("long"), F.lit(0)) % 12
    bad = lambda n, c, value: F.when(k == n, value).otherwise(F.col(c)).alias(c)
    changed = {c: bad(n, c, F.lit(x)) for n, c, x in ((1, "event", "Bad Name"), (2, "category", "asset"), (3, "outcome", "timeout"), (4, "severity", "warning"), (5, "service", ""), (6, "error_message", ""))}
    ms = F.timestamp_diff("MILLISECOND", "started_at", "ended_at").cast("double")
    ms = F.coalesce(F.when(k == 7, ms + 3).otherwise(ms + 2), F.col("duration_ms"))
    return ev.select(*[ms.alias(c) if c == "duration_ms" else changed.get(c, F.col(c)) for c in ev.columns])


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows to store: some without a UUID, some whose time is none, run ids of 120 to 129 characters."""
    key = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.when(key % 5 == 0, key.cast("string")).otherwise(F.substring(F.sha2(key.cast("string"), 256), 1, 32)).alias("event_id"),
        F.when(key % 7 == 0, "yesterday").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("observed_at"), F.repeat(F.lit("r"), (key % 10 + 120).cast("int")).alias("run_id"),
    )


RULES = [s.Rule("quiet_metrics", event="metric.*", rate=0.25), s.Rule("drop_failures", event="quality.*", outcome="failure", rate=0.5), s.Rule("assets", event="asset.*", rate=0.1), s.Rule("slow", min_duration_ms=100000.0, rate=1.0)]
FRACTION = "(CAST('0x' || substr(sha256({0}), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551616.0)"
KEY = "coalesce(run_id, trace_id, '')"

QUERIES = {
    "join1_trace_links": (
        lambda spark, sf_dir: c.link_traces(c.accepted(from_tables(spark, sf_dir))).select("event_id", "run_id"),
        sql("SELECT event_id, run_id FROM ev"),
    ),
    "join2_arrivals": (
        arrivals,
        sql("""SELECT producer, CASE WHEN rn = 1 THEN 'accepted' WHEN said = fo THEN 'duplicate' ELSE 'conflict' END AS status, count(*) AS n
            FROM (SELECT *, row_number() OVER w AS rn, (outcome, row_count, partition_key, observed_at) AS said, first_value((outcome, row_count, partition_key, observed_at)) OVER w AS fo FROM raw2 WINDOW w AS (PARTITION BY event_id ORDER BY received_at, outcome, row_count)) GROUP BY ALL""", ORDERS_TWICE),
    ),
    "val7_agg14_correlation": (
        lambda spark, sf_dir: from_tables(spark, sf_dir).groupBy(F.coalesce(c.correlation_method(), F.lit("uncorrelated")).alias("method")).agg(F.count("*").alias("n")),
        sql("SELECT CASE WHEN run_id IS NOT NULL THEN 'explicit_run_id' WHEN trace_id IS NOT NULL THEN 'trace_id' ELSE 'uncorrelated' END AS method, count(*) AS n FROM raw GROUP BY 1"),
    ),
    "val1_envelope_problems": (
        lambda spark, sf_dir: texted((df := _spoilt(from_tables(spark, sf_dir))).select("event_id", v.envelope_problems(df).alias("problems")).where("size(problems) > 0")),
        sql("""SELECT event_id, concat_ws(',', CASE WHEN k = 1 THEN 'event' END, CASE WHEN k = 2 THEN 'category' END, CASE WHEN k = 3 THEN 'outcome' END, CASE WHEN k = 4 THEN 'severity' END,
            CASE WHEN k = 5 THEN 'service' END, CASE WHEN k = 6 THEN 'error_message' END, CASE WHEN k = 7 AND started_at IS NOT NULL AND ended_at IS NOT NULL THEN 'duration_ms' END) AS problems
            FROM (SELECT *, coalesce(TRY_CAST(split_part(event_id, '-', 2) AS BIGINT), 0) % 12 AS k FROM raw) WHERE k BETWEEN 1 AND 6 OR k = 7 AND started_at IS NOT NULL AND ended_at IS NOT NULL"""),
    ),
    "val2_storage_problems": (
        lambda spark, sf_dir: texted((df := _stored(spark, sf_dir)).select("event_id", v.storage_problems(df).alias("problems"))),
        """SELECT CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE lower(substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 32)) END AS event_id,
            concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'event_id' END, CASE WHEN o_orderkey % 7 = 0 THEN 'observed_at' END, CASE WHEN 120 + o_orderkey % 10 > 128 THEN 'run_id' END) AS problems FROM orders""",
    ),
    "val3_batches": (
        lambda spark, sf_dir: v.batch_status(from_tables(spark, sf_dir).withColumn("batch", F.date_format("received_at", "yyyy-MM-dd")), "batch", 40),
        sql("SELECT strftime(received_at, '%Y-%m-%d') AS batch, count(*) AS n, count(*) <= 40 AS accepted FROM raw GROUP BY 1"),
    ),
    "val8_entity_conformance": (
        over_events(lambda ev: v.entity_conformance(p.with_entities(ev).select("producer", "entity_id").union(odd_entities(ev)))),
        sql("""SELECT producer, CASE WHEN regexp_matches(entity_id, '^[a-z][a-z0-9]*://[^\\s]+$') AND split_part(entity_id, '://', 1) IN ('run', 'asset', 'table', 'branch', 'snapshot', 'service') THEN split_part(entity_id, '://', 1) ELSE 'custom' END AS kind,
            count(*) AS n, count(*) FILTER (NOT regexp_matches(entity_id, '^[a-z][a-z0-9]*://[^\\s]+$')) AS violations
            FROM (SELECT producer, entity_id FROM roles UNION ALL SELECT producer, replace(pattern, '?', table_name) FROM ev, (VALUES ('zzz://?'), ('my-ns://?'), ('table://? x'), ('Table://?'), ('?')) x (pattern) WHERE table_name IS NOT NULL)
            GROUP BY ALL""", ROLES),
    ),
    "val9_contract_violations": (
        contracts,
        """SELECT CAST(o_orderkey AS VARCHAR) AS event_id, CASE WHEN o_orderkey % 11 = 0 THEN 'not_object' WHEN o_orderkey % 4 = 3 THEN '' WHEN o_orderkey % 6 IN (1, 4) THEN 'type:n' WHEN o_orderkey % 6 IN (2, 3) THEN 'missing:n' ELSE '' END AS violations FROM orders""",
    ),
    "val10_registry": (
        lambda spark, sf_dir: v.registry(spark.read.parquet(f"{sf_dir}/events.parquet").select(
            F.concat_ws("/", "event_type", F.col("user_id") % 7).alias("schema_id"), F.concat(F.lit('{"z": 1, "user": '), "user_id", F.lit(', "a": [2, 1]}')).alias("schema_json"), F.col("ts").alias("observed_at"), "event_id")),
        """SELECT event_type || '/' || (user_id % 7) AS schema_id, arg_min('{"z": 1, "user": ' || user_id || ', "a": [2, 1]}', (ts, event_id)) AS schema_json,
            sha256(arg_min('{"a":[2,1],"user":' || user_id || ',"z":1}', (ts, event_id))) AS schema_hash FROM events GROUP BY 1""",
    ),
    "val12_contract_drift": (
        lambda spark, sf_dir: _drifts(spark, sf_dir),
        """WITH l AS (SELECT CAST(l_suppkey % 7 AS VARCHAR) AS mode, l_linestatus AS v, l_quantity, l_tax, l_returnflag FROM lineitem),
            f AS (SELECT mode, v, unnest([{'field': 'quantity', 'type': 'int', 'there': true}, {'field': 'tax', 'type': CASE WHEN v = 'O' THEN 'float' ELSE 'int' END, 'there': true},
              {'field': 'flag', 'type': 'string', 'there': l_returnflag <> 'R'}, {'field': 'big', 'type': 'bool', 'there': v = 'O' AND l_quantity > 25},
              {'field': 'wider', 'type': CASE WHEN v = 'O' AND l_quantity % 2 = 1 THEN 'string' ELSE 'int' END, 'there': true}, {'field': 'narrower', 'type': CASE WHEN v = 'F' AND l_quantity % 2 = 1 THEN 'string' ELSE 'int' END, 'there': true}]) AS x FROM l),
            n AS (SELECT mode, v, count(*) AS n FROM l GROUP BY ALL),
            t AS (SELECT mode, v, x.field AS field, string_agg(DISTINCT x.type, '|' ORDER BY x.type) AS type, count(*) AS c FROM f WHERE x.there GROUP BY mode, v, x.field),
            r AS (SELECT t.*, c = n AS required FROM t JOIN n USING (mode, v)),
            j AS (SELECT coalesce(a.mode, b.mode) AS mode, coalesce(a.field, b.field) AS field, a.type AS t0, b.type AS t1, a.required AS r0, b.required AS r1
              FROM (SELECT * FROM r WHERE v = 'F') a FULL JOIN (SELECT * FROM r WHERE v = 'O') b ON a.mode = b.mode AND a.field = b.field),
            c AS (SELECT mode, field, unnest([CASE WHEN t1 IS NULL THEN 'removed' WHEN t0 IS NULL AND r1 THEN 'new_required' WHEN t0 IS NULL THEN 'new_optional' END,
              CASE WHEN t0 = t1 THEN NULL WHEN list_contains(string_split(t1, '|'), t0) OR (t0 = 'int' AND t1 = 'float') THEN 'widened' WHEN t0 <> t1 THEN 'type_changed' END,
              CASE WHEN NOT r0 AND r1 THEN 'now_required' WHEN r0 AND NOT r1 THEN 'now_optional' END]) AS change FROM j)
            SELECT mode, field, change, change IN ('removed', 'new_required', 'type_changed', 'now_required') AS breaking FROM c WHERE change IS NOT NULL""",
    ),
    "val4_normal_json": (
        lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", j.normal_json(F.concat(F.repeat(F.lit('{"a": '), (F.col("user_id") % 12).cast("int")), "props", F.repeat(F.lit("}"), (F.col("user_id") % 12).cast("int")))).alias("attributes")),
        """SELECT event_id, CASE WHEN k < 8 THEN repeat('{"a":', k) || replace(props, ' ', '') || repeat('}', k) ELSE repeat('{"a":', 8) || '{"_observe_truncated":"max_depth 8 exceeded"}' || repeat('}', 8) END AS attributes FROM (SELECT *, CAST(user_id % 12 AS INTEGER) AS k FROM events)""",
    ),
    "val6_trimmed": (
        docs_column(lambda d: texted(j.trimmed(d.select("doc_id", F.create_map(F.lit("text"), F.coalesce(F.regexp_replace("text", "[^A-Za-z. ]", "x"), F.lit("")), F.lit("source"), F.col("source")).alias("attributes")), limit=16 * 1024).select("doc_id", "trimmed", F.length(F.element_at("attributes", "text")).alias("chars")))),
        """SELECT doc_id, CASE WHEN big THEN 'text' ELSE '' END AS trimmed, CASE WHEN big THEN 1024 + 12 ELSE n END AS chars FROM (SELECT doc_id, length(coalesce(text, '')) AS n, length(coalesce(text, '')) + length(source) + 23 > 16384 AS big FROM documents)""",
    ),
    "val14_secret_values": (
        docs_column(lambda d: d.select("doc_id", F.sha2(pv.redact_value(F.coalesce("text", F.lit(""))), 256).alias("redacted"))),
        r"SELECT doc_id, sha256(CASE WHEN regexp_matches(text, '(?i)Bearer\s+[A-Za-z0-9\-._~+/]{8,}={0,2}') OR regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') OR regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b') OR regexp_matches(text, 'eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}') THEN '[REDACTED]' ELSE coalesce(text, '') END) AS redacted FROM documents",
    ),
    "val13_secret_keys": (
        docs_column(lambda d: d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\w+) ?= ?\"?\w+"), 1)).alias("key")).withColumn("secret", pv.is_secret_key(F.col("key"))).groupBy("key", "secret").agg(F.count("*").alias("n"))),
        r"""SELECT key, regexp_matches(lower(regexp_replace(key, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '(^|_)(password|passwd|secret|token|api_key|apikey|authorization|cookie|set_cookie|client_secret|access_key|private_key|credentials)(_|$)') AS secret, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '([\p{L}\p{N}_]+) ?= ?"?[\p{L}\p{N}_]+', 1)) AS key FROM documents) GROUP BY ALL""",
    ),
    "val15_urls": (
        lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", pv.strip_url(odd_urls(F.col("page_id"), F.col("url"))).alias("url")),
        """SELECT page_id, CASE page_id % 6 WHEN 0 THEN replace(url, '://', '://user:***@') || '?access_token=%5BREDACTED%5D&tokenizer=a' WHEN 1 THEN url || '?q=a+b&Api-Key=%5BREDACTED%5D&empty=#part' WHEN 2 THEN url
            WHEN 3 THEN replace(url, '://', '://user:***@') WHEN 4 THEN '[REDACTED]' ELSE replace(url, '://', '://me:***@') || '?secretary=z' END AS url FROM (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS url FROM pages)""",
    ),
    "src10_sql_fingerprints": (
        docs_column(lambda d: d.withColumn("q", F.concat(F.lit("SELECT /* c */ * FROM t -- x\nWHERE id = "), F.col("doc_id").cast("string"), F.lit(" AND s = '"), F.col("source"), F.lit("' AND lang = "), F.col("lang"))).groupBy(pv.sql_fingerprint(F.col("q")).alias("fingerprint"), pv.sql_class(F.col("q")).alias("class")).agg(F.count("*").alias("n"))),
        "SELECT substr(sha256('SELECT * FROM t WHERE id = ? AND s = ? AND lang = ' || lang), 1, 16) AS fingerprint, 'select' AS class, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1",
    ),
    "val16_sampling": (
        over_events(lambda ev: ev.where(s.keep_sampled({"info": 0.3, "warn": 0.6})).select("event_id")),
        sql(f"SELECT event_id FROM ev WHERE {FRACTION.format(f'event || chr(124) || {KEY}')} < CASE severity WHEN 'info' THEN 0.3 WHEN 'warn' THEN 0.6 ELSE 1.0 END"),
    ),
    "val17_policy_sampling": (
        over_events(lambda ev: s.decide(ev, RULES).groupBy("event", "keep", "reason").agg(F.count("*").alias("n"))),
        sql(f"""SELECT event, keep, reason, count(*) AS n FROM (SELECT event, CASE WHEN rule IS NULL THEN true ELSE safe OR f < rate END AS keep, CASE WHEN rule IS NULL THEN 'no_rule' WHEN safe THEN 'kept_always' ELSE rule END AS reason FROM (
            SELECT *, outcome = 'failure' AND rule <> 'drop_failures' AS safe, {FRACTION.format(f"event || '|' || {KEY} || '|' || rule")} AS f, CASE rule WHEN 'quiet_metrics' THEN 0.25 WHEN 'drop_failures' THEN 0.5 WHEN 'assets' THEN 0.1 ELSE 1.0 END AS rate FROM (
            SELECT *, CASE WHEN event LIKE 'metric.%' THEN 'quiet_metrics' WHEN event LIKE 'quality.%' AND outcome = 'failure' THEN 'drop_failures' WHEN event LIKE 'asset.%' THEN 'assets' WHEN duration_ms >= 100000 THEN 'slow' END AS rule FROM ev))) GROUP BY ALL"""),
    ),
    "val18_tail_sampling": (
        over_events(lambda ev: s.tail_sample(ev, 400000.0).select("event_id")),
        sql("""SELECT event_id FROM (SELECT *, max(CASE WHEN event = 'pipeline.run' AND outcome <> 'unknown' THEN {'a': observed_at, 'b': event_id, 'c': outcome, 'd': duration_ms} END) OVER (PARTITION BY run_id) AS t FROM ev) WHERE run_id IS NULL OR t IS NULL OR t.c = 'failure' OR t.d >= 400000"""),
    ),
    "val13_nested_redaction": (
        lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", pv.redact_json(
            F.concat(F.lit('{"list":[{"accessToken":"'), "event_type", F.lit('"},'), "user_id", F.lit('],"user":{"Name":"u'), "user_id", F.lit('","plain":"v"},"monkey":"Bearer '), F.repeat("event_type", F.lit(3)), F.lit('"}')),
            key_patterns=("^lis$",), paths=("user.name",)).alias("attributes")),
        """SELECT event_id, '{"list":[{"accessToken":"[REDACTED]"},' || user_id || '],"user":{"Name":"[REDACTED]","plain":"v"},"monkey":"[REDACTED]"}' AS attributes FROM events""",
    ),
    "agg12_summary_events": (
        over_events(lambda ev: b.summary_events(b.summaries(ev)).select("event", "observed_at", "service", "metric", "value")),
        sql("""SELECT 'metric.summary' AS event, strftime(date_trunc('minute', observed_at), '%Y-%m-%d %H:%M:%S.%g') AS observed_at, service, metric, round(avg(value), 6) AS value
            FROM ev WHERE event LIKE 'metric.%' AND value IS NOT NULL GROUP BY date_trunc('minute', observed_at), metric, service, run_id, asset_key"""),
    ),
}
