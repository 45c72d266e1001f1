"""The questions by name, archives, sources by name, contracts, retention, rebuilt insights: on small rows and on a part of the tables."""

import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.operators import correlate, insights, lifecycle, maintenance, projections, questions, validate
from eventloom.schema import from_tables
from eventloom.sources import payloads as s
from tests.test_projections import at, events

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ev(spark):
    return correlate.canonical(from_tables(spark, DIR)).where("xxhash64(coalesce(run_id, '')) % 50 = 0").cache()


def test_questions_by_name(spark, ev):
    q = questions.Questions(ev)
    run = ev.where("outcome = 'failure' AND event = 'pipeline.run'").first()
    first = q.search_events("FAILED", limit=2).collect()
    after = questions.cursor(str(first[1].observed_at), first[1].event_id)
    assert not {r.event_id for r in first} & {r.event_id for r in q.search_events("FAILED", limit=2, after=after).collect()}
    assert q.get_event(run.event_id).first().event_id == run.event_id
    assert q.get_event("none").count() == 0
    runs = [r.run_id for r in q.list_runs(3).collect()]
    assert [r.run_id for r in q.list_runs(3, runs[1]).collect()][0] == runs[2]
    assert q.get_run(run.run_id).first().status == "failure"
    timeline = q.run_timeline(run.run_id).collect()
    assert [r.rn for r in timeline] == list(range(1, len(timeline) + 1))
    assert "Run" in {r.label for r in timeline}
    assert run.event_id in {r.event_id for r in q.run_failures(run.run_id).collect()}
    assert {r.run_id for r in q.run_changes(run.run_id, 720.0).collect()} <= {run.run_id}
    assert {r.src for r in q.run_impact(run.run_id).collect()} <= {f"run://{who}/{run.run_id}" for who in ("orders", "lines")}
    assert q.compare_runs(runs[0], runs[1]).count() == 1
    assert {r.run_id for r in q.investigate().collect()} == {r.run_id for r in q.list_runs(1000, status="failure").collect()}
    assert q.asset_health("2001-01-01").where("breached").count() > 0
    assert q.lineage().count() > 0
    assert {r.kind for r in q.event_provenance(run.event_id).collect()} >= {"run", "entity"}
    assert all(r.state == "open" for r in q.list_insights(5, state="open").collect())
    one = q.list_incidents(1).first()
    assert q.incident(one.first_event).count() >= 1
    asset = ev.where("asset_key is not null").first().asset_key
    assert [r.rn for r in q.asset_history(asset, 2).orderBy("rn").collect()][0] == 1
    with pytest.raises(ValueError, match="limit"):
        q.list_runs(1001)


def test_archive_and_restore(spark, ev):
    path = tempfile.mkdtemp() + "/archive"
    some = ev.where("received_at BETWEEN '1995-01-01' AND '1996-12-31'")
    s.archive(ev, path, "1995-01-01", "1996-12-31")
    back = s.restored(spark, path, ev)
    assert back.count() == some.count() > 0
    again = correlate.arrivals(ev.union(back.withColumn("received_at", F.timestamp_add("DAY", F.lit(1), "received_at"))))
    assert {r.status for r in again.join(back.select("event_id"), "event_id").collect()} == {"accepted", "duplicate"}


def test_sources_by_name_and_enrichers(spark):
    p = spark.createDataFrame([("a", '{"run_id": "r"}', None), ("b", "{cut", None)], "payload_id string, payload string, received_at timestamp_ntz")
    events_of, errors_of = s.SOURCES["generic"]
    assert events_of(p).first().run_id == "r"
    assert [(r.payload_id, r.code) for r in errors_of(p).collect()] == [("b", "SCHEMA_INVALID")]
    for name, (events_of, errors_of) in s.SOURCES.items():
        assert events_of(p.limit(0)).count() == errors_of(p.limit(0)).count() == 0, name

    def broken(df):
        return df.withColumn("x", F.col("no_such_column"))

    out, left_out = s.enriched(s.generic(p), [broken, lambda df: df.withColumn("environment", F.lit("prod"))])
    assert out.first().environment == "prod"
    assert left_out == ["broken: UNRESOLVED_COLUMN.WITH_SUGGESTION"]


def test_ingested_attributes_reach_the_rules(spark):
    line = '{{"event_id":"e{0}","schema_version":"2.0","event":"asset.materialize","category":"data","outcome":"success","severity":"info","delivery":"telemetry","observed_at":"2024-01-0{1}T00:00:00Z","service":{{"name":"s"}},"correlation":{{"asset_key":"a"}},"attributes":{{"rows_written":{2},"freshness_sla_seconds":86000}}}}'
    body = "[" + ",".join(line.format(i, i + 1, n) for i, n in enumerate([10] * 6 + [100])) + "]"
    got = s.accepted(s.canonical_json(spark.createDataFrame([("p", body)], "payload_id string, payload string")))
    found = {(r.rule, r.event_id) for r in insights.findings(got).collect()}
    assert ("volume-spike", "e6") in found
    assert ("freshness-breach", "e1") in found
    assert len(found) == 7


def test_contract_of_a_struct_and_drift(spark):
    old = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.StringType())])
    new = T.StructType([T.StructField("a", T.DoubleType(), False), T.StructField("b", T.StringType(), True, {"sensitive": True}), T.StructField("c", T.ArrayType(T.LongType()))])
    a, b = validate.contract_of(spark, "e", 1, old), validate.contract_of(spark, "e", 2, new)
    assert {(r.field, r.change, r.breaking) for r in validate.drift(a, b).collect()} == {("a", "widened", False), ("b", "sensitive_changed", False), ("c", "new_optional", False)}
    ev = spark.createDataFrame([("1", "e", '{"a": 1, "c": [1]}'), ("2", "e", '{"a": "1"}'), ("3", "e", "no json"), ("4", "e", None)], "event_id string, event string, attributes string")
    got = {r.event_id: r.violations for r in validate.contract_violations(ev, a.union(b).select("event", "version", "field", "type", "required")).collect()}
    assert got == {"1": [], "2": ["type:a"], "3": ["not_object"], "4": ["missing:a"]}
    assert validate.contract_violations(ev, b, "strict").count() == 1


def test_lineage_is_cut_by_side(spark):
    edges = spark.createDataFrame([(f"run://p/r{i}", "asset://a", "produces", "explicit") for i in range(5)] + [("asset://a", "asset://b", "part_of", "guess")], "src string, dst string, type string, method string")
    got = {(r.entity_id, r.direction, r.neighbour, r.kind, r.truncated) for r in questions.lineage(edges, cap=3).collect()}
    want = {("asset://a", "upstream", f"run://p/r{i}", "runtime", True) for i in range(3)}
    assert got == want | {("asset://a", "downstream", "asset://b", "guess", False), ("asset://b", "upstream", "asset://a", "guess", False)}


def test_kinds_of_roles_and_first_errors_by_number(spark):
    ev = events(spark, [{"entities": {"widget": "widget://x", "quality_suite": "quality://s", "asset": "asset://a"}}])
    assert {r.entity_id: r.kind for r in projections.entities(ev).where("entity_id NOT LIKE 'service%'").collect()} == {"widget://x": "widget", "quality://s": "quality", "asset://a": "asset"}
    payloads = spark.createDataFrame([("p", "[]", None)], "payload_id string, payload string, received_at timestamp_ntz")
    errors = spark.createDataFrame([("p", "10", "B", "b"), ("p", "2", "A", "a")], "payload_id string, `index` string, code string, message string")
    assert s.quarantined(payloads, errors, payloads.limit(0), "canonical").first().code == "A"


def test_summaries_of_timelines(spark):
    rows = [
        ("ingestion.load", '{"rows_out": 1234567.0}', "1,234,567 rows"), ("ingestion.load", '{"rows_in": 0}', "0 rows"), ("quality.validate", '{"checks_total": 4, "checks_passed": 3}', "3/4 checks passed"),
        ("quality.validate", '{"suite": "s"}', "s"), ("quality.check", '{"check_name": "c", "passed": true}', "c passed"), ("quality.check", None, "failed"), ("wap.promote", '{"branch": "b", "target": "main"}', "b -> main"),
        ("wap.branch.create", '{"branch": "b"}', "branch b"), ("pipeline.step", '{"step_key": "k"}', "k"), ("pipeline.run", '{"job": "j"}', "j"), ("other.thing", None, None),
    ]
    ev = events(spark, [{"event": e, "attributes": a, "run_id": "r", "observed_at": at(i)} for i, (e, a, _) in enumerate(rows)])
    assert [r.summary for r in questions.timeline(ev).orderBy("rn").collect()] == [x for _, _, x in rows]
    assert {r.phase for r in questions.timeline(ev).collect()} == {"other", "quality", "wap", "pipeline"}


def test_drift_of_unions(spark):
    shape = "field string, type string, required boolean"
    old = [("a", "int", True), ("b", "int|string", True), ("c", "int|string", False), ("d", "int", True), ("e", "string", False), ("f", "bool", True)]
    new = [("a", "int|string", False), ("b", "int", True), ("c", "float|int|string", False), ("d", "float|string", True), ("e", "string", True), ("f", "bool", True)]
    got = {(r.field, r.change, r.breaking) for r in validate.drift(spark.createDataFrame(old, shape), spark.createDataFrame(new, shape)).collect()}
    assert got == {("a", "widened", False), ("a", "now_optional", False), ("b", "type_changed", True), ("c", "type_changed", True), ("d", "widened", False), ("e", "now_required", True)}
    ev = spark.createDataFrame([("1", "e", '{"a": 1}'), ("2", "e", '{"a": "1"}'), ("3", "e", '{"a": true}')], "event_id string, event string, attributes string")
    seen = validate.observed_fields(ev.where("event_id < '3'"))
    assert [(r.field, r.type) for r in seen.collect()] == [("a", "int|string")]
    checked = validate.contract_violations(ev, seen.withColumn("version", F.lit(1)))
    assert {r.event_id: r.violations for r in checked.collect()} == {"1": [], "2": [], "3": ["type:a"]}


def test_incidents_need_a_critical_finding_and_rank_severities(spark):
    shape = "rule string, entity string, severity string, kind string, summary string, event string, producer string, event_id string, observed_at string"
    rows = [("r", "e", severity, "k", "s", "ev", "p", f"x{i}", at(i * 10)) for i, severity in enumerate(["error", "critical", "error", "error"])]
    rows += [("r", "other", "error", "k", "s", "ev", "p", "y", at(0))]
    found = spark.createDataFrame(rows, shape).withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
    got = insights.incidents(found).collect()
    assert [(r.who, r.severity, r.member_events) for r in got] == [("e", "critical", ["x1", "x2", "x3"])]


def test_reopening_is_refused_while_another_row_is_open(spark):
    rows = [("a", at(0), 1, "resolved"), ("a", at(1), 2, "open"), ("b", at(0), 1, "resolved"), ("b", at(1), 2, "open")]
    requests = spark.createDataFrame(rows, "target string, at string, seq long, to string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    taken = spark.createDataFrame([("a",)], "target string")
    moved = lifecycle.transitions(requests, taken=taken)
    got = {(r.target, r.seq): r.status for r in moved.collect()}
    assert got == {("a", 1): "moved", ("a", 2): "rejected", ("b", 1): "moved", ("b", 2): "moved"}
    assert {r.target: r.resolved_at is None for r in lifecycle.resolved_at(moved).collect()} == {"a": False, "b": True}


def test_rebuilt_insights_keep_ids_and_decisions(spark):
    rows = [{"run_id": "r", "observed_at": at(i), "outcome": "failure"} for i in range(3)] + [{"run_id": "q", "observed_at": at(9), "outcome": "failure"}]
    ev = events(spark, rows)
    old = insights.episodes(insights.findings(ev.where("event_id <> 'e0'")), ev)
    fresh = insights.episodes(insights.findings(ev), ev)
    ids = {r.entity: r.insight_id for r in old.collect()}
    journal = spark.createDataFrame([(ids["run://p/r"], at(20), 1, "acknowledged", "moved"), ("lost", at(20), 2, "resolved", "moved")], "target string, at string, seq long, to string, status string")
    out, ambiguous = maintenance.rebuilt_insights(fresh, old, journal)
    assert ambiguous.count() == 0
    got = {r.entity: (r.insight_id, r.state, r.findings) for r in out.where("entity is not null").collect()}
    assert got == {"run://p/r": (ids["run://p/r"], "acknowledged", 3), "run://p/q": (ids["run://p/q"], "open", 1)}


def test_retention_keeps_open_rows_and_their_decisions(spark):
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    old = F.lit("2020-01-01").cast("timestamp_ntz")
    found = spark.createDataFrame([("a", "open"), ("b", "resolved")], "insight_id string, state string").withColumn("last_observed_at", old)
    journal = spark.createDataFrame([("a",), ("b",)], "target string").withColumn("at", old)
    kept, report = maintenance.retention({"insights": found, "journal": journal}, now)
    assert [r.insight_id for r in kept["insights"].collect()] == ["a"]
    assert [r.target for r in kept["journal"].collect()] == ["a"]
    assert {r.name: (r.stay, r.go) for r in report.collect()} == {"insights": (1, 1), "journal": (1, 1)}
