"""Steps that must not deal the whole log over the cluster, or go through it more often than needed."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from eventloom.functions import json_values as j
from eventloom.operators import correlate, lifecycle
from eventloom.operators import projections as p
from eventloom.operators import questions as q
from eventloom.schema import flat
from eventloom.sources import payloads as s


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def log(spark, n=40):
    rows = spark.range(n).select(
        F.concat(F.lit("e"), "id").alias("event_id"), F.lit("asset.materialize").alias("event"), F.lit("success").alias("outcome"), F.concat(F.lit("r"), F.col("id") % 4).alias("run_id"),
        F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("observed_at"), F.lit("p").alias("producer"), F.concat(F.lit("a"), F.col("id") % 5).alias("asset_key"), F.lit("s").alias("service"),
    )
    return flat(rows)


def test_only_repeated_ids_are_ordered(spark):
    ev = log(spark)
    assert "Window" not in plan(correlate.accepted(ev))
    twice = ev.union(ev.where("event_id IN ('e3', 'e4')").withColumn("outcome", F.lit("failure")).withColumn("received_at", F.lit("2020-01-01").cast("timestamp_ntz")))
    got = correlate.accepted(twice.union(ev.limit(3).withColumn("event_id", F.lit(None).cast("string"))))
    assert got.count() == 41 and got.select("event_id").distinct().count() == 41


def test_provenance_stays_within_events(spark):
    ev = log(spark).withColumn("entities", F.create_map(F.lit("asset"), F.lit("x://1"), F.lit("table"), F.lit("x://1"), F.lit("model"), F.lit("x://1"), F.lit("other"), F.lit("")))
    out = q.provenance(ev)
    assert "Exchange" not in plan(out) and "Aggregate" not in plan(out)
    assert out.count() == out.distinct().count() == 40 * 6


def test_impact_is_one_grouping(spark):
    out = p.impact(log(spark))
    assert plan(out).count("Exchange hashpartitioning(src") == 1 and "Join" not in plan(out)
    one = out.where("src = 'run://p/r1' AND type = 'produces'").first()
    assert one.targets == [f"asset://a{i}" for i in range(5)] and one.evidence == 10 and one.evidence_ids == [f"e{i}" for i in range(1, 40, 4)]


def test_changes_are_not_dealt_run_by_run(spark):
    ev = log(spark).withColumn("event", F.lit("table.commit"))
    runs = p.runs(ev)
    out = q.changes(runs, ev, 24.0, 7)
    # What comes out of the runs' lists isn't shuffled again.
    assert out._jdf.queryExecution().optimizedPlan().toString().index("Generate") < out._jdf.queryExecution().optimizedPlan().toString().index("Join")
    got = {(r.run_id, r.rn): (r.change_id, r.truncated) for r in out.collect()}
    want = {}
    for k in range(4):
        # A run starts with its first event; before it are those of the runs with smaller numbers.
        for rn, i in enumerate(range(k, max(k - 7, -1), -1), 1):
            want[f"r{k}", rn] = (f"e{i}", False)
    assert got == want
    late = runs.withColumns({"started_at": F.timestamp_add("DAY", F.lit(0), F.lit("2024-01-01 00:00:39").cast("timestamp_ntz"))})
    rows = q.changes(late, ev, 24.0, 7).where("run_id = 'r2'").orderBy("rn").collect()
    assert [r.change_id for r in rows] == [f"e{i}" for i in range(39, 32, -1)] and all(r.truncated for r in rows)


def test_trimmed_at_the_limit(spark):
    """The JSON of a text and a source has 23 characters beside them (val6_trimmed's SQL had 22)."""
    rows = spark.createDataFrame([(n, "x" * n, "web") for n in (16358, 16359)], "doc_id int, text string, source string")
    out = j.trimmed(rows.select("doc_id", F.create_map(F.lit("text"), F.col("text"), F.lit("source"), F.col("source")).alias("attributes")), limit=16384)
    assert {r.doc_id: r.trimmed for r in out.collect()} == {16358: [], 16359: ["text"]}
    assert "length(source) + 23 > 16384" in entry.oracle_sql()["val6_trimmed"]


def test_carried_ids_travel_as_digests(spark):
    shape = "id string, rule string, dedupe_key string, entity string, events array<string>"
    old = spark.createDataFrame([("a", "r", "k", "e", ["1", "2"]), ("b", "r", "k", "e", ["3"]), ("c", "r", "k", None, ["4"])], shape)
    new = spark.createDataFrame([("x", "r", "k", "e", ["2", "3"]), ("y", "r", "k", None, ["4"]), ("z", "r", "other", "e", ["1"])], shape)
    out = lifecycle.carried_ids(old, new)
    assert sorted(map(tuple, out.collect())) == [("a", "x", True), ("b", "x", True)]
    joined = [line for line in plan(out).splitlines() if "Exchange hashpartitioning" in line]
    assert not any("dedupe_key" in line for line in joined)


def test_items_are_read_once(spark):
    body = '[{"event_id":"1","event":"Bad Name"},{"event_id":"2","schema_version":"2.0","event":"a.b","category":"data","outcome":"success","severity":"info","observed_at":"2024-01-01T00:00:00Z","service":{"name":"s"}}]'
    seen = s.canonical_json(spark.createDataFrame([("p", body), ("q", "{")], "payload_id string, payload string"))
    bad, good = s.rejected(seen), s.accepted(seen)
    assert not [line for line in plan(bad).splitlines() if "Filter" in line and "from_json" in line]
    assert sorted(r.payload_id for r in bad.collect()) == ["p", "q"] and [r.event_id for r in good.collect()] == ["2"]


def test_rules_run_on_a_narrow_copy(spark, monkeypatch):
    """Queries that go through the events several times write the columns that they look at, not the whole event."""
    from eventloom.plans import common

    class Written(Exception):
        pass

    def staged(df, name):
        raise Written(len(df.columns))

    monkeypatch.setattr(common, "canonical", lambda df: df)
    monkeypatch.setattr(common, "staged", staged)
    for name in ("rule1_5_findings", "rule7_episodes", "str11_retained", "join14_touched_assets", "join15_lost_evidence", "str10_repaired_gaps", "join10_incident_insights"):
        try:
            entry.queries()[name](spark, "/root/testdata/sf0.001")
            raise AssertionError(name)
        except Written as n:
            assert n.args[0] <= 23


def test_lineage_makes_edges_once(spark):
    shape = "src string, dst string, type string, method string"
    edges = spark.createDataFrame([("run://a/1", "asset://x", "produces", "explicit"), ("asset://x", "asset://y", "t", "inferred"), ("run://a/1", "table://z", "t", "explicit")], shape)
    out = q.lineage(edges)
    assert "Union" not in plan(out)
    assert {(r.entity_id, r.direction, r.neighbour, r.kind) for r in out.collect()} == {("asset://x", "upstream", "run://a/1", "runtime"), ("asset://x", "downstream", "asset://y", "inferred"), ("asset://y", "upstream", "asset://x", "inferred")}


def test_touched_assets_are_folded_before_the_join(spark):
    from eventloom.operators import maintenance as m

    ev = log(spark)
    out = m.touched_assets(ev, spark.createDataFrame([("r1",), ("none",)], "run_id string"))
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join LeftSemi") < text.index("Aggregate")
    assert sorted(r.entity_id for r in out.collect()) == [f"asset://a{i}" for i in range(5)]


def test_exported_payloads_do_not_grow_with_the_log(spark):
    ev = log(spark, 3 * s.EXPORTED).withColumns({c: F.substring("event_id", 1, 1) for c in ("service", "environment")})
    out = s.otlp_export(ev, 1).select(F.concat_ws("-", "service", "block").alias("payload_id"), "payload").collect()
    assert len({r.payload_id for r in out}) == len(out) == 3 and all(r.payload.count("timeUnixNano") == s.EXPORTED for r in out)
    text = plan(s.otlp_export(ev, 1))
    # Events are dealt once, as they are.
    assert text.count("Exchange hashpartitioning") == 1 and "observe.event_id" not in text[text.rindex("Exchange hashpartitioning") :]


def test_payloads_are_parsed_once(spark):
    p = spark.createDataFrame([("p", '{"resource_logs":[{"scopeLogs":[{"logRecords":[{"body":{"stringValue":"x"}}, 5]}]}]}'), ("q", "{")], "payload_id string, payload string")
    out = s.otlp_logs(p)
    assert s.otlp_records(p)._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert [r.attributes for r in out.collect()] == ['{"body":"x"}'] and {(r["payload_id"], r["index"]) for r in s.otlp_rejected(p).collect()} == {("p", "0.0.1"), ("q", "0")}


def test_edges_are_dealt_by_hub_and_sorted_once(spark, monkeypatch):
    """Nothing is sorted before edges are dealt, an event goes to its hub once, and hubs with too many events for a task are cut down first, with the same result."""
    from collections import defaultdict

    ev = log(spark, 300)
    given = F.when(F.col("event_id").isin("e1", "e2"), F.create_map(F.lit("source"), F.lit("x"), F.lit("run"), F.lit("x"), F.lit("asset"), F.lit("y"), F.lit("model"), F.lit(""), F.lit("deployment"), F.lit("d")))
    ev = ev.withColumns({"entities": given.when(F.col("event_id") == "e3", F.create_map(F.lit("source"), F.lit("z"))), "branch": F.when(F.col("event_id") > "e2", "b"), "run_id": F.when(F.col("event_id") != "e9", F.col("run_id"))})
    ev = ev.union(ev.where("event_id = 'e7'").withColumn("event_id", F.lit("e70")))
    want = defaultdict(list)
    for r in p.edges(ev).collect():
        want[r.src, r.dst, r.type].append((r.observed_at, r.event_id))
    want = {k: [e for _, e in sorted(v)[:32]] for k, v in want.items()}
    assert ("z", "asset://a3", "produces") in want and len(want["x", "y", "produces"]) == 4 and len(want["service://s", "run://p/r0", "executes"]) == 32

    def got():
        out = p.edge_sources(ev)
        rows = out.collect()
        assert len(rows) == len(want)
        return {(r.src, r.dst, r.type): r.source_ids for r in rows}, out

    calm, out = got()
    text = out._jdf.queryExecution().executedPlan().toString()
    assert calm == want
    assert "WindowGroupLimit" not in plan(out) and "Aggregate" not in plan(out)
    final = text[: text.index("Initial Plan")] if "Initial Plan" in text else text
    assert final.count("Exchange hashpartitioning(hub") == 1 and final.count("Sort [") == 1
    monkeypatch.setattr(p, "HUB_EVENTS", 74)
    mixed, out = got()
    assert mixed == want and "WindowGroupLimit" in plan(out)
    monkeypatch.setattr(p, "HUB_EVENTS", 0)
    assert got()[0] == want


def test_a_row_of_changes_costs_little(spark):
    """Up to 1000 rows come out of a run: no list is copied and no time is made text for them, only for each change and run."""
    text = entry.queries()["qry7_run_changes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("slice(", "reverse(")) and "date_format" in text
    assert text.index("Generate explode(sequence") < text.index("date_format")


def test_newest_changes_at_every_cap(spark):
    ev = log(spark, 60).withColumns({"event": F.lit("table.commit"), "observed_at": F.timestamp_add("MINUTE", (F.xxhash64("event_id") % 40).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))})
    runs = ev.select(F.col("event_id").alias("run_id"), F.col("observed_at").alias("started_at"), F.col("observed_at").alias("updated_at"))
    rows = sorted(((r.observed_at, r.event_id) for r in ev.collect()), key=lambda x: x[1])
    for cap, hours in ((1, 0.5), (3, 0.5), (7, 0.1), (1000, 720)):
        got = {(r.run_id, r.rn): (r.change_id, r.changed_at, r.truncated) for r in q.changes(runs, ev, hours, cap, shown=lambda t: F.date_format(t, "mm")).collect()}
        want = {}
        for start, run in rows:
            before = sorted((x for x in rows if 0 <= (start - x[0]).total_seconds() <= hours * 3600), key=lambda x: x[0], reverse=True)
            want |= {(run, k): (e, f"{t:%M}", len(before) > cap) for k, (t, e) in enumerate(before[:cap], 1)}
        assert got == want


def test_investigations_deal_events_once(spark, monkeypatch):
    """All lists of a run come out of one pass over its events, with their caps, and edges of another run than the event's are found too."""
    monkeypatch.setattr(q, "EVENT_CAP", 8)
    number = F.substring("event_id", 2, 9).cast("int")
    given = F.when(F.col("event_id") == "e3", F.create_map(F.lit("run"), F.lit("run://x/r1"), F.lit("asset"), F.lit("asset://y")))
    ev = log(spark).withColumns({
        "event": F.when(number < 4, "pipeline.run").when(number % 8 < 4, "table.commit").otherwise(F.col("event")), "entities": given, "job_id": F.lit("j"),
        "outcome": F.when((number < 2) | (number == 3) | (number % 4 == 1), "failure").otherwise("success"), "severity": F.when(number % 4 == 3, "warn").otherwise("info"),
    })
    rows, runs = ev.collect(), p.runs(ev).cache()
    out = q.investigation(ev, runs)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2
    got = {r.run_id: r for r in out.collect()}
    assert set(got) == {"r0", "r1", "r3"}
    for run, r in got.items():
        mine = sorted((x for x in rows if x.run_id == run), key=lambda x: x.observed_at)
        bad, warned = [x for x in mine if x.outcome == "failure"], [x.event_id for x in mine if x.severity == "warn"]
        assert (r.events, r.failures, r.failed_stage, r.first_failure) == (10, len(bad), bad[-1].event, bad[0].event_id)
        assert (r.failure_ids, r.warning_ids, r.truncated) == ([x.event_id for x in bad][:8], warned[:8], True)
        changes = [c.change_id for c in q.changes(runs, ev).where(F.col("run_id") == run).orderBy("rn").collect()]
        assert (r.changes, r.causes, r.evidence) == (changes, [bad[0].event_id, *changes[:3]], sorted({*r.failure_ids, *r.warning_ids, *changes}))
        assert r.comparables == [x for x in ("r3", "r2", "r1", "r0") if x != run]
        assert r.impact == sorted(x.effect for x in p.edges(ev).where("src LIKE 'run://%'").select(F.substring_index("src", "/", -1).alias("run"), F.concat_ws(" ", "type", "dst").alias("effect")).distinct().collect() if x.run == run)
    assert "part_of asset://y" in got["r1"].impact


def test_payloads_are_streamed_out_of_sorted_rows(spark):
    """No aggregation holds, sorts and spills the records of a task; texts travel as one list and come back as they were; payloads go on over batches."""
    import json

    number = F.substring("event_id", 2, 9).cast("int")
    ev = log(spark, 1203).withColumns({
        "service": F.when(number < 1100, "a").when(number < 1150, ""), "environment": F.when(number % 2 == 0, "x"), "error_message": F.when(number == 3, 'a"b\\,\né[]{}').when(number == 4, ""), "duration_ms": F.when(number == 5, 0.1),
        "tags": F.when(number == 6, F.create_map(F.lit("k"), F.lit("v"))),
    })
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = s.otlp_export(ev, 1)
        assert "Aggregate" not in plan(out) and "Window" not in plan(out)
        rows = out.collect()
        back = s.otlp_logs(out.select(F.concat_ws("-", "service", "environment", "block").alias("payload_id"), "payload")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {(r.service, r.environment, r.block): [next(a["value"]["stringValue"] for a in x["attributes"] if a["key"] == "observe.event_id") for x in json.loads(r.payload)["resourceLogs"][0]["scopeLogs"][0]["logRecords"]] for r in rows}
    assert len(got) == len(rows)
    want = {}
    for service, numbers in (("a", range(1100)), ("", range(1100, 1150)), (None, range(1150, 1203))):
        for environment in ("x", None):
            ids = sorted(f"e{i}" for i in numbers if (i % 2 == 0) == (environment == "x"))
            want |= {(service, environment, k): ids[k * s.EXPORTED : (k + 1) * s.EXPORTED] for k in range(-(-len(ids) // s.EXPORTED))}
    assert got == want
    by = {r.event_id: r for r in back}
    assert len(by) == 1203 and (by["e3"].error_message, by["e5"].duration_ms, by["e6"].tags) == ('a"b\\,\né[]{}', 0.1, {"k": "v"})
    assert by["e4"].error_message is None and by["e7"].duration_ms is None and all(by[f"e{i}"].asset_key == f"a{i % 5}" and by[f"e{i}"].run_id == f"r{i % 4}" for i in range(1203))


def test_only_findings_that_incidents_can_have_are_made(spark, monkeypatch):
    """JOIN-10 leaves out events of other names before series and assets are dealt, with the same result."""
    from eventloom.operators import insights as i

    number = F.substring("event_id", 2, 9).cast("int")
    ev = log(spark, 400).withColumns({
        "event": F.when(number % 4 == 0, "pipeline.run").when(number % 4 == 1, "quality.check").otherwise("asset.materialize"), "outcome": F.when(number % 12 < 6, "failure").otherwise("success"),
        "job_id": F.when(number % 4 == 0, "j"), "duration_ms": F.when(number % 4 == 0, F.when(number % 48 == 0, 1000.0).otherwise(10.0)), "row_count": F.when(number % 4 > 1, F.when(number % 50 == 3, 1000.0).otherwise(10.0)), "sla_seconds": F.when(number % 4 == 2, 0.5),
    })
    seen = []
    dealt = i.with_baseline
    monkeypatch.setattr(i, "with_baseline", lambda rows, **more: seen.append({r.base for r in rows.select("base").distinct().collect()}) or dealt(rows, **more))
    found = i.findings(ev)
    hit = {(r.rule, r.severity in ("error", "critical")) for r in found.select("rule", "severity").distinct().collect()}
    assert hit == {(k, k in i.SEVERE) for k in i.RULES}
    want = i.incident_insights(i.incidents(found), i.episodes(found, ev))
    seen.clear()
    got = i.behind_incidents(ev)
    assert seen == [{"run.duration_ms"}]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and {r[2] for r in rows} == {"run-failure", "duration-regression"}
    # An SLA on such an event brings the assets back, and without failures nothing is left.
    late = ev.withColumn("sla_seconds", F.lit(0.5))
    found = i.findings(late)
    rows = sorted(map(tuple, i.behind_incidents(late).collect()))
    assert rows == sorted(map(tuple, i.incident_insights(i.incidents(found), i.episodes(found, late)).collect())) and "freshness-breach" in {r[2] for r in rows}
    assert i.behind_incidents(ev.withColumn("outcome", F.lit("success"))).count() == 0
