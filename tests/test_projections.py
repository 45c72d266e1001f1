"""Boundary rows of projections, rules, episodes, incidents; order does not matter."""

import random

from pyspark.sql import functions as F

from eventloom.operators import baselines, correlate, insights, lifecycle, privacy, projections, sampling
from eventloom.schema import FLAT


def events(spark, rows):
    rows = [{"event_id": f"e{i}", "event": "pipeline.run", "outcome": "unknown", "severity": "info", "service": "s", "producer": "p", **r} for i, r in enumerate(rows)]
    shape = ", ".join(f"{k} {'string' if t == 'timestamp_ntz' else t}" for k, t in FLAT.items())
    df = spark.createDataFrame([tuple(r.get(k) for k in FLAT) for r in rows], shape)
    return df.select(*[F.col(k).cast(t).alias(k) for k, t in FLAT.items()])


def at(minutes, seconds=0):
    return f"2024-01-{1 + minutes // 1440:02d} {minutes % 1440 // 60:02d}:{minutes % 60:02d}:{seconds:02d}"


def only_rule(name):
    return {name: insights.RULES[name]}


def test_run_status_is_the_highest_and_order_free(spark):
    rows = [{"run_id": "r", "observed_at": at(i), "outcome": o, "job_id": j} for i, (o, j) in enumerate([("unknown", "a"), ("success", ""), ("failure", "b"), ("success", None)])]
    rows.append({"run_id": "r", "observed_at": at(9), "event": "pipeline.step", "severity": "warn"})
    got = projections.runs(events(spark, rows)).first()
    assert (got.status, got.event_count, got.warning_count, got.job_name) == ("failure", 5, 1, "b")
    mixed = [dict(r, event_id=f"e{i}") for i, r in enumerate(rows)]
    random.Random(3).shuffle(mixed)
    assert [r["event_id"] for r in mixed] != sorted(r["event_id"] for r in mixed)
    assert projections.runs(events(spark, mixed)).first() == got


def test_trace_takes_the_smallest_run(spark):
    ev = events(spark, [{"trace_id": "t", "run_id": r, "observed_at": at(i)} for i, r in enumerate([None, "r2", "r1", ""])])
    assert sorted(r.run_id for r in correlate.link_traces(ev).collect()) == ["r1", "r1", "r1", "r2"]


def test_duplicate_and_conflict(spark):
    rows = [{"event_id": "x", "observed_at": at(0), "received_at": at(i), "outcome": o} for i, o in enumerate(["success", "success", "failure"])]
    assert sorted(r.status for r in correlate.arrivals(events(spark, rows)).collect()) == ["accepted", "conflict", "duplicate"]


def test_duration_regression_needs_five_samples_and_twice_the_median(spark):
    def found(values):
        rows = [{"run_id": f"r{i}", "job_id": "j", "observed_at": at(i), "duration_ms": float(v)} for i, v in enumerate(values)]
        return insights.findings(events(spark, rows), only_rule("duration-regression")).count()

    assert found([100] * 6 + [320]) == 1
    assert found([100] * 6 + [200]) == 0
    assert found([100] * 3 + [900]) == 0
    assert found([100] * 5 + [201]) == 1


def test_volume_spike_by_partition(spark):
    rows = [{"event": "asset.materialize", "asset_key": "a", "partition_key": k, "row_count": float(v), "observed_at": at(i)} for i, (k, v) in enumerate([("A", 50000)] * 7 + [("B", 10)] * 3 + [("A", 200000), ("B", 900)])]
    got = insights.findings(events(spark, rows), only_rule("volume-spike")).collect()
    assert [r.summary for r in got] == ["many: rows|A"]
    counts = {r.metric: r["count"] for r in baselines.baselines(baselines.observations(events(spark, rows))).collect()}
    assert counts == {"rows|A": 8, "rows|B": 4}


def test_episode_resolves_at_the_same_instant_by_the_smallest_id(spark):
    rows = [{"event_id": i, "run_id": "r", "observed_at": at(5), "outcome": o} for i, o in [("b", "success"), ("c", "failure"), ("a", "success")]]
    ev = events(spark, rows)
    got = insights.episodes(insights.findings(ev), ev).collect()
    assert [(r.state, r.resolved_by) for r in got] == [("resolved", "a")]


def test_incident_gap_is_inclusive(spark):
    def n(last):
        rows = [{"run_id": "r", "observed_at": t, "outcome": "failure"} for t in (at(0), at(30), last)]
        return insights.incidents(insights.findings(events(spark, rows), only_rule("run_failure".replace("_", "-")))).count()

    assert n(at(60)) == 1
    assert n(at(60, 1)) == 2


def test_asset_recovering_when_failure_is_older(spark):
    rows = [{"event": "asset.materialize", "asset_key": "a", "outcome": o, "observed_at": at(t)} for o, t in (("success", 2), ("failure", 1))]
    assert projections.assets(events(spark, rows)).first().status == "recovering"


def test_transitions_and_cooldown(spark):
    r = spark.createDataFrame([("t", 1, 1, "resolved"), ("t", 2, 2, "acknowledged"), ("t", 3, 3, "resolved"), ("t", 4, 4, "open")], "target string, at long, seq long, to string").withColumn("at", F.timestamp_add("SECOND", F.col("at").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")))
    assert [x.status for x in lifecycle.transitions(r).orderBy("at").collect()] == ["moved", "rejected", "same", "moved"]
    a = spark.createDataFrame([("k", s) for s in (0, 299, 300, 500, 600)], "key string, s int").select("key", F.timestamp_add("SECOND", "s", F.lit("2024-01-01").cast("timestamp_ntz")).alias("at"))
    assert [x.sent for x in lifecycle.alerts(a).orderBy("at").collect()] == [True, False, True, False, True]


def test_secrets(spark):
    df = spark.createDataFrame([("api_key",), ("userToken",), ("x-secret-y",), ("tokens",), ("keyboard",)], "k string")
    assert [r[0] for r in df.select(privacy.is_secret_key(F.col("k"))).collect()] == [True, True, True, False, False]
    u = spark.createDataFrame([("http://u:pw@h/p?token=1&a=2",), (None,)], "u string").select(privacy.strip_url(F.col("u"))).collect()
    assert u[0][0] == "http://u:***@h/p?token=%5BREDACTED%5D&a=2"
    assert u[1][0] is None


def test_sampling_keeps_critical_and_shares_fate(spark):
    ev = events(spark, [{"run_id": f"r{i % 50}", "observed_at": at(i), "severity": "critical" if i == 7 else "info"} for i in range(200)])
    kept = ev.where(sampling.keep_sampled({"info": 0.0})).collect()
    assert [r.severity for r in kept] == ["critical"]
    half = ev.where(sampling.keep_sampled({"info": 0.5})).groupBy("run_id").count().collect()
    assert 10 < len(half) < 40
    assert all(r["count"] == 4 for r in half if r.run_id != "r7")


def test_alerts_of_a_hot_key_are_not_folded_in_one_array(spark):
    rows = spark.range(30_000).selectExpr("'k' AS key", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS at")
    out = lifecycle.alerts(rows, 300)
    assert out.where("sent").count() == 100
    assert "collect_list" not in out._jdf.queryExecution().toString()
