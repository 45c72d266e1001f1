"""The store: what a batch costs, identities and decisions over rebuilds, conflicts, late links, retention."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from eventloom.operators import correlate, maintenance
from eventloom.schema import FLAT, flat
from eventloom.streaming import segments
from eventloom.streaming.store import AmbiguousLifecycle, Store

T0 = dt.datetime(2024, 1, 1)
SHAPE = ", ".join(f"{k} {t}" for k, t in FLAT.items())


def events(spark, rows):
    base = {"event": "pipeline.run", "category": "pipeline", "outcome": "success", "severity": "info", "producer": "p", "service": "s"}
    full = []
    for i, r in enumerate(rows):
        r = {**base, "event_id": f"e{i}", "observed_at": T0 + dt.timedelta(minutes=i), **r}
        full.append({"received_at": r["observed_at"], **r})
    return spark.createDataFrame([tuple(r.get(k) for k in FLAT) for r in full], SHAPE)


def fails(run, minute, **more):
    return {"run_id": run, "outcome": "failure", "observed_at": T0 + dt.timedelta(minutes=minute), "event_id": f"{run}-{minute}", **more}


def store_of(spark, *batches):
    store = Store(spark, tempfile.mkdtemp())
    for k, batch in enumerate(batches):
        store.ingest(batch, k)
    assert store.gaps().count() == 0, store.gaps().first().error
    return store


def same_tables(store, ev, names):
    want = maintenance.rebuild(correlate.canonical(ev))
    for name in names:
        cols = [F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in sorted(want[name].dtypes) if c != "insight_id"]
        assert sorted(map(str, store.table(name).select(*cols).collect())) == sorted(map(str, want[name].select(*cols).collect())), name


def test_a_batch_reads_and_writes_what_its_keys_touch(spark, monkeypatch):
    """Files read by a batch, and files it writes, at two sizes of the log: small buckets, so that both have many."""
    monkeypatch.setattr(segments, "BUCKET_ROWS", 50)
    small = [events(spark, [{"run_id": f"r{i}", "event_id": f"a{i}"} for i in range(n)]) for n in (1_000, 4_000)]
    batch = events(spark, [{"run_id": "r7", "event_id": "new1"}, {"run_id": "x", "event_id": "new2"}])
    seen = []
    for log in small:
        store = store_of(spark, log)
        read, whole, written = [], [], []
        of = segments.Segments.read

        def reading(self, listed, touched=None, of_n=1, of=of, read=read, whole=whole):
            if listed:
                read.append(sum(1 for s in listed for b in s["have"] if touched is None or s["buckets"] > of_n or b in {t % s["buckets"] for t in touched}))
                whole.append(sum(len(s["have"]) for s in listed))
            return of(self, listed, touched, of_n)

        wrote = segments.Segments.write

        def writing(self, rows, name, expected, level=0, wrote=wrote, written=written):
            out = wrote(self, rows, name, expected, level)
            written.append(len(out["have"]))
            return out

        with monkeypatch.context() as m:
            m.setattr(segments.Segments, "read", reading)
            m.setattr(segments.Segments, "write", writing)
            store.ingest(batch, 1)
        assert store.gaps().count() == 0
        seen.append((sum(read), sum(whole), sum(written)))
        assert store.table("runs").where("run_id = 'r7'").first().event_count == 2
    (read_small, all_small, written_small), (read_large, all_large, written_large) = seen
    assert all_large > 3 * all_small
    assert read_large <= read_small + 5
    assert written_large == written_small


def test_a_run_that_comes_later_takes_its_traces_events(spark):
    first = [{"trace_id": "t", "event": "asset.materialize", "asset_key": "a", "row_count": 5.0, "event_id": "o1"}, {"trace_id": "u", "event_id": "o2", "outcome": "failure"}]
    later = [{"trace_id": "t", "run_id": "r2", "event_id": "n1", "observed_at": T0}, {"trace_id": "u", "run_id": "r9", "event_id": "n2", "observed_at": T0}]
    smaller = [{"trace_id": "t", "run_id": "r1", "event_id": "m1", "observed_at": T0 + dt.timedelta(hours=1)}]
    batches = [events(spark, x) for x in (first, later, smaller)]
    store = store_of(spark, *batches[:2])
    same_tables(store, batches[0].union(batches[1]), ["runs", "entities", "relationships", "insights", "incidents", "baselines"])
    assert {r.run_id: r.event_count for r in store.table("runs").collect()} == {"r2": 2, "r9": 2}
    store.ingest(batches[2], 2)  # a smaller run takes them away from another: all is derived anew
    same_tables(store, batches[0].union(batches[1]).union(batches[2]), ["runs", "entities", "relationships", "insights", "baselines"])
    assert {r.run_id: r.event_count for r in store.table("runs").collect()} == {"r1": 2, "r2": 1, "r9": 2}


def test_late_samples_change_the_verdicts_after_them(spark):
    made = lambda i, n, **x: {"event": "asset.materialize", "asset_key": "a", "row_count": float(n), "observed_at": T0 + dt.timedelta(minutes=i), "event_id": f"m{i}", **x}
    first = events(spark, [made(i, 10) for i in range(10, 14)] + [made(30, 100, sla_seconds=600.0)])
    late = events(spark, [made(20, 10), made(25, 9)])
    store = store_of(spark, first)
    assert {r.rule for r in store.table("insights").collect()} == {"freshness-breach"}
    store.ingest(late, 1)
    same_tables(store, first.union(late), ["insights", "baselines", "assets"])
    assert {r.rule for r in store.table("insights").collect()} == {"volume-spike"}


def test_conflicts_and_duplicates_are_kept_apart(spark):
    a = events(spark, [{"event_id": "x", "run_id": "r"}])
    other = a.withColumn("outcome", F.lit("failure"))
    store = store_of(spark, a, a.union(other))
    assert sorted((r.event_id, r.status, r.batch) for r in store.arrived().collect()) == [("x", "conflict", 1), ("x", "duplicate", 1)]
    assert store.table("runs").first().event_count == 1


def test_ids_and_decisions_outlive_late_events_and_rebuilds(spark):
    ev = events(spark, [fails("r", 5), fails("r", 9), fails("q", 5)])
    store = store_of(spark, ev)
    ids = {r.entity: (r.insight_id, r.created_at) for r in store.table("insights").collect()}
    incident = {r.who: r.incident_id for r in store.table("incidents").collect()}
    me = ids["run://p/r"][0]
    asked = spark.createDataFrame([(me, T0, 1, "acknowledged"), (me, T0, 2, "expired"), (me, T0, 3, "open")], "target string, at timestamp_ntz, seq long, to string")
    assert [(r["from"], r.to, r.status) for r in store.decide(asked, "insights", 1).orderBy("seq").collect()] == [("open", "acknowledged", "moved"), ("acknowledged", "expired", "moved"), ("expired", "open", "rejected")]
    store.ingest(events(spark, [fails("r", 1)]), 1)  # earlier than all: another first event, the same insight
    now = {r.entity: (r.insight_id, r.created_at, r.state, r.findings) for r in store.table("insights").collect()}
    assert now["run://p/r"] == (*ids["run://p/r"], "expired", 3)
    assert {r.who: r.incident_id for r in store.table("incidents").collect()} == incident
    store.rebuild()
    assert {r.entity: (r.insight_id, r.created_at, r.state, r.findings) for r in store.table("insights").collect()} == now
    assert {r.who: r.incident_id for r in store.table("incidents").collect()} == incident


def test_rows_whose_evidence_expired_stay_over_a_rebuild(spark):
    old = events(spark, [fails("gone", 0)])
    new = events(spark, [fails("here", 60 * 24 * 200)])
    store = store_of(spark, old, new)
    ids = {r.entity: r.insight_id for r in store.table("insights").collect()}
    gone = store.retain(T0 + dt.timedelta(days=201))
    assert gone == {"events": 1, "runs": 0, "insights": 0, "incidents": 0}
    assert [r.event_id for r in store.events().collect()] == [f"here-{60 * 24 * 200}"]
    assert store.folder.names("events/batch=0") == ["_SUCCESS"] or not [x for x in store.folder.names("events/batch=0") if x.startswith("day=")]
    store.rebuild()
    assert {r.entity: r.insight_id for r in store.table("insights").collect()} == ids
    assert {r.run_id for r in store.table("runs").collect()} == {"here"}


def test_terminal_rows_go_with_their_journal_and_open_ones_stay(spark):
    store = store_of(spark, events(spark, [fails("a", 0), fails("b", 0)]))
    ids = {r.entity: r.insight_id for r in store.table("insights").collect()}
    ask = [(ids["run://p/a"], T0, 1, "suppressed"), (ids["run://p/b"], T0, 1, "acknowledged")]
    store.decide(spark.createDataFrame(ask, "target string, at timestamp_ntz, seq long, to string"), "insights", 1)
    gone = store.retain(T0 + dt.timedelta(days=500))
    assert (gone["insights"], gone["journal"], gone["runs"], gone["events"]) == (1, 1, 2, 2)
    assert [(r.entity, r.state) for r in store.table("insights").collect()] == [("run://p/b", "acknowledged")]
    assert [r.target for r in store.journal().collect()] == [ids["run://p/b"]]


def test_an_ambiguous_match_keeps_the_old_version(spark):
    """A success that came to the log without a derivation splits an insight in two: a rebuild must not choose."""
    store = store_of(spark, events(spark, [fails("r", 1), fails("r", 9)]))
    before = store.versions()
    split = flat(events(spark, [{"run_id": "r", "event_id": "ok", "observed_at": T0 + dt.timedelta(minutes=5)}]))
    split.withColumn("day", F.to_date("received_at")).write.partitionBy("day").parquet(f"{store.path}/events/batch=7")
    with pytest.raises(AmbiguousLifecycle, match="insights"):
        store.rebuild()
    assert store.versions() == before
    assert [r.findings for r in store.table("insights").collect()] == [2]
