"""A stream of shuffled, late and repeated events gives the tables of a rebuild, whatever fails on the way."""

import collections
import tempfile

from pyspark.sql import functions as F

from eventloom.operators import correlate, maintenance
from eventloom.operators.baselines import summaries
from eventloom.schema import from_tables
from eventloom.streaming.ingest import KEYS, Store, change_feed, metric_rollup, start, tail_sampled

DIR = "/root/testdata/sf0.001"


def some_events(spark):
    return from_tables(spark, DIR).where("xxhash64(coalesce(trace_id, '')) % 80 = 0").cache()


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def assert_rebuilt(store, ev):
    """Tables of the store are those of a rebuild; ids of insights and incidents have a test of their own."""
    want = maintenance.rebuild(correlate.canonical(ev))
    assert set(want) == set(KEYS)
    for name, df in want.items():
        cols = [F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in sorted(df.dtypes) if c != "insight_id"]
        got = store.table(name)
        assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, df.select(*cols).collect())), name


def parts(ev, n=2):
    """Arrival out of order: by a hash of the id, so that late ones come in each part; the first part's come again."""
    part = lambda k: ev.where(F.pmod(F.xxhash64("event_id"), F.lit(n)) == k)
    return [part(k).union(part(0).limit(5)) for k in range(n)]


def test_batches_run_twice_and_a_failure_between_write_and_mark(spark, monkeypatch):
    ev = some_events(spark)
    store = Store(spark, tempfile.mkdtemp())
    batches = parts(ev)
    order = [r.event_id for r in batches[0].orderBy("observed_at", "event_id").collect()]
    assert [r.event_id for r in ev.orderBy("observed_at", "event_id").limit(len(order)).collect()] != order
    for k, batch in enumerate(batches):
        store.ingest(batch, k)
        n = store.events().count()
    store.ingest(batch, k)  # the same batch again stores the same
    assert store.events().count() == n
    assert_rebuilt(store, ev)
    assert len(store.versions()) == 2
    assert {(r.batch, r.status): r["count"] for r in store.arrived().groupBy("batch", "status").count().collect()} == {(0, "duplicate"): 5, (1, "duplicate"): 5}
    more = ev.withColumns({"event_id": F.concat(F.lit("x"), "event_id"), "observed_at": F.timestamp_add("DAY", F.lit(-3), "observed_at")}).limit(40).cache()
    before = rows(store.table("runs"))
    with monkeypatch.context() as m:
        m.setattr(Store, "mark", lambda self, doc: (_ for _ in ()).throw(OSError("no mark")))
        store.ingest(more, 9)
    assert rows(store.table("runs")) == before  # readers still see the version before
    assert store.events().count() == n + 40
    gaps = store.gaps().collect()
    assert ({g.batch for g in gaps}, len({i for g in gaps for i in g.event_ids}), {g.error for g in gaps}) == ({9}, 40, {"no mark"})
    assert store.repair() == []
    assert store.gaps().count() == 0
    assert_rebuilt(store, ev.union(more))


def test_a_gap_without_its_events_blocks_repair(spark):
    ev = some_events(spark)
    store = Store(spark, tempfile.mkdtemp())
    ev.limit(5).withColumn("day", F.to_date("received_at")).write.partitionBy("day").parquet(f"{store.path}/events/batch=0")
    spark.createDataFrame([("f", None, 1, "e", ["gone"])], "failure_id string, occurred_at timestamp_ntz, batch long, error string, event_ids array<string>").write.json(f"{store.path}/gaps/gap-1")
    assert store.repair() == ["f"]
    assert store.gaps().count() == 1


def test_stream_equals_rebuild_and_tail_sampling_runs(spark):
    src, out = tempfile.mkdtemp(), tempfile.mkdtemp()
    ev = some_events(spark)
    for batch in parts(ev, 2):
        batch.coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    store = Store(spark, out)
    start(stream(), store, tempfile.mkdtemp()).awaitTermination()
    want = maintenance.rebuild(correlate.canonical(ev))
    assert rows(store.table("runs")) == rows(want["runs"])
    told = store.changes().collect()
    assert {r.key for r in told if r.kind == "run.changed"} == {r.run_id for r in want["runs"].collect()}
    assert {r.key for r in told if r.kind == "insight.opened"} >= {r.insight_id for r in store.table("insights").where("state = 'open'").collect()}
    feed = {(r.kind, r.key) for r in change_feed(store.table("runs"), store.table("insights"), store.table("incidents")).collect()}
    assert len([k for k, _ in feed if k == "run.changed"]) == store.table("runs").count()
    long = store.table("runs").limit(1).withColumn("job_name", F.repeat(F.lit("j"), 8000))
    assert [(r.kind, r.body) for r in change_feed(long, store.table("insights").limit(0), store.table("incidents").limit(0)).collect()] == [("refresh", None)]
    q = tail_sampled(stream(), 1e12).writeStream.format("memory").queryName("tails").option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start()
    q.awaitTermination()
    kept = spark.table("tails").join(ev.select("event_id", "outcome", "event"), "event_id").where("event = 'pipeline.run'").collect()
    assert any(r.outcome == "failure" for r in kept)
    assert not any(r.outcome == "success" for r in kept)


def test_streaming_rollup_is_the_batch_summary(spark):
    src = tempfile.mkdtemp()
    ev = from_tables(spark, DIR).where("event LIKE 'metric.%'").cache()
    ev.coalesce(1).write.mode("append").parquet(src)
    q = metric_rollup(spark.readStream.schema(ev.schema).parquet(src)).writeStream.format("memory").queryName("rollup").outputMode("append").option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start()
    q.awaitTermination()
    key = ["metric", "service", "count", "min", "max", "p50", "p99"]
    got = [str(r) for r in spark.table("rollup").select(*key).collect()]
    want = [str(r) for r in summaries(ev).select(*key).collect()]
    assert len(want) - 30 < len(got) < len(want)  # the last minutes wait for the watermark
    assert not collections.Counter(got) - collections.Counter(want)
