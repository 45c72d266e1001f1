"""Rules in streams against their batch forms."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from eventloom.operators import insights, lifecycle
from eventloom.streaming.ingest import alert_stream, incident_stream

T0 = dt.datetime(2024, 1, 1)
FOUND = "rule string, entity string, severity string, kind string, summary string, event string, producer string, event_id string, observed_at timestamp_ntz"


def run(spark, name, df):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name), q


def stream_of(spark, batches, schema):
    src = tempfile.mkdtemp()
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_cooldown_in_a_stream_is_that_of_the_batch(spark):
    r = random.Random(4)
    at = sorted(r.randrange(4000) for _ in range(60))
    rows = [(f"k{r.randrange(3)}", T0 + dt.timedelta(seconds=s)) for s in at]
    df = spark.createDataFrame(rows, "key string, at timestamp_ntz")
    cut = rows[30][1]
    last = spark.createDataFrame([("end", T0 + dt.timedelta(days=1)), ("end", T0 + dt.timedelta(days=2))], df.schema)
    batches = [df.where(F.col("at") <= cut), df.where(F.col("at") > cut), last.limit(1), last.where("at > '2024-01-02'")]
    got, q = run(spark, "alerts_sent", alert_stream(stream_of(spark, batches, df.schema)))
    key = lambda x: sorted((y.key, y["at"], y.sent) for y in x.select("key", F.col("at").cast("timestamp_ntz").alias("at"), "sent").collect() if y.key != "end")
    assert key(got) == key(lifecycle.alerts(df))
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_incidents_in_a_stream_are_those_of_the_batch(spark):
    r = random.Random(5)
    # Minutes between findings are often just the gap, so that sessions touch, and bridge late.
    at, rows = 0, []
    for i in range(60):
        at += r.choice([1, 10, 29, 30, 30, 31, 90])
        rows.append(("r", f"e{r.randrange(2)}" if i % 7 else None, r.choice(["error", "error", "critical", "warning"]), "k", f"s{i}", "ev", "p", f"x{i:02d}", T0 + dt.timedelta(minutes=at)))
    found = spark.createDataFrame(rows, FOUND)
    shuffled = found.withColumn("b", F.pmod(F.xxhash64("event_id"), F.lit(3)))
    far = spark.createDataFrame([("r", "z", "critical", "k", "s", "ev", "p", f"end{k}", T0 + dt.timedelta(days=30 + k)) for k in range(2)], FOUND)
    batches = [shuffled.where(F.col("b") == k).drop("b") for k in range(3)] + [far.limit(1), far.where("event_id = 'end1'")]
    got, _ = run(spark, "incidents_found", incident_stream(stream_of(spark, batches, found.schema), lateness="20 days"))
    cols = ["who", "entity", "title", "started_at", "last_at", "members", "first_event", "member_events", "severity"]
    want = insights.incidents(found).select(*cols)
    assert sorted(map(str, got.where("who <> 'z'").select(*cols).collect())) == sorted(map(str, want.collect()))
    assert want.count() > 5
