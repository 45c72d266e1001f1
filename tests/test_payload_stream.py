"""Raw payload files in a stream: dispatch by source, landing, quarantine and replay, each batch twice."""

import json
import tempfile

from pyspark.sql import functions as F

from eventloom.streaming.ingest import start
from eventloom.streaming.payloads import PAYLOAD, PayloadStore
from eventloom.streaming.store import Store


def envelope(i, **more):
    return {"event_id": f"00000000-0000-0000-0000-0000000000{i:02d}", "schema_version": "2.0", "event": "pipeline.run", "category": "pipeline", "outcome": "success", "severity": "info", "delivery": "telemetry",
            "observed_at": f"2024-01-01T00:00:{i:02d}Z", "service": {"name": "s"}, "correlation": {"run_id": f"r{i}"}, **more}


def test_a_stream_of_payloads_with_bad_ones(spark):
    good, half, bad = [envelope(1), envelope(2)], [envelope(3), *[envelope(4, event="No Name")] * 11], [envelope(i, category="?") for i in range(5, 17)]
    rows = [
        ("a", "canonical", json.dumps(good)), ("b", "canonical", json.dumps(half)), ("c", "canonical", json.dumps(bad)), ("d", "canonical", "{cut"), ("e", "generic", '{"run_id": "g1", "x": 1}'),
        ("f", "nobody", "{}"), ("g", None, "{}"), ("h", "generic", None), ("i", "otlp", '{"resourceLogs": [{"scopeLogs": [{"logRecords": ["no record"]}]}]}'),
    ]
    src = tempfile.mkdtemp()
    table = spark.createDataFrame([(*x, None) for x in rows], PAYLOAD)
    table.where("payload_id < 'e'").coalesce(1).write.mode("append").parquet(src)
    table.where("payload_id >= 'e'").coalesce(1).write.mode("append").parquet(src)
    into = PayloadStore(Store(spark, tempfile.mkdtemp()))
    numbers = []

    def twice(batch, number):
        numbers.append(number)
        into.ingest(batch, number)
        into.ingest(batch, number)

    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(src)
    start(stream, into.store, tempfile.mkdtemp(), twice).awaitTermination()
    assert len(numbers) == 2
    assert into.store.gaps().count() == 0
    assert {r.payload_id: (r.status, r["items"], r.errors) for r in into.landed().collect()} == {
        "a": ("ok", 2, 0), "b": ("partial", 12, 11), "c": ("failed", 12, 12), "d": ("failed", 1, 1), "e": ("ok", 1, 0), "f": ("failed", 1, 1), "g": ("failed", 1, 1), "h": ("failed", 1, 1), "i": ("failed", 1, 1),
    }
    assert into.landed().count() == 9
    assert into.store.events().count() == 4
    assert {r.run_id for r in into.store.table("runs").collect()} == {"r1", "r2", "r3", "g1"}
    held = {r.payload_id: (r.source, r.kind, r.code, r.replayed) for r in into.quarantine().collect()}
    assert held == {
        "c": ("canonical", "json", "SCHEMA_INVALID", False), "d": ("canonical", "text", "SCHEMA_INVALID", False), "f": ("unknown", "json", "UNKNOWN_SOURCE", False), "g": ("unknown", "json", "UNKNOWN_SOURCE", False),
        "h": ("generic", "text", "SCHEMA_INVALID", False), "i": ("otlp", "json", "SCHEMA_INVALID", False),
    }
    assert into.quarantine().count() == 6
    assert into.rejected().where("payload_id = 'b'").count() == 11
    assert {r.status for r in into.reports().collect()} == {"partial"}
    # What a later version of a source can read goes the normal path.
    into.replay(7, F.col("payload_id") == "c")
    now = {(r.payload_id, r.batch): r.replayed for r in into.quarantine().where("payload_id = 'c'").collect()}
    assert sorted(now.values()) == [False, True]
    assert {r.status for r in into.reports().where("batch = 7").collect()} == {"rejected"}
