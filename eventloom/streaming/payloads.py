"""A stream of raw payloads: each goes to its source, and what comes of it to several tables, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eventloom.functions.staging import staged, unstage
from eventloom.sources.payloads import SOURCES, landed, otlp_records, quarantined
from eventloom.streaming.segments import at_once
from eventloom.streaming.store import Store

PAYLOAD = "payload_id string, source string, payload string, received_at timestamp_ntz"
LANDED = "payload_id string, source string, received_at timestamp_ntz, stored string, kind string, sha256 string, expires_at timestamp_ntz, items long, errors long, status string"
REJECTED = "payload_id string, `index` string, code string, message string"
QUARANTINE = "payload_id string, received_at timestamp_ntz, source string, payload string, kind string, sha256 string, code string, message string"
REPORT = "source string, payloads long, ok long, partial long, failed long, rejected long, status string"
REPLAY = "payload_id string"


def items_of(payloads: DataFrame) -> DataFrame:
    """payload_id, items: what a payload has to offer. A list of envelopes or the records of a protocol payload are checked one by one, anything else as a whole."""
    doc = F.try_parse_json("payload")
    listed = F.size(F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), F.array(doc)))
    many = payloads.where("source = 'canonical'").select("payload_id", listed.cast("long").alias("items"))
    records = otlp_records(payloads.where("source = 'otlp'")).groupBy("payload_id").agg(F.count("*").alias("items"))
    one = payloads.where("source NOT IN ('canonical', 'otlp')").select("payload_id", F.lit(1).cast("long").alias("items"))
    return many.union(records).union(one)


class PayloadStore:
    """Payloads (payload_id, source, payload, received_at) into a store of events.

    Beside the events: landed (every payload, with its status), rejected (errors by item), quarantine (payloads of which
    nothing could be read), replays, reports. Each batch writes folders of its own number in all of them, so a batch that
    runs again replaces what it wrote. Repeated payload_ids in a batch are one payload; a null source is unknown.
    """

    def __init__(self, store: Store):
        self.store, self.path, self.spark = store, f"{store.path}/payloads", store.spark

    def _rows(self, name: str, shape: str) -> DataFrame:
        if not self.store.folder.names(f"payloads/{name}"):
            return self.spark.createDataFrame([], f"{shape}, batch long")
        return self.spark.read.schema(f"{shape}, batch long").parquet(f"{self.path}/{name}")

    def landed(self) -> DataFrame:
        return self._rows("landed", LANDED)

    def rejected(self) -> DataFrame:
        return self._rows("rejected", REJECTED)

    def reports(self) -> DataFrame:
        """AGG-13: by batch and source the payloads by status, rejected items, and the batch's status: accepted, partial, rejected."""
        return self._rows("reports", REPORT)

    def quarantine(self) -> DataFrame:
        """SRC-16: what is in quarantine, with replayed true once a later batch took it up again."""
        rows = self._rows("quarantine", QUARANTINE)
        last = self._rows("replays", REPLAY).groupBy("payload_id").agg(F.max("batch").alias("taken"))
        return rows.join(last, "payload_id", "left").withColumn("replayed", F.coalesce(F.col("taken") > F.col("batch"), F.lit(False))).drop("taken")

    def ingest(self, payloads: DataFrame, number: int) -> None:
        """STR-1, SRC-11, SRC-16: lands the batch's payloads, turns them into events, and stores and derives these."""
        known = F.coalesce(F.col("source").isin(*SOURCES), F.lit(False))
        payloads = payloads.select("payload_id", F.when(known, F.col("source")).otherwise("unknown").alias("source"), "payload", F.col("received_at").cast("timestamp_ntz").alias("received_at"))
        payloads = staged(payloads.dropDuplicates(["payload_id"]), "payloads")
        parts = {name: payloads.where(F.col("source") == name).select("payload_id", "payload", "received_at") for name in SOURCES}
        events, errors = None, payloads.where("source = 'unknown'").select("payload_id", F.lit("0").alias("index"), F.lit("UNKNOWN_SOURCE").alias("code"), F.lit("source").alias("message"))
        for name, part in parts.items():
            events_of, errors_of = SOURCES[name]
            events = events_of(part) if events is None else events.unionByName(events_of(part))
            errors = errors.unionByName(errors_of(part).withColumn("index", F.col("index").cast("string")).select(*errors.columns))
        events, errors = at_once([lambda: staged(events, "payload-events"), lambda: staged(errors, "payload-errors")])
        bad = errors.groupBy("payload_id").agg(F.count("*").alias("errors"))
        judged = payloads.join(items_of(payloads), "payload_id", "left").join(bad, "payload_id", "left").fillna(0, ["items", "errors"])
        status = F.when(F.col("errors") == 0, "ok").when(F.col("items") > F.col("errors"), "partial").otherwise("failed")
        judged = staged(judged.withColumn("status", status), "payload-status")
        counted = Observation("payloads")
        rows = landed(judged, F.col("received_at")).select("payload_id", "source", "received_at", "stored", "kind", "sha256", "expires_at", "items", "errors", "status")
        rows = rows.observe(counted, F.count("*").alias("payloads"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))
        failed = judged.where("status = 'failed'").select("payload_id", "payload", "received_at", "source")
        read = judged.where("status <> 'failed'").select("payload_id")

        def put(name: str, df: DataFrame) -> Callable[[], None]:
            return lambda: df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

        kept = None
        for name in (*SOURCES, "unknown"):
            of = quarantined(failed.where(F.col("source") == name).drop("source"), errors, read, name).drop("replayed")
            kept = of if kept is None else kept.unionByName(of)
        at_once([put("landed", rows), put("rejected", errors), put("quarantine", kept)])
        self.store.ingest(events, number)
        totals = counted.get
        said = F.lit("accepted" if not totals["errors"] else "rejected" if totals["failed"] == totals["payloads"] else "partial")
        n = lambda s: F.count_if(F.col("status") == s).alias(s)
        put("reports", judged.groupBy("source").agg(F.count("*").alias("payloads"), n("ok"), n("partial"), n("failed"), F.sum("errors").alias("rejected")).withColumn("status", said).coalesce(1))()
        unstage(payloads, events, errors, judged)

    def replay(self, number: int, which: Column | None = None) -> None:
        """SRC-16: takes the quarantined payloads that are JSON (and which is true of) through the normal path again, as batch number."""
        rows = self.quarantine().where("kind = 'json' AND NOT replayed").where(F.col("batch") < number)
        rows = staged((rows if which is None else rows.where(which)).select("payload_id", "source", "payload", "received_at").dropDuplicates(["payload_id"]), "replay")
        rows.select("payload_id").write.mode("overwrite").parquet(f"{self.path}/replays/batch={number}")
        self.ingest(rows, number)
        unstage(rows)
