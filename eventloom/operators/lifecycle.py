"""Operators' decisions on insights and incidents, alerts, duplicates of open insights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Allowed moves between states.
MOVES = {
    "insight": {"open": ("acknowledged", "resolved", "suppressed", "expired"), "acknowledged": ("open", "resolved", "suppressed", "expired"), "suppressed": ("open", "resolved"), "resolved": ("open",), "expired": ()},
    "incident": {"open": ("acknowledged", "resolved", "suppressed"), "acknowledged": ("open", "resolved", "suppressed"), "suppressed": ("open", "resolved"), "resolved": ("open",)},
}
COOLDOWN_SECONDS, OPEN = 300, ("open", "acknowledged")


def folded(rows: DataFrame, key: str, added: str, kind: str, fold: Callable[[], Callable[[dict], object]]) -> DataFrame:
    """rows sorted within each key's partition -> with a column that fold gives them one after the other.

    fold() starts anew at each key. A key's rows are streamed in order and only its state is held.
    """
    names = rows.columns

    def go(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step, begun = None, None, False
        for rb in batch_iter:
            out = []
            for row in rb.to_pylist():
                if not begun or row[key] != now:
                    now, step, begun = row[key], fold(), True
                out.append(step(row))
            yield pa.record_batch([*rb.columns, pa.array(out, kind_of)], [*names, added])

    kind_of = {"boolean": pa.bool_(), "string": pa.string()}[kind]
    return rows.mapInArrow(go, T.StructType([*rows.schema, T.StructField(added, T.StringType() if kind == "string" else T.BooleanType())]))


def transitions(requests: DataFrame, kind: str = "insight", first: str = "open", taken: DataFrame | None = None) -> DataFrame:
    """RULE-9: requests(target, at, seq, to) in order per target -> each with from and status (moved, same, rejected).

    A target's requests are streamed in order. taken(target) names those whose key another open row has: they can't be
    opened again.
    """
    moves = MOVES[kind]
    ordered = requests.select("target", F.col("at").cast("timestamp_ntz").alias("at"), F.col("seq").cast("bigint").alias("seq"), "to")
    closed = F.lit(False)
    if taken is not None:
        ordered = ordered.join(taken.select("target", F.lit(True).alias("taken")).distinct(), "target", "left")
        closed = F.coalesce("taken", F.lit(False))
    ordered = ordered.withColumn("taken", closed).repartition("target").sortWithinPartitions("target", "at", "seq", "to")

    def fold():
        state = first

        def step(row: dict) -> str:
            nonlocal state
            ok = row["to"] in moves.get(state, ()) and not (row["to"] == "open" and row["taken"])
            said = f"{state}|{'same' if row['to'] == state else 'moved' if ok else 'rejected'}"
            state = row["to"] if ok and row["to"] != state else state
            return said

        return step

    out = folded(ordered, "target", "said", "string", fold)
    return out.select("target", "at", "seq", F.split_part("said", F.lit("|"), F.lit(1)).alias("from"), "to", F.split_part("said", F.lit("|"), F.lit(2)).alias("status"))


def resolved_at(moved: DataFrame) -> DataFrame:
    """RULE-9: target -> when it was resolved, null if it has left that state since."""
    return moved.where("status = 'moved'").groupBy("target").agg(F.max_by(F.when(F.col("to") == "resolved", F.col("at")), F.struct("at", "seq")).alias("resolved_at"))


def overlay(derived: DataFrame, journal: DataFrame, key: str) -> DataFrame:
    """RULE-10: the latest decision on each target wins over the derived state; decided rows that are derived no more stay with their decision."""
    last = journal.where("status = 'moved'").groupBy("target").agg(F.max_by("to", F.struct("at", "seq")).alias("decided"))
    out = derived.join(last, derived[key] == last["target"], "full")
    return out.withColumns({key: F.coalesce(key, "target"), "state": F.coalesce("decided", "state")}).drop("target", "decided")


def alerts(rows: DataFrame, cooldown: int = COOLDOWN_SECONDS) -> DataFrame:
    """RULE-11: rows(key, at) -> each with sent: the first of a key, and each at least cooldown seconds after the last that was sent.

    After a gap of the cooldown or more the next one is sent whatever came before, so a busy key's rows are cut there and the
    pieces dealt over the cluster; each piece is streamed in order.
    """
    w = W.partitionBy("key").orderBy("at")
    rows = rows.where("at IS NOT NULL").select("key", F.col("at").cast("timestamp_ntz").alias("at"))
    far = F.coalesce(F.timestamp_diff("MICROSECOND", F.lag("at").over(w), F.col("at")) >= cooldown * 1_000_000, F.lit(True))
    rows = rows.withColumn("far", far.cast("int")).withColumn("piece", F.sum("far").over(w))
    rows = rows.select(F.struct("key", "piece").alias("piece"), "key", "at").repartition("piece").sortWithinPartitions("piece", "at")

    def fold():
        last = None

        def step(row: dict) -> bool:
            nonlocal last
            sent = last is None or (row["at"] - last).total_seconds() >= cooldown
            last = row["at"] if sent else last
            return sent

        return step

    return folded(rows, "piece", "sent", "boolean", fold).drop("piece")


def collapse_open(rows: DataFrame) -> DataFrame:
    """AGG-17: of the open rows(insight_id, dedupe_key, observed_at, state, findings) with one key the earliest stays and gets the others' findings; they are suppressed and point to it."""
    opened = rows.where(F.col("state").isin(*OPEN)).groupBy("dedupe_key").agg(F.min_by("insight_id", F.struct("observed_at", "insight_id")).alias("keeper"), F.sum("findings").alias("all_findings"))
    out = rows.join(opened, "dedupe_key", "left")
    is_open, keeps = F.col("state").isin(*OPEN), F.col("insight_id") == F.col("keeper")
    return out.select("insight_id", "dedupe_key", F.when(is_open & ~keeps, "suppressed").otherwise(F.col("state")).alias("state"), F.when(is_open & ~keeps, F.col("keeper")).alias("merged_into"), F.when(is_open & keeps, F.col("all_findings")).otherwise(F.col("findings")).alias("findings"))


def carried_ids(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """JOIN-16: old(id, rule, dedupe_key, entity, events), fresh(same) -> old_id, new_id of rows with equal keys and a common event.

    Adds ambiguous, true where either side has more than one partner; a rebuild must stop on those.
    """
    # Rows meet on a digest of the keys and the event (unhex: 32 bytes), so that no long text travels.
    keys = ("rule", "dedupe_key", "entity", "event")

    def side(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select(F.col("id").alias(f"{name}_id"), *keys[:3], F.explode("events").alias("event"))
        return rows.where(F.concat(*keys).isNotNull()).select(f"{name}_id", F.unhex(F.sha2(F.to_json(F.struct(*keys)), 256)).alias("h"))

    pairs = side(old, "old").join(side(fresh, "new"), "h").select("old_id", "new_id").distinct()
    n = lambda c: F.count("*").over(W.partitionBy(c))
    pairs = pairs.withColumn("n_old", n("old_id")).withColumn("n_new", n("new_id"))
    return pairs.select("old_id", "new_id", ((F.col("n_old") > 1) | (F.col("n_new") > 1)).alias("ambiguous"))
