"""Duplicates, conflicts, and links from traces to runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.staging import staged, unstage
from eventloom.schema import present


def ordered(m: str) -> Column:
    """A map's entries by key: maps that hold the same are then equal."""
    return F.array_sort(F.map_entries(m))


def fields(df: DataFrame) -> list[Column]:
    """All fields but the arrival's, by name, maps as ordered entries."""
    return [ordered(c).alias(c) if t.startswith("map") else F.col(c) for c, t in sorted(df.dtypes) if c != "received_at"]


def content_hash(df: DataFrame) -> Column:
    """SHA-256 of the event without its arrival: fields in fixed order, nulls left out, times to the millisecond."""
    return F.sha2(F.to_json(F.struct(*fields(df))), 256)


def arrival_order(df: DataFrame):
    """By arrival; a hash of the content decides between rows that arrived together, so that each run takes the same one."""
    return W.partitionBy("event_id").orderBy("received_at", "outcome", "row_count", F.xxhash64(*fields(df)))


def arrivals(df: DataFrame) -> DataFrame:
    """JOIN-2: adds arrival status. Of rows with one event_id the first to arrive is accepted; the others are duplicates if their content is equal, else conflicts."""
    w = arrival_order(df)
    df = df.withColumn("content", content_hash(df))
    df = df.withColumns({"place": F.row_number().over(w), "first": F.first("content").over(w)})
    status = F.when(F.col("place") == 1, "accepted").when(F.col("content") == F.col("first"), "duplicate").otherwise("conflict")
    return df.withColumn("status", status).drop("content", "first", "place")


def accepted(df: DataFrame) -> DataFrame:
    """The accepted rows alone, for which contents need not be compared.

    Ids that came more than once are found first, by hash; only their rows are ordered by arrival, the others stay where
    they are. Ids that share a hash are told apart by the order.
    """
    h = F.xxhash64("event_id").alias("_h")
    repeated = staged(df.select(h).groupBy("_h").agg(F.count("*").alias("n")).where("n > 1").select("_h"), "repeated")
    if repeated.isEmpty():
        unstage(repeated)
        return df
    one = df.withColumn("_h", h).join(repeated, "_h", "left_anti").select(*df.columns)
    more = df.withColumn("_h", h).join(repeated, "_h", "left_semi").select(*df.columns)
    return one.union(more.withColumn("place", F.row_number().over(arrival_order(more))).where("place = 1").drop("place"))


def link_traces(df: DataFrame) -> DataFrame:
    """JOIN-1: events with a trace and no run take the smallest run of that trace. Only those meet the join, with one row for each trace, so a busy trace is no hot key on its side."""
    link = df.where(present("trace_id").isNotNull() & present("run_id").isNotNull()).groupBy("trace_id").agg(F.min("run_id").alias("linked"))
    bare = present("trace_id").isNotNull() & present("run_id").isNull()
    found = df.where(bare).join(link, "trace_id", "left").withColumn("run_id", F.col("linked")).select(*df.columns)
    return df.where(~bare).withColumn("run_id", present("run_id")).union(found)


def correlation_method() -> Column:
    """VAL-7, on events before traces are linked."""
    return F.when(present("run_id").isNotNull(), "explicit_run_id").when(present("trace_id").isNotNull(), "trace_id").when(present("invocation_id").isNotNull(), "producer_invocation")


def canonical(df: DataFrame) -> DataFrame:
    """Accepted events with traces linked: what all projections start from."""
    return link_traces(accepted(df))
