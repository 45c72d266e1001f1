"""Metric samples, rolling baselines, metric summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.operators.projections import producer
from eventloom.schema import flat, present

SAMPLES, LEAST = 200, 5


def observations(ev: DataFrame) -> DataFrame:
    """AGG-10: one row for each event with a sample: entity, metric (with its partition, from the tag or the key), base, v.

    A metric.summary event's mean has come in as its value. The entity is that of the entities map, by role, else the
    asset, else the run.
    """
    is_metric = F.col("event").startswith("metric.") & F.col("metric").isNotNull()
    is_run = F.col("event").isin("pipeline.run", "dlt.pipeline.run") & (F.coalesce("duration_ms", F.lit(0.0)) != 0)
    base = F.when(is_metric, F.col("metric")).when(is_run, F.lit("run.duration_ms")).when(F.coalesce("rows_written", "row_count").isNotNull(), F.lit("rows"))
    v = F.when(is_metric, F.col("value")).when(is_run, F.col("duration_ms")).otherwise(F.coalesce("rows_written", "row_count"))
    # The map is looked into only where it holds something: a projection with all look-ups spelt out is too large a method to be compiled.
    roles = F.array(*map(F.lit, ("asset", "table", "model", "run", "service")))
    given = F.when(F.size("entities") > 0, F.get(F.filter(F.transform(roles, lambda r: F.try_element_at("entities", r)), lambda e: e != ""), F.lit(0)))
    of_event = F.coalesce(
        given, F.concat(F.lit("asset://"), present("asset_key")), F.concat(F.lit("run://"), producer(), F.lit("/"), present("run_id")), F.concat(F.lit("service://"), present("service")),
    )
    job_id = F.when(is_run & ~is_metric, F.coalesce(present("job_id"), present("pipeline")))
    job = F.concat(F.lit("job://"), producer(), F.lit("/"), job_id)
    # There is an entity where one of its parts is there; base is there where v is.
    found = F.coalesce(job_id, present("asset_key"), present("run_id"), present("service"), given).isNotNull()
    out = ev.where(v.isNotNull() & found).withColumns({"entity": F.coalesce(job, of_event), "base": base, "v": v})
    part = F.coalesce(present(F.try_element_at("tags", F.lit("partition"))), present("partition_key"))
    return out.withColumn("metric", F.concat_ws("|", "base", part))


def order(partition: tuple[str, ...] = ("entity", "metric")):
    return W.partitionBy(*partition).orderBy("observed_at", "event_id")


def prior(rows: pa.RecordBatch, tail: np.ndarray, last: tuple | None, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Median and number of the up to n values before each row in its series; rows come in order, tail has the values before them of the series last.

    Also the next batch's tail and last.
    """
    keys, v = [rows.column(k) for k in ("entity", "metric")], rows.column("v").to_numpy(zero_copy_only=False)
    starts = np.zeros(len(v), bool)
    for k in keys:
        starts[1:] |= pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
    goes_on = last == tuple(k[0].as_py() for k in keys)
    starts[0] = not goes_on
    tail = tail if goes_on else tail[:0]
    place = np.arange(len(v))
    begun = np.maximum.accumulate(np.where(starts, place, -len(tail)))
    count = np.minimum(place - begun, n)
    values, median = np.concatenate([np.full(n, np.nan), tail, v]), np.full(len(v), np.nan)
    for i in range(0, len(v), 1024):
        c = count[i : i + 1024]
        width = int(c.max())
        if width:
            at = n + len(tail) + i - width
            few = np.lib.stride_tricks.sliding_window_view(values[at : at + len(c) + width - 1], width).copy()
            # What is before the series goes behind its values, as NaN does.
            few[np.arange(width) < width - c[:, None]] = np.nan
            few.sort(axis=1)
            row, some = np.arange(len(c)), np.maximum(c, 1)
            median[i : i + 1024] = 0.5 * few[row, (some - 1) // 2] + 0.5 * few[row, some // 2 - (c == 0)]
    return median, count, np.concatenate([tail, v])[-int(min(len(v) - begun[-1], n)) :], tuple(k[-1].as_py() for k in keys)


def with_baseline(samples: DataFrame, n: int = SAMPLES, times: float | None = None) -> DataFrame:
    """WIN-1, JOIN-4: adds the median and number of the n samples strictly before each.

    With times only rows come out that have LEAST samples before them and aren't known to be at most times the median. One series is read in order by one task, no more than a batch and n values held. A sliding window of Spark's makes the
    median anew from all n for each row; here numpy sorts a thousand rows' at once.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, last = np.empty(0), None
        for rb in batches:
            if rb.num_rows:
                median, count, tail, last = prior(rb, tail, last, n)
                out = pa.record_batch([*rb.columns, pa.array(median, mask=count == 0), pa.array(count, pa.int64())], [*rb.schema.names, "prior_median", "prior_n"])
                if times is not None:
                    # NaN is larger than any number, so it stays.
                    out = out.filter(pa.array((count >= LEAST) & ~(rb.column("v").to_numpy(zero_copy_only=False) <= times * median)))
                yield out

    # Entities begin alike, so a hash goes before them: most comparisons end there.
    rows = samples.repartition("entity", "metric").sortWithinPartitions(F.xxhash64("entity", "metric"), "entity", "metric", "observed_at", "event_id")
    return rows.mapInArrow(go, T.StructType([*samples.schema, T.StructField("prior_median", T.DoubleType()), T.StructField("prior_n", T.LongType())]))


def baselines(samples: DataFrame, n: int = SAMPLES) -> DataFrame:
    """AGG-11: for each series the count of all, and over the newest n: median, median absolute deviation, mean, p10, p90."""
    w = W.partitionBy("entity", "metric")
    rows = samples.select("entity", "metric", "v", "observed_at", "event_id")
    ranked = rows.withColumns({"rn": F.row_number().over(w.orderBy(F.desc("observed_at"), F.desc("event_id"))), "total": F.count("*").over(w)}).where(F.col("rn") <= n)
    middle = ranked.withColumn("m", F.percentile("v", F.lit(0.5)).over(w))

    def at(p: float) -> Column:
        values = F.array_sort(F.collect_list("v"))
        return F.element_at(values, (F.bround(F.lit(p) * (F.size(values) - 1)) + 1).cast("int"))

    return middle.groupBy("entity", "metric").agg(
        F.first("total").alias("count"), F.first("m").alias("median"), F.percentile(F.abs(F.col("v") - F.col("m")), F.lit(0.5)).alias("mad"), F.avg("v").alias("mean"), at(0.1).alias("p10"), at(0.9).alias("p90")
    )


def series(ev: DataFrame) -> list[Column]:
    """AGG-12: what tells metric series apart: the metric, its service, dimensions, entities, correlation and tags, maps as ordered JSON."""
    maps = [F.to_json(F.array_sort(F.map_entries(c))).alias(c) for c in ("entities", "tags")]
    dimensions = F.get_json_object("attributes", "$.dimensions").alias("dimensions")
    return [F.col("metric"), F.col("service"), F.col("run_id"), F.col("asset_key"), dimensions, *maps]


def summarised(groups: GroupedData) -> DataFrame:
    """Groups by a window w -> count, sum, min, max, mean and nearest-rank percentiles (exact) of value.

    A minute's values of one series are held at once, for the percentiles are exact.
    """
    values = F.array_sort(F.collect_list("value"))
    rank = lambda p: F.element_at(values, F.greatest(F.lit(1), F.ceil(F.lit(p) * F.size(values)).cast("int")))
    out = groups.agg(
        F.count("*").alias("count"), F.round(F.sum("value"), 6).alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.round(F.avg("value"), 6).alias("mean"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"),
    )
    return out.withColumn("slot", F.col("w.start")).drop("w")


def summaries(ev: DataFrame, every: str = "60 seconds") -> DataFrame:
    """AGG-12: metric samples by time slot and series."""
    rows = ev.where(F.col("event").startswith("metric.")).where("value IS NOT NULL")
    return summarised(rows.groupBy(F.window("observed_at", every).alias("w"), *series(rows)))


def summary_events(summaries: DataFrame) -> DataFrame:
    """AGG-12: summaries as metric.summary events, one for each series and slot."""
    body = F.to_json(F.struct("metric", "count", "sum", "min", "max", "mean", "p50", "p95", "p99", "dimensions"))
    key = F.concat_ws("|", "metric", "service", "run_id", "asset_key", "dimensions", "entities", "tags", F.col("slot").cast("string"))
    return flat(summaries.select(
        F.substring(F.sha2(key, 256), 1, 32).alias("event_id"), F.lit("metric.summary").alias("event"), F.lit("metric").alias("category"), F.lit("unknown").alias("outcome"),
        F.lit("info").alias("severity"), F.col("slot").cast("timestamp_ntz").alias("observed_at"), "service", "run_id", "asset_key", "metric", F.col("mean").alias("value"), body.alias("attributes"),
    ))
