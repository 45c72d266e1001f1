"""Medians of what came before each sample in its series."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from eventloom.operators import baselines as b
from tests.test_growth import plan


def test_prior_medians_across_batches():
    rng = np.random.default_rng(1)
    keys = sorted([("a", "m")] * 2500 + [("a", "n")] * 3 + [("b", "m")] * 900 + [("c", "m")])
    v = rng.integers(0, 50, len(keys)).astype(float)
    v[[7, 2600]], v[[9, 11]] = np.inf, np.nan
    tail, last, got, at = np.empty(0), None, [], 0
    for size in (1, 1500, 7, 1, 1895):
        part = slice(at, at + size)
        rb = pa.record_batch({"entity": [k[0] for k in keys[part]], "metric": [k[1] for k in keys[part]], "v": v[part]})
        median, count, tail, last = b.prior(rb, tail, last, 200)
        got += list(zip(median, count, strict=True))
        at += size
    assert at == len(keys)
    first = {}
    for i, k in enumerate(keys):
        before = np.sort(v[max(first.setdefault(k, i), i - 200) : i])
        n = len(before)
        assert got[i][1] == n
        if n:
            np.testing.assert_equal(got[i][0], 0.5 * before[(n - 1) // 2] + 0.5 * before[n // 2])


def test_baseline_has_no_sliding_window(spark):
    rows = spark.range(500).select(
        (F.col("id") % 3).cast("string").alias("entity"), F.lit("m").alias("metric"), F.lit("2024-01-01").cast("timestamp_ntz").alias("observed_at"), F.format_string("%04d", "id").alias("event_id"), (F.col("id") * 7 % 11).cast("double").alias("v"),
    )
    out = b.with_baseline(rows, 20)
    assert "Window" not in plan(out)
    w = b.order().rowsBetween(-20, -1)
    want = rows.withColumns({"prior_median": F.percentile("v", F.lit(0.5)).over(w), "prior_n": F.count("v").over(w)})
    assert sorted(map(tuple, out.collect()), key=lambda r: r[3]) == sorted(map(tuple, want.collect()), key=lambda r: r[3])


def test_only_what_rules_can_hit_comes_back(spark):
    """Series that no rule looks at aren't dealt out, and of the others only outliers come out of Python."""
    from eventloom.operators import insights as i
    from eventloom.schema import flat

    n = F.col("id").cast("int")
    shape = lambda event, metric, v: spark.range(40).select(
        F.format_string(f"{event}{metric}%03d", "id").alias("event_id"), F.lit(event).alias("event"), F.lit(metric).alias("metric"), v.alias("value"), F.lit("s").alias("service"), F.timestamp_add("SECOND", n, F.lit("2024-01-01").cast("timestamp_ntz")).alias("observed_at"),
    )
    spiky = F.when(n % 10 == 9, F.when(n == 19, float("nan")).otherwise(35.0)).otherwise(10.0)
    ev = flat(shape("metric.a", "cpu", spiky).union(shape("metric.b", "rows", spiky)).union(shape("metric.c", "my.duration_ms", spiky)))
    out = i.outliers(ev)
    assert {(r.metric, r.event_id[-3:]) for r in out.collect()} == {(m, k) for m in ("rows", "my.duration_ms") for k in ("009", "019", "029", "039")}
    every = i.judged(ev).select(F.explode(F.array_compact(F.array(i.duration_regression(), i.volume_spike()))).alias("f")).select("f.rule", "f.event_id")
    rules = {k: i.RULES[k] for k in ("duration-regression", "volume-spike")}
    assert sorted(map(tuple, i.findings(ev, rules).select("rule", "event_id").collect())) == sorted(map(tuple, every.collect())) != []
