"""Deterministic, policy and whole-run sampling. They drop rows because that is what they are for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators.projections import TERMINAL
from eventloom.schema import SEVERITY_RANK, present

IDLE_SECONDS = 3600


def fraction(*parts: Column) -> Column:
    """The first 64 bits of a SHA-256 of the parts, joined with pipes, as a number in [0, 1)."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16), 16, 10).cast("double") / 18446744073709551616.0


def sample_key() -> Column:
    return F.coalesce(present("run_id"), present("trace_id"), present("invocation_id"), present("request_id"), F.lit(""))


def is_critical() -> Column:
    return F.col("severity") == "critical"


def keep_sampled(rates: dict[str, float], default: float = 1.0) -> Column:
    """VAL-16: events of one name and key share one fate; critical ones always stay."""
    rate = F.lit(default)
    for severity, r in rates.items():
        rate = F.when(F.col("severity") == severity, F.lit(r)).otherwise(rate)
    return is_critical() | (fraction(F.col("event"), sample_key()) < rate)


@dataclass(frozen=True)
class Rule:
    name: str
    event: str = "*"
    min_severity: str | None = None
    outcome: str | None = None
    min_duration_ms: float | None = None
    environment: str | None = None
    service: str | None = None
    rate: float = 1.0
    allow_critical: bool = False

    def matches(self) -> Column:
        glob = "^" + self.event.replace(".", r"\.").replace("*", ".*").replace("?", ".") + "$"
        ok = F.col("event").rlike(glob)
        if self.min_severity:
            rank = F.element_at(F.create_map(*[x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))]), F.col("severity"))
            ok &= rank >= SEVERITY_RANK[self.min_severity]
        for c in ("outcome", "environment", "service"):
            if getattr(self, c):
                ok &= F.col(c) == getattr(self, c)
        if self.min_duration_ms is not None:
            ok &= F.col("duration_ms") >= self.min_duration_ms
        return F.coalesce(ok, F.lit(False))


def decide(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """VAL-17: adds keep and reason. The first rule that matches decides; failures stay unless its name is drop_failures, critical ones unless it allows."""
    keep, reason = F.lit(True), F.lit("no_rule")
    for r in reversed(rules):
        hit = r.matches()
        drawn = fraction(F.col("event"), sample_key(), F.lit(r.name)) < r.rate
        safe = (is_critical() & F.lit(not r.allow_critical)) | ((F.col("outcome") == "failure") & F.lit(r.name != "drop_failures"))
        keep = F.when(hit, safe | drawn).otherwise(keep)
        reason = F.when(hit, F.when(safe, F.lit("kept_always")).otherwise(F.lit(r.name))).otherwise(reason)
    return df.withColumns({"keep": keep, "reason": reason})


def tail_sample(df: DataFrame, slow_ms: float, as_of: Column | None = None) -> DataFrame:
    """VAL-18: a run's events stay if its last terminal event failed or lasted slow_ms or more; events without a run stay; so do runs without a terminal event once idle for an hour."""
    w = W.partitionBy("run_id")
    end = F.col("event").isin(*TERMINAL) & (F.col("outcome") != "unknown")
    last = F.max(F.when(end, F.struct("observed_at", "event_id", "outcome", "duration_ms"))).over(w)
    df = df.withColumns({"_t": last, "_idle": F.max("observed_at").over(w)})
    idle = F.lit(True) if as_of is None else F.timestamp_diff("SECOND", F.col("_idle"), as_of) > IDLE_SECONDS
    keep = F.when(present("run_id").isNull(), True).when(F.col("_t").isNull(), idle).otherwise((F.col("_t.outcome") == "failure") | (F.coalesce(F.col("_t.duration_ms"), F.lit(0.0)) >= slow_ms))
    return df.where(keep).drop("_t", "_idle")
