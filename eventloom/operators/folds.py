"""Projections as folds: each row of a derived table is a sum, minimum, maximum or newest-first list over what events add to it.

Such states can be merged in any order and grouping, so a batch's events are folded alone and the result is put beside what
is stored; the merge of all is the projection of all events.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators import baselines, insights, projections
from eventloom.operators.projections import MATERIALIZE, STATUS_RANK, TERMINAL, verb
from eventloom.schema import present

#: Samples that a series keeps: those that a verdict looks back on, and as many again, so that late samples find theirs.
TAIL = 2 * baselines.SAMPLES


@dataclass(frozen=True)
class Fold:
    """key: the columns of a row; how: what becomes of each other column (sum, min, max, newest); parts: what events add, one row for each; final: the table of merged rows."""

    key: tuple[str, ...]
    how: dict[str, str]
    parts: Callable[[DataFrame], DataFrame]
    final: Callable[[DataFrame], DataFrame]


def newest(c: str) -> Column:
    """Of lists of structs that start with the position: the TAIL newest."""
    return F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list(c)))), 1, TAIL)


KINDS: dict[str, Callable[[str], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "newest": newest}


def merged(rows: DataFrame, fold: Fold) -> DataFrame:
    return rows.groupBy(*fold.key).agg(*[KINDS[kind](c).alias(c) for c, kind in fold.how.items()])


def folded(ev: DataFrame, fold: Fold, salts: int = 1) -> DataFrame:
    """What these events add, merged by key. Lists are cut down in so many parts of a key first, so that a busy key's is never held whole."""
    rows = fold.parts(ev)
    if salts > 1 and "newest" in fold.how.values():
        salt = F.pmod(F.xxhash64(*[F.col(c) for c, kind in fold.how.items() if kind == "newest"]), F.lit(salts))
        rows = rows.groupBy(*fold.key, salt.alias("_salt")).agg(*[KINDS[kind](c).alias(c) for c, kind in fold.how.items()]).drop("_salt")
    return merged(rows, fold)


def at(value: Column, when: Column | None = None) -> Column:
    """The value with its position, where it is present: the maximum of these is the newest."""
    ok = present(value.cast("string")).isNotNull()
    return F.when(ok if when is None else ok & when, F.struct("observed_at", "event_id", value.alias("v")))


def _runs(ev: DataFrame) -> DataFrame:
    ended = F.col("event").isin(*TERMINAL)
    known = ended & (F.col("outcome") != "unknown")
    bad = F.col("error_message").isNotNull() | F.col("severity").isin("error", "critical")
    rank = F.when(known, F.element_at(F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(k), F.lit(v))]), F.col("outcome"))).otherwise(F.lit(1))
    one = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    return ev.where(present("run_id").isNotNull()).select(
        "run_id", F.lit(1).cast("long").alias("event_count"), one(bad).alias("error_count"), one(~bad & (F.col("severity") == "warn")).alias("warning_count"),
        at(F.col("branch")).alias("branch"), at(F.col("job_id")).alias("job_name"), at(F.col("service")).alias("service"), at(F.col("environment")).alias("environment"), rank.alias("rank"),
        F.when(known, F.coalesce("ended_at", "observed_at")).alias("ended_at"), at(F.col("duration_ms"), ended).alias("duration_ms"), at(F.col("trigger"), ended).alias("trigger"),
        F.col("started_at").alias("min_started"), F.struct("observed_at", "event_id", F.col("started_at").isNull().alias("v")).alias("first"), F.col("observed_at").alias("updated_at"),
    )


def _runs_final(rows: DataFrame) -> DataFrame:
    status = F.element_at(F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(v), F.lit(k))]), F.col("rank"))
    latest = [F.col(f"{c}.v").alias(c) for c in ("branch", "job_name", "service", "environment")]
    first = F.when(F.col("first.v"), F.col("first.observed_at"))
    return rows.select(
        "run_id", "event_count", "error_count", "warning_count", *latest, "ended_at", F.col("duration_ms.v").alias("duration_ms"), F.col("trigger.v").alias("trigger"), "updated_at",
        status.alias("status"), F.least("min_started", first).alias("started_at"),
    )


def _entities(ev: DataFrame) -> DataFrame:
    rows = projections.with_entities(ev)
    return rows.select(
        "entity_id", F.struct("observed_at", "event_id", "role", projections.kind_of(F.col("role")).alias("v")).alias("kind"), F.col("observed_at").alias("first_seen"), F.col("observed_at").alias("last_seen"),
        F.lit(1).cast("long").alias("sightings"),
    )


def _entities_final(rows: DataFrame) -> DataFrame:
    return rows.select("entity_id", F.col("kind.v").alias("kind"), "first_seen", "last_seen", "sightings", F.substring_index("entity_id", "://", -1).alias("display_name"))


def _relationships(ev: DataFrame) -> DataFrame:
    return projections.edges(ev).select(
        "src", "dst", "type", "confidence", "method", F.lit(1).cast("long").alias("events"), F.col("observed_at").alias("first_seen"), F.col("observed_at").alias("last_seen"),
    )


def _assets(ev: DataFrame) -> DataFrame:
    ev = ev.where(present("asset_key").isNotNull())
    ok, bad = F.col("outcome") == "success", F.col("outcome") == "failure"
    return ev.select(
        F.concat(F.lit("asset://"), "asset_key").alias("entity_id"), F.col("observed_at").alias("last_event_at"), F.when(ok & verb().isin(*MATERIALIZE), F.col("observed_at")).alias("last_materialized_at"),
        F.when(ok, F.col("observed_at")).alias("s"), F.when(bad, F.col("observed_at")).alias("f"), at(F.col("sla_seconds")).alias("sla_seconds"),
    )


def _assets_final(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("sla_seconds", F.col("sla_seconds.v"))
    status = F.when(F.col("s").isNull() & F.col("f").isNull(), "unknown").when(F.col("f").isNull(), "healthy").when(F.col("s").isNull() | (F.col("f") >= F.col("s")), "failing").otherwise("recovering")
    return rows.withColumn("status", status).drop("s", "f")


#: Of an event, what a finding on a sample says of it besides the sample.
SAID = ("event", "producer")


def _samples(ev: DataFrame) -> DataFrame:
    rows = baselines.observations(ev.withColumn("producer", projections.producer()))
    return rows.select("entity", "metric", F.lit(1).cast("long").alias("count"), F.array(F.struct("observed_at", "event_id", "v", "base", *SAID)).alias("tail"))


def _baselines_final(rows: DataFrame) -> DataFrame:
    """Statistics of each series' newest samples, from its list."""
    values = F.array_sort(F.transform(F.slice("tail", 1, baselines.SAMPLES), lambda x: x["v"]))
    rows = rows.select("entity", "metric", "count", values.alias("v")).withColumn("n", F.size("v"))

    def middle(v: Column) -> Column:
        pick = lambda i: F.get(v, i.cast("int"))
        n = F.size(v)
        return (pick(F.floor((n - 1) / 2)) + pick(F.floor(n / 2))) / 2.0

    rows = rows.withColumn("median", middle(F.col("v")))
    apart = F.array_sort(F.transform("v", lambda x: F.abs(x - F.col("median"))))
    rank = lambda p: F.get("v", F.bround(F.lit(p) * (F.col("n") - 1)).cast("int"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    return rows.select("entity", "metric", "count", "median", middle(apart).alias("mad"), mean.alias("mean"), rank(0.1).alias("p10"), rank(0.9).alias("p90"))


def _freshness(ev: DataFrame) -> DataFrame:
    """By asset the newest successful materialisations, and the newest events with an SLA; n counts both, to tell whether a list is whole."""
    ev = ev.where(present("asset_key").isNotNull()).withColumn("producer", projections.producer())
    done = (F.col("outcome") == "success") & verb().isin(*MATERIALIZE)
    due = F.col("sla_seconds").isNotNull()
    none = F.array()
    made = F.struct("observed_at", "event_id")
    asked = F.struct("observed_at", "event_id", "sla_seconds", *SAID)
    return ev.where(F.coalesce(done, F.lit(False)) | due).select(
        "asset_key", F.when(done, 1).otherwise(0).cast("long").alias("n_done"), F.when(due, 1).otherwise(0).cast("long").alias("n_due"),
        F.when(done, F.array(made)).otherwise(none).alias("done"), F.when(due, F.array(asked)).otherwise(none).alias("due"),
    )


def _links(ev: DataFrame) -> DataFrame:
    return ev.where(present("trace_id").isNotNull() & present("run_id").isNotNull()).select("trace_id", "run_id")


#: Columns of a stored finding that the rules say; hit is false where a later verdict took it back.
VERDICT = ("hit", "severity", "kind", "summary", "event", "producer", "observed_at", "dedupe_key")


def verdicts(found: DataFrame, number: int) -> DataFrame:
    """Findings, or what became of them, as rows of the fold `findings`: of one event and rule the newest verdict holds."""
    return found.select("entity", "rule", "event_id", F.struct(F.lit(number).cast("long").alias("number"), *[F.col(c) for c in VERDICT]).alias("said"))


def live_findings(rows: DataFrame) -> DataFrame:
    said = [F.col(f"said.{c}").alias(c) for c in VERDICT if c != "hit"]
    return rows.where("said.hit").select("rule", "entity", "event_id", *said)


def resolving(ends: DataFrame, number: int, live: bool = True) -> DataFrame:
    return ends.select("entity", "rule", "event_id", F.struct(F.lit(number).cast("long").alias("number"), F.lit(live).alias("live"), "observed_at").alias("said"))


def live_resolvers(rows: DataFrame) -> DataFrame:
    return rows.where("said.live").select("rule", "entity", "event_id", F.col("said.observed_at").alias("observed_at"))


def _found(ev: DataFrame) -> DataFrame:
    return verdicts(insights.findings(ev).withColumn("hit", F.lit(True)), 0)


same: Callable[[DataFrame], DataFrame] = lambda rows: rows
FOLDS: dict[str, Fold] = {
    "runs": Fold(
        ("run_id",),
        {
            "event_count": "sum", "error_count": "sum", "warning_count": "sum", "branch": "max", "job_name": "max", "service": "max", "environment": "max", "rank": "max", "ended_at": "max", "duration_ms": "max",
            "trigger": "max", "min_started": "min", "first": "min", "updated_at": "max",
        }, _runs, _runs_final,
    ),
    "entities": Fold(("entity_id",), {"kind": "min", "first_seen": "min", "last_seen": "max", "sightings": "sum"}, _entities, _entities_final),
    "relationships": Fold(("src", "dst", "type"), {"confidence": "max", "method": "max", "events": "sum", "first_seen": "min", "last_seen": "max"}, _relationships, same),
    "assets": Fold(("entity_id",), {"last_event_at": "max", "last_materialized_at": "max", "s": "max", "f": "max", "sla_seconds": "max"}, _assets, _assets_final),
    "baselines": Fold(("entity", "metric"), {"count": "sum", "tail": "newest"}, _samples, _baselines_final),
    "freshness": Fold(("asset_key",), {"n_done": "sum", "n_due": "sum", "done": "newest", "due": "newest"}, _freshness, same),
    "links": Fold(("trace_id",), {"run_id": "min"}, _links, same),
    "findings": Fold(("entity", "rule", "event_id"), {"said": "max"}, _found, live_findings),
    "resolvers": Fold(("entity", "rule", "event_id"), {"said": "max"}, lambda ev: resolving(insights.resolvers(ev), 0), live_resolvers),
}
#: What a batch of events adds at once; links and findings are made on the way.
ADDITIVE = ("runs", "entities", "relationships", "assets", "baselines", "freshness")
