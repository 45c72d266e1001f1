"""Rules over canonical events, episodes of findings, incidents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.staging import staged
from eventloom.operators.baselines import LEAST, observations, with_baseline
from eventloom.operators.projections import MATERIALIZE, PROVENANCE, TERMINAL, producer, verb
from eventloom.schema import present, seconds_between

QUALITY = ("quality.check", "quality.validate", "dbt.test.execute")
DURATION_TIMES, ROWS_TIMES, GAP_SECONDS = 2, 3, 30 * 60


def run_entity() -> Column:
    return F.concat(F.lit("run://"), producer(), F.lit("/"), present("run_id"))


def signal_entity() -> Column:
    given = lambda r: present(F.try_element_at("entities", F.lit(r)))
    return F.coalesce(
        given("asset"), F.concat(F.lit("asset://"), present("asset_key")), given("model"), given("table"), F.concat(F.lit("table://"), present("table_name")), run_entity(),
    )


def finding(rule: str, hit: Column, entity: Column, severity: str, kind: Column, summary: Column) -> Column:
    """What a rule says of an event; null where it doesn't hit."""
    said = F.struct(
        F.lit(rule).alias("rule"), entity.alias("entity"), F.lit(severity).alias("severity"), kind.alias("kind"), summary.alias("summary"),
        "event", producer().alias("producer"), "event_id", "observed_at",
    )
    return F.when(hit, said)


def run_failure() -> Column:
    """RULE-1."""
    hit = F.col("event").isin(*TERMINAL) & (F.col("outcome") == "failure")
    kind = F.when(present("retry_of").isNotNull(), "recurring_failure").otherwise("failure")
    return finding("run-failure", hit, run_entity(), "critical", kind, F.coalesce(present("error_message"), F.concat(F.col("event"), F.lit(" failed"))))


def quality_failure() -> Column:
    """RULE-2."""
    hit = F.col("event").isin(*QUALITY) & (F.col("outcome") == "failure")
    return finding("quality-failure", hit, signal_entity(), "warning", F.lit("quality"), F.coalesce(present("error_message"), F.lit("quality check failed")))


#: What the rules on samples look at, and all that a series needs of an event.
SAMPLE = ("event_id", "event", "observed_at", "producer", "service", "entity", "metric", "base", "v")


def judged(ev: DataFrame, only: DataFrame | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Events with a sample, with what came before it in its series; of the events all columns, or those named."""
    rows = of_entities(observations(ev), F.col("entity"), only)
    return with_baseline(rows if columns is None else rows.select(*columns))


def outliers(ev: DataFrame, only: DataFrame | None = None, named: Sequence[str] | None = None) -> DataFrame:
    """Of judged what RULE-3 and RULE-4 can hit. Only series that have their samples are dealt out, each of them whole; with named those whose base has a sample of such an event."""
    rows = of_entities(observations(ev), F.col("entity"), only).withColumn("producer", producer())
    # A series' name is the base, or the base with a partition after it.
    of_rules = (F.split_part("metric", F.lit("|"), F.lit(1)) == "rows") | F.contains("metric", F.lit("duration_ms"))
    rows = rows.where(of_rules)
    if named is not None:
        rows = rows.join(F.broadcast(rows.where(F.col("event").isin(*named)).select("base").distinct()), "base", "left_semi")
    return with_baseline(rows.select(*[c for c in SAMPLE if c != "service"]), times=min(DURATION_TIMES, ROWS_TIMES)).withColumn("service", F.lit(None).cast("string"))


def duration_regression() -> Column:
    """RULE-3: more than twice the prior median, from five samples on."""
    hit = F.col("base").endswith("duration_ms") & (F.col("prior_n") >= LEAST) & (F.col("prior_median") != 0) & (F.col("v") > DURATION_TIMES * F.col("prior_median"))
    return finding("duration-regression", hit, F.col("entity"), "warning", F.lit("regression"), F.concat(F.lit("slow: "), F.col("metric")))


def volume_spike() -> Column:
    """RULE-4: more than three times the prior median."""
    hit = (F.col("base") == "rows") & (F.col("prior_n") >= LEAST) & (F.col("prior_median") > 0) & (F.col("v") > ROWS_TIMES * F.col("prior_median"))
    return finding("volume-spike", hit, F.col("entity"), "warning", F.lit("anomaly"), F.concat(F.lit("many: "), F.col("metric")))


def materialized() -> Column:
    return (F.col("outcome") == "success") & verb().isin(*MATERIALIZE)


def with_sla(ev: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Of freshness what RULE-5 can hit: events with an SLA, and what materialised before them."""
    return freshness(ev.where(F.col("sla_seconds").isNotNull() | materialized()), only)


def freshness(ev: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """JOIN-3: adds the newest successful materialisation of the asset strictly before each event."""
    done = materialized()
    w = W.partitionBy("asset_key").orderBy("observed_at", "event_id").rowsBetween(W.unboundedPreceding, -1)
    rows = of_entities(ev.where(present("asset_key").isNotNull()), F.concat(F.lit("asset://"), "asset_key"), only)
    return rows.withColumn("materialized_before", F.max(F.when(done, F.col("observed_at"))).over(w))


def freshness_breach() -> Column:
    """RULE-5."""
    hit = F.col("sla_seconds").isNotNull() & (seconds_between("materialized_before", "observed_at") > F.col("sla_seconds"))
    return finding("freshness-breach", hit, F.concat(F.lit("asset://"), F.col("asset_key")), "warning", F.lit("freshness"), F.lit("stale before this event"))


#: What rules look at: name -> function of events.
VIEWS: dict[str, Callable[[DataFrame, DataFrame | None], DataFrame]] = {"events": lambda ev, only: ev, "samples": judged, "assets": freshness}
#: UDF-4: rule id -> (version, view, the finding of a row of that view).
RULES: dict[str, tuple[int, str, Callable[[], Column]]] = {
    "run-failure": (1, "events", run_failure),
    "quality-failure": (1, "events", quality_failure),
    "duration-regression": (1, "samples", duration_regression),
    "volume-spike": (1, "samples", volume_spike),
    "freshness-breach": (1, "assets", freshness_breach),
}

#: Rules whose findings are of incidents, errors or critical; the others warn.
SEVERE = ("run-failure",)


def dedupe_key() -> Column:
    """RULE-6: 32 hex digits of a SHA-256 over the compact JSON list of rule, entity, event and producer."""
    return F.substring(F.sha2(F.to_json(F.array("rule", F.coalesce("entity", F.lit("")), "event", "producer")), 256), 1, 32)


def of_entities(rows: DataFrame, entity: Column, only: DataFrame | None) -> DataFrame:
    return rows if only is None else rows.withColumn("_entity", entity).join(only.withColumnRenamed("entity", "_entity"), "_entity", "left_semi").drop("_entity")


def findings(ev: DataFrame, rules=None, only: DataFrame | None = None, named: Sequence[str] | None = None) -> DataFrame:
    """What the rules say of all events: each view is gone through once, however many rules look at it.

    only(entity) keeps to findings of those entities, named to findings of events of those names.
    """
    rules = RULES if rules is None else rules
    of_names = F.lit(True) if named is None else F.col("event").isin(*named)
    out = None
    for name, view in VIEWS.items():
        mine = [rule for _, at, rule in rules.values() if at == name]
        said = [rule() for rule in mine]
        if said:
            # A rule of the caller's may look at any row and column.
            known = {"samples": (duration_regression, volume_spike), "assets": (freshness_breach,)}.get(name, ())
            narrow = {"samples": outliers, "assets": with_sla}[name] if known and all(rule in known for rule in mine) else view
            if narrow is with_sla and named is not None and ev.where(F.col("sla_seconds").isNotNull() & of_names).isEmpty():
                continue
            rows = outliers(ev, only, named) if narrow is outliers else narrow(ev, only)
            rows = rows.where(of_names).select(F.explode(F.array_compact(F.array(*said))).alias("f")).select("f.*")
            out = rows if out is None else out.union(rows)
    out = out.withColumn("dedupe_key", dedupe_key())
    return of_entities(out, F.col("entity"), only)


def entities_judged(ev: DataFrame) -> DataFrame:
    """Entities (entity) that findings of these events, or of those after them in a series, may have."""
    asset = F.concat(F.lit("asset://"), present("asset_key"))
    each = ev.select(F.explode(F.array_compact(F.array(run_entity(), signal_entity(), asset))).alias("entity"))
    return each.union(observations(ev).select("entity"))


def resolvers(ev: DataFrame) -> DataFrame:
    """Events that close findings: rule, entity, event_id, observed_at."""
    ok = ev.where("outcome = 'success'")
    runs = ok.where(F.col("event").isin(*TERMINAL)).select(F.lit("run-failure").alias("rule"), run_entity().alias("entity"), "event_id", "observed_at")
    checks = ok.where(F.col("event").isin(*QUALITY)).select(F.lit("quality-failure").alias("rule"), signal_entity().alias("entity"), "event_id", "observed_at")
    return runs.union(checks)


def with_resolver(found: DataFrame, ev: DataFrame | None, only: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """JOIN-5, WIN-4: adds the first resolver of the same rule and entity at or after each finding's instant.

    ends are the resolvers, if they are known already. Read from the newest on, all that is not before a row's instant is a
    growing frame, so the minimum is carried along.
    """
    ends = of_entities(resolvers(ev), F.col("entity"), only) if ends is None else ends
    both = found.withColumn("res", F.lit(False)).unionByName(ends.withColumn("res", F.lit(True)), allowMissingColumns=True)
    w = W.partitionBy("rule", "entity").orderBy(F.desc("observed_at")).rangeBetween(W.unboundedPreceding, W.currentRow)
    next_one = F.min(F.when(F.col("res"), F.struct("observed_at", "event_id"))).over(w)
    out = both.withColumn("r", next_one).where("NOT res").drop("res")
    return out.withColumns({"resolved_at": F.col("r.observed_at"), "resolved_by": F.col("r.event_id")}).drop("r")


def with_evidence(rows: DataFrame, key: list[str], k: int = PROVENANCE) -> DataFrame:
    """TOP-1: adds evidence, the event's id where it is among its key's k earliest, and p, its position."""
    w = W.partitionBy(*key).orderBy("observed_at", "event_id")
    return rows.withColumns({"p": F.struct("observed_at", "event_id"), "evidence": F.when(F.row_number().over(w) <= k, F.struct("observed_at", "event_id"))})


def evidence_ids() -> Column:
    return F.transform(F.array_sort(F.collect_list("evidence")), lambda x: x["event_id"])


def episodes(found: DataFrame, ev: DataFrame | None, only: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """RULE-7: findings of one key with the same next resolver are one insight, with its earliest events as evidence."""
    rows = with_evidence(with_resolver(found, ev, only, ends), ["dedupe_key", "resolved_by"])
    out = rows.groupBy("dedupe_key", "resolved_by").agg(
        F.first("rule").alias("rule"), F.first("entity").alias("entity"), F.first("resolved_at").alias("resolved_at"),
        F.min_by("severity", "p").alias("severity"), F.min_by("kind", "p").alias("kind"), F.min_by("summary", "p").alias("summary"),
        F.min_by("event_id", "p").alias("first_event"), F.min("observed_at").alias("observed_at"), F.max("observed_at").alias("last_observed_at"),
        F.count("*").alias("findings"), evidence_ids().alias("evidence"),
    )
    before = W.partitionBy("dedupe_key").orderBy(F.col("resolved_at").asc_nulls_last(), "resolved_by")
    return out.withColumns({
        "state": F.when(F.col("resolved_by").isNull(), "open").otherwise("resolved"), "open_from": F.lag("resolved_at").over(before),
        "insight_id": F.sha2(F.concat_ws("|", "dedupe_key", "first_event"), 256),
    })


def incidents(found: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """RULE-8, WIN-2: error and critical findings of one entity, at most gap seconds apart, are one incident from the first critical on.

    Errors alone open none. Severity is the highest by rank. A finding without an entity is its own incident.
    """
    rank = F.when(F.col("severity") == "critical", 60).otherwise(50)
    rows = found.where("severity IN ('error', 'critical')").withColumns({"who": F.coalesce("entity", F.col("event_id")), "rank": rank})
    w = W.partitionBy("who").orderBy("observed_at", "event_id")
    new = F.coalesce((seconds_between(F.lag("observed_at").over(w), "observed_at") > gap).cast("int"), F.lit(1))
    rows = rows.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    opened = F.max("rank").over(W.partitionBy("who", "island").orderBy("observed_at", "event_id"))
    rows = with_evidence(rows.withColumn("opened", opened).where("opened = 60"), ["who", "island"])
    out = rows.groupBy("who", "island").agg(
        F.first("entity").alias("entity"), F.min_by("summary", "p").alias("title"), F.min("observed_at").alias("started_at"), F.max("observed_at").alias("last_at"),
        F.max("rank").alias("rank"), F.count("*").alias("members"), F.min_by("event_id", "p").alias("first_event"), evidence_ids().alias("member_events"),
    )
    return out.withColumn("severity", F.when(F.col("rank") == 60, "critical").otherwise("error")).drop("island", "rank")


def incident_insights(incidents: DataFrame, episodes: DataFrame) -> DataFrame:
    """JOIN-10: the insights behind each incident: those with a member's event among their evidence."""
    members = incidents.select(F.col("first_event").alias("incident"), F.explode("member_events").alias("event_id"))
    behind = episodes.select("insight_id", "rule", "state", "observed_at", F.explode("evidence").alias("event_id"))
    return members.join(behind, "event_id").select("incident", "insight_id", "rule", "state", "observed_at").distinct()


def behind_incidents(ev: DataFrame) -> DataFrame:
    """JOIN-10 over all events: only findings are made that can stand behind an incident.

    An insight's findings have one key, and so events of one name. One that shares an event with an incident has the name of a
    severe finding's event, so findings of other names are left out before series and assets are dealt, and resolvers of
    rules that found nothing else. The findings that are left are staged, for incidents and insights come of them.
    """
    names = [r.event for r in findings(ev, {k: RULES[k] for k in SEVERE}).select("event").distinct().collect()]
    found = staged(findings(ev, named=names), "findings")
    rules = [r.rule for r in found.select("rule").distinct().collect()]
    return incident_insights(incidents(found), episodes(found, None, ends=resolvers(ev).where(F.col("rule").isin(*rules))))
