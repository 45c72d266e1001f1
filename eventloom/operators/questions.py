"""Operators' questions, each as a DataFrame over events and projections, for all runs or assets at once."""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.staging import staged
from eventloom.operators import insights
from eventloom.operators import projections as p
from eventloom.schema import pos, present, seconds_between

PAGE, EVENT_CAP, CHANGE_CAP, COMPARABLE, CAUSES, LINEAGE_CAP = 100, 10_000, 1000, 5, 3, 5000
#: Fixed values.
CHANGE_CATEGORIES, CHANGE_VERBS = ("infrastructure", "storage"), ("deploy", "commit", "create", "migrate", "release", "upgrade")
PHASES = ("pipeline", "asset", "quality", "table", "wap", "external")
LABELS = {
    "pipeline.run": "Run", "pipeline.step": "Step", "ingestion.load": "Ingest", "ingestion.extract": "Extract", "asset.materialize": "Materialize",
    "quality.validate": "Validate", "quality.check": "Check", "wap.branch.create": "Create branch", "wap.promote": "Promote", "table.commit": "Commit",
    "iceberg.snapshot.create": "Snapshot", "dbt.run": "dbt run", "dbt.test": "dbt test", "external.source_event": "External event", "observer.ingest": "Observer ingest",
}


def search(ev: DataFrame, q: str | None = None, since=None, until=None, **equal: str) -> DataFrame:
    """QRY-1, QRY-3: equality filters, inclusive bounds, and q anywhere in the text columns, literally and whatever its case."""
    for c, v in equal.items():
        ev = ev.where(F.col(c) == v)
    if since is not None:
        ev = ev.where(F.col("observed_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        ev = ev.where(F.col("observed_at") <= F.lit(until).cast("timestamp_ntz"))
    if q:
        hit = F.lit(False)
        for c in ("event", "table_name", "asset_key", "service", "error_message"):
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))
        ev = ev.where(hit)
    return ev


def cursor(observed_at: str, event_id: str) -> str:
    return base64.urlsafe_b64encode(f"{observed_at}|{event_id}".encode()).decode()


def page(ev: DataFrame, limit: int = PAGE, after: str | None = None) -> DataFrame:
    """TOP-2: the next events by position after a cursor. The limit is the feature."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit is 1 to 1000")
    if after:
        at, event_id = base64.urlsafe_b64decode(after).decode().split("|", 1)
        at = F.lit(at).cast("timestamp_ntz")
        ev = ev.where((F.col("observed_at") > at) | ((F.col("observed_at") == at) & (F.col("event_id") > event_id)))
    return ev.orderBy("observed_at", "event_id").limit(limit)


def bounded(df: DataFrame, key: str, order: list[Column], cap: int) -> DataFrame:
    """TOP-4: the first rows of each key up to a cap, with truncated true where there were more. The cap is the feature."""
    w = W.partitionBy(key)
    return df.withColumns({"rn": F.row_number().over(w.orderBy(*order)), "truncated": F.count("*").over(w) > cap}).where(F.col("rn") <= cap)


def summary() -> Column:
    """What a step did, in a line: its error, else what its kind of event says of itself; null where it says nothing."""
    attr = lambda name: F.get_json_object("attributes", f"$.{name}")
    number = lambda name: F.try_variant_get(F.try_parse_json("attributes"), f"$.{name}", "double")
    rows = F.coalesce(number("rows_out"), number("rows_in"))
    total, passed = number("checks_total").cast("long"), F.coalesce(number("checks_passed").cast("long"), F.lit(0).cast("long"))
    verdict = F.when(attr("passed") == "true", "passed").otherwise("failed")
    branch, target = F.coalesce(present(attr("branch")), F.col("branch")), F.coalesce(attr("target"), F.col("target"))
    subject = F.coalesce(present("asset_key"), present("table_name"))
    event = F.col("event")
    of_kind = (
        F.when(event.startswith("ingestion.") & rows.isNotNull(), F.concat(F.format_number(F.floor(rows), 0), F.lit(" rows")))
        .when((event == "quality.validate") & (total > 0), F.concat(passed.cast("string"), F.lit("/"), total.cast("string"), F.lit(" checks passed")))
        .when(event == "quality.validate", attr("suite"))
        .when(event == "quality.check", F.concat_ws(" ", present(attr("check_name")), verdict))
        .when(event == "wap.promote", F.when(present(branch).isNotNull() & present(target).isNotNull(), F.concat(branch, F.lit(" -> "), target)).otherwise(branch))
        .when(event == "wap.branch.create", F.concat(F.lit("branch "), present(branch)))
        .when(event == "pipeline.step", attr("step_key"))
        .when(event == "pipeline.run", F.coalesce(present(attr("job")), F.col("job_id")))
        .otherwise(subject)
    )
    return F.coalesce(present("error_message"), of_kind)


def timeline(ev: DataFrame) -> DataFrame:
    """QRY-5: events of all runs in order, with phase, label and a line of text."""
    head = F.substring_index("event", ".", 1)
    phase = F.when(head.isin(*PHASES) & F.contains("event", F.lit(".")), head).otherwise("other")
    fixed = F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))])
    label = F.coalesce(F.element_at(fixed, F.col("event")), F.initcap(F.regexp_replace(p.verb(), "_", " ")))
    rows = bounded(ev.where(present("run_id").isNotNull()), "run_id", [F.col("observed_at"), F.col("event_id")], EVENT_CAP)
    return rows.select("run_id", "rn", "event_id", "observed_at", phase.alias("phase"), label.alias("label"), summary().alias("summary"), "truncated")


def failures(ev: DataFrame) -> DataFrame:
    """QRY-6: events of runs that failed or carry an error."""
    return ev.where(present("run_id").isNotNull() & ((F.col("outcome") == "failure") | F.col("error_message").isNotNull())).select("run_id", "event_id", "event", "outcome", "error_message", "observed_at")


def is_change() -> Column:
    return F.col("category").isin(*CHANGE_CATEGORIES) | p.verb().isin(*CHANGE_VERBS)


def numbered_changes(runs: DataFrame, ev: DataFrame, hours: float, cap: int, shown: Callable[[Column], Column] = lambda t: t, columns: tuple[str, ...] = ("change_id", "change", "changed_at")) -> tuple[DataFrame, DataFrame]:
    """Changes numbered by time: runs with the numbers lo, hi around their changes and their block, and the blocks of changes with those columns, times as shown.

    Numbers are given within each slot of an hour by a window, across slots by the slots' sums. A block holds the changes of
    cap numbers and of the cap before them, the newest first, so a run's newest changes up to the cap lie in the block of its
    hi: it meets one row, and no run meets all changes of a day.
    """
    if not 0.1 <= hours <= 720:
        raise ValueError("hours is 0.1 to 720")
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    slot = F.floor(F.timestamp_diff("SECOND", epoch, F.col("t")) / 3600).alias("slot")
    start = F.coalesce("started_at", "updated_at")
    low = F.timestamp_add("SECOND", F.lit(-round(hours * 3600)), start)
    none = lambda kind: F.lit(None).cast(kind)
    changed = ev.where(is_change()).select("event_id", "event", F.col("observed_at").alias("t"))
    # One row a slot: the hours of the log.
    before = changed.withColumn("slot", slot).groupBy("slot").agg(F.count("*").alias("m"))
    # Kinds: 0 before all changes of its instant, 1 a change, 2 after them.
    ends = runs.where(start.isNotNull()).select("run_id", start.alias("start"), F.explode(F.array(F.struct(low.alias("t"), F.lit(0).alias("kind")), F.struct(start.alias("t"), F.lit(2).alias("kind")))).alias("x"))
    ends = ends.select("run_id", "start", none("string").alias("change_id"), none("string").alias("change"), "x.t", "x.kind").withColumn("slot", slot)
    rows = ends.union(changed.select(none("string"), none("timestamp_ntz"), "event_id", "event", "t", F.lit(1)).withColumn("slot", slot))
    # A slot without changes has the sum of those before it.
    slots = before.union(ends.select("slot", F.lit(0).cast("long")).distinct()).groupBy("slot").agg(F.sum("m").alias("m"))
    slots = slots.select("slot", (F.sum("m").over(W.orderBy("slot")) - F.col("m")).alias("before"))
    within = W.partitionBy("slot").orderBy("t", "kind", F.desc("change_id")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = staged(rows.withColumn("n", F.sum((F.col("kind") == 1).cast("long")).over(within)).join(F.broadcast(slots), "slot").withColumn("n", F.col("n") + F.col("before")).drop("slot", "before"), "changes")
    bound = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("n")))
    of_run = rows.where("kind <> 1").groupBy("run_id").agg(shown(F.max("start")).alias("start"), bound(0).alias("lo"), bound(2).alias("hi")).where("hi > lo")
    of_run = of_run.withColumns({"truncated": F.col("hi") - F.col("lo") > cap, "block": F.floor(F.col("hi") / cap)})
    own = F.floor(F.col("n") / cap)
    both = rows.where("kind = 1").withColumn("changed_at", shown(F.col("t"))).select(F.explode(F.array(own, own + 1)).alias("block"), F.struct((-F.col("n")).alias("place"), *columns).alias("c"))
    return of_run, both.groupBy("block").agg(F.sort_array(F.collect_list("c")).alias("all"))


def newest_changes(cap: int) -> tuple[Column, Column]:
    """Where a run's changes begin among its block's, from 0 on, and how many they are up to the cap."""
    return (-F.element_at("all", 1)["place"] - F.col("hi")).cast("int"), F.least(F.col("hi") - F.col("lo"), F.lit(cap)).cast("int")


def changes(runs: DataFrame, ev: DataFrame, hours: float = 24.0, cap: int = CHANGE_CAP, shown: Callable[[Column], Column] = lambda t: t) -> DataFrame:
    """QRY-7, JOIN-6: change events at most so many hours before each run's start, the newest first up to a cap, the feature.

    What comes out is up to cap times the runs, so a row costs next to nothing: places are counted and looked up in the
    block, no list is copied, and times are shown where there is one for each change and run.
    """
    of_run, blocks = numbered_changes(runs, ev, hours, cap, shown)
    first, n = newest_changes(cap)
    # Runs of a block by time: neighbours have nearly the same changes, which files keep small.
    near = of_run.repartition("block").sortWithinPartitions("block", "hi")
    out = near.join(blocks, "block").select("run_id", "start", "truncated", "all", first.alias("first"), F.explode(F.sequence(F.lit(1), n)).alias("rn"))
    c = F.get("all", F.col("first") + F.col("rn") - 1)
    return out.select("run_id", "start", c["change_id"].alias("change_id"), c["change"].alias("change"), c["changed_at"].alias("changed_at"), "rn", "truncated")


def newest_of_jobs(runs: DataFrame, k: int) -> DataFrame:
    """Each job's newest k + 1 runs (newest): whichever of them a run is, k others are there."""
    w = W.partitionBy("job_name").orderBy(F.desc("updated_at"), "run_id")
    top = runs.where("job_name is not null").select("job_name", "run_id", F.row_number().over(w).alias("rk")).where(F.col("rk") <= k + 1)
    return top.groupBy("job_name").agg(F.array_sort(F.collect_list(F.struct("rk", "run_id"))).alias("newest"))


def others(k: int) -> Column:
    """A run's comparables among its job's newest."""
    return F.slice(F.filter(F.transform("newest", lambda x: x["run_id"]), lambda x: x != F.col("run_id")), 1, k)


def comparable(runs: DataFrame, k: int = COMPARABLE) -> DataFrame:
    """JOIN-12: for each run the newest other runs of its job. Ranked within the job, so no run meets all others: its k are among the job's newest k + 1."""
    rows = runs.select("job_name", "run_id").join(newest_of_jobs(runs, k), "job_name").select("job_name", "run_id", F.posexplode(others(k)).alias("place", "other"))
    return rows.select("job_name", "run_id", "other", (F.col("place") + 1).alias("place"))


def compared(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """QRY-9, JOIN-13: pairs(run_id, other) -> differences, other less run."""
    side = lambda k: runs.select(*[F.col(c).alias(f"{c}_{k}") for c in ("run_id", "duration_ms", "status", "error_count")])
    both = pairs.join(side("a"), F.col("run_id") == F.col("run_id_a")).join(side("b"), F.col("other") == F.col("run_id_b"))
    return both.select("run_id", "other", (F.col("duration_ms_b") - F.col("duration_ms_a")).alias("duration_delta_ms"), (F.col("status_a") != F.col("status_b")).alias("status_changed"), (F.col("error_count_b") - F.col("error_count_a")).alias("error_delta"))


def run_entities(edges: DataFrame) -> DataFrame:
    """SET-1, JOIN-7: entities that each run touches: targets of its edges and sources of edges to it."""
    one = lambda at, to: F.when(F.col(at).startswith("run://"), F.struct(F.substring_index(at, "/", -1).alias("run_id"), F.col(to).alias("entity_id")))
    return edges.select(F.explode(F.array_compact(F.array(one("src", "dst"), one("dst", "src")))).alias("x")).select("x.*").distinct()


def lineage(edges: DataFrame, entity_prefix: str = "asset://", cap: int = LINEAGE_CAP) -> DataFrame:
    """JOIN-8, QRY-11: one hop up and down from each entity of a kind: a side's first neighbours up to a cap, truncated true where there were more. The cap is the feature."""
    kind = F.when(F.col("method") == "explicit", "runtime").otherwise(F.col("method")).alias("kind")

    of_kind = lambda c: F.col(c).startswith(entity_prefix)

    def hop(direction: str, at: str, to: str) -> Column:
        return F.when(of_kind(at), F.struct(F.col(at).alias("entity_id"), F.lit(direction).alias("direction"), F.col(to).alias("neighbour")))

    # Both directions come out of an edge at once, so that edges are made once.
    hops = F.explode(F.array_compact(F.array(hop("upstream", "dst", "src"), hop("downstream", "src", "dst")))).alias("x")
    both = edges.where(of_kind("dst") | of_kind("src")).select(hops, "type", kind).select("x.*", "type", "kind").withColumn("side", F.struct("entity_id", "direction"))
    return bounded(both, "side", [F.col("neighbour"), F.col("type")], cap).drop("side", "rn")


def asset_health(assets: DataFrame, as_of: Column) -> DataFrame:
    """QRY-11: age since the last materialisation, and whether it breaches the SLA, at a given time."""
    age = seconds_between(F.col("last_materialized_at"), as_of)
    return assets.withColumns({"age_seconds": age, "breached": F.coalesce(age > F.col("sla_seconds"), F.lit(False))})


def asset_insights(assets: DataFrame, episodes: DataFrame) -> DataFrame:
    """JOIN-9: assets with their open insights."""
    opened = episodes.where("state IN ('open', 'acknowledged')").groupBy("entity").agg(F.array_sort(F.collect_list("insight_id")).alias("insights"), F.count("*").alias("open_insights"))
    return assets.join(opened, assets["entity_id"] == opened["entity"], "left").drop("entity").fillna(0, ["open_insights"])


def provenance(ev: DataFrame) -> DataFrame:
    """JOIN-11, QRY-14: for each event what lists it: its run, entities and edges. Only explicit roles can name one entity twice; that is dropped within the event, for an id is one event's."""
    listing = lambda kind, by: F.struct(F.lit(kind).alias("kind"), by.alias("listed_by"))
    entities = F.transform(p.entity_entries(), lambda e: listing("entity", e["value"]))
    edge = F.transform(p.edge_structs(), lambda x: listing("edge", F.concat(x["src"], F.lit(" -["), x["type"], F.lit("]-> "), x["dst"])))
    run = F.array_compact(F.array(F.when(present("run_id").isNotNull(), listing("run", F.col("run_id")))))
    listed = F.concat(run, entities, edge)
    rows = p.with_roles(ev).select("event_id", F.when(F.size("entities") > 0, F.array_distinct(listed)).otherwise(listed).alias("x"))
    return rows.select("event_id", F.explode("x").alias("x")).select("event_id", "x.*")


def run_effects() -> Column:
    """An event's edges from runs, over the columns of with_roles: owner, the run's id, and effect."""
    ours = F.filter(p.edge_structs(), lambda x: x["src"].startswith("run://"))
    return F.transform(ours, lambda x: F.struct(F.substring_index(x["src"], "/", -1).alias("owner"), F.concat_ws(" ", x["type"], x["dst"]).alias("effect")))


def own_lists(mine: DataFrame) -> DataFrame:
    """Of each run, from its events dealt once: their number, failures, warnings, and effects under its own id."""
    bad = F.coalesce((F.col("outcome") == "failure") | F.col("error_message").isNotNull(), F.lit(False))
    warned = F.coalesce(F.col("severity").isin("warn", "error"), F.lit(False))
    own = F.transform(F.filter(run_effects(), lambda x: x["owner"] == F.col("run_id")), lambda x: x["effect"])
    rows = p.with_roles(mine).select("run_id", "event_id", "observed_at", "event", bad.alias("bad"), warned.alias("warned"), own.alias("effects"))
    # The caps hold by number before lists are made, so that a busy run's are bounded.
    so_far = W.partitionBy("run_id").orderBy("observed_at", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({f"{c}_n": F.count_if(c).over(so_far) for c in ("bad", "warned")})
    first = lambda c: F.collect_list(F.when(F.col(c) & (F.col(f"{c}_n") <= EVENT_CAP), pos()))
    ids = lambda c: F.sort_array(first(c))["event_id"]
    failed = F.when(F.col("bad"), pos())
    return rows.groupBy("run_id").agg(
        F.count("*").alias("events"), F.count_if("bad").alias("failures"), F.max_by("event", failed).alias("failed_stage"), F.min_by("event_id", failed).alias("first_failure"),
        ids("bad").alias("failure_ids"), ids("warned").alias("warning_ids"), F.count_if("warned").alias("warnings"), F.array_distinct(F.flatten(F.collect_set("effects"))).alias("own"),
    )


def investigation(ev: DataFrame, runs: DataFrame) -> DataFrame:
    """QRY-10: for each failed run its failures, warnings, changes, comparables, impact, likely causes and evidence.

    The lists have the caps of the questions of their own (EVENT_CAP, CHANGE_CAP), and truncated says if one was met. The
    last failure is the failed stage; causes are the first failure and the newest CAUSES changes. The timeline is
    timeline(), by run_id.
    """
    runs = staged(runs.select("run_id", "job_name", "started_at", "updated_at", "status"), "runs")
    bad = runs.where("status = 'failure'").drop("status")
    of_bad = lambda df: df.where(present("run_id").isNotNull()).join(bad.select("run_id"), "run_id", "left_semi")
    lists = own_lists(of_bad(ev))
    # Edges of another run than the event's can only come from entities that were given, or from an id with a slash.
    apart = p.with_roles(of_bad(ev.where((F.size("entities") > 0) | F.contains("run_id", F.lit("/")))))
    apart = apart.select("run_id", F.explode(run_effects()).alias("x")).where("x.owner <> run_id").groupBy(F.col("x.owner").alias("run_id")).agg(F.collect_set("x.effect").alias("given"))
    found, blocks = numbered_changes(bad, ev, 24.0, CHANGE_CAP, columns=("change_id",))
    out = bad.select("run_id", "job_name").join(newest_of_jobs(runs, COMPARABLE), "job_name", "left").withColumn("comparables", others(COMPARABLE)).drop("newest")
    for part in (lists, apart, found.select("run_id", "lo", "hi", "block", F.col("truncated").alias("changes_cut"))):
        out = out.join(part, "run_id", "left")
    # The lists of changes come last, so that no join deals them out again, and runs of a block by time: neighbours have nearly the same changes, which files keep small.
    none = F.array().cast("array<string>")
    out = out.withColumn("block", F.coalesce("block", -1 - F.pmod(F.xxhash64("run_id"), F.lit(CHANGE_CAP)))).repartition("block").sortWithinPartitions("block", "hi").join(blocks, "block", "left")
    first, n = newest_changes(CHANGE_CAP)
    out = out.withColumn("changes", F.slice("all", first + 1, n)["change_id"])
    lists = {c: F.coalesce(c, none) for c in ("failure_ids", "warning_ids", "changes", "comparables")} | {"impact": F.sort_array(F.array_union(F.coalesce("own", none), F.coalesce("given", none)))}
    cut = F.coalesce(F.greatest(F.col("failures") > EVENT_CAP, F.col("warnings") > EVENT_CAP, "changes_cut"), F.lit(False)) | (F.col("events") > EVENT_CAP)
    out = out.fillna(0, ["failures"]).withColumns(lists | {"truncated": cut}).drop("own", "given", "warnings", "changes_cut", "block", "lo", "hi", "all")
    causes = F.concat(F.array_compact(F.array("first_failure")), F.slice("changes", 1, CAUSES))
    out = out.withColumns({"causes": causes, "evidence": F.sort_array(F.array_compact(F.array_distinct(F.concat("failure_ids", "warning_ids", "changes"))))})
    return out.select("run_id", "job_name", "events", "failures", "failed_stage", "first_failure", "failure_ids", "warning_ids", "comparables", "impact", "changes", "truncated", "causes", "evidence")


def newest(df: DataFrame, by: str, key: str, limit: int = PAGE, **equal: str) -> DataFrame:
    """TOP-5, QRY-12: the newest rows that equal all filters; the limit is the feature."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit is 1 to 1000")
    for c, v in equal.items():
        df = df.where(F.col(c) == v)
    return df.orderBy(F.desc(by), key).limit(limit)


def run_page(runs: DataFrame, limit: int = PAGE, after: str | None = None, **equal: str) -> DataFrame:
    """TOP-3: the next runs by id after a cursor (the last id seen). The limit is the feature."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit is 1 to 1000")
    for c, v in equal.items():
        runs = runs.where(F.col(c) == v)
    return (runs if after is None else runs.where(F.col("run_id") > after)).orderBy("run_id").limit(limit)


def asset_history(ev: DataFrame, limit: int = 200) -> DataFrame:
    """QRY-11: the newest events of each asset, at most limit of each (1 to 1000), the feature."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit is 1 to 1000")
    rows = ev.where(present("asset_key").isNotNull())
    return bounded(rows, "asset_key", [F.desc("observed_at"), F.desc("event_id")], limit).select("asset_key", "rn", "event_id", "event", "outcome", "observed_at", "truncated")


def analyses(recorded: DataFrame, ev: DataFrame) -> DataFrame:
    """QRY-15: recorded(analysis_id, subject, created_at, model, template, evidence) with the evidence that the log lacks.

    newest() makes the list of it. An analysis without evidence lacks none.
    """
    named = recorded.select("analysis_id", F.explode("evidence").alias("event_id"))
    lost = named.join(ev.select("event_id"), "event_id", "left_anti").groupBy("analysis_id").agg(F.array_sort(F.collect_set("event_id")).alias("missing"))
    out = recorded.join(lost, "analysis_id", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    return out.withColumn("sound", F.size("missing") == 0)


class Questions:
    """QRY-16: the named questions over one set of canonical events."""

    def __init__(self, ev: DataFrame):
        self.events = ev

    def search_events(self, q: str | None = None, limit: int = PAGE, after: str | None = None, **filters) -> DataFrame:
        return page(search(self.events, q, **filters), limit, after)

    def get_event(self, event_id: str) -> DataFrame:
        return self.events.where(F.col("event_id") == event_id)

    def list_runs(self, limit: int = PAGE, after: str | None = None, **filters: str) -> DataFrame:
        return run_page(p.runs(self.events), limit, after, **filters)

    def list_insights(self, limit: int = PAGE, **filters: str) -> DataFrame:
        return newest(insights.episodes(insights.findings(self.events), self.events), "observed_at", "insight_id", limit, **filters)

    def list_incidents(self, limit: int = PAGE, **filters: str) -> DataFrame:
        return newest(insights.incidents(insights.findings(self.events)), "last_at", "first_event", limit, **filters)

    def incident(self, first_event: str) -> DataFrame:
        """An incident, known by its first event, with its insights."""
        found = insights.findings(self.events)
        one = insights.incidents(found).where(F.col("first_event") == first_event)
        return insights.incident_insights(one, insights.episodes(found, self.events))

    def asset_history(self, asset_key: str, limit: int = 200) -> DataFrame:
        return asset_history(self.events.where(F.col("asset_key") == asset_key), limit)

    def get_run(self, run_id: str) -> DataFrame:
        return p.runs(self.events.where(F.col("run_id") == run_id))

    def run_timeline(self, run_id: str) -> DataFrame:
        return timeline(self.events.where(F.col("run_id") == run_id)).orderBy("rn")

    def run_failures(self, run_id: str) -> DataFrame:
        return failures(self.events.where(F.col("run_id") == run_id))

    def run_changes(self, run_id: str, hours: float = 24.0) -> DataFrame:
        return changes(self.get_run(run_id), self.events, hours)

    def run_impact(self, run_id: str) -> DataFrame:
        return p.impact(self.events.where(F.col("run_id") == run_id))

    def compare_runs(self, a: str, b: str) -> DataFrame:
        pair = self.events.sparkSession.createDataFrame([(a, b)], "run_id string, other string")
        return compared(p.runs(self.events.where(F.col("run_id").isin(a, b))), pair)

    def investigate(self) -> DataFrame:
        return investigation(self.events, p.runs(self.events))

    def asset_health(self, as_of: str) -> DataFrame:
        return asset_health(p.assets(self.events), F.lit(as_of).cast("timestamp_ntz"))

    def lineage(self) -> DataFrame:
        return lineage(p.relationships(self.events))

    def event_provenance(self, event_id: str) -> DataFrame:
        return provenance(self.get_event(event_id))
