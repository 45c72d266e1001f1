"""Runs, entities, edges and assets: order-independent aggregations over canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from eventloom.functions.staging import staged, unstage
from eventloom.schema import pos, present

#: Fixed values.
TERMINAL = ("pipeline.run", "dlt.pipeline.run", "dbt.invocation")
STATUS_RANK = {"running": 1, "partial": 2, "cancelled": 3, "success": 4, "failure": 5}
VERB_EDGE = {
    "reads_from": ("read", "scan", "query", "extract"),
    "writes_to": ("write", "load", "commit"),
    "produces": ("materialize", "materialized", "produce", "execute"),
    "validates": ("validate", "check", "test"),
    "promotes": ("promote", "publish"),
}
MATERIALIZE = ("materialize", "materialized", "produce", "write", "load", "execute")
#: Roles whose entities are of a kind with another name; any other role is a kind of its own.
KIND_OF_ROLE = {"quality_suite": "quality"}
PROVENANCE, EDGE_SOURCES, RUN_ASSETS = 64, 32, 1000
#: Roles that an event's columns name an entity for, and the roles that edges join.
DERIVED = ("run", "asset", "table", "branch", "snapshot", "service")
JOINED = (*DERIVED, "iceberg", "model", "source", "deployment")
#: AGG-7: the roles at an edge's ends, and its type; None: by the event's verb. Each edge has a run or a source at one end, its hub.
EDGES = (
    ("service", "run", "executes"), ("run", "branch", "writes_to"), ("source", "asset", "produces"), ("run", "deployment", "deployed_as"),
    *(("run", r, None) for r in ("asset", "table", "iceberg", "model", "snapshot")),
)
HUBS = ("run", "source")
#: Events of one hub that a task may put in order alone.
HUB_EVENTS = 1_000_000


def verb() -> Column:
    return F.substring_index("event", ".", -1)


def producer() -> Column:
    return F.coalesce(present("producer"), present("service"), F.lit("unknown"))


def latest(c: str, when: Column | None = None) -> Column:
    """The newest present value by position."""
    ok = present(F.col(c).cast("string")).isNotNull() if when is None else present(F.col(c).cast("string")).isNotNull() & when
    return F.max_by(F.when(ok, F.col(c)), F.when(ok, pos())).alias(c)


def earliest(df: DataFrame, key: list[str], value: str, k: int, name: str) -> DataFrame:
    """TOP-1: for each key the values of its k earliest events by position, in order. Each task cuts its own rows down first, so a busy key is no hot one."""
    w = W.partitionBy(*key).orderBy("observed_at", "event_id")
    few = df.select(*key, value, "observed_at", "event_id").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return listed(few, w, key, value, k, name)


def listed(df: DataFrame, w: WindowSpec, key: list[str], value: str, k: int, name: str) -> DataFrame:
    """One row for each key with the values of its first k rows, out of the sorted rows themselves: a grouping would sort them once more."""
    first = df.withColumns({"rn": F.row_number().over(w), name: F.collect_list(F.struct(value)).over(w.rowsBetween(0, k - 1))}).where("rn = 1")
    return first.select(*key, F.transform(name, lambda x: x[value]).alias(name))


def runs(ev: DataFrame) -> DataFrame:
    """AGG-1, AGG-2: one row for each run."""
    ev = ev.where(present("run_id").isNotNull())
    terminal = F.col("event").isin(*TERMINAL)
    known = F.col("outcome") != "unknown"
    bad = F.col("error_message").isNotNull() | F.col("severity").isin("error", "critical")
    rank = F.when(terminal & known, F.element_at(F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(k), F.lit(v))]), F.col("outcome"))).otherwise(F.lit(1))
    out = ev.groupBy("run_id").agg(
        F.count("*").alias("event_count"), F.count_if(bad).alias("error_count"), F.count_if(~bad & (F.col("severity") == "warn")).alias("warning_count"),
        latest("branch"), F.coalesce(latest("job_id"), F.lit(None)).alias("job_name"), latest("service"), latest("environment"),
        F.max(rank).alias("rank"),
        F.max(F.when(terminal & known, F.coalesce("ended_at", "observed_at"))).alias("ended_at"),
        latest("duration_ms", terminal), latest("trigger", terminal),
        *_span(),
    )
    status = F.element_at(F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(v), F.lit(k))]), F.col("rank"))
    return _started(out.withColumn("status", status).drop("rank"))


def _span() -> list[Column]:
    return [F.min("started_at").alias("min_started"), F.min_by(F.when(F.col("started_at").isNull(), F.col("observed_at")), pos()).alias("first_observed"), F.max("observed_at").alias("updated_at")]


def _started(out: DataFrame) -> DataFrame:
    return out.withColumn("started_at", F.least("min_started", "first_observed")).drop("min_started", "first_observed")


def run_spans(ev: DataFrame) -> DataFrame:
    """Of runs() when each started and was last seen, which few of an event's columns tell."""
    return _started(ev.where(present("run_id").isNotNull()).groupBy("run_id").agg(*_span()))


def run_assets(ev: DataFrame, cap: int = RUN_ASSETS) -> DataFrame:
    """AGG-3: distinct assets of each run, the first in order up to a cap, and their number. The cap is the feature."""
    pairs = ev.where(present("run_id").isNotNull() & present("asset_key").isNotNull()).select("run_id", "asset_key").distinct()
    few = pairs.withColumn("rn", F.row_number().over(W.partitionBy("run_id").orderBy("asset_key"))).where(F.col("rn") <= cap)
    return few.groupBy("run_id").agg(F.array_sort(F.collect_list("asset_key")).alias("assets"), F.count("*").alias("asset_count"))


def entity_of(role: str) -> Column:
    """AGG-4: the entity id that an event has in a role; an explicit one overrides the derived, empty strings are missing."""
    p = producer()
    derived = {
        "run": lambda: F.concat(F.lit("run://"), p, F.lit("/"), present("run_id")), "asset": lambda: F.concat(F.lit("asset://"), present("asset_key")), "table": lambda: F.concat(F.lit("table://"), present("table_name")),
        "branch": lambda: F.concat(F.lit("branch://"), p, F.lit("/"), present("branch")), "snapshot": lambda: F.concat(F.lit("snapshot://"), F.coalesce(present("table_name"), F.lit("unknown")), F.lit("/"), present("snapshot_id")),
        "service": lambda: F.concat(F.lit("service://"), present("service")),
    }
    given = present(F.try_element_at("entities", F.lit(role)))
    return F.coalesce(given, derived[role]()) if role in derived else given


def entity_entries() -> Column:
    """AGG-4: all roles of an event with their entity ids: key, value."""
    derived = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(r).alias("key"), c.alias("value"))) for r in DERIVED for c in (entity_of(r),)]))
    other = F.map_entries(F.map_filter("entities", lambda k, v: (v != "") & ~k.isin(*DERIVED)))
    return F.when(F.size("entities") > 0, F.concat(derived, other)).otherwise(derived)


def with_entities(ev: DataFrame) -> DataFrame:
    """One row for each event and role: role, entity_id."""
    return ev.withColumn("_e", F.explode(entity_entries())).withColumns({"role": F.col("_e.key"), "entity_id": F.col("_e.value")}).drop("_e")


def kind_of(role: Column) -> Column:
    for name, kind in KIND_OF_ROLE.items():
        role = F.when(role == name, kind).otherwise(role)
    return role


def entities_of(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("entity_id").agg(
        F.min_by(kind_of(F.col("role")), F.struct("observed_at", "event_id", "role")).alias("kind"), F.min("observed_at").alias("first_seen"),
        F.max("observed_at").alias("last_seen"), F.count("*").alias("sightings"),
    )
    return out.withColumn("display_name", F.substring_index("entity_id", "://", -1))


def entities(ev: DataFrame) -> DataFrame:
    """AGG-5: one row for each entity: kind of the first sight, name, first and last seen."""
    return entities_of(with_entities(ev))


def entity_sources(ev: DataFrame) -> DataFrame:
    return earliest(with_entities(ev), ["entity_id"], "event_id", PROVENANCE, "source_ids")


def branches(ev: DataFrame) -> DataFrame:
    """AGG-6: attributes of branches, the newest event of each field winning, nulls included."""
    v, ok = verb(), F.col("outcome") == "success"
    field = lambda name, value: F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"))
    at = F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss.SSS")
    fields = (
        F.when(F.col("event").isin("wap.branch.create", "nessie.branch.create"), F.array(field("state", F.lit("open")), field("created_at", at), field("base_branch", F.col("base_branch"))))
        .when(v == "validate", F.array(field("validation", F.col("outcome")), field("validated_at", at)))
        .when(v == "promote", F.array(field("state", F.when(ok, "promoted").otherwise("promotion_failed")), field("promoted_at", at), field("target", F.col("target"))))
        .when(v == "reject", F.array(field("state", F.lit("rejected"))))
        .when(v == "cleanup", F.array(field("state", F.lit("cleaned"))))
        .when(v == "commit", F.array(field("last_commit_at", at), field("last_snapshot_id", F.col("snapshot_id"))))
    )
    rows = with_entities(ev).where("role = 'branch'").select("entity_id", "observed_at", "event_id", F.explode(fields).alias("f"))
    newest = rows.groupBy("entity_id", "f.field").agg(F.max_by(F.struct("f.value"), pos()).alias("v"))
    return newest.select("entity_id", "field", F.col("v.value").alias("value"))


def edge_type() -> Column:
    out = F.lit("part_of")
    for name, verbs in VERB_EDGE.items():
        out = F.when(verb().isin(*verbs), name).otherwise(out)
    return out


def edge_structs() -> Column:
    """AGG-7: an event's edges as structs of src, dst, type, over the columns of with_roles."""
    edge = lambda a, b, t: F.when(F.col(f"_{a}").isNotNull() & F.col(f"_{b}").isNotNull(), F.struct(F.col(f"_{a}").alias("src"), F.col(f"_{b}").alias("dst"), typed(t).alias("type")))
    return F.array_compact(F.array(*[edge(*e) for e in EDGES]))


def typed(t: str | None) -> Column:
    return F.col("_type") if t is None else F.lit(t)


def by_hub(ev: DataFrame) -> DataFrame:
    """One row for each event and hub: hub, event_id, observed_at, edges as structs of the other end and the type. Those of a type all have the hub at the same end."""

    def bundle(hub: str) -> Column:
        ends = [(b if a == hub else a, t) for a, b, t in EDGES if hub in (a, b)]
        return F.struct(F.col(f"_{hub}").alias("hub"), F.array_compact(F.array(*[F.when(F.col(f"_{r}").isNotNull(), F.struct(F.col(f"_{r}").alias("other"), typed(t).alias("type"))) for r, t in ends])).alias("edges"))

    rows = with_roles(ev).select("event_id", "observed_at", F.explode(F.array(*[bundle(r) for r in HUBS])).alias("_b"))
    return rows.select("event_id", "observed_at", "_b.*").where(F.col("hub").isNotNull() & (F.size("edges") > 0))


def with_roles(ev: DataFrame) -> DataFrame:
    """Adds the entity in each role that edges join as _role, and _type, the type of edges by verb."""
    return ev.withColumns({f"_{r}": entity_of(r) for r in JOINED} | {"_type": edge_type()})


def edges(ev: DataFrame) -> DataFrame:
    """AGG-7: one row for each event and edge: src, dst, type, confidence, method."""
    rows = with_roles(ev).select("event_id", "observed_at", F.explode(edge_structs()).alias("_x"))
    return rows.select("event_id", "observed_at", "_x.*", F.lit(1.0).alias("confidence"), F.lit("explicit").alias("method"))


def relationships_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("src", "dst", "type").agg(
        F.max("confidence").alias("confidence"), F.max("method").alias("method"), F.count("*").alias("events"),
        F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"),
    )


def relationships(ev: DataFrame) -> DataFrame:
    """AGG-8: edges folded by (src, dst, type). First and last seen are the events' times, not the wall clock."""
    return relationships_of(edges(ev))


def edge_sources(ev: DataFrame) -> DataFrame:
    """TOP-1 for edges. An event is dealt once, to its hub, with all edges there, and they are sorted after that alone.

    Hubs with more events than one task should sort are found first, by hash; their edges are cut down before they are dealt, edge by edge.
    """
    key = ["hub", "other", "type"]
    h = F.xxhash64("hub")
    hubs = ev.select(F.explode(F.array(*[entity_of(r) for r in HUBS])).alias("hub")).where("hub IS NOT NULL")
    busy = staged(hubs.groupBy(h.alias("_h")).agg(F.count("*").alias("n")).where(F.col("n") > HUB_EVENTS).select("_h"), "busy")
    rows, apart = by_hub(ev), lambda df: df.select("hub", "event_id", "observed_at", F.inline("edges"))
    none = busy.isEmpty()
    if none:
        unstage(busy)
    calm = rows if none else rows.withColumn("_h", h).join(busy, "_h", "left_anti").select(*rows.columns)
    # The hash comes first, for it is compared faster than texts that begin alike.
    w = W.partitionBy("_k", *key).orderBy("observed_at", "event_id")
    out = listed(apart(calm.repartition("hub")).withColumn("_k", F.xxhash64(*key)), w, key, "event_id", EDGE_SOURCES, "source_ids")
    if not none:
        out = out.union(earliest(apart(rows.withColumn("_h", h).join(busy, "_h", "left_semi").select(*rows.columns)), key, "event_id", EDGE_SOURCES, "source_ids"))
    into = F.col("type").isin(*[t for _, b, t in EDGES if b in HUBS])
    return out.select(F.when(into, F.col("other")).otherwise(F.col("hub")).alias("src"), F.when(into, F.col("hub")).otherwise(F.col("other")).alias("dst"), "type", "source_ids")


def assets(ev: DataFrame) -> DataFrame:
    """AGG-9: one row for each asset: last event and materialisation, health, the newest SLA."""
    ev = ev.where(present("asset_key").isNotNull()).withColumn("entity_id", F.concat(F.lit("asset://"), "asset_key"))
    ok, bad = F.col("outcome") == "success", F.col("outcome") == "failure"
    out = ev.groupBy("entity_id").agg(
        F.max("observed_at").alias("last_event_at"), F.max(F.when(ok & verb().isin(*MATERIALIZE), F.col("observed_at"))).alias("last_materialized_at"),
        F.max(F.when(ok, F.col("observed_at"))).alias("s"), F.max(F.when(bad, F.col("observed_at"))).alias("f"), latest("sla_seconds"),
    )
    status = F.when(F.col("s").isNull() & F.col("f").isNull(), "unknown").when(F.col("f").isNull(), "healthy").when(F.col("s").isNull() | (F.col("f") >= F.col("s")), "failing").otherwise("recovering")
    return out.withColumn("status", status).drop("s", "f")


def impact(ev: DataFrame) -> DataFrame:
    """AGG-16: for each run and edge type its targets, distinct, their number of events, and the earliest of those as evidence.

    An event's edges of one run and type are one row, so rows are events; the evidence is numbered first, then all comes from one grouping.
    """
    mine = F.filter(edge_structs(), lambda x: x["src"].startswith("run://"))
    rows = with_roles(ev).select("event_id", "observed_at", mine.alias("x"))
    keys = F.array_distinct(F.transform("x", lambda x: F.struct(x["src"].alias("src"), x["type"].alias("type"))))
    rows = rows.select("event_id", "observed_at", "x", F.explode(keys).alias("k")).select(
        "k.src", "k.type", "event_id", "observed_at", F.array_distinct(F.transform(F.filter("x", lambda x: (x["src"] == F.col("k.src")) & (x["type"] == F.col("k.type"))), lambda x: x["dst"])).alias("dsts"),
    )
    w = W.partitionBy("src", "type").orderBy("observed_at", "event_id")
    rows = rows.withColumn("rn", F.row_number().over(w))
    few = F.when(F.col("rn") <= PROVENANCE, F.struct("rn", "event_id"))
    out = rows.groupBy("src", "type").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("dsts")))).alias("targets"), F.count("*").alias("evidence"), F.transform(F.array_sort(F.collect_list(few)), lambda x: x["event_id"]).alias("evidence_ids"))
    return out
