"""A store of events and the tables derived from them, kept up batch by batch.

A batch reads of the store what its own keys touch, and writes what it adds: the cost follows the batch, not the log. States
of all tables are folds in segments (see segments.py); insights and incidents are made again for the entities whose findings
changed, and keep their identities.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.staging import staged, unstage
from eventloom.operators import baselines, folds, insights, lifecycle, maintenance, projections
from eventloom.operators.correlate import arrivals, content_hash, link_traces
from eventloom.operators.folds import ADDITIVE, FOLDS, Fold, folded, merged
from eventloom.schema import FLAT, flat, present
from eventloom.streaming.segments import Folder, Manifest, Segments, at_once

#: Derived tables and their keys.
KEYS = {
    "runs": ["run_id"], "entities": ["entity_id"], "relationships": ["src", "dst", "type"], "assets": ["entity_id"],
    "baselines": ["entity", "metric"], "insights": ["entity"], "incidents": ["entity"],
}
GAP = "failure_id string, occurred_at timestamp_ntz, batch long, error string, event_ids array<string>"
ARRIVAL = "event_id string, status string, received_at timestamp_ntz, content string, stored_content string"
JOURNAL = "target string, at timestamp_ntz, seq long, `from` string, to string, status string, kind string"
CHANGE = "kind string, key string, body string"
#: The longest notice of the feed, and the parts in which a rebuild cuts down a busy key's list.
FEED_BYTES, SALTS = 7000, 64
#: Kinds of rows with an identity: the insights and incidents of an entity.
IDENTIFIED = {"insights": ("insight_id", "entity"), "incidents": ("incident_id", "who")}


class AmbiguousLifecycle(ValueError):
    """Old rows with identities or decisions match new ones in more than one way."""


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def with_incident_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"incident_id": hashed(F.col("who"), F.col("first_event")), "state": F.lit("open")})


def matched(old: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """Pairs (old_id, new_id, ambiguous) of rows of one kind that are the same: equal keys and a common event among their evidence or members."""
    name, entity = IDENTIFIED[kind]
    rule, key = (F.col("rule"), F.col("dedupe_key")) if kind == "insights" else (F.lit("incident"), F.lit(""))
    shape = lambda df: df.select(F.col(name).alias("id"), rule.alias("rule"), key.alias("dedupe_key"), F.coalesce(entity, F.lit("")).alias("entity"), F.col("evidence" if kind == "insights" else "member_events").alias("events"))
    return lifecycle.carried_ids(shape(old), shape(new))


class Store:
    """One writer. Readers see all tables of the last whole batch.

    Under path: events/batch=/day= (the log; day is the first day of the arrival's period, a day unless every says otherwise), arrivals (what wasn't stored), changes (the feed), journal, gaps, and the segments of
    the log (ids, orphans, links) and of the tables, each with a manifest. A batch is first stored, which publishes the log's
    manifest, and then derived, which publishes the tables'. A batch that runs again replaces its own files.
    """

    def __init__(self, spark: SparkSession, path: str, every: str = "DAY"):
        self.spark, self.path, self.folder, self.every = spark, path.rstrip("/"), Folder(spark, path), every
        self.shape = ", ".join(f"{k} {t}" for k, t in FLAT.items())
        self.log_manifest, self.table_manifest = Manifest(spark, f"{self.path}/manifest-log"), Manifest(spark, f"{self.path}/manifest-tables")
        none = spark.createDataFrame([], self.shape)
        self.none = none
        self.empty = maintenance.rebuild(none)
        self.folds = {name: fold for name, fold in FOLDS.items() if name != "links"}
        ids = self._ids(none.withColumn("content", F.lit("")), 0)
        orphans = self._orphans(none)
        self.identified: dict[str, T.StructType] = {
            "insights": self.empty["insights"].schema, "incidents": with_incident_ids(self.empty["incidents"]).schema,
        }
        for kind, (name, entity) in IDENTIFIED.items():
            self.folds[kind] = Fold((entity, name), {"said": "max"}, folds.same, folds.same)
        self.log_folds = {"ids": Fold(("event_id",), {"first": "min"}, folds.same, folds.same), "orphans": Fold(("trace_id", "event_id"), {"event": "max"}, folds.same, folds.same), "links": FOLDS["links"]}
        shapes = {name: folded(none, fold).schema for name, fold in FOLDS.items()}
        shapes |= {"ids": ids.schema, "orphans": orphans.schema, **{kind: self._said(none, kind, 0, empty=True).schema for kind in IDENTIFIED}}
        both = self.folds | self.log_folds
        self.segments = {name: Segments(spark, f"{self.path}/segments/{name}", both[name], shapes[name]) for name in both}

    # Rows of the folds that only a store has.

    @staticmethod
    def _ids(rows: DataFrame, number: int) -> DataFrame:
        return rows.select("event_id", F.struct(F.lit(number).cast("long").alias("batch"), "content").alias("first"))

    @staticmethod
    def _orphans(rows: DataFrame) -> DataFrame:
        """Events of a trace that name no run: a run that comes later may be theirs. Maps have no order, so they travel as text."""
        maps = [c for c, t in FLAT.items() if t.startswith("map")]
        rows = rows.where(present("trace_id").isNotNull() & present("run_id").isNull())
        return rows.select("trace_id", "event_id", F.struct(*[F.to_json(c).alias(c) if c in maps else F.col(c) for c in FLAT if c != "trace_id"]).alias("event"))

    @staticmethod
    def _events_of(orphans: DataFrame, run: Column) -> DataFrame:
        cols = [run.alias(c) if c == "run_id" else F.col(c) if c in ("trace_id", "event_id") else F.from_json(f"event.{c}", t).alias(c) if t.startswith("map") else F.col(f"event.{c}").alias(c) for c, t in FLAT.items()]
        return orphans.select(*cols)

    def _said(self, rows: DataFrame, kind: str, number: int, live: Column | bool = True, empty: bool = False) -> DataFrame:
        """Rows of insights or incidents as rows of their fold: the newest number holds."""
        name, entity = IDENTIFIED[kind]
        shape = self.identified[kind]
        if empty:
            rows = self.spark.createDataFrame([], shape)
        live = F.lit(live) if isinstance(live, bool) else live
        created = F.col("created_at") if "created_at" in rows.columns else F.lit(None).cast("timestamp_ntz").alias("created_at")
        return rows.select(entity, name, F.struct(F.lit(number).cast("long").alias("number"), live.alias("live"), created, *[F.col(c) for c in shape.names if c not in (entity, name)]).alias("said"))

    def _live(self, rows: DataFrame, kind: str) -> DataFrame:
        name, entity = IDENTIFIED[kind]
        cols = [F.col(c) if c in (entity, name) else F.col(f"said.{c}").alias(c) for c in self.identified[kind].names]
        return rows.where("said.live").select(*cols, F.col("said.created_at").alias("created_at"))

    # Reading.

    def versions(self) -> list[int]:
        """Numbers of the versions of the tables, in order."""
        return self.table_manifest.versions()

    def table(self, name: str) -> DataFrame:
        """A derived table as of the last whole batch. Insights and incidents carry their decisions."""
        listed = self.table_manifest.load()["segments"].get(name, [])
        if name in IDENTIFIED:
            rows = self._live(self.segments[name].state(listed), name)
            return lifecycle.overlay(rows, self.journal().where(F.col("kind") == name), IDENTIFIED[name][0]) if self.folder.names("journal") else rows
        return self.folds[name].final(self.segments[name].state(listed))

    def _rows(self, name: str, shape: str, numbered: str = "batch") -> DataFrame:
        if not self.folder.names(name):
            return self.spark.createDataFrame([], f"{shape}, {numbered} long")
        return self.spark.read.schema(f"{shape}, {numbered} long").parquet(f"{self.path}/{name}")

    def log(self) -> DataFrame:
        """All stored events with day (of arrival) and batch, which are folders: conditions on them choose files."""
        if not self.folder.names("events"):
            return self.spark.createDataFrame([], f"{self.shape}, day date, batch long")
        return self.spark.read.schema(f"{self.shape}, day date, batch long").parquet(f"{self.path}/events")

    def events(self) -> DataFrame:
        return self.log().select(*FLAT)

    def arrived(self) -> DataFrame:
        """JOIN-2: duplicates and conflicts that were not stored, by batch."""
        return self._rows("arrivals", ARRIVAL)

    def changes(self) -> DataFrame:
        """STR-4: what each batch changed: changed runs, newly opened insights, changed incidents. A stream can read the folder."""
        return self._rows("changes", CHANGE)

    def journal(self) -> DataFrame:
        return self._rows("journal", JOURNAL, "number")

    def gaps(self) -> DataFrame:
        names = [x for x in self.folder.names("gaps") if x.startswith("gap-")]
        return self.spark.read.schema(GAP).json([f"{self.path}/gaps/{x}" for x in names]) if names else self.spark.createDataFrame([], GAP)

    # Writing.

    def mark(self, doc: dict) -> None:
        self.table_manifest.publish(doc)

    def ingest(self, batch: DataFrame, number: int) -> None:
        """STR-1, STR-2, STR-3: stores what isn't stored, then adds to all tables what the batch changes.

        Late and repeated events need no special case: the result is that of a rebuild. If the derivation fails, the events stay
        and the gap is put down; repair() makes up for it.
        """
        kept = self.store(batch, number)
        if kept is None:
            return
        try:
            self.derive(*kept, number)
        except Exception as e:  # whatever it is, the events are stored and the gap must be known
            now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
            ids = kept[0].select(F.lit(f"batch-{number}").alias("failure_id"), F.lit(now).alias("occurred_at"), F.lit(number).alias("batch"), F.lit(str(e)[:1000]).alias("error"), F.array("event_id").alias("event_ids"))
            ids.write.mode("overwrite").json(f"{self.path}/gaps/gap-{number}")

    def store(self, batch: DataFrame, number: int) -> tuple[DataFrame, DataFrame | None, int] | None:
        """Stores the batch's new events; gives them linked, the orphans that get a run by them if any do, and the events' number. None where the batch is part of a merged segment already."""
        doc, name = self.log_manifest.load(), f"b{number}"
        if number < doc["batch"]:
            return None
        listed = {k: [s for s in doc["segments"].get(k, []) if s["name"] != name] for k in self.log_folds}
        came = flat(batch)
        came = staged(arrivals(came).withColumn("content", content_hash(came)), "came")
        known = self.segments["ids"].lookup(listed["ids"], came.select("event_id")).select("event_id", F.col("first.content").alias("stored_content"))
        status = F.when(F.col("stored_content").isNull(), F.col("status")).when(F.col("stored_content") == F.col("content"), "duplicate").otherwise("conflict")
        judged = staged(came.join(known, "event_id", "left").withColumn("status", status), "judged")
        fresh = judged.where("status = 'accepted'").select(*FLAT, "content")
        expected = fresh.count()
        others = judged.where("status <> 'accepted'").select("event_id", "status", "received_at", "content", "stored_content")
        seen = fresh.where(present("trace_id").isNotNull())
        old = self.segments["links"].lookup(listed["links"], seen.select("trace_id")).withColumnRenamed("run_id", "old")
        links = staged(folded(fresh, FOLDS["links"]), "links")
        now = staged(old.join(links, "trace_id", "full").select("trace_id", "old", F.least("old", "run_id").alias("run")), "traces")
        changed = now.where("old IS NULL OR run < old")
        orphans = self.segments["orphans"].lookup(listed["orphans"], changed.select("trace_id")).join(changed, "trace_id")
        linked = fresh.join(now.select("trace_id", "run"), "trace_id", "left").withColumn("run_id", F.coalesce(present("run_id"), "run")).select(*FLAT)
        day = F.to_date(F.date_trunc(self.every, "received_at")).alias("day")

        def events() -> None:
            # One file for each day, however many tasks hold some of it.
            fresh.select(*FLAT, day).repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/events/batch={number}")

        parts = {"ids": self._ids(fresh, number), "orphans": self._orphans(fresh.select(*FLAT)), "links": links}
        steps: list[Callable] = [lambda k=k, df=df: self.segments[k].write(df, name, max(expected, 1)) for k, df in parts.items()]
        kept = at_once([*steps, events, lambda: others.write.mode("overwrite").parquet(f"{self.path}/arrivals/batch={number}"), lambda: staged(linked, "linked"), lambda: staged(orphans, "relinked")])
        segments, gone = {}, []
        for (k, one) in zip(parts, kept, strict=False):
            segments[k], old_names = self.segments[k].compacted([*listed[k], one], name)
            gone += [(k, x) for x in old_names]
        self.log_manifest.publish({"segments": segments, "batch": number})
        for k, x in gone:
            self.segments[k].drop(x)
        unstage(came, judged, links, now)
        return kept[-2], None if kept[-1].isEmpty() else kept[-1], expected

    def derive(self, fresh: DataFrame, orphans: DataFrame | None, expected: int, number: int) -> None:
        """Adds to the tables what fresh events, and orphans that have found a run, bring."""
        doc, name = self.table_manifest.load(), f"b{number}"
        listed = {k: [s for s in doc["segments"].get(k, []) if s["name"] != name] for k in self.folds}
        was = now = None
        if orphans is not None:
            was, now = self._events_of(orphans, F.col("old")), self._events_of(orphans, F.col("run"))
            if not orphans.where("old IS NOT NULL").isEmpty() or not self._moved(was, now).isEmpty():
                # A trace's events go from one run to another: what they added there can't be taken back from a sum.
                return self.rebuild(check=False)
        temporary: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            # Written rather than cached: what follows then starts from a file, not from the plan so far.
            temporary.append(staged(df, "batch"))
            return temporary[-1]

        fresh_runs = fresh if now is None else fresh.unionByName(now)
        found = self._findings(fresh, was, now, listed, number)
        ends = folds.resolving(insights.resolvers(fresh_runs), number)
        if was is not None:
            ends = ends.union(folds.resolving(insights.resolvers(was), number, False))
        said, resolved, *parts = at_once([
            lambda: keep(merged(found, FOLDS["findings"])), lambda: keep(merged(ends, FOLDS["resolvers"])), *[lambda k=k: self._added(FOLDS[k], fresh, was, now) for k in ADDITIVE],
        ])
        added = dict(zip(ADDITIVE, parts, strict=True))
        entities = keep(said.select("entity").union(resolved.select("entity")).distinct())
        made = self._identified(entities, {"findings": said, "resolvers": resolved}, listed, number, keep)
        rows = {**added, "findings": said, "resolvers": resolved, **{k: x for k, (x, _, _) in made.items()}}
        sizes = {"runs": 1, "assets": 1, "findings": 1, "resolvers": 1, "insights": 1, "incidents": 1}
        written = at_once([lambda k=k, df=df: self.segments[k].write(df, name, max(1, expected * sizes.get(k, 4))) for k, df in rows.items()] + [lambda: self._notices(added["runs"], made, listed, number)])
        fresh_segments = dict(zip(rows, written, strict=False))
        merged_now = dict(zip(self.folds, at_once([lambda k=k: self.segments[k].compacted([*listed[k], fresh_segments[k]], name) for k in self.folds]), strict=True))
        self.mark({"segments": {k: s for k, (s, _) in merged_now.items()}, "batch": number})
        for k, (_, gone) in merged_now.items():
            for x in gone:
                self.segments[k].drop(x)
        unstage(*temporary, fresh, *([] if orphans is None else [orphans]))

    def _moved(self, was: DataFrame, now: DataFrame) -> DataFrame:
        """Samples whose series is another now that their event has a run."""
        a, b = (baselines.observations(x).select("event_id", "entity", "metric") for x in (was, now))
        return a.exceptAll(b)

    def _added(self, fold: Fold, fresh: DataFrame, was: DataFrame | None, now: DataFrame | None) -> DataFrame:
        """What the fold gains: all of fresh events, and of relinked ones what they didn't add before."""
        if was is None or now is None:
            return folded(fresh, fold)
        return merged(fold.parts(fresh).unionByName(fold.parts(now).exceptAll(fold.parts(was))), fold)

    def _findings(self, fresh: DataFrame, was: DataFrame | None, now: DataFrame | None, listed: dict, number: int) -> DataFrame:
        """Verdicts on fresh events, and on stored ones that fresh events change, as rows of the fold `findings`."""
        direct = {k: r for k, r in insights.RULES.items() if r[1] == "events"}
        hit = lambda df, yes=True: folds.verdicts(df.withColumn("hit", F.lit(yes)), number)
        out = hit(insights.findings(fresh if now is None else fresh.unionByName(now), direct))
        if was is not None:
            out = out.union(hit(insights.findings(was, direct), False))
        series, late_series = self._judged_samples(fresh, listed)
        assets, late_assets = self._judged_assets(fresh, listed)
        for rows, rules in ((series, ("duration-regression", "volume-spike")), (assets, ("freshness-breach",))):
            for rule in rules:
                of = insights.RULES[rule][2]()
                said = rows.withColumn("service", F.lit(None).cast("string")).withColumn("f", of)
                no = said.where("f IS NULL AND NOT fresh").select(F.lit(rule).alias("rule"), "entity", F.lit("").alias("severity"), F.lit("").alias("kind"), F.lit("").alias("summary"), "event", "producer", "event_id", "observed_at")
                out = out.union(hit(said.where("f IS NOT NULL").select("f.*").withColumn("dedupe_key", insights.dedupe_key()))).union(hit(no.withColumn("dedupe_key", F.lit("")), False))
        late = late_series.union(late_assets).distinct()
        if not late.isEmpty():
            late = staged(late, "late")
            # Events older than what a series keeps: those series' verdicts are made again from their events in the log.
            again = insights.findings(link_traces(self.events()), {k: r for k, r in insights.RULES.items() if r[1] != "events"}, only=late)
            before = folds.live_findings(self.segments["findings"].lookup(listed["findings"], late)).where(F.col("rule").isin(*[k for k in insights.RULES if k not in direct]))
            out = out.union(hit(before.select(again.columns), False)).union(hit(again))
        return out

    def _judged_samples(self, fresh: DataFrame, listed: dict) -> tuple[DataFrame, DataFrame]:
        """Samples from each touched series' first fresh one on, with what came before each; and the entities of series that don't reach back far enough."""
        obs = baselines.observations(fresh.withColumn("producer", projections.producer()))
        tail = ["observed_at", "event_id", "v", "base", *folds.SAID]
        obs = obs.select("entity", "metric", *tail, F.lit(True).alias("fresh"))
        touched = obs.groupBy("entity", "metric").agg(F.min(F.struct("observed_at", "event_id")).alias("since"))
        old = self.segments["baselines"].lookup(listed["baselines"], touched.select("entity")).join(touched, ["entity", "metric"])
        before = F.size(F.filter("tail", lambda x: F.struct(x["observed_at"], x["event_id"]) < F.struct(F.col("since.observed_at"), F.col("since.event_id"))))
        cut = (F.col("count") > F.size("tail")) & (before < baselines.SAMPLES)
        late = old.where(cut).select("entity")
        stored = old.where(~cut).select("entity", "metric", F.explode("tail").alias("x")).select("entity", "metric", *[F.col(f"x.{c}") for c in tail], F.lit(False).alias("fresh"))
        rows = baselines.with_baseline(obs.unionByName(stored)).join(touched, ["entity", "metric"])
        rows = rows.join(late.distinct(), "entity", "left_anti")
        return rows.where(F.struct("observed_at", "event_id") >= F.col("since")).drop("since"), late

    def _judged_assets(self, fresh: DataFrame, listed: dict) -> tuple[DataFrame, DataFrame]:
        """The same for events with an SLA, with the newest materialisation before each."""
        new = FOLDS["freshness"].parts(fresh).select("asset_key", F.get("done", F.lit(0)).alias("made"), F.get("due", F.lit(0)).alias("asked"))
        new = new.withColumn("p", F.when(F.col("made").isNotNull(), F.struct("made.observed_at", "made.event_id")).otherwise(F.struct("asked.observed_at", "asked.event_id"))).withColumn("fresh", F.lit(True))
        touched = new.groupBy("asset_key").agg(F.min("p").alias("since"))
        old = self.segments["freshness"].lookup(listed["freshness"], touched.select("asset_key")).join(touched, "asset_key")
        first = lambda c: F.struct(F.element_at(c, F.lit(-1))["observed_at"], F.element_at(c, F.lit(-1))["event_id"])
        beyond = lambda c, n: (F.col(n) > F.size(c)) & (F.col("since") < F.when(F.size(c) > 0, first(c)))
        cut = F.coalesce(beyond("done", "n_done") | beyond("due", "n_due"), F.lit(False))
        late = old.where(cut).select(F.concat(F.lit("asset://"), "asset_key").alias("entity"))
        good = old.where(~cut)
        made = good.select("asset_key", F.explode("done").alias("x")).select("asset_key", F.col("x").alias("made"), F.lit(None).cast(new.schema["asked"].dataType).alias("asked"), F.struct("x.observed_at", "x.event_id").alias("p"), F.lit(False).alias("fresh"))
        asked = good.select("asset_key", F.explode("due").alias("x")).select("asset_key", F.lit(None).cast(new.schema["made"].dataType).alias("made"), F.col("x").alias("asked"), F.struct("x.observed_at", "x.event_id").alias("p"), F.lit(False).alias("fresh"))
        rows = new.unionByName(made).unionByName(asked)
        rows = rows.groupBy("asset_key", "p").agg(F.max("made").alias("made"), F.max("asked").alias("asked"), F.max("fresh").alias("fresh"))
        w = W.partitionBy("asset_key").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("materialized_before", F.max("made.observed_at").over(w)).where("asked IS NOT NULL").join(touched, "asset_key").where("p >= since")
        entity = F.concat(F.lit("asset://"), "asset_key").alias("entity")
        rows = rows.select(entity, "asset_key", "asked.*", "materialized_before", "fresh").join(late.distinct(), "entity", "left_anti")
        return rows, late

    def _identified(self, entities: DataFrame, delta: dict[str, DataFrame], listed: dict, number: int, keep: Callable) -> dict[str, tuple[DataFrame, DataFrame, DataFrame]]:
        """Insights and incidents of these entities, made again: rows of their folds, the rows as they are now, and as they were."""
        both = {k: merged(self.segments[k].lookup(listed[k], entities).unionByName(delta[k]), FOLDS[k]) for k in delta}
        found, ends = keep(folds.live_findings(both["findings"])), folds.live_resolvers(both["resolvers"])
        now = F.lit(dt.datetime.now(dt.UTC).replace(tzinfo=None))
        # A finding without an entity is an incident of its own, which goes when a run takes its event.
        who = F.coalesce("entity", F.col("event_id")).alias("who")
        critical = found.select(who).union(delta["findings"].select(who)).distinct()

        def made(kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
            keys = entities if kind == "insights" else entities.union(critical)
            new, old = at_once([
                lambda: keep(insights.episodes(found, None, ends=ends) if kind == "insights" else with_incident_ids(insights.incidents(found))),
                lambda: keep(self._live(self.segments[kind].lookup(listed[kind], keys), kind)),
            ])
            return (*self._with_ids(old, new, kind, number, now, keep), old)

        return dict(zip(IDENTIFIED, at_once([lambda kind=kind: made(kind) for kind in IDENTIFIED]), strict=True))

    def _with_ids(self, old: DataFrame, new: DataFrame, kind: str, number: int, now: Column, keep: Callable) -> tuple[DataFrame, DataFrame]:
        """New rows under the old ones' ids where they match; where several do, the earliest row has the id. Undecided old rows without a match are gone."""
        name, entity = IDENTIFIED[kind]
        start = "observed_at" if kind == "insights" else "started_at"
        pairs = matched(old, new, kind).join(new.select(F.col(name).alias("new_id"), F.col(start).alias("at")), "new_id")
        pairs = pairs.withColumn("a", F.row_number().over(W.partitionBy("old_id").orderBy("at", "new_id"))).where("a = 1")
        pairs = pairs.withColumn("b", F.row_number().over(W.partitionBy("new_id").orderBy("old_id"))).where("b = 1").select("old_id", "new_id")
        pairs = keep(pairs)
        was = old.select(F.col(name).alias("old_id"), "created_at")
        ids = pairs.join(was, "old_id").withColumnRenamed("new_id", name)
        # An id that a match has taken is not given to another row that would have it by its first event.
        rows = new.join(ids, name, "left")
        taken = pairs.select(F.col("old_id").alias("t")).distinct()
        rows = rows.join(taken, F.col(name) == F.col("t"), "left")
        own = F.when(F.col("t").isNull(), F.col(name)).otherwise(hashed(F.col(name), F.lit("again")))
        rows = rows.withColumns({name: F.coalesce("old_id", own), "created_at": F.coalesce("created_at", now), "opened": F.col("old_id").isNull()}).drop("old_id", "t")
        rows = keep(rows)
        gone = old.join(pairs.select(F.col("old_id").alias(name)), name, "left_anti").join(rows.select(name), name, "left_anti")
        decided = self.journal().where("status = 'moved'").select(F.col("target").alias(name)).distinct()
        gone = gone.join(decided, name, "left_anti")
        return self._said(rows, kind, number).unionByName(self._said(gone, kind, number, False)), rows

    def _notices(self, delta: DataFrame, made: dict, listed: dict, number: int) -> None:
        """STR-4: writes the batch's notices. A row that is as it was gives none; a long one says only that it is time to look."""
        fold, of = FOLDS["runs"], self.segments["runs"]
        before = of.lookup(listed["runs"], delta.select("run_id"))
        after = fold.final(merged(before.unionByName(delta), fold))
        body = lambda df: df.select(F.col("run_id").alias("key"), F.to_json(F.struct(*sorted(df.columns))).alias("body"))
        rows = body(after).exceptAll(body(fold.final(before))).select(F.lit("run.changed").alias("kind"), "key", "body")
        opened = made["insights"][1].where("opened AND state = 'open'")
        rows = rows.union(opened.select(F.lit("insight.opened"), "insight_id", F.to_json(F.struct(*[c for c in opened.columns if c not in ("opened", "created_at")]))))
        shape = self.identified["incidents"].names
        say = lambda df: df.select("incident_id", F.to_json(F.struct(*sorted(shape))).alias("body"))
        rows = rows.union(say(made["incidents"][1]).exceptAll(say(made["incidents"][2])).select(F.lit("incident.updated"), "incident_id", "body"))
        long = F.octet_length("body") > FEED_BYTES
        rows = rows.select(F.when(long, "refresh").otherwise(F.col("kind")).alias("kind"), "key", F.when(long, F.lit(None)).otherwise(F.col("body")).alias("body"))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/changes/batch={number}")

    # Rebuilds, decisions, retention.

    def rebuild(self, check: bool = True) -> None:
        """STR-7: all tables anew from the log, as one segment each. Insights and incidents keep their ids, times and decisions.

        Old rows without a match stay: evidence that has expired doesn't take them away. Where old and new rows match in more
        than one way (check), AmbiguousLifecycle is raised and the old version stays.
        """
        doc = self.table_manifest.load()
        number = max(doc["batch"], self.log_manifest.load()["batch"])
        log = staged(link_traces(self.events()), "log")
        n = log.count()
        name = f"r{(self.versions() or [0])[-1] + 1}"
        temporary = [log]

        def keep(df: DataFrame) -> DataFrame:
            temporary.append(staged(df, "rebuild"))
            return temporary[-1]

        try:
            rows = {k: folded(log, FOLDS[k], SALTS) for k in (*ADDITIVE, "findings", "resolvers")}
            found = keep(insights.findings(log))
            rows["findings"] = folds.verdicts(found.withColumn("hit", F.lit(True)), number)
            now = F.lit(dt.datetime.now(dt.UTC).replace(tzinfo=None))
            for kind in IDENTIFIED:
                new = keep(insights.episodes(found, log) if kind == "insights" else with_incident_ids(insights.incidents(found)))
                old = keep(self._live(self.segments[kind].state(doc["segments"].get(kind, [])), kind))
                if check:
                    several = matched(old, new, kind).where("ambiguous").select("old_id").limit(5).collect()  # a few, for the message
                    if several:
                        raise AmbiguousLifecycle(f"{kind} that match in more than one way: {[r.old_id for r in several]}")
                said, fresh = self._with_ids(old, new, kind, number, now, keep)
                pairs = fresh.select(F.col(IDENTIFIED[kind][0]))
                stay = old.join(pairs, IDENTIFIED[kind][0], "left_anti") if check else old.limit(0)
                if check and kind == "insights":
                    self._one_open(fresh, stay)
                rows[kind] = said.where("said.live").unionByName(self._said(stay, kind, number))
            written = at_once([lambda k=k, df=df: [self.segments[k].write(df, name, max(1, n * (4 if k in ("entities", "relationships") else 1)), 9)] for k, df in rows.items()])
            self.mark({"segments": dict(zip(rows, written, strict=True)), "batch": number})
        finally:
            unstage(*temporary)
        for k, listed in doc["segments"].items():
            for s in listed:
                self.segments[k].drop(s["name"])

    def _one_open(self, fresh: DataFrame, stay: DataFrame) -> None:
        """A key has one open insight: a retained one and a new one of the same key would be two."""
        journal = self.journal()
        opened = [lifecycle.overlay(x.select("insight_id", "dedupe_key", "state"), journal, "insight_id").where("state = 'open' AND dedupe_key IS NOT NULL").select("dedupe_key") for x in (fresh, stay)]
        twice = opened[0].intersect(opened[1]).limit(5).collect()  # a few, for the message
        if twice:
            raise AmbiguousLifecycle(f"open insights that can't be matched to their events: {[r.dedupe_key for r in twice]}")

    def repair(self) -> list[str]:
        """STR-10: rebuilds, and clears the gaps that were there at the start. A gap whose events are lost blocks it: those come back, and nothing is done."""
        names = [x for x in self.folder.names("gaps") if x.startswith("gap-")]
        lost = [r.failure_id for r in maintenance.lost_evidence(self.gaps(), self.events()).select("failure_id").distinct().collect()]  # gaps, not events
        if lost or not names:
            return lost
        self.rebuild()
        for x in names:
            self.folder.drop(f"gaps/{x}")
        return []

    def decide(self, requests: DataFrame, kind: str, number: int) -> DataFrame:
        """RULE-9: requests(target, at, seq, to) on insights or incidents, judged after those before, and put into the journal.

        A target starts in the state that its row has without decisions; number is the request batch's, so it may run again.
        """
        name = IDENTIFIED[kind][0]
        earlier = self.journal().where((F.col("kind") == kind) & (F.col("number") < number))
        targets = requests.select("target").distinct()
        rows = self._live(self.segments[kind].state(self.table_manifest.load()["segments"].get(kind, [])), kind).join(targets, F.col(name) == F.col("target"), "left_semi")
        asked = earlier.where("status = 'moved'").join(targets, "target", "left_semi").select("target", "at", "seq", "to", F.lit(False).alias("new"))
        asked = asked.unionByName(requests.select("target", F.col("at").cast("timestamp_ntz").alias("at"), F.col("seq").cast("long").alias("seq"), "to", F.lit(True).alias("new")))
        out = None
        for state in ("open", "resolved") if kind == "insights" else ("open",):
            of = asked.join(rows.where(F.col("state") == state).select(F.col(name).alias("target")), "target", "left_semi")
            taken = None
            if kind == "insights":
                live = self.table("insights")
                busy = live.where(F.col("state").isin(*lifecycle.OPEN)).select("dedupe_key", F.col(name).alias("other"))
                taken = live.join(busy, "dedupe_key").where(F.col(name) != F.col("other")).select(F.col(name).alias("target"))
            judged = lifecycle.transitions(of, kind.removesuffix("s"), state, taken)
            out = judged if out is None else out.union(judged)
        fresh = asked.where("new").select("target", "at", "seq", "to")
        out = out.join(fresh, ["target", "at", "seq", "to"], "left_semi").select("target", "at", "seq", "from", "to", "status", F.lit(kind).alias("kind"))
        out.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/journal/number={number}")
        return self.journal().where(F.col("number") == number)

    def retain(self, as_of: dt.datetime) -> dict[str, int]:
        """STR-11: removes what is too old, and tells how many rows of each table went.

        Events go by day of arrival, whole folders at a time, as soon as all of a day is too old; those without an arrival
        stay. Runs, and insights and incidents in a terminal state, go by their own clock; open ones and their decisions stay.
        """
        gone = {}
        first_day = (as_of - dt.timedelta(days=maintenance.EVENT_DAYS)).date()
        # A period's last day decides: 31 days after the first, at most, for months.
        ends = lambda x: dt.date.fromisoformat(x[4:]) + dt.timedelta(days={"DAY": 0, "WEEK": 6, "MONTH": 30}[self.every])
        days = [f"{b}/{x}" for b in self.folder.names("events") if b.startswith("batch=") for x in self.folder.names(f"events/{b}") if x[:4] == "day=" and x[4:5].isdigit() and ends(x) < first_day]
        old = sorted({dt.date.fromisoformat(x.rpartition("=")[2]) for x in days})
        gone["events"] = self.log().where(F.col("day").isin(*old)).count() if old else 0
        for x in days:
            self.folder.drop(f"events/{x}")
        doc, now = self.table_manifest.load(), F.lit(as_of)
        name, segments = f"t{(self.versions() or [0])[-1] + 1}", dict(doc["segments"])
        old_files = []
        for k, by, states in (("runs", "updated_at", None), ("insights", "last_observed_at", maintenance.TERMINAL_STATES), ("incidents", "last_at", ("resolved", "suppressed"))):
            state = staged(self.segments[k].state(segments.get(k, [])), k)
            key = "run_id" if k == "runs" else IDENTIFIED[k][0]
            shown = self.table(k)
            stays = F.coalesce(maintenance.retained(shown, now, maintenance.RUN_DAYS, by), F.lit(True))
            stays = stays if states is None else stays | ~F.col("state").isin(*states)
            going = staged(shown.where(~stays).select(key), "going")
            gone[k] = going.count()
            if gone[k]:
                old_files += [(k, s["name"]) for s in segments[k]]
                rows = sum(s["rows"] for s in segments[k])
                segments[k] = [self.segments[k].write(state.join(going, key, "left_anti"), name, rows, 9)]
                if k != "runs":
                    journal = staged(self.journal().join(going.select(F.col(key).alias("target")), "target", "left_anti"), "journal")
                    gone["journal"] = gone.get("journal", 0) + self.journal().count() - journal.count()
                    journal.write.option("partitionOverwriteMode", "static").mode("overwrite").partitionBy("number").parquet(f"{self.path}/journal")
                    unstage(journal)
            unstage(state, going)
        self.mark({**doc, "segments": segments})
        for k, x in old_files:
            self.segments[k].drop(x)
        return gone
