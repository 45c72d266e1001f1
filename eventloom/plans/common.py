"""What the registered queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.staging import staged
from eventloom.operators.correlate import canonical
from eventloom.schema import from_tables, stamp

Query = Callable[[SparkSession, str], DataFrame]


def over_events(f: Callable[[DataFrame], DataFrame]) -> Query:
    """A query over the canonical events of the given tables."""
    return lambda spark, sf_dir: texted(f(canonical(from_tables(spark, sf_dir))))


#: Columns that rules, resolvers and what is made of findings look at.
SEEN = (
    "event_id", "event", "outcome", "observed_at", "service", "producer", "run_id", "retry_of", "error_message", "entities", "asset_key", "table_name", "duration_ms", "job_id", "pipeline", "rows_written", "row_count", "metric",
    "value", "tags", "partition_key", "sla_seconds",
)


def over_silver(f: Callable[[DataFrame], DataFrame], columns: tuple[str, ...] | None = None) -> Query:
    """The same where the query goes through the events several times: they are written once as a table of their own, with all columns or those that the query looks at."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ev = canonical(from_tables(spark, sf_dir))
        return texted(f(staged(ev if columns is None else ev.select(*columns), "canonical")))

    return query


def texted(df: DataFrame) -> DataFrame:
    """Times as text with milliseconds, arrays of strings joined with commas, so that other engines can compare."""
    for name, kind in df.dtypes:
        if kind.startswith("timestamp"):
            df = df.withColumn(name, stamp(name))
        elif kind == "array<string>":
            df = df.withColumn(name, F.array_join(name, ","))
    return df
