"""Of each part of the library some registered queries agree with their SQL at the smallest size; the driver compares all of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = ("qry_failed_runs", "agg8_relationships", "agg11_baselines", "rule7_episodes", "rule8_incidents", "qry10_investigations", "src3_run_results", "src5_6_15_otlp_round_trip", "val17_policy_sampling", "str11_retention",
         "val8_entity_conformance", "val12_contract_drift", "val15_urls", "qry5_timelines", "join5_finding_resolver", "join8_lineage")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    got, want = entry.queries()[name](spark, DIR).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda df: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False))
    a, b = text(got), text(want)
    assert [tuple(x) for x in a] == [tuple(x) for x in b]


def test_entry(spark):
    if os.path.isdir(DIR):
        assert entry.entry(spark).columns
