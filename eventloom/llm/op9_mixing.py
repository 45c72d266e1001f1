"""Mixing sources to target weights: Poisson replication by an inverted, hash-seeded Poisson distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import documents, staged

SEED, ALPHA = "mix-1", 0.5
#: Most sources, and numbers of their distributions, that are broadcast; beyond that each source is dealt to SALT places.
SOURCES, NUMBERS, SALT = 10_000, 500_000, 64


def uniform(*cols: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone: 52 bits of a SHA-256."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= j) for j = 0, 1, ... until the rest is beyond what 52 bits can tell; in logarithms, so that no rate underflows."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(a: Column, j: Column) -> Column:
        log = a["log"] + F.ln(rate) - F.ln(j)
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"), F.concat(a["all"], F.array(a["sum"] + F.exp(log))).alias("all"))

    return F.when(rate <= 0, F.array(F.lit(1.0))).otherwise(F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["all"]))


def rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, size: float = 1.0) -> DataFrame:
    """source -> n, weight, rate, cdf. The mean number of copies of a source's documents is size * N * weight / n.

    weights(source, weight) may give any non-negative weights; a source that it lacks has none, and goes. Without it,
    weights are counts to the power alpha. Null is a source like any other.
    """
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        w = n.withColumn("weight", F.pow("n", F.lit(alpha)))
    else:
        w = n.join(weights.select(F.col("source").alias("_s"), "weight"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    total = w.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_w"))
    # The other side is one row, a sum.
    rate = F.when(F.col("all_w") > 0, F.lit(size) * F.col("all_n") * F.col("weight") / F.col("all_w") / F.col("n")).otherwise(F.lit(0.0))
    w = w.join(F.broadcast(total)).withColumn("rate", rate)
    return w.select("source", "n", "weight", "rate", poisson_cdf(F.col("rate")).alias("cdf"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, size: float = 1.0, seed: str = SEED) -> DataFrame:
    """Each document as often as a Poisson number with its source's rate says, all in one shuffled order.

    Returns docs' columns, with copy (1, 2, ...) and rate; columns of docs with those names are replaced. The number
    depends on doc_id and the seed alone, so a lost executor's work comes out the same. Rows with the same doc_id get the
    same number each. Null doc_id counts as the empty string. An empty table gives an empty result. The documents
    are shuffled once, for the order; the rates reach them by broadcast if SOURCES and NUMBERS bound it.
    """
    docs = docs.drop("copy", "rate")
    r = staged(rates(docs, weights, alpha, size).select(F.col("source").alias("_mix_source"), "rate", "cdf"), "rates")
    sources, numbers = r.agg(F.count("*"), F.coalesce(F.sum(F.size("cdf")), F.lit(0))).first()
    same = F.col("source").eqNullSafe(F.col("_mix_source"))
    if sources <= SOURCES and numbers <= NUMBERS:
        out = docs.join(F.broadcast(r), same)
    else:
        out = docs.withColumn("_mix_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
        r = r.withColumn("_mix_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        out = out.join(r, same & (F.col("_mix_salt") == F.col("_mix_part"))).drop("_mix_salt", "_mix_part")
    out = out.withColumn("_mix_u", uniform(F.col("doc_id"), seed=seed))
    out = out.withColumn("_mix_n", F.size(F.filter("cdf", lambda c: F.col("_mix_u") >= c)))
    out = out.where("_mix_n > 0").drop("cdf", "_mix_u", "_mix_source")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).drop("_mix_n")
    out = out.withColumn("_mix_place", F.xxhash64(F.lit(seed), "doc_id", "copy"))
    return out.repartition(F.col("_mix_place")).sortWithinPartitions("_mix_place").drop("_mix_place")


ORACLE_SQL = f"""
WITH n AS (SELECT source, count(*) AS n, pow(count(*), {ALPHA}) AS weight FROM documents GROUP BY source),
w AS (SELECT source, n, (SELECT sum(n) FROM n) * weight / (SELECT sum(weight) FROM n) / n AS rate FROM n),
j AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS j FROM w),
p AS (SELECT source, j, exp(-rate + j * ln(rate) - lgamma(j + 1)) AS p FROM j),
c AS (SELECT source, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM p),
u AS (SELECT d.*, CAST(CAST('0x' || substr(sha256('{SEED}|' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents d),
k AS (SELECT u.doc_id, count(*) AS k FROM u JOIN c ON c.source IS NOT DISTINCT FROM u.source AND u.u >= c.c GROUP BY u.doc_id)
SELECT d.*, CAST(unnest(range(1, k + 1)) AS INTEGER) AS copy, rate FROM documents d JOIN k USING (doc_id) JOIN w ON w.source IS NOT DISTINCT FROM d.source
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))
