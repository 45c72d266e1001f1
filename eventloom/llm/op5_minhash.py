"""MinHash near-dedup: banded candidates, sequential Bayesian pruning of signature batches, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import documents, linked_components, staged
from eventloom.llm.textops import batches, mix, shingle_sets

SHINGLE, THRESHOLD = 5, (75, 100)
#: 40 bands of 5 values find a pair of similarity 0.75 with probability 1 - (1 - 0.75**5)**40 = 0.99998.
BANDS, ROWS = 40, 5
#: Posterior odds below which a candidate is dropped, and the number of values compared at a time.
MISS, STEP = 1e-6, 25


@lru_cache(8)
def hash_family(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """The smallest value of each of n hash functions; shingles must be well mixed and not empty."""
    a, b = hash_family(n)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 512):
        x = (shingles[i : i + 512] >> np.uint64(32)).astype(np.uint32)
        np.minimum(out, (a[:, None] * x + b[:, None]).min(1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = np.arange(bands, dtype=np.uint64)
    s = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
    for j in range(rows):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + s[:, j] + np.uint64(1))
    return x.view(np.int64)


@lru_cache(4)
def fewest_matches(n: int, step: int, threshold: float, miss: float) -> np.ndarray:
    """For each multiple of step up to n: with fewer matches than this, similarity >= threshold has a posterior below miss.

    The prior is uniform, so after m matches of n the similarity is Beta(m + 1, n - m + 1); its upper tail is a sum of
    binomial terms.
    """
    out = []
    for k in range(step, n + 1, step):
        tail = [sum(math.comb(k + 1, i) * threshold**i * (1 - threshold) ** (k + 1 - i) for i in range(m + 1)) for m in range(k + 1)]
        out.append(next((m for m, t in enumerate(tail) if t >= miss), k))
    return np.array(out)


def sketch(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, set size, a 128-bit digest of the set, signature, band keys."""
    for rb in batch_iter:
        ids = rb.column(0)
        for at, data, offsets in batches(rb.column(1)):
            rows = []
            for s in shingle_sets(data, offsets, SHINGLE):
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                sig = signature(s, BANDS * ROWS)
                one = int(np.bitwise_xor.reduce(mix(s)))
                two = int(np.sum(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64))
                rows.append((len(s), one.to_bytes(8, "big") + two.to_bytes(8, "big"), sig.astype(np.uint16).tobytes(), band_keys(sig, BANDS, ROWS)))
            n, d, s, b = zip(*rows, strict=True)
            yield pa.record_batch(
                [ids.slice(at, len(rows)), pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.array(s, pa.binary()), pa.array(b, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "sig", "bands"]
            )


def packed(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for rb in batch_iter:
        yield pa.record_batch([rb.column(0), pa.array([None if t is None else z.compress(t.encode()) for t in rb.column(1).to_pylist()], pa.binary())], ["doc_id", "z"])


def unpacked_sets(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for rb in batch_iter:
        for lo in range(0, rb.num_rows, 256):
            part = rb.slice(lo, 256)
            texts = pa.array([z.decompress(t) for t in part.column(1).to_pylist()], pa.large_binary())
            sets = [s.view(np.int64) for _, data, offsets in batches(texts) for s in shingle_sets(data, offsets, SHINGLE)]
            yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])


@F.pandas_udf(T.BooleanType())
def plausible(a: pd.Series, b: pd.Series) -> pd.Series:
    """Compares the signatures step by step; a pair goes as soon as its posterior falls below MISS."""
    n = BANDS * ROWS
    least = fewest_matches(n, STEP, THRESHOLD[0] / THRESHOLD[1], MISS)
    alive = np.arange(len(a))
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, n) for s in (a, b))
    matches = np.zeros(len(a), int)
    for k, m in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches[alive] += (x[alive, part] == y[alive, part]).sum(1)
        alive = alive[matches[alive] >= m]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return pd.Series(out)


@F.pandas_udf(T.BooleanType())
def linked(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two packed texts' full shingle sets reach the threshold."""
    z, out = zstandard.ZstdDecompressor(), []
    for i in range(0, len(a), 256):
        texts = [z.decompress(t).decode() for s in (a[i : i + 256], b[i : i + 256]) for t in s]
        sets = [s for _, data, offsets in batches(pa.array(texts, pa.large_string())) for s in shingle_sets(data, offsets, SHINGLE)]
        half = len(sets) // 2
        for s, t in zip(sets[:half], sets[half:], strict=True):
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(THRESHOLD[1] * both >= THRESHOLD[0] * (len(s) + len(t) - both))
    return pd.Series(out)


def verified(pairs: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs(a, b) whose sets are similar enough; texts holds every document of any pair, packed."""
    few = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("s")), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("t")), "b")
    few = few.where(plausible("s", "t")).select("a", "b")
    full = few.join(texts.select(F.col("doc_id").alias("a"), F.col("z").alias("y")), "a").join(texts.select(F.col("doc_id").alias("b"), "z"), "b")
    return full.where(linked("y", "z")).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept; other columns are not read, so their names can't clash.

    A document's set is its distinct five-word shingles (fewer words: the whole sequence); documents with 100 *
    intersection >= 75 * union are linked, and a component keeps its smallest doc_id. Null and empty texts have an
    empty set and stay alone. Rows with one doc_id and one text are one document; doc_ids should be distinct. An
    empty table gives an empty result. Ties: component ids are minima, so they don't depend on order.

    Equal sets are merged first by digest; linked_components says which of a band's documents are compared.
    """
    docs = docs.select("doc_id", "text")
    base = staged(docs.mapInArrow(sketch, "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>"), "minhash")
    sets = base.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    sets = staged(sets, "minhash-sets")
    reps = base.join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    banded = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    members = staged(banded.join(buckets, "key").select("key", F.col("doc_id").alias("id")), "minhash-members")
    sigs = reps.select("doc_id", "sig")
    involved = members.select(F.col("id").alias("doc_id")).distinct()
    texts = staged(docs.mapInArrow(packed, "doc_id long, z binary").join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "minhash-texts")
    sets_of = lambda ids: texts.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(unpacked_sets, "id long, s array<long>")
    comps = linked_components(members, lambda pairs: verified(pairs, sigs, texts), sets_of, THRESHOLD, "minhash").withColumnRenamed("id", "rep")
    of_set = sets.join(comps, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = base.select("doc_id", "n_shingles", "digest").join(of_set, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
