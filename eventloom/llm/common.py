"""Connected components, and groups that share a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.staging import staged, unstage


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fingerprint(pairs: DataFrame) -> tuple:
    """Number and digest of the rows, whatever their order."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges(a, b): one row (id, component) for each id in an edge, component the smallest id.

    Alternates large-star and small-star steps (each node links what it sees to the
    smallest), which needs a number of rounds near the logarithm of the longest path. A node's
    neighbours are never gathered: each step is a minimum per node and a join.
    """
    e = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    seen = fingerprint(e)
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = staged(small.where("a <> b").distinct(), name)
        now = fingerprint(new)
        unstage(e)
        e, done, seen = new, now == seen, now
        if done:
            break
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def prefix_pairs(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """sets(id, c, s: distinct longs) -> pairs(a, b) of different c; all with den * intersection >= num * union are among them.

    Also returns the staged tables that the pairs are read from.

    With all elements in one order, the rarest first, such sets share one of their first n - ceil(num * n / den) + 1, and
    their sizes are as near. What very many sets have stands last in that order and so finds no pairs.
    """
    rows = sets.select("id", "c", F.size("s").alias("n"), F.explode("s").alias("key"))
    common = rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    of = W.partitionBy("id")
    rows = rows.join(common, "key").withColumn("place", F.row_number().over(of.orderBy("df", "key"))).withColumn("shared", F.count("*").over(of))
    # Elements that no other set has come first of all.
    rows = rows.where(F.col("place") + F.col("n") - F.col("shared") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1)
    # What may come after this element bounds the intersection.
    rows = staged(rows.select("key", "id", "c", "n", (F.col("shared") - F.col("place") + 1).alias("rest")), "prefixes")
    rows_at = rows
    mixed = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    rows = rows.join(mixed, "key", "left_semi")
    a, b = (rows.select("key", *[F.col(x).alias(f"{x}_{k}") for x in ("id", "c", "n", "rest")]) for k in "ab")
    # An intersection of m or more is needed; this is the first common element for at least one of a pair's rows.
    least = F.ceil((F.col("n_a") + F.col("n_b")) * num / (num + den))
    near = (F.col("id_a") < F.col("id_b")) & (F.col("c_a") != F.col("c_b")) & (F.least("rest_a", "rest_b") >= least)
    return a.join(b, (a["key"] == b["key"]) & near).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), [rows_at]


BITS = 1024


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """For each set of hashes a bitmap of BITS places, each the parity of the hashes that fall on it: (sets, BITS / 64)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    at = np.concatenate([s.view(np.uint64) & np.uint64(BITS - 1) for s in sets]).astype(np.int64) if len(sets) else np.zeros(0, np.int64)
    counts = np.bincount(np.repeat(np.arange(len(sets)), sizes) * BITS + at, minlength=len(sets) * BITS)
    return np.packbits((counts & 1).astype(bool).reshape(-1, BITS), axis=1).view(np.uint64)


def alike_sets(s: np.ndarray, t: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets' Jaccard similarity is num / den or more."""
    if den * min(len(s), len(t)) < num * max(len(s), len(t)):
        return False
    both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
    return den * both >= num * (len(s) + len(t) - both)


def joined_in_buckets(num: int, den: int, sets_of: Callable[[list], list[np.ndarray]]):
    """Rows (key, id, c, text), a key's together -> the links (a, b) that join a key's components c: one for each that are joined.

    The places at which two sets' bitmaps differ are at most as many as the elements in one of them alone, so a pair that
    differs at more than those may be is none; the others are held against each other whole, the nearest first, unless they
    are in one component by then. So no link between components is missed, and no more come out than join them.
    """

    def joined(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda x: x[1])
        ids = [x[1] for x in rows]
        c = np.unique([x[2] for x in rows], return_inverse=True)[1]
        if c.max() == 0:
            return
        sets = sets_of([x[3] for x in rows])
        bits, n = bitmaps(sets), np.array([len(x) for x in sets], np.int64)
        found = []
        for lo in range(0, len(ids), 32):
            part = slice(lo, lo + 32)
            apart = np.bitwise_count(bits[part, None] ^ bits[None, lo:]).sum(-1, dtype=np.int64)
            ok = (c[part, None] != c[None, lo:]) & (apart * (den + num) <= (n[part, None] + n[None, lo:]) * (den - num))
            i, j = np.nonzero(np.triu(ok, 1))
            order = np.argsort(apart[i, j], kind="stable")
            for x, y in zip((lo + i[order]).tolist(), (lo + j[order]).tolist(), strict=True):
                if c[x] != c[y] and alike_sets(sets[x], sets[y], num, den):
                    c[c == c[y]] = c[x]
                    found.append((ids[x], ids[y]))
        if found:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    def go(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for rb in batch_iter:
            for at in range(0, rb.num_rows, 1000):
                for row in zip(*(x.slice(at, 1000).to_pylist() for x in rb.columns), strict=True):
                    if held and row[0] != held[0][0]:
                        yield from joined(held)
                        held = []
                    held.append(row)
        if held:
            yield from joined(held)

    return go


def linked_components(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame], threshold: tuple[int, int], name: str,
    small: int = 0, texts: DataFrame | None = None, sets_of: Callable[[list], list[np.ndarray]] | None = None,
) -> DataFrame:
    """Components (id, component) of the links that verify finds among ids that share a key of members(key, id).

    A key's members are not compared all with all: first each with the key's smallest and largest id. Where a key of four
    members or more (smaller ones have been compared whole) then still holds more than one component, its members are
    compared across components: in one task over texts(id, text) if it has small members at most, else by prefix_pairs over
    sets(ids) (id, s). Neither misses a link between components, so the result is the same as if all pairs that share a key
    had been compared.
    """
    order = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    ends = members.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    star = members.join(ends, "key")
    star = star.select(*order("id", "lo")).union(star.select(*order("id", "hi"))).where("a <> b").distinct()
    star = staged(star, f"{name}-pairs")
    edges = staged(verify(star), f"{name}-edges")
    comps = staged(components(edges, f"{name}-cc"), f"{name}-components")
    named = members.join(comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    keys = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"))
    keys = staged(keys.where("lo < hi AND n > 3").select("key", "n"), f"{name}-keys")
    named = staged(named.join(keys, "key"), f"{name}-open")
    left = staged(named.where(F.col("n") > small).select("id", "c").distinct(), f"{name}-large")
    found, prefixed = edges.limit(0), []
    if texts is not None:
        rows = named.where(F.col("n") <= small).select("key", "id", "c").join(texts, "id").select("key", "id", "c", "text")
        found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(joined_in_buckets(*threshold, sets_of), "a long, b long")
    if not left.isEmpty():
        more, prefixed = prefix_pairs(sets(left.select("id")).join(left, "id").select("id", "c", "s"), *threshold)
        prefixed.append(staged(more.join(star, ["a", "b"], "left_anti"), f"{name}-pairs"))
        found = found.union(verify(prefixed[-1]))
    found = staged(found.distinct(), f"{name}-edges")
    unstage(star, keys, named, left, *prefixed)
    if not found.isEmpty():
        all_edges = staged(components(edges.union(found), f"{name}-cc"), f"{name}-components")
        unstage(comps)
        comps = all_edges
    unstage(edges, found)
    return comps
