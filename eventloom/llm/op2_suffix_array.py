"""Suffix-array dedup: maximal repeats from common-prefix intervals of a sparse enhanced suffix array.

Every window of LENGTH bytes has an anchor: the SEED-byte string with the smallest hash in it. Equal windows have equal
anchors at equal places, so only suffixes that start at anchors need be sorted, and only those whose seed occurs twice.
Each seed's suffixes, sorted, are one piece of the suffix array; a stack scan over their common prefixes gives the
interval tree, and members of an interval that also agree far enough to the left are the occurrences of a repeat.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import documents, staged, unstage
from eventloom.llm.textops import batches, mix, prefix_hash

LENGTH, SEED = 200, 64
WIDTH = LENGTH - SEED + 1
#: Seeds with more distinct contexts than this are counted window by window, over the whole cluster.
GROUP = 20_000
PIECE = 1 << 22


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each run of w values."""
    n = len(v) - w + 1
    pad = np.full(-len(v) % w, v.max(), v.dtype)
    blocks = np.concatenate([v, pad]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and seed hashes of the anchors of all windows that don't cross an offset."""
    at, hashes = [], []
    for base in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
        part = data[base : base + PIECE + LENGTH - 1]
        p, down = prefix_hash(part)
        h = mix((p[SEED:] - p[:-SEED]) * down[: len(part) - SEED + 1])
        v = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        m = sliding_min(v, WIDTH)
        ok = np.ones(len(m), bool)
        for o in offsets[(offsets > base) & (offsets < base + len(part))] - base:
            ok[max(o - LENGTH + 1, 0) : o] = False
        a = (m[ok] & np.uint64(0xFFFFFF)).astype(np.int64)
        a = a[np.flatnonzero(np.diff(a, prepend=-1))]
        at.append(a + base)
        hashes.append(h[a])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    keep = np.flatnonzero(np.diff(at, prepend=-1))
    return at[keep], hashes[keep]


def find_anchors(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batch_iter:
        ids = rb.column(0)
        for i, data, offsets in batches(rb.column(1)):
            at, h = anchors(data, offsets)
            cut = np.searchsorted(at, offsets)
            n = np.diff(offsets)
            shas = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            rel = at - np.repeat(offsets[:-1], np.diff(cut))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), x) for x in (pa.array(rel, pa.int64()), pa.array(h.view(np.int64), pa.int64()))]
            yield pa.record_batch([ids.slice(i, len(n)), pa.array(n), pa.array(shas, pa.binary()), *lists], ["doc_id", "n_bytes", "sha", "at", "seeds"])


def packed(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for rb in batch_iter:
        for lo in range(0, rb.num_rows, 500):
            part = rb.slice(lo, 500)
            texts = [(t or "").encode() for t in part.column(1).to_pylist()]
            yield pa.record_batch(
                [part.column(0), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([z.compress(t) for t in texts], pa.binary())], ["doc_id", "sha", "z"]
            )


def contexts(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, packed text, places, seeds -> one row for each place: what stands around it. Left bytes are reversed."""
    z = zstandard.ZstdDecompressor()
    for rb in batch_iter:
        for rid, t, places, seeds in zip(*rb.columns, strict=True):
            text, places, seeds = z.decompress(t.as_py()), places.values, seeds.values
            for lo in range(0, len(places), 5000):
                at = places.slice(lo, 5000)
                left = [text[max(0, p - LENGTH + SEED) : p][::-1] for p in at.to_pylist()]
                right = [text[p : p + LENGTH] for p in at.to_pylist()]
                ctx = [hashlib.blake2b(x + b"%d" % len(x) + y, digest_size=16).digest() for x, y in zip(left, right, strict=True)]
                yield pa.record_batch([pa.array([rid.as_py()] * len(at), pa.int64()), at, seeds.slice(lo, 5000), pa.array(ctx, pa.binary()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["rid", "at", "seed", "ctx", "lft", "rgt"])


def common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """The interval tree of a sorted list by the common lengths of its neighbours: (length, first, last) of each interval of least or more."""
    stack: list[tuple[int, int]] = []
    for i, h in enumerate([*lcp, -1]):
        start = i
        while stack and stack[-1][0] > h:
            n, start = stack.pop()
            yield n, start, i
        if h >= least and (not stack or stack[-1][0] < h):
            stack.append((h, start))


def stack_scan(lefts: list[bytes], rights: list[bytes], rank: list[int]) -> Iterator[tuple[int, list[int], list[int], list[tuple[int, int, int]]]]:
    """Repeats of a piece of the suffix array (rights sorted; rank: each row's place in the order of lefts).

    Length to the right, members in the order of rank, each one's own reach to the left, and the repeats among them as
    (length to the left, first, last). An interval's members with the same LENGTH - r bytes to the left repeat a string of
    LENGTH bytes; the intervals of their left contexts are the strings that can't be made longer to the left without losing
    an occurrence. A set of members that lies in one child interval was put out there, with a longer string.
    """
    lcp = [common(rights[i - 1], rights[i]) for i in range(1, len(rights))]
    for r, start, end in intervals(lcp, SEED):
        need = LENGTH - r
        child, groups = 0, defaultdict(list)
        for m in range(start, end + 1):
            if m > start and lcp[m - 1] == r:
                child += 1
            if len(lefts[m]) >= need:
                groups[lefts[m][:need]].append((rank[m], m, child))
        for g in groups.values():
            g.sort()
            changes = [0]
            for k in range(1, len(g)):
                changes.append(changes[-1] + (g[k - 1][2] != g[k][2]))
            if changes[-1]:
                near = [common(lefts[g[k - 1][1]], lefts[g[k][1]]) for k in range(1, len(g))]
                reach = [max(x, y) for x, y in zip([0, *near], [*near, 0], strict=True)]
                nodes = [(n, lo, hi) for n, lo, hi in intervals(near, need) if changes[hi] > changes[lo]]
                yield r, [m for _, m, _ in g], reach, nodes


def pieces_of(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (seed, ctx, n, lft, rgt) sorted by seed and rgt -> each seed's."""
    held: list[tuple] = []
    for rb in batch_iter:
        for lo in range(0, rb.num_rows, 2000):
            for row in zip(*(c.to_pylist() for c in rb.slice(lo, 2000).columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


SCANNED = "seed long, ctx binary, lo long, hi long, left_lo long, left_hi long, l long, r long, n long, num long"


def scan_repeats(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each seed's piece -> its maximal repeats, a row each as the scan finds it, then its contexts.

    A repeat (no ctx): its members are the contexts whose suffix has a place from lo to hi and whose left bytes have one from
    left_lo to left_hi; l and r bytes to the left and right of the anchor; n occurrences; its number. A context that is in a
    repeat: its two places (lo, left_lo), the furthest l and r of its repeats, the length n of the longest, their number.
    """
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 8]
    names = [x.split()[0] for x in SCANNED.split(", ")]
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        rb = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        out.clear()
        return rb

    for rows in pieces_of(batch_iter):
        seed, size = rows[0][0], len(rows)
        lefts, rights = [x[3] for x in rows], [x[4] for x in rows]
        order = sorted(range(size), key=lefts.__getitem__)
        rank = [0] * size
        for k, m in enumerate(order):
            rank[m] = k
        far, right, longest, among, whole = [0] * size, [0] * size, [0] * size, [0] * size, set()
        number = 0
        for r, members, reach, nodes in stack_scan(lefts, rights, rank):
            before, opened = [0], [0] * (len(members) + 1)
            for m in members:
                before.append(before[-1] + rows[m][2])
            # Others that lie between them in the suffix array differ to the left, so they have no place from left_lo to left_hi.
            first, last = min(members), max(members)
            for left, lo, hi in nodes:
                number += 1
                opened[lo] += 1
                opened[hi + 1] -= 1
                out.append((seed, None, first, last, rank[members[lo]], rank[members[hi]], left, r, before[hi + 1] - before[lo], number))
                if len(out) >= 20_000:
                    yield batch()
            level = 0
            for k, (m, own) in enumerate(zip(members, reach, strict=True)):
                level += opened[k]
                if level:
                    among[m] += level
                    far[m], right[m], longest[m] = max(far[m], own), max(right[m], r), max(longest[m], own + r)
                    if own == len(lefts[m]) and r == len(rights[m]):
                        whole.add(m)
        for m, (_, ctx, n, x, y) in enumerate(rows):
            # A context that occurs twice or more repeats as a whole, if it isn't in a repeat of just these bytes.
            if n > 1 and len(x) + len(y) >= LENGTH:
                if m not in whole:
                    number += 1
                    among[m] += 1
                    out.append((seed, None, m, m, rank[m], rank[m], len(x), len(y), n, number))
                far[m], right[m], longest[m] = len(x), len(y), len(x) + len(y)
            if among[m]:
                out.append((seed, ctx, m, None, rank[m], None, far[m], right[m], longest[m], among[m]))
            if len(out) >= 20_000:
                yield batch()
    if out:
        yield batch()


def windows_of(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (seed, ctx, n, lft, rgt) -> a digest of each window of LENGTH bytes around the anchor, with its reach to the left."""
    for rb in batch_iter:
        for lo in range(0, rb.num_rows, 64):
            out: list = []
            for seed, ctx, n, left, right in zip(*(c.to_pylist() for c in rb.slice(lo, 64).columns), strict=True):
                text, x = left[::-1] + right, len(left)
                out += [(seed, ctx, n, x - s, int.from_bytes(hashlib.blake2b(text[s : s + LENGTH], digest_size=8, salt=b"%x" % (x - s)).digest(), "big", signed=True)) for s in range(min(x, len(text) - LENGTH) + 1)]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["seed", "ctx", "n", "j", "w"])


CUT = "rid long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, n_repeats long, longest_repeat long"


def cut_out(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, packed text, spans, n_repeats, longest_repeat -> what is removed, a digest of what stays, and the last two."""
    z = zstandard.ZstdDecompressor()
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.int64(), pa.int64())
    for rb in batch_iter:
        out = []
        for d, t, spans, repeats, longest in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            text, runs = z.decompress(t), []
            for s in sorted((x["s"], x["e"]) for x in spans):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            out.append((d, sum(b - a for a, b in runs), len(runs), kept.hexdigest(), runs, repeats, longest))
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in CUT.split(", ")])


class Repeats:
    """The steps' tables, .groups() with .members(), .occurrences() and .removed().

    A row is known by rid, a number of its own that is given out once, in the first staged table: rows that share a doc_id
    are told apart. Of equal texts one is searched. A seed's contexts are scanned in one task up to GROUP of them. A passage
    that very many texts share has more, each with other text around it; so they can't be brought together in one task, and
    are counted window by window.
    """

    def __init__(self, docs: DataFrame):
        docs = docs.select("doc_id", "text")
        found = docs.mapInArrow(find_anchors, "doc_id long, n_bytes long, sha binary, at array<long>, seeds array<long>")
        self.found = staged(found.select(F.monotonically_increasing_id().alias("rid"), "*"), "repeats-anchors")
        self.texts = self.found.groupBy("sha").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"))
        one = self.found.join(self.texts.select("rid"), "rid", "left_semi")
        rows = one.select("rid", F.explode(F.arrays_zip("at", "seeds")).alias("x")).select("rid", "x.at", F.col("x.seeds").alias("seed"))
        twice = rows.groupBy("seed").count().where("count > 1").select("seed")
        hits = rows.join(twice, "seed").groupBy("rid").agg(F.collect_list(F.struct("at", "seed")).alias("x"))
        hits = hits.select("rid", F.col("x.at").alias("at"), F.col("x.seed").alias("seeds"))
        # The packed texts find their number by doc_id and sha, and by a hash of both, which spreads copies.
        key = F.xxhash64("doc_id", "sha").alias("key")
        hits = hits.join(one.select("rid", key, F.col("doc_id").alias("id"), F.col("sha").alias("digest")), "rid")
        packs = docs.mapInArrow(packed, "doc_id long, sha binary, z binary").select(key, "*")
        # Both sides grow with the documents, so they are shuffled at any size.
        packs = packs.join(hits.hint("merge"), "key").where(F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("digest")))
        self.hits = staged(packs.select("rid", "z", "at", "seeds"), "repeats-hits")
        near = self.hits.mapInArrow(contexts, "rid long, at long, seed long, ctx binary, lft binary, rgt binary")
        self.near = near.select("rid", "at", "seed", "ctx")
        kinds = staged(near.groupBy("seed", "ctx").agg(F.count("*").alias("n"), F.first("lft").alias("lft"), F.first("rgt").alias("rgt")), "repeats-contexts")
        size = kinds.groupBy("seed").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1")
        sized = kinds.join(size, "seed")
        few = sized.where(F.col("kinds") <= GROUP).select("seed", "ctx", "n", "lft", "rgt")
        self.scanned = staged(few.repartition("seed").sortWithinPartitions("seed", "rgt").mapInArrow(scan_repeats, SCANNED), "repeats-scanned")
        self.large = staged(sized.where(F.col("kinds") > GROUP).select("seed", "ctx", "n", "lft", "rgt"), "repeats-large")
        unstage(kinds)

    def windows(self) -> tuple[DataFrame, DataFrame]:
        """Of the large groups: each context's windows (seed, ctx, n, j, w), and those that occur twice, with a hash of the set of contexts that have them."""
        each = self.large.mapInArrow(windows_of, "seed long, ctx binary, n long, j long, w long")
        mark = F.xxhash64("ctx")
        twice = each.groupBy("seed", "j", "w").agg(F.sum("n").alias("all"), F.xxhash64(F.bit_xor(mark), F.sum(F.shiftright(mark, 20)), F.count("*")).alias("set")).where("all > 1")
        return each, twice.drop("all")

    def large_members(self) -> DataFrame:
        """seed, ctx, set, l, r: the repeats of the large groups, each the union of the windows that occur in just the same contexts."""
        each, twice = self.windows()
        both = each.join(twice, ["seed", "j", "w"])
        return both.groupBy("seed", "ctx", "set").agg(F.max("j").alias("l"), (LENGTH - F.min("j")).alias("r"))

    def groups(self) -> DataFrame:
        """seed, num, l, r, n, lo, hi, left_lo, left_hi: each maximal repeat of the scan, n its occurrences (equal texts count once, repeated rows each)."""
        return self.scanned.where("ctx is null").select("seed", "num", "l", "r", "n", "lo", "hi", "left_lo", "left_hi")

    def members(self) -> DataFrame:
        """seed, ctx, set, l, r: the contexts of each repeat of the scan, found by their two places."""
        at = self.groups().withColumn("at", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
        ctx = self.scanned.where("ctx is not null").select("seed", "ctx", F.col("lo").alias("at"), F.col("left_lo").alias("left_at"))
        return at.join(ctx, ["seed", "at"]).where("left_at between left_lo and left_hi").select("seed", "ctx", F.col("num").alias("set"), "l", "r")

    def reach(self) -> DataFrame:
        """seed, ctx -> how far left and right of the anchor its repeats cover it, the longest one's length, their number."""
        near = self.scanned.where("ctx is not null").select("seed", "ctx", "l", "r", F.col("n").alias("longest"), F.col("num").alias("repeats"))
        if self.large.isEmpty():
            return near
        far = self.large_members().groupBy("seed", "ctx")
        return near.union(far.agg(F.max("l").alias("l"), F.max("r").alias("r"), F.max(F.col("l") + F.col("r")).alias("longest"), F.count("*").alias("repeats")))

    def occurrences(self) -> DataFrame:
        """repeat_id, doc_id, start, end (bytes): one row for each occurrence of a repeat, copies of equal texts among them.

        A repeat is a string that, made longer on either side, occurs less often. It reaches as far from its anchor as windows
        of LENGTH bytes do: a longer one comes out anchor by anchor. In groups beyond GROUP it is the union of the windows that
        occur in just the same contexts. Equal texts of LENGTH bytes or more are a repeat of their own.
        """
        rows = self.members()
        if not self.large.isEmpty():
            rows = rows.union(self.large_members())
        copies = self.found.select("sha", "doc_id", "n_bytes").join(self.texts, "sha")
        x = rows.join(self.near, ["seed", "ctx"]).join(copies.select("rid", "doc_id"), "rid")
        x = x.select(F.struct("seed", "set").alias("repeat_id"), "doc_id", (F.col("at") - F.col("l")).alias("start"), (F.col("at") + F.col("r")).alias("end"))
        whole = copies.where((F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH))
        whole = whole.select(F.struct(F.col("rid").alias("seed"), F.lit(0).cast("long").alias("set")).alias("repeat_id"), "doc_id", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))
        return x.union(whole)

    def removed(self) -> DataFrame:
        span = F.struct((F.col("at") - F.col("l")).alias("s"), (F.col("at") + F.col("r")).alias("e"))
        spans = self.near.join(self.reach(), ["seed", "ctx"]).groupBy("rid")
        spans = spans.agg(F.collect_list(span).alias("spans"), F.sum("repeats").alias("n_repeats"), F.max("longest").alias("longest_repeat"))
        cut = self.hits.select("rid", "z").join(spans, "rid").mapInArrow(cut_out, CUT)
        cut = cut.dropDuplicates(["rid"])  # repeated rows are one text
        whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
        out = self.found.select("rid", "doc_id", "n_bytes", "sha").join(self.texts.select("sha", "copies"), "sha").join(cut, "rid", "left")
        return out.select(
            "doc_id", "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
            F.when(whole, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(F.coalesce("spans", F.array().cast("array<array<long>>"))).alias("spans"),
            F.when(whole, F.greatest(F.coalesce("n_repeats", F.lit(0)), F.lit(1))).otherwise(F.coalesce("n_repeats", F.lit(0))).alias("n_repeats"),
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("longest_repeat", F.lit(0))).alias("longest_repeat"),
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, n_repeats, longest_repeat; other columns are not read.

    Removes each byte covered by a string of LENGTH bytes that also starts anywhere else. Null is an empty text; texts
    shorter than LENGTH stay whole; equal texts and repeated rows are removed whole; rows that share a doc_id and differ are
    texts of their own; an empty table gives an empty result. What is removed is what the maximal repeats of the scan cover:
    n_repeats counts those at the text's anchors, longest_repeat is the longest one's bytes (a whole equal text counts as one).
    """
    return Repeats(docs).removed()


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("spans")
