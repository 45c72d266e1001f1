"""Conversation prefix trie: ternary search trees over range shards of turn sequences, merged along the shards' borders.

Each distinct sequence of turns is one row of turn digests, sorted over the cluster by ranges. A shard numbers its digests in
order (its dictionary) and inserts its sequences into a ternary search tree, the middle one first, so that the binary trees on
each level stay balanced. A node whose sequences lie in one shard is finished there. Only the nodes on the paths of a shard's
first and last sequence may have sequences in other shards; these paths, with what hangs off them already summed up, are the
sequences of the next round, until one shard holds them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.staging import staged, unstage
from eventloom.llm.op13_merkle import crc32_sql

GROUP, HEADS = 5, 9
#: Turns that a shard is meant to have; a shard's sequences are held in one task.
SHARD = 500_000
DIGEST = 16
NOTHING = hashlib.sha256().hexdigest()


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def sequences(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, seq: its turns in order, each a digest of role and text, and the text's bytes."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    digest = F.substring(F.unhex(F.sha2(said, 256)), 1, DIGEST)
    return turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", digest.alias("id"), F.octet_length(text("text")).cast("long").alias("bytes")).alias("t"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation c, with the first h turns of conversation c - c % GROUP in place of its own first h; h is CRC-32(c) % HEADS.

    The conversations of one group are shuffled together, once, as digests; their texts are not.
    """
    base = (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    convs = sequences(turns).select(base, "conv_id", "t").repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("seq"))
    group = convs.groupBy("base").agg(F.collect_list(F.struct("conv_id", "seq")).alias("all"))
    first = F.filter("all", lambda x: x["conv_id"] == F.col("base"))
    head = F.coalesce(F.slice(F.try_element_at(first, F.lit(1))["seq"], 1, HEADS), F.array().cast("array<struct<turn: long, id: binary, bytes: long>>"))
    h = (F.crc32(F.col("x.conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    each = group.select(head.alias("head"), F.explode("all").alias("x")).select("x.conv_id", "x.seq", "head", h.alias("h"))
    own = F.when(F.size("seq") > F.col("h"), F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))).otherwise(F.slice("seq", 1, 0))
    return each.select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), own).alias("seq"))


def members(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, conv_id, sorted -> for each key the number of conversations, the smallest, and the SHA-256 of them all, joined by commas.

    The digest of a long list can only be made in order; the list is streamed and never held.
    """
    now, n, low, sha = None, 0, 0, None
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "n", "conv_id", "ends"])

    for rb in batch_iter:
        for key, conv in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            if key != now:
                if sha is not None:
                    out.append((now, n, low, sha.hexdigest()))
                now, n, low, sha = key, 0, conv, hashlib.sha256()
            sha.update((b"," if n else b"") + b"%d" % conv)
            n += 1
        if len(out) >= 10_000:
            yield batch()
            out = []
    if sha is not None:
        out.append((now, n, low, sha.hexdigest()))
    if out:
        yield batch()


#: What a row adds to each node of its path, the root first: members, the smallest member, and of finished subtrees the children, leaves and savings.
PARTS = ("n", "low", "kids", "leaves", "saved")
#: A round's result: finished nodes (level = 0), and the paths that go on to the next round (level = 1).
ROUND = {
    "level": pa.int32(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(),
    "ends_sha256": pa.string(), "up": pa.binary(), "key": pa.binary(), "path": pa.binary(), "bytes": pa.list_(pa.int64()), **{k: pa.list_(pa.int64()) for k in PARTS}, "ends": pa.list_(pa.string()),
}
SQL_OF = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


class Tree:
    """A ternary search tree over numbered turns. A node's three links are indices: lower and higher turns, and the next level.

    Index 0 is the root, which has no turn. A node's trie parent was inserted before it, so its index is smaller.
    """

    def __init__(self) -> None:
        self.code, self.low, self.high, self.down, self.up, self.depth = [-1], [0], [0], [0], [0], [0]

    def path(self, codes: list[int]) -> list[int]:
        """The nodes of a sequence, those that lack inserted."""
        code, low, high, down = self.code, self.low, self.high, self.down
        out, at = [0], 0
        for c in codes:
            links, i, nxt = down, at, down[at]
            while nxt and code[nxt] != c:
                links, i = (low if c < code[nxt] else high), nxt
                nxt = links[i]
            if not nxt:
                nxt = links[i] = len(code)
                code.append(c)
                low.append(0)
                high.append(0)
                down.append(0)
                self.up.append(at)
                self.depth.append(self.depth[at] + 1)
            out.append(nxt)
            at = nxt
        return out


def middles(n: int) -> Iterator[int]:
    """0 to n - 1, the middle first, then the middles of both halves, and so on."""
    ranges = [(0, n)]
    for lo, hi in ranges:
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            ranges += [(lo, mid), (mid + 1, hi)]


def turns_of(path: bytes) -> list[bytes]:
    return [path[i : i + DIGEST] for i in range(0, len(path), DIGEST)]


def node_keys(path: bytes) -> list[bytes]:
    """The names of a path's nodes: each a digest of its parent's name and its turn."""
    out = [b""]
    for x in turns_of(path):
        out.append(hashlib.blake2b(out[-1] + x, digest_size=DIGEST).digest())
    return out


def whole_sequences(rows: pa.Table) -> list[dict]:
    """The first round's rows: a sequence adds its members to the last node of its path."""
    out = []
    for path, size, n, low, ends in zip(*(rows[c].to_pylist() for c in ("path", "bytes", "n", "low", "ends")), strict=True):
        before = [0] * len(size)
        out.append({"path": path, "bytes": [0, *size], "n": [*before, n], "low": [*([None] * len(size)), low], **{k: [*before, 0] for k in PARTS[2:]}, "ends": [*([None] * len(size)), ends]})
    return out


class Shard:
    """Sorted rows in a tree, with what they add to each node; border holds the nodes of the first and last path, unless nothing else exists."""

    def __init__(self, rows: list[dict], whole: bool):
        number = {x: i for i, x in enumerate(sorted({x for r in rows for x in turns_of(r["path"])}))}
        self.rows, self.tree = rows, Tree()
        self.paths: list[list[int]] = [[]] * len(rows)
        for i in middles(len(rows)):
            self.paths[i] = self.tree.path([number[x] for x in turns_of(rows[i]["path"])])
        size = len(self.tree.code)
        self.bytes = [0] * size
        self.sums = {k: [None if k == "low" else 0] * size for k in PARTS}
        self.ends: list[str | None] = [None] * size
        for r, path in zip(rows, self.paths, strict=True):
            for d, v in enumerate(path):
                self.bytes[v] = r["bytes"][d]
                self.add(v, {k: r[k][d] for k in PARTS})
                self.ends[v] = r["ends"][d] or self.ends[v]
        self.border = {} if whole else {v: key for i in {0, len(rows) - 1} for v, key in zip(self.paths[i], node_keys(rows[i]["path"]), strict=True)}

    def add(self, v: int, more: dict) -> None:
        for k, x in more.items():
            of = self.sums[k]
            of[v] = of[v] + x if k != "low" else x if of[v] is None else of[v] if x is None else min(of[v], x)

    def climb(self) -> None:
        """Adds what each finished node has to its parent. Children come after their parents, so from the last on each is complete when it is met."""
        n, low, kids, leaves, saved = (self.sums[k] for k in PARTS)
        for v in range(len(self.bytes) - 1, -1, -1):
            if v in self.border:
                continue
            leaves[v] += not kids[v]
            saved[v] += (n[v] - 1) * self.bytes[v]
            if v:
                self.add(self.tree.up[v], {"n": n[v], "low": low[v], "kids": 1, "leaves": leaves[v], "saved": saved[v]})

    def finished(self, first_round: bool) -> dict[str, list]:
        n, low, kids, leaves, saved = (self.sums[k] for k in PARTS)
        done = [v for v in range(len(self.bytes)) if v not in self.border]
        above = [self.tree.up[v] if v else None for v in done]
        # All nodes of later rounds were on a border, and children that were finished before know them by name only.
        names = {} if first_round else {v: key for r, path in zip(self.rows, self.paths, strict=True) for v, key in zip(path, node_keys(r["path"]), strict=True)}
        return {
            "conv_id": [low[v] for v in done], "depth": [self.tree.depth[v] for v in done], "parent_conv_id": [None if u is None or u in self.border else low[u] for u in above],
            "n_convs": [n[v] for v in done], "n_children": [kids[v] for v in done], "n_leaves": [leaves[v] for v in done], "saved_tokens": [saved[v] for v in done],
            "ends_sha256": [self.ends[v] or NOTHING for v in done], "up": [self.border.get(u) for u in above], "key": [names.get(v) for v in done],
        }

    def further(self) -> dict[str, list]:
        """The first and last path for the next round; a node that both have goes with the first."""
        out: dict[str, list] = {k: [] for k in ("path", "bytes", *PARTS, "ends")}
        given: set[int] = set()
        for i in sorted({0, len(self.rows) - 1}) if self.border else ():
            path = self.paths[i]
            out["path"].append(self.rows[i]["path"])
            out["bytes"].append([self.bytes[v] for v in path])
            for k in PARTS:
                out[k].append([(None if k == "low" else 0) if v in given else self.sums[k][v] for v in path])
            out["ends"].append([self.ends[v] for v in path])
            given.update(path)
        return out


def shards(first_round: bool, whole: bool):
    """A partition's rows, sorted by path, are one shard -> a round's result; whole: there is no other shard."""

    def batch(level: int, cols: dict[str, list], lo: int, hi: int) -> pa.RecordBatch:
        part = {k: x[lo:hi] for k, x in cols.items()}
        n = len(next(iter(part.values())))
        part["level"] = [level] * n
        return pa.record_batch([pa.array(part.get(k, [None] * n), t) for k, t in ROUND.items()], list(ROUND))

    def go(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [rb for rb in batch_iter if rb.num_rows]
        if not table:
            return
        rows = pa.Table.from_batches(table)
        shard = Shard(whole_sequences(rows) if first_round else rows.to_pylist(), whole)
        shard.climb()
        done = shard.finished(first_round)
        for lo in range(0, len(done["depth"]), 10_000):
            yield batch(0, done, lo, lo + 10_000)
        if not whole:
            yield batch(1, shard.further(), 0, 2)

    return go


def prefix_trie(turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """turns(conv_id, turn, role, text) -> one row for each distinct beginning of the rebuilt conversations; other columns are not read.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Null roles and
    texts are empty; a null turn comes first; turns with one number stand in the order of the SHA-256 of role and text, and
    repeated rows are turns of their own. Rows without a conv_id belong to no conversation. Without conversations there is no
    root: an empty table gives an empty result. The turn digests of a conversation (16 bytes each, not its texts) are one row.
    """
    spark = turns.sparkSession
    path = F.unhex(F.array_join(F.transform("seq", lambda x: F.hex(x["id"])), ""))
    convs = staged(rebuilt(turns).select("conv_id", path.alias("path"), F.transform("seq", lambda x: x["bytes"]).alias("bytes")), "trie-conversations")
    keys = convs.select(F.unhex(F.sha2("path", 256)).alias("key"), "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    found = keys.mapInArrow(members, "key binary, n long, conv_id long, ends string").select("conv_id", "n", "ends")
    rows = staged(convs.join(found, "conv_id").select("path", "bytes", "n", F.col("conv_id").alias("low"), "ends"), "trie-sequences")
    unstage(convs)
    shape, finished, first_round = ", ".join(f"{k} {SQL_OF[t]}" for k, t in ROUND.items()), [], True
    while True:
        n_rows, nodes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("path")) / DIGEST, F.lit(0))).first()
        # Enough shards to keep the cluster busy, but each round leaves a fourth of the rows at most.
        few = max(-(-int(nodes) // shard), min(spark.sparkContext.defaultParallelism, int(nodes) // 10_000))
        few = max(1, min(few, n_rows // 8))
        dealt = rows.repartitionByRange(few, "path") if few > 1 else rows.coalesce(1)
        done = staged(dealt.sortWithinPartitions("path").mapInArrow(shards(first_round, few == 1), shape), "trie-round")
        unstage(rows)
        finished.append(done.where("level = 0").select(*RESULT, "up", "key"))
        if few == 1:
            break
        rows, first_round = staged(done.where("level = 1").select("path", "bytes", *PARTS, "ends"), "trie-borders"), False
    out = finished[0]
    for more in finished[1:]:
        out = out.union(more)
    parents = out.where("key IS NOT NULL").select(F.col("key").alias("up"), F.col("conv_id").alias("parent"))
    known = out.where("up IS NULL").select(*RESULT)
    asked = out.where("up IS NOT NULL").join(parents, "up").withColumn("parent_conv_id", F.col("parent")).select(*RESULT)
    return known.union(asked)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(conversations(spark, sf_dir))


ORACLE_SQL = f"""
WITH x AS (SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, id, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS p FROM x),
c AS (SELECT conv_id, {crc32_sql("conv_id")} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM x)),
r AS (SELECT c.conv_id, p, id, bytes FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {GROUP} AND p <= h UNION ALL SELECT c.conv_id, p, id, bytes FROM c JOIN t USING (conv_id) WHERE p > h),
s AS (SELECT conv_id, coalesce(string_agg(id, '' ORDER BY p), '') AS path, coalesce(list(bytes ORDER BY p) FILTER (id IS NOT NULL), []) AS bytes FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
d AS (SELECT *, unnest(range(0, len(bytes) + 1)) AS depth FROM s),
n AS (SELECT left(path, 64 * depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(bytes[depth]), 0) AS bytes,
 sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (len(bytes) = depth), '')) AS ends_sha256 FROM d GROUP BY ALL),
k AS (SELECT left(node, length(node) - 64) AS node, count(*) AS kids FROM n WHERE depth > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (node)),
u AS (SELECT left(node, 64 * up) AS node, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM a) GROUP BY ALL)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, b.conv_id AS parent_conv_id, a.n_convs, CAST(a.kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, a.ends_sha256
FROM a JOIN u USING (node) LEFT JOIN a b ON a.depth > 0 AND b.node = left(a.node, length(a.node) - 64)
"""
