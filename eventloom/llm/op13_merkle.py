"""Merkle manifest of a dataset: a ternary hash tree for each source and one over the sources, stored as blocks.

A block is an aligned subtree of HEIGHT levels over BLOCK neighbouring nodes. Its nodes lie in one buffer in van Emde Boas
order: the upper half of the levels first, then each lower subtree, each laid out in the same way. One block's root is a node
of the next level of blocks, so a tree of any size is built in rounds, each with one shuffle of a BLOCK-th of the nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.staging import staged, unstage
from eventloom.llm.common import documents

ARITY, HEIGHT = 3, 6
BLOCK = ARITY**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32


def subtree_size(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


@lru_cache(256)
def addresses(depth: int, levels: int) -> np.ndarray:
    """Places, in van Emde Boas order, of all nodes at a depth of a complete subtree of so many levels."""
    if levels == 1:
        return np.zeros(1, np.int64)
    top = levels // 2
    if depth < top:
        return addresses(depth, top)
    below = addresses(depth - top, levels - top)
    first = subtree_size(top) + np.arange(ARITY**top) * subtree_size(levels - top)
    return (first[:, None] + below).ravel()


def height_of(n: int) -> int:
    """Levels above n nodes of a tree's top block."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def widths(n: int, height: int) -> list[int]:
    """The number of nodes on each level, from n at the bottom up."""
    return [-(-n // ARITY**k) for k in range(height + 1)]


def block_of(digests: list[bytes], height: int) -> bytes:
    """The buffer of the block over these nodes; places without a node are zero."""
    levels = height + 1
    out = np.zeros((subtree_size(levels), DIGEST), np.uint8)
    row = digests
    for k in range(levels):
        if k:
            names = [d.hex() for d in row]
            row = [hashlib.sha256("".join(names[i : i + ARITY]).encode()).digest() for i in range(0, len(names), ARITY)]
        out[addresses(height - k, levels)[: len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, DIGEST)
    return out.tobytes()


class Block:
    """Reads a block's nodes by their addresses."""

    def __init__(self, nodes: bytes, n: int, height: int):
        self.text, self.widths = nodes.hex(), widths(n, height)
        self.at = [addresses(height - k, height + 1)[:w].tolist() for k, w in enumerate(self.widths)]

    def node(self, level: int, i: int) -> str:
        a = self.at[level][i] * 2 * DIGEST
        return self.text[a : a + 2 * DIGEST]

    def siblings(self, i: int) -> list[tuple[str, str]]:
        """For each level from node i of the bottom up: what stands before and after its ancestor in the run of ARITY."""
        out = []
        for level, width in enumerate(self.widths[:-1]):
            first = i - i % ARITY
            left = "".join(self.node(level, j) for j in range(first, i))
            right = "".join(self.node(level, j) for j in range(i + 1, min(first + ARITY, width)))
            out.append((left, right))
            i //= ARITY
        return out


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = hashed(left + leaf + right)
    return leaf


def runs_of(batch_iter: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted rows -> a table for each run of rows that agree in the first so many columns."""
    held = None
    for rb in batch_iter:
        t = pa.Table.from_batches([rb])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for c in t.columns[:keys]:
            c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            codes = c.dictionary_encode(null_encoding="encode")
            codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
            change |= np.diff(codes.indices.to_numpy(zero_copy_only=False)) != 0
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), t.num_rows]
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield t.slice(a, b - a)
        held = t.slice(cuts[-2])
    if held is not None:
        yield held


def built(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tree, block, place, total, digest, key, claim, sorted -> one row for each block."""
    rows: list[tuple] = []
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()))
    names = ["tree", "block", "total", "n", "root", "nodes", "keys", "claims"]

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for t in runs_of(batch_iter, 2):
        total, digests = t["total"][0].as_py(), t["digest"].to_pylist()
        height = HEIGHT if total > BLOCK else height_of(total)
        nodes = block_of(digests, height)
        rows.append((t["tree"][0].as_py(), t["block"][0].as_py(), total, len(digests), nodes[:DIGEST], nodes, t["key"].to_pylist(), t["claim"].to_pylist()))
        if len(rows) >= 64:
            yield batch()
            rows = []
    if rows:
        yield batch()


BUILT = "tree string, block long, total long, n long, root binary, nodes binary, keys array<long>, claims array<binary>"
PATH = "array<struct<left: string, right: string>>"


def height_in(n: int, total: int) -> int:
    return HEIGHT if total > BLOCK else height_of(n)


def paths_down(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tree, block, total, n, nodes, path, subroot -> for each node of the block: tree, place, path, subroot."""
    path_type = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    for rb in batch_iter:
        for tree, block, total, n, nodes, path, subroot in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            b = Block(nodes, n, height_in(n, total))
            paths = [[{"left": x, "right": y} for x, y in b.siblings(i)] + path for i in range(n)]
            cols = [pa.array([tree] * n, pa.string()), pa.array(range(block * BLOCK, block * BLOCK + n), pa.int64()), pa.array(paths, path_type), pa.array([subroot] * n, pa.string())]
            yield pa.record_batch(cols, ["tree", "place", "path", "subroot"])


def proofs_of(root: str):
    """Blocks of leaves with their path -> the proof of each leaf, and its claim folded up to the root."""

    def go(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batch_iter:
            for k in range(rb.num_rows):
                _, _, total, n, nodes, keys, claims, path, subroot = (c[0].as_py() for c in rb.slice(k, 1).columns)
                b, up = Block(nodes, n, height_in(n, total)), [(x["left"], x["right"]) for x in path]
                above = "".join(x + y for x, y in up)
                leaves, proofs, ends = [], [], []
                for i in range(n):
                    near = b.siblings(i)
                    leaf = b.node(0, i)
                    leaves.append(leaf)
                    proofs.append(hashed("".join(x + y for x, y in near) + above))
                    ends.append(folded(folded(claims[i].hex() if claims[i] else leaf, near), up))
                said = [subroot] * n, [root] * n, proofs, ends
                yield pa.record_batch(
                    [pa.array(keys, pa.int64()), pa.array(leaves), *(pa.array(x, pa.string()) for x in said), pa.array([x == root for x in ends])],
                    ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    return go


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_of(text: Column, names: tuple[str, ...] = FIELDS) -> Column:
    """The hash of a row's fields: each its length in bytes, a colon and the value; a null is a dash."""
    cols = [F.col(c).cast("string") if c != "text" else text for c in names]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cols]), 256)


def placed(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, list[DataFrame]]:
    """rows(tree, ...) with place, the number of a row in its tree's order, and total, the tree's rows; also the tables that they are read from.

    All trees are sorted over the cluster by ranges, so a large one spreads over many tasks; a range's rows are numbered where
    they lie, and each range adds the tree's rows in the ranges before it.
    """
    cols = ["tree", *order]
    rows = rows.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id())
    rows = staged(rows, name)
    ranges = rows.groupBy("tree", F.shiftrightunsigned("_at", 33).alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of = W.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(of.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = staged(ranges.select(F.col("tree").alias("_tree"), "_range", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of).alias("total")), f"{name}-ranges")
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.shiftrightunsigned("_at", 33) == F.col("_range"))
    return rows.join(ranges, same).withColumn("place", F.col("_at") + F.col("_shift")).drop("_tree", "_range", "_shift", "_at"), [rows, ranges]


class Forest:
    """Trees over rows(tree, digest, key, claim): tables of blocks, the leaves' first, each the next one's lower level."""

    def __init__(self, rows: DataFrame, order: list[str], name: str):
        nodes, tables = placed(rows, order, f"{name}-leaves")
        self.levels: list[DataFrame] = []
        while True:
            nodes = nodes.withColumn("block", F.expr(f"place div {BLOCK}"))
            nodes = nodes.select("tree", "block", "place", "total", "digest", "key", "claim")
            nodes = nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
            level = staged(nodes.mapInArrow(built, BUILT), f"{name}-blocks")
            self.levels.append(level)
            unstage(*tables)
            tables = []
            up = level.where(F.col("total") > BLOCK)
            if up.isEmpty():
                break
            nothing = F.lit(None)
            nodes = up.select(
                "tree", F.col("block").alias("place"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("root").alias("digest"), nothing.cast("long").alias("key"), nothing.cast("binary").alias("claim"),
            )

    def roots(self) -> DataFrame:
        """tree, digest of each tree's root."""
        tops = [x.where(F.col("total") <= BLOCK).select("tree", F.col("root").alias("digest")) for x in self.levels]
        out = tops[0]
        for t in tops[1:]:
            out = out.union(t)
        return out

    def with_paths(self, tops: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame]]:
        """The lowest level's blocks, each with its path from its root up; tops(tree, path, subroot) holds the paths of the trees' roots."""
        above, tables = None, []
        for k, level in reversed(list(enumerate(self.levels))):
            top = level.where(F.col("total") <= BLOCK)
            of_tree = tops.select(F.col("tree").alias("_tree"), "path", "subroot")
            rows = top.join(of_tree, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
            if above is not None:
                up = above.select(F.col("tree").alias("_tree"), F.col("place").alias("_block"), "path", "subroot")
                inner = level.where(F.col("total") > BLOCK).join(up, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))).drop("_tree", "_block")
                rows = rows.unionByName(inner)
            if k:
                few = rows.select("tree", "block", "total", "n", "nodes", "path", "subroot")
                above = staged(few.mapInArrow(paths_down, f"tree string, place long, path {PATH}, subroot string"), f"{name}-paths")
                tables.append(above)
        return rows, tables


def merkle(docs: DataFrame, delivered: Column | None = None) -> DataFrame:
    """docs(doc_id, source, lang, n_chars, text) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    delivered is each row's text as it is to be verified against the manifest of docs (default: the text itself, so all
    rows are verified). Null fields hash as a dash, so null and empty differ. Rows with one doc_id and source are ordered by
    their leaf; equal rows are leaves of their own. A null doc_id comes first. Other columns are not read, so their names
    can't clash. An empty table has no root and gives an empty result.
    """
    changed = F.col("text") if delivered is None else delivered
    docs = docs.select("doc_id", "source", "lang", "n_chars", "text", changed.alias("_delivered"))
    same = F.col("_delivered").eqNullSafe(F.col("text"))
    leaves = docs.select(
        F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("key"), F.unhex(leaf_of(F.col("text"))).alias("digest"),
        F.when(~same, F.unhex(leaf_of(F.col("_delivered")))).alias("claim"),
    )
    # Equal rows are told apart by their place in this table, so that even very many of them are dealt over ranges.
    leaves = staged(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-rows")
    sources = Forest(leaves, ["key", "digest", "row"], "merkle")
    unstage(leaves)
    # One tree over the sources: its leaves are their roots, numbered in the sources' order.
    subroots = sources.roots().select(F.lit("").alias("tree"), "digest", F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("claim"), F.col("tree").alias("source"))
    subroots = staged(subroots, "merkle-subroots")
    whole = Forest(subroots.select("tree", "digest", "key", "claim", "source"), ["source"], "merkle-top")
    root = whole.roots().first()
    root = root["digest"].hex() if root else ""
    one = docs.sparkSession.createDataFrame([("", [], "")], f"tree string, path {PATH}, subroot string")
    few, tables = whole.with_paths(one, "merkle-top")
    each = staged(few.select("tree", "block", "total", "n", "nodes", "path", "subroot").mapInArrow(paths_down, f"tree string, place long, path {PATH}, subroot string"), "merkle-top-paths")
    numbered, more = placed(subroots, ["source"], "merkle-sources")
    tops = numbered.select(F.col("source").alias("tree"), "place", F.lower(F.hex("digest")).alias("subroot")).join(each.select("place", "path"), "place")
    tops = staged(tops.select("tree", "path", "subroot"), "merkle-tops")
    unstage(subroots, each, *tables, *more, *whole.levels)
    blocks, _ = sources.with_paths(tops, "merkle")
    blocks = blocks.select("tree", "block", "total", "n", "nodes", "keys", "claims", "path", "subroot")
    return blocks.mapInArrow(proofs_of(root), PROOFS)


def tampered() -> Column:
    """A test of the manifest: of every document whose doc_id has an even CRC-32 the line breaks are gone."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle(documents(spark, sf_dir), tampered())


#: CRC-32 of a text x in SQL, bit by bit over its ASCII bytes.
CRC32_SQL = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(x, ''), lambda c: ascii(c)::BIGINT)), "
    "lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"
)


def crc32_sql(column: str) -> str:
    return CRC32_SQL.replace("(x,", f"(CAST({column} AS VARCHAR),")


def _field(c: str, value: str = "") -> str:
    v = value or f"CAST({c} AS VARCHAR)"
    return f"coalesce(strlen({v}) || ':' || {v}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([*(_field(c) for c in FIELDS[:-1]), _field("", text)]) + ")"


ORACLE_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {crc32_sql("doc_id")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS claim FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS total FROM l),
n AS (SELECT source, 0 AS lvl, place, leaf AS h, total FROM p
 UNION ALL SELECT source, lvl + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (any_value(total) + 2) // 3 FROM n WHERE total > 1 GROUP BY source, lvl, place // 3),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM n WHERE total = 1),
m AS (SELECT 0 AS lvl, place, subroot AS h, total FROM s
 UNION ALL SELECT lvl + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (any_value(total) + 2) // 3 FROM m WHERE total > 1 GROUP BY lvl, place // 3),
r AS (SELECT h AS root FROM m WHERE total = 1),
up AS (SELECT p.doc_id, p.leaf, 0 AS part, n.lvl, p.place // CAST(pow(3, n.lvl) AS BIGINT) AS me, n.place AS other, n.h FROM p JOIN n ON n.source IS NOT DISTINCT FROM p.source AND n.total > 1
  AND n.place // 3 = p.place // CAST(pow(3, n.lvl + 1) AS BIGINT)
 UNION ALL SELECT p.doc_id, p.leaf, 1, m.lvl, s.place // CAST(pow(3, m.lvl) AS BIGINT), m.place, m.h FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN m ON m.total > 1 AND m.place // 3 = s.place // CAST(pow(3, m.lvl + 1) AS BIGINT)),
run AS (SELECT doc_id, leaf, part, lvl, coalesce(string_agg(h, '' ORDER BY other) FILTER (other < me), '') AS a, coalesce(string_agg(h, '' ORDER BY other) FILTER (other > me), '') AS b FROM up GROUP BY doc_id, leaf, part, lvl),
path AS (SELECT doc_id, leaf, string_agg(a || b, '' ORDER BY part, lvl) AS proof, list(a || '|' || b ORDER BY part, lvl) AS steps FROM run GROUP BY doc_id, leaf),
f AS (SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(proof, '')) AS proof_sha256,
 list_reduce(list_concat([p.claim], coalesce(steps, [])), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
 FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source CROSS JOIN r LEFT JOIN path ON path.doc_id IS NOT DISTINCT FROM p.doc_id AND path.leaf = p.leaf)
SELECT *, folded_root = root AS verified FROM f
"""
