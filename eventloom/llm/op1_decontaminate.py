"""Benchmark decontamination: block-max WAND over a BM25 index of test items, then question and answer overlap."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import documents, staged
from eventloom.llm.textops import LOWER, batches, mix, prefix_hash

K1, B = 0.9, 0.4
#: A passage is a run of PASSAGE words or of two longest items, whichever is more; runs start at each half.
PASSAGE = 128
#: Least score of a passage, as a share of what the item's own text scores; least overlaps.
SCORE, QUESTION, ANSWER = 0.6, 0.5, 0.5
#: Share of an item's score that its most common words may carry without being looked up for candidates.
COMMON = 0.3
BLOCK = 16
#: Bounds of one broadcast index; a larger benchmark is searched shard by shard.
SHARD_ITEMS, SHARD_CHARS = 50_000, 20_000_000

#: Words are runs of letters and digits; bytes of other alphabets count as letters.
LETTERS = np.zeros(258, bool)
LETTERS[128:256] = True
for _a, _b in (("a", "z"), ("A", "Z"), ("0", "9")):
    LETTERS[ord(_a) : ord(_b) + 1] = True


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-case words, and each text's first word."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = LETTERS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    p, down = prefix_hash(LOWER[data])
    return mix((p[ends] - p[starts]) * down[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


@dataclass
class Statistics:
    """Of all items, whatever their shard: number, mean and most words, documents of each word (of one shard's, at least)."""

    n: int
    mean: float
    longest: int
    df: dict[int, int]


class Index:
    """Inverted index of items. Impacts are BM25 weights as shares of the item's own score, so one threshold suits all items."""

    def __init__(self, items: list[tuple[int, str]], of_all: Statistics | None = None):
        items = sorted(items, key=lambda x: x[0])
        self.ids = [i for i, _ in items]
        self.words: list[list[int]] = []
        for _, data, offsets in batches(pa.array([t for _, t in items], pa.large_string())):
            h, first = hashed_words(data, offsets)
            self.words += [h[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        counts = [defaultdict(int) for _ in items]
        here: dict[int, int] = defaultdict(int)
        for c, ws in zip(counts, self.words, strict=True):
            for w in ws:
                c[w] += 1
            for w in c:
                here[w] += 1
        if of_all is None:
            of_all = Statistics(len(items), sum(map(len, self.words)) / max(1, len(items)), max(map(len, self.words), default=1), here)
        df, mean = of_all.df, max(1.0, of_all.mean)
        idf = {w: math.log(1 + (of_all.n - df[w] + 0.5) / (df[w] + 0.5)) for w in here}
        self.postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        lookup: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.rest = np.zeros(len(items))
        for d, c in enumerate(counts):
            weight = {w: idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(self.words[d]) / mean)) for w, tf in c.items()}
            own = sum(weight.values())
            for w in sorted(weight, key=lambda w: (-df[w], w)):
                share = weight[w] / own
                self.postings[w].append((d, share))
                if self.rest[d] + share <= COMMON:
                    self.rest[d] += share
                else:
                    lookup[w].append((d, share))
        # Blocks of postings: last item, largest impact.
        self.blocks = {w: [(p[min(i + BLOCK, len(p)) - 1][0], max(x for _, x in p[i : i + BLOCK])) for i in range(0, len(p), BLOCK)] for w, p in self.postings.items()}
        self.terms = np.array(sorted(lookup), np.uint64)
        flat = [x for w in self.terms.tolist() for x in lookup[w]]
        self.start = np.concatenate([[0], np.cumsum([len(lookup[w]) for w in self.terms.tolist()])]).astype(np.int64)
        self.item = np.array([d for d, _ in flat], np.int64)
        self.share = np.array([x for _, x in flat])
        self.width = max(PASSAGE, 2 * of_all.longest)

    def wand(self, passage: list[int], least: float = SCORE) -> list[tuple[int, float]]:
        """All items that the passage's words score at least so high, by block-max WAND."""
        lists = [(self.postings[w], self.blocks[w], max(b for _, b in self.blocks[w])) for w in set(passage) if w in self.blocks]
        at = [0] * len(lists)
        found, eps = [], 1e-9
        while True:
            live = sorted((lists[k][0][at[k]][0], k) for k in range(len(lists)) if at[k] < len(lists[k][0]))
            bound, pivot = 0.0, None
            for place, (d, k) in enumerate(live):
                bound += lists[k][2]
                if bound >= least - eps:
                    pivot = d
                    break
            if pivot is None:
                return found
            while place + 1 < len(live) and live[place + 1][0] == pivot:
                place += 1
            near, nexts = 0.0, [live[place + 1][0]] if place + 1 < len(live) else []
            for _, k in live[: place + 1]:
                blocks, b = lists[k][1], at[k] // BLOCK
                while b < len(blocks) and blocks[b][0] < pivot:
                    b += 1
                if b < len(blocks):
                    near += blocks[b][1]
                    nexts.append(blocks[b][0] + 1)
            if near < least - eps:
                to = max(min(nexts, default=pivot + 1), pivot + 1)  # no item before this can reach the threshold
            else:
                score = sum(p[at[k]][1] for k, p in ((k, lists[k][0]) for _, k in live[: place + 1]) if p[at[k]][0] == pivot) if live[0][0] == pivot else None
                if score is None:
                    to = pivot
                else:
                    if score >= least - eps:
                        found.append((pivot, score))
                    to = pivot + 1
            for _, k in live[: place + 1]:
                p = lists[k][0]
                while at[k] < len(p) and p[at[k]][0] < to:
                    at[k] += 1

    def overlaps(self, item: int, passage: list[int]) -> tuple[float, float]:
        """Shares of the question's five-word and of the answer's two-word shingles that the passage has.

        An item's last third of words is its answer.
        """
        ws = self.words[item]
        cut = len(ws) - len(ws) // 3
        out = []
        for part, k in ((ws[:cut], 5), (ws[cut:] or ws, 2)):
            k = min(k, len(part))
            have = {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)}
            want = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}
            out.append(len(want & have) / len(want))
        return out[0], out[1]

    def candidates(self, hashes: np.ndarray, passage_of: np.ndarray) -> np.ndarray:
        """Passages in which some item's bound reaches the threshold: the rarer words' impacts, and all of the common ones'."""
        t = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[t] == hashes)
        seen = np.unique(passage_of[hit] * len(self.terms) + t[hit])
        p, t = seen // len(self.terms), seen % len(self.terms)
        n = self.start[t + 1] - self.start[t]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[t], n)
        keys, inverse = np.unique(np.repeat(p, n) * len(self.ids) + self.item[at], return_inverse=True)
        total = np.bincount(inverse, self.share[at], len(keys)) + self.rest[keys % len(self.ids)]
        return np.unique(keys[total >= SCORE - 1e-9] // len(self.ids))

    def search(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, float, float, float]]:
        """(text, item, first word of the passage, score, overlaps) for each text and item that pass, by the best passage."""
        half = self.width // 2
        for lo in range(0, len(hashes), 1 << 18):  # by the words' place: a long text is not held as a whole
            hi = min(len(hashes), lo + (1 << 18) + self.width)
            text = np.searchsorted(first, np.arange(lo, hi), "right") - 1
            unit = (np.arange(lo, hi) - first[text]) // half
            # A word is in the passage that starts at its half and in the one before.
            code = np.cumsum((np.diff(text, prepend=text[:1]) != 0) | (np.diff(unit, prepend=unit[:1]) != 0))
            start = np.flatnonzero(np.diff(code, prepend=-1)) + lo
            for c in self.candidates(np.concatenate([hashes[lo:hi]] * 2), np.concatenate([code, code - 1])):
                if c < 0:
                    continue
                a = int(start[c])
                d = int(text[a - lo])
                if a >= lo + (1 << 18) and hi < len(hashes):
                    continue
                a = int(first[d] + (a - first[d]) // half * half)
                passage = hashes[a : min(a + self.width, first[d + 1])].tolist()
                for item, score in self.wand(passage):
                    q, x = self.overlaps(item, passage)
                    if q >= QUESTION and x >= ANSWER:
                        yield d, item, int(a - first[d]), score, q, x


def words_of(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, text -> shard's key, words."""
    for rb in batch_iter:
        for i, data, offsets in batches(rb.column(1)):
            h, first = hashed_words(data, offsets)
            words = [h[a:b].view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.record_batch([rb.column(0).slice(i, len(words)), pa.array(words, pa.list_(pa.int64()))], ["shard", "words"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, passage, score, question_overlap, answer_overlap.

    One row for each document and item whose best passage scores SCORE or more and holds both the question and the answer.
    Null and empty texts and items match nothing; ties go to the first passage; repeated documents get rows each,
    repeated items too; other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_ITEMS), -(-chars // SHARD_CHARS))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    # Counts are those of all items, so that scores don't depend on the shards.
    words = staged(items.select("shard", "text").mapInArrow(words_of, "shard long, words array<long>"), "item-words")
    mean, longest = words.agg(F.coalesce(F.avg(F.size("words")), F.lit(0.0)), F.coalesce(F.max(F.size("words")), F.lit(1))).first()
    df = words.select("shard", F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("df"), F.collect_set("shard").alias("shards"))
    df = staged(df, "item-counts")
    shape = "doc_id long, item_id long, passage long, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], shape)
    for s in range(shards):
        rows = items.where(F.col("shard") == s).select("item_id", "text").collect()  # bounded by the shards' number
        counts = df.where(F.array_contains("shards", F.lit(s).cast("long"))).select("w", "df").toPandas()  # this shard's words
        counts = dict(zip(counts["w"].to_numpy(np.int64).view(np.uint64).tolist(), counts["df"].tolist(), strict=True))
        index = Index([(r[0], r[1]) for r in rows], Statistics(n, mean, longest, counts))
        keep = [k for k, w in enumerate(index.words) if w]
        if not keep:
            continue
        shared = spark.sparkContext.broadcast(index)

        def find(batch_iter: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for rb in batch_iter:
                ids = rb.column(0)
                for i, data, offsets in batches(rb.column(1)):
                    hashes, first = hashed_words(data, offsets)
                    best: dict[tuple[int, int], tuple] = {}
                    for d, item, at, score, q, x in index.search(hashes, first):
                        if (d, item) not in best or (score, -at) > (best[d, item][1], -best[d, item][0]):
                            best[d, item] = (at, score, q, x)
                    if best:
                        rows = [(ids[i + d].as_py(), index.ids[item], *v) for (d, item), v in best.items()]
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"])

        out = out.union(docs.select("doc_id", "text").mapInArrow(find, shape))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a test item; all columns stay."""
    # As a table of its own its size is known: Spark broadcasts it if it is small, else it shuffles.
    bad = staged(leaks(docs, benchmark).select(F.col("doc_id").alias("_leaked")).distinct(), "leaked")
    return docs.join(bad, F.col("doc_id") == F.col("_leaked"), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
