"""Toxicity: noisy-channel deobfuscation by Viterbi under a character language model, then a score of the restored text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import documents, staged, unstage
from eventloom.llm.op7_language_id import BATCH_CHARS, code_points, held_out
from eventloom.llm.textops import batches, mix, prefix_hash

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
#: Costs (negative log-probabilities) of the channel: a sign for a letter, one more of a letter that stands three times or
#: more, a sign put between, a space put between, a space that is none of the channel's.
SIGN, AGAIN, BETWEEN, SPACED, KEPT = 1.0, 0.3, 0.7, 0.2, 3.0
#: Language model: letters a-z, all other letters as one, and a space; trigrams, added counts.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SYMBOLS, SMOOTH = 28, 0.1
#: Longest span whose result is kept for the next time.
SEEN = 64
#: Bound of the classifier's training rows; cells of its hash space, which bound its table at any input size; prefixes'
#: lengths; least documents of a feature, least z, and least ratio of its shares in toxic and clean texts, for the z of any
#: slightly commoner word grows with the table.
SAMPLE, CELLS, PREFIX, LEAST, TELLS, RATIO = 20_000, 1 << 22, (4, 5, 6), 3, 2.5, 2.0

#: Bytes that can be part of a word.
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True
#: Kinds of characters: what ends a token, spaces, signs put between, signs for letters, other digits, digits for letters, letters.
BREAK, SPACE, JOINER, SIGNS, DIGIT, FIGURE, PLAIN = range(7)
BREAKS, APART = ",;:?\"()[]{}<>", "\naa\n"


@lru_cache(1)
def kinds() -> np.ndarray:
    """Kind of each code point."""
    alnum = lambda x: FIGURE if x in LEET else PLAIN if x.isalpha() else DIGIT
    other = lambda x: SIGNS if x in LEET else SPACE if x.isspace() else BREAK if x in BREAKS else JOINER
    return np.array([(alnum if x.isalnum() else other)(x) for x in map(chr, range(0x110000))], np.uint8)


def spans(cp: np.ndarray) -> list[tuple[int, int]]:
    """Places (start, end) of all that the channel can have made, in order: what Channel.decode is for.

    Tokens that hold a letter and a sign for a letter, a sign between or a letter three times in a row; and three or more
    letters or signs for letters, one of them a letter, that stand alone, whatever stands between.
    """
    n = len(cp)
    kind = kinds()[cp]
    letters = np.concatenate([[0], np.cumsum(kind == PLAIN)])
    # Tokens, without signs at their ends that stand for no letter.
    odd = (kind == JOINER) | (kind == SIGNS) | (kind == FIGURE)
    odd[2:] |= (cp[2:] == cp[1:-1]) & (cp[2:] == cp[:-2]) & (kind[2:] == PLAIN)
    ends = np.flatnonzero(kind <= SPACE)
    token = np.unique(np.searchsorted(ends, np.flatnonzero(odd)))
    a, b = np.concatenate([[0], ends + 1])[token], np.concatenate([ends, [n]])[token]
    firm = np.flatnonzero(kind > JOINER)
    i, j = np.searchsorted(firm, a), np.searchsorted(firm, b)
    i, j = i[i < j], j[i < j]
    a, b = firm[i], firm[j - 1] + 1
    odds = np.concatenate([[0], np.cumsum(odd)])
    use = (letters[a] < letters[b]) & (odds[a] < odds[b])
    # Runs of characters that stand alone. A sign beside a letter or digit may be one of those put between.
    word, sign = (np.concatenate([[False], x, [False]]) for x in (kind >= DIGIT, kind == SIGNS))
    lone = sign[1:-1] & ~word[:-2] & ~word[2:] & ~sign[:-2]
    units = np.flatnonzero(lone | word[1:-1] & ~word[:-2])
    alone = lone[units] | ~word[units + 2] & (kind[units] != DIGIT)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], alone, [False]])))
    lo, hi = edge[::2], edge[1::2]
    ra, rb = units[lo[hi - lo >= 3]], units[hi[hi - lo >= 3] - 1] + 1
    keep = letters[ra] < letters[rb]
    a, b = np.concatenate([a[use], ra[keep]]), np.concatenate([b[use], rb[keep]])
    out: list[tuple[int, int]] = []
    for x, y in sorted(zip(a.tolist(), b.tolist(), strict=True)):
        if out and x < out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def symbol(c: str) -> int:
    i = ord(c) - 97
    return i if 0 <= i < 26 else 26 if c.isalpha() else 27


def trigram_counts(docs: DataFrame) -> DataFrame:
    """Counts of symbol trigrams over all texts: trigram, n. Each task sends SYMBOLS**3 rows at most."""

    def count(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for rb in batch_iter:
            for lo in range(0, rb.num_rows, 1000):
                for _, cp, _ in code_points(rb.column(0).slice(lo, 1000).to_pylist()):
                    s = np.where(cp == 32, 27, np.where((cp >= 97) & (cp < 123), cp - 97, 26)).astype(np.int64)
                    total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["trigram", "n"])

    return docs.select("text").mapInArrow(count, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


class Channel:
    """Restores obfuscated spans: the cheapest path through a lattice of letters, by channel and language-model costs."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + SMOOTH
        self.cost = (-np.log(c / c.sum(2, keepdims=True))).tolist()
        self.seen: dict[str, str] = {}

    def decode(self, span: str) -> str:
        if len(span) > SEEN:
            return self.cheapest(span)
        if span not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[span] = self.cheapest(span)
        return self.seen[span]

    def cheapest(self, span: str) -> str:
        # last two symbols -> cost, and the text as (text before, letter): exact, and linear in the span's length
        start = symbol(" ")
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(start, start): (0.0, None)}
        before = ""
        for i, c in enumerate(span + " "):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            last = i == len(span)  # the word's end, which no path passes by
            if c.isalpha() or c.isspace():
                options = [(c, KEPT if c.isspace() and not last else 0.0)]
            else:
                options = [(x, SIGN) for x in LEET.get(c, "")] + [(" ", KEPT)] * (not c.isalnum())
            run = c == before and (span[i - 2 : i - 1] == c and i > 1 or span[i + 1 : i + 2] == c)
            skip = None if last else AGAIN if run else SPACED if c.isspace() else BETWEEN if not c.isalnum() else None
            for (a, b), (cost, text) in paths.items():
                for x, extra in options:
                    s = symbol(x)
                    if s == 27 == b:
                        if last and cost < new.get((a, b), (math.inf,))[0]:
                            new[a, b] = (cost, text)
                        continue
                    total = cost + extra + self.cost[a][b][s]
                    if total < new.get((b, s), (math.inf,))[0]:
                        new[b, s] = (total, (text, x))
                if skip is not None and cost + skip < new.get((a, b), (math.inf,))[0]:
                    new[a, b] = (cost + skip, text)
            if new:
                paths = new
            before = c
        text, letters = min(paths.values(), key=lambda x: x[0])[1], []
        while text is not None:
            text, x = text
            letters.append(x)
        return "".join(reversed(letters)).strip()

    def restore(self, text: str) -> str:
        """The text in lower case, each obfuscated span replaced."""
        return restored(self, [text])[0]


def restored(channel: Channel, texts: list[str | None]) -> list[str]:
    """Each text in lower case, its spans() decoded. Null is empty."""
    low = [(t or "").lower() for t in texts]
    out: list[str] = []
    while len(out) < len(low):
        at = [0]  # so many texts as fill a batch, with a word between that no span holds
        for t in low[len(out) :]:
            if at[-1] and at[-1] + len(t) > BATCH_CHARS:
                break
            at.append(at[-1] + len(t) + len(APART))
        part = low[len(out) : len(out) + len(at) - 1]
        found = spans(np.frombuffer(APART.join(part).encode("utf-32-le", "surrogatepass"), np.uint32))
        cut = np.searchsorted(np.array([a for a, _ in found], np.int64), at)
        for k, t in enumerate(part):
            pieces, done = [], 0
            for a, b in found[cut[k] : cut[k + 1]]:
                a, b = a - at[k], b - at[k]
                pieces += [t[done:a], channel.decode(t[a:b])]
                done = b
            out.append("".join([*pieces, t[done:]]) if pieces else t)
    return out


def feature_batches(channel: Channel, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Feature cells of the restored texts' words and word beginnings: (bytes, starts, first word of each text, words' ends, cells by length)."""
    for _, data, offsets in batches(pa.array(restored(channel, texts), pa.large_string())):
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = LETTER[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        p, down = prefix_hash(data)
        rows = []
        for n in (0, *PREFIX):  # a beginning of a shorter word is the word itself
            to = ends if n == 0 else np.minimum(starts + n, ends)
            rows.append(mix((p[to] - p[starts]) * down[starts] + (to - starts).astype(np.uint64) + np.uint64(n * 1009)))
        yield data, starts, np.searchsorted(starts, offsets), ends, (np.stack(rows) & np.uint64(CELLS - 1)).astype(np.int64)


class Classifier:
    """A logistic model over words and word beginnings, known by their cells of the hash space."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(names)
        self.names, self.weights, self.bias = names[order], weights[order], bias
        self.known = np.zeros(CELLS, bool)
        self.known[names] = True

    def hits(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where cells has a feature, and which."""
        at = np.flatnonzero(self.known[cells])
        return at, np.searchsorted(self.names, cells[at])

    def score(self, channel: Channel, texts: list[str | None]) -> tuple[list[float], list[list[str]]]:
        """Scores, and the restored words that tell."""
        scores: list[float] = []
        tell: list[list[str]] = []
        for data, starts, first, ends, hashes in feature_batches(channel, texts):
            n = len(first) - 1
            word, feature = (np.concatenate(x) for x in zip(*[self.hits(h) for h in hashes], strict=True))
            text = np.searchsorted(first, word, "right") - 1
            pairs = np.unique(text * max(1, len(self.names)) + feature)
            total = self.bias + np.bincount(pairs // max(1, len(self.names)), self.weights[pairs % max(1, len(self.names))], n)
            scores += (1 / (1 + np.exp(-np.clip(total, -50, 50)))).tolist()
            words: list[set[str]] = [set() for _ in range(n)]
            for t, w in zip(text.tolist(), word.tolist(), strict=True):
                words[t].add(data[starts[w] : ends[w]].tobytes().decode(errors="replace"))
            tell += [sorted(x) for x in words]
        return scores, tell


def weights_of(f: np.ndarray, sizes: np.ndarray, y: np.ndarray, n: int, bias: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model, by accelerated gradient steps, over sparse rows: their features (of n) one after the other, and how many each has."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    parts = [(lo, min(lo + 1000, len(y))) for lo in range(0, len(y), 1000)]
    cut = lambda lo, hi: f[first[lo] : first[hi]]
    dot = lambda w: np.concatenate([np.bincount(np.repeat(np.arange(hi - lo), sizes[lo:hi]), w[cut(lo, hi)], hi - lo) for lo, hi in parts])
    back = lambda g: sum(np.bincount(cut(lo, hi), np.repeat(g[lo:hi], sizes[lo:hi]), n) for lo, hi in parts)
    scale = np.bincount(f, minlength=n) + 1.0
    v, top = np.ones(n), 1.0
    for _ in range(20):  # the largest curvature of the scaled problem
        v = back(dot(v)) / scale
        top = float(np.abs(v).max(initial=0.0)) or 1.0
        v /= top
    step = 1 / (0.25 * 1.1 * max(top, 1.0) + 0.1)
    w, old, b = np.zeros(n), np.zeros(n), bias
    for i in range(200):
        ahead = w + i / (i + 3) * (w - old)
        g = 1 / (1 + np.exp(-np.clip(dot(ahead) + b, -30, 30))) - y
        old, w = w, ahead - step * (back(g) + 0.1 * ahead) / scale
        b -= float(g.mean())
    return w, b


def labelled_features(docs: DataFrame, labels: DataFrame, channel: Channel) -> DataFrame:
    """h (a hash of doc_id), toxic, f (cells as 32-bit numbers) of each labelled text.

    The labels may be of any number, so texts meet them in a shuffle; that is done once, and features are staged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(channel)

    def extract(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batch_iter:
            at = 0
            for _, _, first, _, cells in feature_batches(shared.value, rb.column(1).to_pylist()):
                f = [np.unique(cells[:, a:b]).astype(np.int32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.record_batch([rb.column(0).slice(at, len(f)), rb.column(2).slice(at, len(f)), pa.array(f, pa.binary())], ["h", "toxic", "f"])
                at += len(f)

    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", "text").join(known.hint("merge"), "doc_id").select(F.xxhash64("doc_id").alias("h"), "text", "toxic")
    return staged(rows.mapInArrow(extract, "h long, toxic int, f binary"), "toxicity-features")


def tally(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, toxic, f -> cell, toxic and clean texts with it; a row for each cell of a batch."""
    for rb in batch_iter:
        toxic, f = np.array(rb.column(1).to_pylist(), bool), rb.column(2).to_pylist()
        both = [np.unique(np.frombuffer(b"".join(x for x, y in zip(f, toxic, strict=True) if y == k), np.int32), return_counts=True) for k in (True, False)]
        cells = np.union1d(both[0][0], both[1][0])
        counts = np.zeros((2, len(cells)), np.int64)
        for k, (c, n) in enumerate(both):
            counts[k, np.searchsorted(cells, c)] = n
        yield pa.record_batch([pa.array(cells.astype(np.int64)), pa.array(counts[0]), pa.array(counts[1])], ["f", "a", "b"])


def fit(docs: DataFrame, labels: DataFrame, channel: Channel) -> Classifier:
    """docs(doc_id, text), labels(doc_id, toxic) -> a classifier.

    Features are cells of a hash space of CELLS, counted over all labelled documents; all that tell (by TELLS and RATIO) are kept.
    Their weights come from SAMPLE labelled rows at most, the first by a hash of doc_id. Labels other than 0 and 1, null
    among them, are left out; a doc_id with both counts as toxic; null and empty texts are rows without features; repeated
    rows of docs count each. Without labels, or with one kind alone, all texts get the same score.
    """
    spark, rows = docs.sparkSession, labelled_features(docs, labels, channel)
    n1, n0 = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    none = np.zeros(0, np.int64)
    if not n1 or not n0:
        unstage(rows)
        return Classifier(none, np.zeros(0), 0.0 if n1 == n0 else 4.0 if n1 else -4.0)
    counts = rows.mapInArrow(tally, "f long, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") >= LEAST)
    p, q = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    z = F.ln(p / q) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    names = np.sort(counts.where(F.col("a") > 0).where((z > TELLS) & (p / q >= RATIO)).select("f").toPandas()["f"].to_numpy(np.int64))  # CELLS rows at most
    if not len(names):
        unstage(rows)
        return Classifier(none, np.zeros(0), math.log(n1 / n0))
    known = np.full(CELLS, -1, np.int32)
    known[names] = np.arange(len(names))
    shared = spark.sparkContext.broadcast(known)

    def numbered(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batch_iter:
            numbers = [shared.value[np.frombuffer(x, np.int32)] for x in rb.column(2).to_pylist()]
            yield pa.record_batch([rb.column(1), pa.array([k[k >= 0].tobytes() for k in numbers], pa.binary())], ["toxic", "f"])

    # The first SAMPLE hashes; as hashes are even, a fifth more than that stand below a bound known beforehand.
    near = rows
    if SAMPLE < n1 + n0:
        near = rows if SAMPLE * 1.2 >= n1 + n0 else rows.where(F.col("h") < int(-(2**63) + 1.2 * SAMPLE / (n1 + n0) * 2**64))
        near = near.where(F.col("h") <= near.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0])
    few = near.mapInArrow(numbered, "toxic int, f binary").toArrow().combine_chunks()  # SAMPLE rows
    f = few["f"].combine_chunks()
    sizes = np.array([len(x.as_buffer()) // 4 for x in f], np.int64)
    flat = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in f]) if len(f) else np.zeros(0, np.int32)
    w, b = weights_of(flat, sizes, few["toxic"].to_numpy().astype(np.float64), len(names), math.log(n1 / n0))
    unstage(rows)
    return Classifier(names, w, b)


def score_toxicity(docs: DataFrame, channel: Channel, classifier: Classifier) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score (0 to 1), restored: the words that tell, as restored.

    Null and empty texts get the score of a text without any such word. Repeated rows are scored each; other columns are not
    read, so their names can't clash; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((channel, classifier))

    def score(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, classifier = shared.value
        for rb in batch_iter:
            for lo in range(0, rb.num_rows, 500):
                part = rb.slice(lo, 500)
                scores, tell = classifier.score(channel, part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(scores, pa.float64()), pa.array(tell, pa.list_(pa.string()))], ["doc_id", "score", "restored"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, restored array<string>")


def language_model(docs: DataFrame) -> Channel:
    counts = np.zeros(SYMBOLS**3)
    table = trigram_counts(docs).toPandas()  # SYMBOLS**3 rows at most
    counts[table["trigram"].to_numpy(np.int64)] = table["n"]
    return Channel(counts)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 5, 0))
    channel = language_model(docs)
    out = score_toxicity(docs, channel, fit(docs, labels, channel))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
