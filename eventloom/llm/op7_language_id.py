"""Language ID: multinomial naive Bayes over hashed character n-grams, the log-probability matrix broadcast, numpy scoring."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import documents

#: n-gram lengths, most hash buckets, most cells of the matrix (32 MB), additive smoothing.
GRAMS, BUCKETS, CELLS, SMOOTHING = (1, 2, 3), 1 << 15, 1 << 22, 0.5
BATCH_CHARS = 1 << 20
UNKNOWN = "und"


@lru_cache(1)
def letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def code_points(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts in lower case: (index of the first, code points, offsets). What isn't a letter is a space, and each text ends with one."""
    low = [(t or "").lower() + " " for t in texts]
    i = 0
    while i < len(low):
        j, n = i, 0
        while j < len(low) and (n == 0 or n + len(low[j]) <= BATCH_CHARS):
            n += len(low[j])
            j += 1
        cp = np.frombuffer("".join(low[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield i, np.where(letter_table()[cp], cp, np.uint32(32)), np.concatenate([[0], np.cumsum([len(t) for t in low[i:j]])])
        i = j


def gram_buckets(cp: np.ndarray, offsets: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: bucket of the n-gram that ends at each place, and which count (those of nothing but spaces, or across texts, don't)."""
    h, some = np.zeros(len(cp), np.uint32), np.zeros(len(cp), bool)
    place = np.arange(len(cp)) - np.repeat(offsets[:-1], np.diff(offsets))
    for n in range(1, max(GRAMS) + 1):
        old = np.zeros(len(cp), np.uint32)
        old[n - 1 :] = cp[: len(cp) - n + 1]
        h = h * np.uint32(0x9E3779B1) + old + np.uint32(n)
        some |= old != 32
        if n in GRAMS:
            x = h ^ (h >> np.uint32(15))
            x = x * np.uint32(0x85EBCA6B)
            yield ((x ^ (x >> np.uint32(13))) & np.uint32(buckets - 1)).astype(np.int64), some & (place >= n - 1)


def held_out(doc_id: Column, mod: int, at: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == at


def gram_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """docs(lang, text) -> lang, bucket, n: sums over all rows; each task sends one row for each language and bucket at most."""

    def count(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for rb in batch_iter:
            langs = rb.column(0).to_pylist()
            for i, cp, offsets in code_points(rb.column(1).to_pylist()):
                own = langs[i : i + len(offsets) - 1]
                names = sorted(set(own))
                code = np.repeat([names.index(x) for x in own], np.diff(offsets))
                for b, ok in gram_buckets(cp, offsets, buckets):
                    c = np.bincount(code[ok] * buckets + b[ok], minlength=len(names) * buckets).reshape(-1, buckets)
                    for k, name in enumerate(names):
                        totals[name] = totals.get(name, 0) + c[k]
        for name, c in totals.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities: languages x buckets, and of the languages."""

    def __init__(self, langs: list[str], docs: np.ndarray, counts: np.ndarray):
        self.langs, self.buckets = langs, counts.shape[1]
        smooth = counts + SMOOTHING
        self.table = np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)))
        self.prior = np.log(docs / docs.sum())

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names: list[str] = []
        scores: list[float] = []
        for _, cp, offsets in code_points(texts):
            total = np.tile(self.prior, (len(offsets) - 1, 1))
            for b, ok in gram_buckets(cp, offsets, self.buckets):
                for k, row in enumerate(self.table):
                    total[:, k] += np.add.reduceat(np.where(ok, row[b], 0.0), offsets[:-1])
            letters = np.add.reduceat(cp != 32, offsets[:-1]) > 0
            p = np.exp(total - total.max(1, keepdims=True))
            best = total.argmax(1)
            p = p[np.arange(len(best)), best] / p.sum(1)
            names += [self.langs[k] if a else UNKNOWN for k, a in zip(best, letters, strict=True)]
            scores += np.where(letters, p, 0.0).tolist()
        return names, scores


def fit(docs: DataFrame) -> Model | None:
    """docs(lang, text), null langs left out -> a model, or None if nothing is left. Languages are in order, so ties are too.

    More than CELLS // 256 languages raise a ValueError: the matrix, and so the broadcast, has a bound.
    """
    docs = docs.where("lang is not null")
    n = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().orderBy("lang").limit(CELLS // 256 + 1).collect()}
    if not n:
        return None
    if len(n) > CELLS // 256:
        raise ValueError(f"more than {CELLS // 256} languages")
    langs = sorted(n)
    buckets = min(BUCKETS, 1 << ((CELLS // len(langs)).bit_length() - 1))
    table = gram_counts(docs, buckets).toPandas()  # CELLS rows at most
    counts = np.zeros((len(langs), buckets))
    counts[table["lang"].map(langs.index).to_numpy(np.int64), table["bucket"].to_numpy(np.int64)] = table["n"]
    return Model(langs, np.array([n[x] for x in langs], float), counts)


def predict_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score; other columns are not read, so their names can't clash.

    Null texts and those without a letter are `und` with score 0, and so is every text without a model. Repeated rows are
    judged each; ties go to the first language in order; an empty table gives an empty result.
    """
    shape = "doc_id long, lang_pred string, score double"
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batch_iter:
            for lo in range(0, rb.num_rows, 1000):
                part = rb.slice(lo, 1000)
                names, scores = shared.value.predict(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, shape)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    out = predict_language(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
