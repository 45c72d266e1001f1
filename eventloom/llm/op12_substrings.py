"""Substring dedup by seed and extend: documents meet on winnowed anchors, and matches are extended both ways.

Of each WINDOW consecutive words the run of SEED words with the smallest hash is the anchor, so equal windows have equal
anchors at equal places. Documents that share an anchor are joined on it. All of an anchor's occurrences are extended at once:
those that agree over j words to the left and the rest of a window to the right are one class, known by a digest of its
words, and its earliest document is the one that the others repeat. The furthest classes to the left and right that an
earlier document is in are the maximal match around this anchor; those of neighbouring anchors are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.staging import staged, unstage
from eventloom.llm.common import documents
from eventloom.llm.op2_suffix_array import sliding_min
from eventloom.llm.textops import BASE, POWERS, batches, mix, word_hashes, word_spans

WINDOW, SEED = 50, 16
WIDTH = WINDOW - SEED + 1
#: Anchors that stand in more different surroundings than this are extended by the whole cluster instead of one task.
GROUP = 20_000
PLACE_BITS = np.uint64(24)
#: Words looked at together: their places must fit PLACE_BITS.
PIECE = 1 << 22
#: A null doc_id counts as the smallest.
NULL_ID = -(1 << 63)


def anchors(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' words: places and seed hashes of the anchors, and for each the first and last start of the windows that chose it.

    first holds the place of each text's first word, and the end. A text of fewer words than a window has none.
    """
    parts: list[list[np.ndarray]] = [[], [], [], []]
    mask = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    for base in range(0, max(len(hashes) - WINDOW + 1, 0), PIECE):
        h = hashes[base : base + PIECE + WINDOW - 1]
        seed = np.zeros(len(h) - SEED + 1, np.uint64)
        for j in range(SEED):
            seed = seed * np.uint64(BASE) + h[j : j + len(seed)]
        seed = mix(seed)
        chosen = sliding_min((seed & ~mask) | np.arange(len(seed), dtype=np.uint64), WIDTH) & mask
        start = np.arange(len(chosen))
        # Windows that reach into the next text are none.
        text = np.searchsorted(first, start + base, "right")
        ok = first[np.minimum(text, len(first) - 1)] >= start + base + WINDOW
        start, chosen, text = start[ok], chosen[ok].astype(np.int64), text[ok]
        if not len(start):
            continue
        new = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        last = np.append(new[1:], len(start)) - 1
        for out, x in zip(parts, (chosen[new] + base, seed[chosen[new]], start[new] + base, start[last] + base), strict=True):
            out.append(x)
    kinds = (np.int64, np.uint64, np.int64, np.int64)
    return tuple(np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, kinds, strict=True))  # type: ignore[return-value]


def window_hashes(hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Digests of the windows that start at these words."""
    up, down = POWERS.upto(len(hashes) + 1)
    p = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=p[1:])
    return mix((p[start + WINDOW] - p[start]) * down[start])


def find_seeds(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, sha, n_words, kept (of the whole text), seeds (distinct), z (the text, compressed)."""
    pack = zstandard.ZstdCompressor(level=3)
    for rb in batch_iter:
        ids = rb.column(0)
        for i, data, offsets in batches(rb.column(1)):
            starts, ends, first = word_spans(data, offsets)
            _, seed, lo, _ = anchors(word_hashes(data, starts, ends), first)
            cut = np.searchsorted(lo, first)
            rows = []
            for k in range(len(offsets) - 1):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                own = np.unique(seed[cut[k] : cut[k + 1]]).view(np.int64)
                rows.append((hashlib.sha256(text).digest(), int(first[k + 1] - first[k]), hashlib.sha256(b" ".join(text.split())).hexdigest(), own, pack.compress(text) if len(own) else None))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary())
            yield pa.record_batch([ids.slice(i, len(rows)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "sha", "n_words", "kept", "seeds", "z"])


def surroundings(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha, doc, packed text, seeds that other documents have -> for each of their places what stands around it.

    around holds the digests of the anchor's windows, from the one that reaches furthest to the right on; far is the furthest
    reach to the left, in words.
    """
    z = zstandard.ZstdDecompressor()
    for rb in batch_iter:
        for sha, doc, packed, wanted in zip(*rb.columns, strict=True):
            text = np.frombuffer(z.decompress(packed.as_py()), np.uint8)
            starts, ends, first = word_spans(text, np.array([0, len(text)]))
            hashes = word_hashes(text, starts, ends)
            at, seed, lo, hi = anchors(hashes, first)
            ours = np.flatnonzero(np.isin(seed.view(np.int64), wanted.values.to_numpy(zero_copy_only=False)))
            for k in range(0, len(ours), 5000):
                part = ours[k : k + 5000]
                n = hi[part] - lo[part] + 1
                ends_at = np.cumsum(n)
                # From the last window, which reaches least to the left, down to the first.
                start = np.repeat(hi[part], n) - (np.arange(ends_at[-1]) - np.repeat(ends_at - n, n))
                windows = window_hashes(hashes, start)
                around = pa.ListArray.from_arrays(pa.array(np.append(0, ends_at), pa.int32()), pa.array(windows.view(np.int64)))
                ctx = [hashlib.blake2b(windows[e - m : e].tobytes(), digest_size=16).digest() for e, m in zip(ends_at.tolist(), n.tolist(), strict=True)]
                own = pa.array([sha.as_py()] * len(part), pa.binary()), pa.array([doc.as_py()] * len(part), pa.int64())
                yield pa.record_batch(
                    [*own, pa.array(at[part]), pa.array(seed[part].view(np.int64)), pa.array(ctx, pa.binary()), pa.array(at[part] - lo[part]), around],
                    ["sha", "doc", "at", "seed", "ctx", "far", "around"],
                )


def extended(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """seed, ctx, doc, far, around, a seed's rows together -> seed, ctx, l, r, of: how far an earlier document agrees, and the earliest that does."""

    def judged(t: pa.Table) -> pa.RecordBatch:
        around = t["around"].combine_chunks()
        around = around.chunk(0) if isinstance(around, pa.ChunkedArray) else around
        n = np.diff(around.offsets.to_numpy())
        windows, doc, far = around.flatten().to_numpy(zero_copy_only=False), t["doc"].to_numpy(), t["far"].to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((doc[row], windows))
        heads = np.flatnonzero(np.diff(windows[order], prepend=windows[order[0]] ^ 1))
        earliest = np.empty(len(row), np.int64)
        earliest[order] = np.repeat(doc[row][order][heads], np.diff(np.append(heads, len(row))))
        hit = np.flatnonzero(earliest < doc[row])
        left = far[row] - (n[row] - 1 - (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)))
        r, begun = np.unique(row[hit], return_index=True)
        if not len(r):
            return out([], [], [], [], [])
        reach = left[hit]
        l_max, l_min, of = np.maximum.reduceat(reach, begun), np.minimum.reduceat(reach, begun), np.minimum.reduceat(earliest[hit], begun)
        return out(t["seed"].to_numpy()[r], t["ctx"].take(pa.array(r)).to_pylist(), l_max, WINDOW - l_min, of)

    def out(*cols) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["seed", "ctx", "l", "r", "of"])

    held: pa.Table | None = None
    for rb in batch_iter:
        if not rb.num_rows:
            continue
        t = pa.Table.from_batches([rb])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        seeds = t["seed"].to_numpy()
        cut = int(np.flatnonzero(np.diff(seeds, prepend=seeds[0] ^ 1))[-1])
        if cut:
            yield judged(t.slice(0, cut).combine_chunks())
        held = t.slice(cut)
    if held is not None:
        yield judged(held.combine_chunks())


def cut_out(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha, packed text, spans (s, e, of) -> the words removed, a digest of those that stay, and the merged spans."""
    z = zstandard.ZstdDecompressor()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("of", pa.int64())]))
    for rb in batch_iter:
        for k in range(rb.num_rows):
            sha, packed, spans = (c[k].as_py() for c in rb.columns)
            words, runs = z.decompress(packed).split(), []
            for s, e, of in sorted((x["s"], x["e"], x["of"]) for x in spans):
                if runs and s <= runs[-1]["end"]:
                    runs[-1]["end"], runs[-1]["of"] = max(runs[-1]["end"], e), min(runs[-1]["of"], of)
                else:
                    runs.append({"start": s, "end": e, "of": of})
            at, kept = 0, []
            for x in runs:
                kept += words[at : x["start"]]
                at = x["end"]
            kept = hashlib.sha256(b" ".join(kept + words[at:])).hexdigest()
            n = sum(x["end"] - x["start"] for x in runs)
            yield pa.record_batch([pa.array([sha], pa.binary()), pa.array([n]), pa.array([kept]), pa.array([runs], span)], ["sha", "n_removed", "kept_sha256", "spans"])


SPANS = "array<struct<start: long, end: long, of: long>>"


def reaches(around: DataFrame) -> DataFrame:
    """around(seed, ctx, doc, far, around), one row for each kind of surroundings -> seed, ctx, l, r, of where an earlier document agrees.

    A seed's rows are extended in one task up to GROUP of them. A passage that very many documents hold, each in other text,
    has more; their windows are grouped over the whole cluster, with the same result.
    """
    size = around.groupBy("seed").agg(F.count("*").alias("kinds"))
    sized = around.join(size.where("kinds > 1"), "seed")
    few = sized.where(F.col("kinds") <= GROUP).select("seed", "ctx", "doc", "far", "around")
    out = few.repartition("seed").sortWithinPartitions("seed").mapInArrow(extended, "seed long, ctx binary, l long, r long, of long")
    large = sized.where(F.col("kinds") > GROUP).select("seed", "ctx", "doc", (F.col("far") - F.size("around") + 1).alias("near"), "around")
    each = large.select("seed", "ctx", "doc", "near", F.posexplode("around").alias("k", "window"))
    earliest = each.groupBy("seed", "window").agg(F.min("doc").alias("of"))
    hits = each.join(earliest, ["seed", "window"]).where("of < doc").withColumn("l", F.col("near") + F.col("k"))
    return out.union(hits.groupBy("seed", "ctx").agg(F.max("l").cast("long").alias("l"), (WINDOW - F.min("l")).cast("long").alias("r"), F.min("of").alias("of")))


def repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, spans; other columns are not read, so their names can't clash.

    Removes each word covered by a run of WINDOW words that also starts in a document with a smaller doc_id. spans are the
    maximal runs of removed words: start, end (words), of (the smallest doc_id that has a window of it). Null texts have no
    words; texts of fewer than WINDOW words stay whole. A null doc_id counts as the smallest. Documents with one doc_id don't
    lose words to each other, so repeated rows have equal results. An empty table gives an empty result.

    Of equal texts only the one with the smallest doc_id is searched; the others repeat it as a whole.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    found = staged(docs.mapInArrow(find_seeds, "doc_id long, sha binary, n_words long, kept string, seeds array<long>, z binary"), "substrings-found")
    texts = staged(found.groupBy("sha").agg(F.min("doc_id").alias("doc")), "substrings-texts")
    # Joined on both columns, the copies of a text are dealt over the cluster.
    ours = found.where(F.size("seeds") > 0).withColumnRenamed("doc_id", "doc")
    one_each = lambda cols, few: ours.select(*cols).join(few.hint("merge"), ["sha", "doc"]).dropDuplicates(["sha", "doc"])
    rows = one_each(["sha", "doc", "seeds"], texts).select("sha", "doc", F.explode("seeds").alias("seed"))
    # Equal texts have been merged, so what one document has twice and no other has is left out here.
    shared = rows.groupBy("seed").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("seed")
    wanted = staged(rows.join(shared, "seed").groupBy("sha", "doc").agg(F.collect_list("seed").alias("seeds")), "substrings-wanted")
    packed = staged(one_each(["sha", "doc", "z"], wanted).select("sha", "doc", "z", "seeds"), "substrings-shared")
    near = packed.mapInArrow(surroundings, "sha binary, doc long, at long, seed long, ctx binary, far long, around array<long>")
    near = staged(near, "substrings-near")
    kinds = near.groupBy("seed", "ctx").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"), F.first("far").alias("far"), F.first("around").alias("around"))
    kinds = staged(kinds, "substrings-kinds")
    reach = staged(reaches(kinds.select("seed", "ctx", "doc", "far", "around")), "substrings-reach")
    # Surroundings that an earlier document has too are repeated as a whole; for the earliest, what was found counts.
    whole = kinds.where("doc < last").select("seed", "ctx", "doc", (F.size("around") - 1).alias("more"))
    told = reach.join(whole, ["seed", "ctx"], "full").select("seed", "ctx", "l", "r", "of", "doc", "more")
    spans = near.select("sha", "doc", "at", "seed", "ctx", "far").withColumnRenamed("doc", "own").join(told, ["seed", "ctx"])
    repeated = F.col("own") > F.col("doc")
    spans = spans.select(
        "sha", F.when(repeated, F.col("at") - F.col("far")).otherwise(F.col("at") - F.col("l")).alias("s"),
        F.when(repeated, F.col("at") - F.col("far") + F.col("more") + WINDOW).otherwise(F.col("at") + F.col("r")).alias("e"), F.when(repeated, F.least("doc", "of")).otherwise(F.col("of")).alias("of"),
    ).where("s IS NOT NULL")
    spans = spans.groupBy("sha").agg(F.collect_list(F.struct("s", "e", "of")).alias("spans"))
    cut = packed.select("sha", "z").join(spans.hint("merge"), "sha").select("sha", "z", "spans").mapInArrow(cut_out, f"sha binary, n_removed long, kept_sha256 string, spans {SPANS}")
    cut = staged(cut, "substrings-cut")
    unstage(wanted, packed, near, kinds, reach)
    again = (F.col("doc_id") > F.col("doc")) & (F.col("n_words") >= WINDOW)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"), F.col("doc").alias("of")))
    out = found.select("doc_id", "sha", "n_words", "kept").join(texts, "sha").join(cut, "sha", "left")
    ids = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    return out.select(
        ids.alias("doc_id"), "n_words", F.when(again, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(again, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "kept")).alias("kept_sha256"),
        F.when(again, all_of_it).otherwise(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"),
    )


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir)).drop("spans")


#: A window by its words; equal windows in DuckDB, word by word.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS s, words FROM d WHERE len(words) >= 50),
h AS (SELECT doc_id, s, md5(array_to_string(words[s : s + 49], ' ')) AS h FROM w),
m AS (SELECT h, min(doc_id) AS lo FROM h GROUP BY h),
hit AS (SELECT doc_id, s FROM h JOIN m USING (h) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM hit),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
k AS (SELECT d.doc_id, u.i, u.word FROM d, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word) u),
s AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) AS kept, count(*) AS n FROM k ANTI JOIN gone ON gone.doc_id = k.doc_id AND gone.i = k.i GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""
