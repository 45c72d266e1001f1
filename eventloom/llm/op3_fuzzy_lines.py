"""Line dedup: fuzzy lines by MinHash over character shingles, exact Jaccard, one line of each component stays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import alike_sets, documents, linked_components, staged, unstage
from eventloom.llm.op5_minhash import hash_family
from eventloom.llm.textops import mix, prefix_hash

#: Characters of a shingle; lines are alike from THRESHOLD on.
SHINGLE, THRESHOLD = 10, (80, 100)
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**4)**10 = 0.995, one of 0.9 with 0.99997.
BANDS, ROWS = 10, 4
#: Characters handled at a time, and distinct lines whose band keys a task holds before it sends them on.
PIECE, HELD = 1 << 18, 100_000
#: Most members of a bucket that one task compares; larger ones are compared by prefix filtering.
SMALL = 2048


def lower(text: str) -> np.ndarray:
    """The text's characters, A-Z in lower case."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp + np.uint32(32) * ((cp >= 65) & (cp <= 90))


def spans(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines, which line feeds part."""
    feeds = np.flatnonzero(low == 10)
    return np.concatenate([[0], feeds + 1]), np.concatenate([feeds, [len(low)]])


def digests(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of each line in lower case: (lines, 2)."""
    raw = low.tobytes()
    found = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip((starts * 4).tolist(), (ends * 4).tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def rolled(low: np.ndarray) -> np.ndarray:
    """Hashes of all shingles, by their start."""
    out = [np.zeros(0, np.uint64)]
    for lo in range(0, len(low) - SHINGLE + 1, PIECE):
        part = low[lo : lo + PIECE + SHINGLE - 1]
        p, down = prefix_hash(part)
        out.append(mix((p[SHINGLE:] - p[:-SHINGLE]) * down[: len(part) - SHINGLE + 1]))
    return np.concatenate(out)


def line_sets(lines: list[str]) -> list[np.ndarray]:
    """Distinct shingle hashes of each line in lower case; a line shorter than a shingle is one."""
    out: list[np.ndarray] = []
    while len(out) < len(lines):
        n, size = len(out), 0
        while n < len(lines) and (not size or size + len(lines[n]) < PIECE):
            size += len(lines[n]) + 1
            n += 1
        low = lower("\n".join(lines[len(out) : n]))
        ends = np.cumsum([len(x) + 1 for x in lines[len(out) : n]]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        all_of = rolled(low)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(all_of[a : b - SHINGLE + 1]))
            else:
                out.append(np.frombuffer(hashlib.blake2b(low[a:b].tobytes(), digest_size=8).digest(), np.uint64))
    return out


def band_keys(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Band keys of lines of a shingle or more: (lines, BANDS)."""
    a, b = hash_family(BANDS * ROWS)
    sig = np.full((BANDS * ROWS, len(starts)), 0xFFFFFFFF, np.uint32)
    last = ends - SHINGLE + 1
    for lo in range(0, len(low), PIECE):  # a line may go on in the next piece
        use = slice(np.searchsorted(last, lo, "right"), np.searchsorted(starts, lo + PIECE, "left"))
        if use.start >= use.stop:
            continue
        x = np.append((rolled(low[lo : lo + PIECE + SHINGLE - 1]) >> np.uint64(32)).astype(np.uint32), np.uint32(0xFFFFFFFF))
        cuts = np.stack([np.maximum(starts[use] - lo, 0), np.minimum(last[use] - lo, len(x) - 1)], 1).ravel()
        for k in range(len(a)):
            np.minimum(sig[k, use], np.minimum.reduceat(x * a[k] + b[k], cuts)[::2], out=sig[k, use])
    keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(starts), 1)
    for j in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[j::ROWS].astype(np.uint64) + np.uint64(1))
    return np.ascontiguousarray(keys.T).view(np.int64)


def by_key(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, h) in order; where each key's run starts; whether a pair's key has several."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(1)
    pairs = pairs[new]
    first = np.ones(len(pairs), bool)
    first[1:] = pairs[1:, 0] != pairs[:-1, 0]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(pairs)))
    return pairs, starts, np.repeat(sizes > 1, sizes)


def pieces(texts: list[str | None]) -> Iterator[tuple[str, list[int], list[int]]]:
    """Texts (null is empty) joined to about PIECE characters, a longer one cut at line feeds: (lines, index of each one's text, its number there)."""
    held: list[str] = []
    of: list[int] = []
    number: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        at, n = 0, 0
        t = t or ""
        while at <= len(t):
            to = len(t) if len(t) - at <= PIECE else t.find("\n", at + PIECE)
            to = len(t) if to < 0 else to
            count = t.count("\n", at, to) + 1
            held.append(t[at:to])
            of += [i] * count
            number += range(n, n + count)
            n, size, at = n + count, size + to - at + 1, to + 1
            if size >= PIECE:
                yield "\n".join(held), of, number
                held, of, number, size = [], [], [], 0
    if held:
        yield "\n".join(held), of, number


SKETCH = "doc_id long, line long, h long, g long, bucket int, pairs binary"


def sketch_lines(buckets: int):
    """doc_id, text -> a row (doc_id, line, digest h and g) for each line with a word; and rows (bucket, pairs) of band keys and h.

    A task sends each line's band keys once for as long as it remembers the line. Of a key with several lines in the task all
    are members of a shared bucket, which is sent as such (negative bucket), and only the smallest and largest go on to
    meet other tasks' lines: so a key gets two rows a task at most there.
    """
    space = np.zeros(33, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True

    def send(keys: list[np.ndarray], hs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.repeat(np.concatenate(hs), BANDS)
        pairs, starts, several = by_key(np.stack([np.concatenate(keys).ravel(), h], 1))
        ends = np.unique(np.concatenate([starts, np.append(starts[1:], len(pairs)) - 1]))
        out = pairs[ends]
        bucket = (mix(out[:, 0].view(np.uint64).copy()) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        out, bucket = out[order], bucket[order]
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        blobs = [out[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(out)), strict=True)]
        members = pairs[several]
        mine = [members[lo : lo + 4096] for lo in range(0, len(members), 4096)]
        names = bucket[cut].tolist() + [-1 - int(x[0, 1] % buckets) for x in mine]
        blobs += [x.tobytes() for x in mine]
        none = pa.nulls(len(names), pa.int64())
        yield pa.record_batch([none, none, none, none, pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "line", "h", "g", "bucket", "pairs"])

    def sketch(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        keys: list[np.ndarray] = []
        hs: list[np.ndarray] = []
        for rb in batch_iter:
            for at in range(0, rb.num_rows, 200):
                ids = rb.column(0).slice(at, 200)
                for text, of, number in pieces(rb.column(1).slice(at, 200).to_pylist()):
                    low = lower(text)
                    starts, ends = spans(low)
                    words = np.concatenate([[0], np.cumsum((low > 32) | ~space[np.minimum(low, 32)])])
                    use = np.flatnonzero(words[ends] > words[starts])
                    if not len(use):
                        continue
                    starts, ends = starts[use], ends[use]
                    d = digests(low, starts, ends)
                    new = [i for i, x in enumerate(d[:, 0].tolist()) if x not in known and not known.add(x)]
                    new = np.array(new, np.int64)
                    new = new[ends[new] - starts[new] >= SHINGLE]
                    if len(new):
                        keys.append(band_keys(low, starts[new], ends[new]))
                        hs.append(d[new, 0])
                    n = len(use)
                    yield pa.record_batch(
                        [ids.take(pa.array(np.array(of)[use])), pa.array(np.array(number)[use]), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                        ["doc_id", "line", "h", "g", "bucket", "pairs"],
                    )
                    if len(known) >= HELD:
                        if keys:
                            yield from send(keys, hs)
                        keys, hs = [], []
                        known.clear()
        if keys:
            yield from send(keys, hs)

    return sketch


def shared_keys(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, pairs), a bucket's all together -> key, h of the keys that several lines share."""

    def flush(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        if held:
            pairs, _, several = by_key(np.frombuffer(b"".join(held), np.int64).reshape(-1, 2))
            yield pa.record_batch([pa.array(np.ascontiguousarray(pairs[several, k])) for k in (0, 1)], ["key", "h"])

    held: list[bytes] = []
    last = None
    for rb in batch_iter:
        for bucket, blob in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            if bucket < 0:
                members = np.frombuffer(blob, np.int64).reshape(-1, 2)
                yield pa.record_batch([pa.array(np.ascontiguousarray(members[:, k])) for k in (0, 1)], ["key", "h"])
                continue
            if bucket != last:
                yield from flush(held)
                held, last = [], bucket
            held.append(blob)
    yield from flush(held)


def wanted_lines(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, wanted (line, h, g, uid) -> uid, text of the lines."""
    for rb in batch_iter:
        for at in range(0, rb.num_rows, 100):
            ids, texts = [], []
            for t, wanted in zip(*(c.slice(at, 100).to_pylist() for c in rb.columns), strict=True):
                lines = (t or "").split("\n")
                for w in wanted:
                    # Rows that share a doc_id have lines of their own.
                    line = lines[w["line"]] if w["line"] < len(lines) else ""
                    low = lower(line)
                    if digests(low, np.zeros(1, int), np.array([len(low)])).tolist() == [[w["h"], w["g"]]]:
                        ids.append(w["uid"])
                        texts.append(line)
            if ids:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["uid", "text"])


def sets_of_lines(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batch_iter:
        for at in range(0, rb.num_rows, 500):
            part = rb.slice(at, 500)
            sets = [s.view(np.int64) for s in line_sets(part.column(1).to_pylist())]
            yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])


def alike(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, their texts -> the pairs (a, b) that reach the threshold."""
    for rb in batch_iter:
        for at in range(0, rb.num_rows, 500):
            part = rb.slice(at, 500)
            x, y = part.column(2).to_pylist(), part.column(3).to_pylist()
            names: dict[str, int] = {}
            for t in (*x, *y):
                names.setdefault(t, len(names))
            sets = line_sets(list(names))
            keep = [alike_sets(sets[names[i]], sets[names[j]], *THRESHOLD) for i, j in zip(x, y, strict=True)]
            found = part.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            if found.num_rows:
                yield found


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs(a, b) of ids whose lines are alike."""
    side = lambda k: lines.select(F.col("uid").alias(k), F.col("text").alias(f"t_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b").mapInArrow(alike, "a long, b long")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> the lines that go: doc_id, line, and keeper (doc_id, line), the one that stays for them.

    Lines are parts between line feeds; those without a word (nothing but white space) are never judged. Lines are linked if
    the Jaccard similarity of their character shingles, A-Z in lower case, is THRESHOLD or more; a component keeps its
    first line by doc_id and place. A line shorter than a shingle is its own only shingle. Null and empty texts have no
    lines; an empty table gives an empty result. doc_ids should be distinct: two rows with one doc_id and equal lines
    count as the same line.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketch = staged(docs.mapInArrow(sketch_lines(4 * parts), SKETCH), "lines")
    lines = sketch.where("h is not null").select("doc_id", "line", "h", "g")
    exact = lines.groupBy("h", "g").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.count("*").alias("n"))
    exact = staged(exact.select(F.monotonically_increasing_id().alias("uid"), "h", "g", "at", "n"), "lines-exact")
    blobs = sketch.where("bucket is not null").select("bucket", "pairs")
    members = blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(shared_keys, "key long, h long")
    members = members.join(exact.select("h", "uid"), "h").select("key", F.col("uid").alias("id"))
    members = staged(members.distinct(), "lines-members")
    asked = exact.join(members.select(F.col("id").alias("uid")).distinct(), "uid", "left_semi")
    asked = asked.select("at.doc_id", F.struct("at.line", "h", "g", "uid").alias("w")).groupBy("doc_id").agg(F.collect_list("w").alias("wanted"))
    # Both sides grow with the documents, so they are shuffled at any size.
    texts = docs.join(staged(asked, "lines-asked").hint("merge"), "doc_id").select("text", "wanted").mapInArrow(wanted_lines, "uid long, text string")
    texts = staged(texts.dropDuplicates(["uid"]), "lines-texts")
    sets = lambda ids: texts.join(ids.withColumnRenamed("id", "uid"), "uid", "left_semi").mapInArrow(sets_of_lines, "id long, s array<long>")
    by_id = texts.withColumnRenamed("uid", "id")
    comps = linked_components(members, lambda pairs: verified(pairs, texts), sets, THRESHOLD, "lines", small=SMALL, texts=by_id, sets_of=line_sets)
    found = staged(comps.withColumnRenamed("id", "uid").join(exact, "uid"), "lines-found")
    keeper = found.groupBy("component").agg(F.min("at").alias("keeper"))
    near = found.join(keeper, "component").where("n > 1 OR keeper <> at").select("h", "g", "keeper")
    alone = exact.where("n > 1").join(found.select("uid"), "uid", "left_anti").select("h", "g", F.col("at").alias("keeper"))
    keepers = staged(near.union(alone), "lines-keepers")
    unstage(members, texts, comps, found, exact)
    gone = lines.join(keepers, ["h", "g"])
    return gone.where(F.struct("doc_id", "line") != F.col("keeper")).select("doc_id", "line", "keeper")


def cut_lines(names: list[str]):
    """Rows with names, the last a list of lines to remove -> the other columns with text cut, n_removed_lines."""
    at = names.index("text")

    def cut(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batch_iter:
            for lo in range(0, rb.num_rows, 500):
                part = rb.slice(lo, 500)
                texts, counts = part.column(at).to_pylist(), []
                for i, gone in enumerate(part.column(len(names) - 1).to_pylist()):
                    counts.append(len(gone or ()))
                    if gone:
                        drop = set(gone)
                        texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in drop)
                cols = [c if k != at else pa.array(texts, c.type) for k, c in enumerate(part.columns[:-1])]
                yield pa.record_batch([*cols, pa.array(counts, pa.int32())], [*names[:-1], "n_removed_lines"])

    return cut


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines taken out of text, n_removed_lines added, other columns as they are.

    A text that loses lines is joined from those that stay; one that loses none, null included, stays as it is. n_chars is
    left for the caller to count again. A column n_removed_lines or _gone of docs is replaced.
    """
    gone = staged(repeated_lines(docs).groupBy("doc_id").agg(F.collect_set("line").alias("_gone")), "lines-gone")
    docs = docs.drop("n_removed_lines", "_gone")
    out = docs.join(gone.hint("merge"), "doc_id", "left").select(*[docs[c] for c in docs.columns], "_gone")
    return out.mapInArrow(cut_lines(out.columns), docs.withColumn("n_removed_lines", F.lit(0)).schema)


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    out = dedup_lines(documents(spark, sf_dir).withColumn("n_lines", lines))
    return out.select("doc_id", (F.col("n_lines") - F.col("n_removed_lines")).alias("n_kept_lines"), "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
