"""The whole pipeline against the brute-force forms of its five stages, one after the other."""

import collections
import hashlib
import math
import random
import re

import duckdb
import pandas as pd

import corpus_pipeline
from eventloom.llm import op1_decontaminate as op1
from eventloom.llm import op4_quality_rules as op4
from eventloom.llm import op9_mixing as op9
from tests.llm.test_llm import joined, shingles


def corpus():
    r = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "lo", "ti", "mas")]
    common = "the of and to in is that it was for on are with as his they be at".split()
    line = lambda k: " ".join(r.choice(common) if r.random() < 0.4 else r.choice(words) for _ in range(k)).capitalize() + "."
    items = [" ".join(r.choice(words) for _ in range(r.randint(12, 30))) for _ in range(8)]
    shared = [line(14) for _ in range(4)]
    docs = []
    for i in range(70):
        docs.append("\n".join([line(r.randint(20, 60)) for _ in range(r.randint(3, 6))] + ([r.choice(shared)] if i % 4 == 0 else [])))
    near = [" ".join(w if r.random() > 0.02 else "other" for w in d.split(" ")) for d in docs[:12]]
    leaks = [f"{d}\n{items[k % 8].upper()} {line(8)}" for k, d in enumerate(line(80) for _ in range(6))]
    junk = ["short text", "### $$ %% && ||| <> " * 20, "same words here " * 60, None, ""]
    return [*docs, *near, *docs[20:24], *leaks, *junk], items


def without_lines(docs):
    first, found = {}, []
    for d, t in docs.items():
        for i, x in enumerate((t or "").split("\n")):
            if x.strip():
                found.append((x, (d, i)))
                first[x] = min(first.get(x, (d, i)), (d, i))
    lines = list(first)
    low = [x.lower() for x in lines]
    sets = [{b[i : i + 10] for i in range(len(b) - 9)} if len(b) >= 10 else {b} for b in low]
    root = joined(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    keep, of = {}, dict(zip(lines, root, strict=True))
    for x in lines:
        keep[of[x]] = min(keep.get(of[x], first[x]), first[x])
    gone = {at for x, at in found if keep[of[x]] != at}
    out = {}
    for d, t in docs.items():
        left = t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
        if left == t or left.strip():
            out[d] = left
    return out


def without_copies(docs):
    ids = sorted(docs)
    sets = [shingles(docs[d]) for d in ids]
    root = joined(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])])
    return {d: docs[d] for k, d in enumerate(ids) if root[k] == k}


def copies(doc_id, rate):
    u = int(hashlib.sha256(f"{op9.SEED}|{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while u >= total:
        k += 1
        p *= rate / k
        total += p
    return k


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    texts, items = corpus()
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": [("web", "web", "books", None)[i % 4] for i in range(len(texts))], "n_chars": [len(t or "") for t in texts]})
    spark.createDataFrame(docs.astype(object).where(docs.notna(), None).values.tolist(), "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    verdicts = con.sql(op4.ORACLE_SQL).df()
    left = {d: texts[d] for d in verdicts[verdicts["kept"]]["doc_id"].tolist()}
    assert 40 < len(left) < len(texts)
    lined = without_lines(left)
    assert lined != left
    single = without_copies(lined)
    plain = lambda t: " ".join(re.findall("[a-z0-9]+", (t or "").lower()))
    clean = {d: t for d, t in single.items() if not any(plain(x) in plain(t) for x in items)}
    assert len(clean) < len(single)
    n = collections.Counter(docs["source"][d] for d in clean)
    weights = {s: c**op9.ALPHA for s, c in n.items()}
    rates = {s: len(clean) * weights[s] / sum(weights.values()) / c for s, c in n.items()}
    want = sorted((d, k, t, len(t)) for d, t in clean.items() for k in range(1, copies(d, rates[docs["source"][d]]) + 1))
    got = sorted((r.doc_id, r.copy, r.text, r.n_chars) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long, copy string, kept string, component_id string"
    good = "\n".join(" ".join(f"{w}{i}{k}" for i, w in enumerate("the of and to in is that it was for on are with as they be at have this from".split())) for k in "ab")
    for name, rows in (("empty", []), ("odd", [(0, None), (1, ""), (2, good), (2, good), (3, "x" * 300_000)])):
        base = f"{tmp_path}/{name}"
        spark.createDataFrame([(d, t, None, None, 0, "c", "k", "z") for d, t in rows], shape).write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
        docs = spark.read.parquet(f"{base}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, base)
            assert docs.columns == shape.replace(" long", "").replace(" string", "").split(", ")
        assert corpus_pipeline.run(spark, base).where("doc_id <> 2").count() == 0
    assert op1 is not None
