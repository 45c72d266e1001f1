"""The operators against brute force and on odd inputs: nulls, empty texts, repeated rows, clashing names, empty tables."""

import collections
import hashlib
import itertools
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.llm import op1_decontaminate as op1
from eventloom.llm import op2_suffix_array as op2
from eventloom.llm import op3_fuzzy_lines as op3
from eventloom.llm import op4_quality_rules as op4
from eventloom.llm import op5_minhash as op5
from eventloom.llm import op6_toxicity as op6
from eventloom.llm import op7_language_id as op7
from eventloom.llm import op8_licenses as op8
from eventloom.llm import op9_mixing as op9
from eventloom.llm import op10_surrogates as op10

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, component_id string, copy string"


def table(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), f"s{i % 3}" if i % 5 else None, len(t or ""), "x", "y", "z", "w") for i, t in enumerate(texts)], SHAPE)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "lo", "ti")]
    make = lambda k: " ".join(r.choice(words) for _ in range(k))
    base = [make(r.randint(30, 120)) for _ in range(n)]
    out = [None, "", "   ", "one two", *base, base[0], base[1]]
    passage = make(60)
    for b in base[:15]:  # near copies
        w = b.split()
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [f"{make(20)} {passage}\n{make(25)}" for _ in range(12)]
    out.append(" ".join(base[5:20]) * 20)
    return out


ODD = [None, "", " \n\t", "a", "same same", "same same", "word " * 5000, "é" * 300]


def leaks_of_some(d):
    return op1.leaks(d, d.select(F.col("doc_id").alias("item_id"), "text").where("doc_id between 4 and 6"))


def by_doc(rows, *names):
    return sorted(tuple(r[n] for n in ("doc_id", *names)) for r in rows)


#: Operator, and what its rows are on the odd texts, sorted by doc_id.
CASES = {
    "op1": (leaks_of_some, lambda rows: by_doc(rows, "item_id", "passage") == [(4, 4, 0), (4, 5, 0), (5, 4, 0), (5, 5, 0), (6, 6, 0)]),
    "op2": (op2.remove_repeats, lambda rows: by_doc(rows, "n_bytes", "n_removed", "n_spans") == [(i, len((t or "").encode()), n, int(n > 0)) for i, (t, n) in enumerate(zip(ODD, [0] * 6 + [25000, 600], strict=True))]),
    "op3": (op3.dedup_lines, lambda rows: [r.text for r in sorted(rows, key=lambda r: r.doc_id)] == [*ODD[:5], "", *ODD[6:]] and [r.n_removed_lines for r in sorted(rows, key=lambda r: r.doc_id)] == [0] * 5 + [1, 0, 0]),
    "op4": (op4.quality, lambda rows: by_doc(rows, "n_words", "base_failed") == [(i, n, True) for i, n in enumerate([0, 0, 0, 1, 2, 2, 5000, 1])]),
    "op5": (op5.near_duplicates, lambda rows: by_doc(rows, "n_shingles", "component_id") == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7)]),
    "op6": (lambda d: op6.score_toxicity(d, ch := op6.language_model(d), op6.fit(d, d.select("doc_id", F.lit(None).cast("int").alias("toxic")), ch)), lambda rows: [(r.doc_id, r.score, r.restored) for r in sorted(rows)] == [(i, 0.5, []) for i in range(8)]),
    "op7": (lambda d: op7.predict_language(d, op7.fit(d)), lambda rows: by_doc(rows, "lang_pred") == [(i, "und" if i < 3 else "en") for i in range(8)]),
    "op8": (op8.licenses, lambda rows: rows == []),
    "op9": (op9.mix_sources, lambda rows: sorted({r.copy for r in rows}) == list(range(1, max(r.copy for r in rows) + 1)) and len({(r.doc_id, r.copy) for r in rows}) == len(rows) and {r.kept for r in rows} == {"x"}),
    "op10": (lambda d: op10.pseudonymize(d, "k"), lambda rows: by_doc(rows, "n_entities") == [(i, 0) for i in range(8)] and [r.text for r in sorted(rows, key=lambda r: r.doc_id)] == ODD),
}


@pytest.mark.parametrize("name", CASES)
def test_empty_table_and_odd_rows(spark, name):
    f, holds = CASES[name]
    assert f(table(spark, ["x"]).where("doc_id < 0")).count() == 0
    rows = f(table(spark, ODD)).collect()
    assert holds(rows), rows


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def joined(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_op5_is_brute_force(spark):
    texts = corpus()
    s = [shingles(t) for t in texts]
    want = joined(len(s), [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])])
    got = op5.near_duplicates(table(spark, texts)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == want
    assert [r.n_shingles for r in got] == [len(x) for x in s]
    assert len(set(want)) < len(want) - 10


def test_op2_is_brute_force(spark):
    texts = [t and t[:1500] for t in corpus()]
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    got = {r.doc_id: r for r in op2.remove_repeats(table(spark, texts)).collect()}
    removed = 0
    for i, t in enumerate(data):
        gone = bytearray(len(t))
        for p in range(len(t) - 199):
            if count[t[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        removed += sum(gone)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        kept = hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), sum(gone), spans, kept)
    assert removed


def test_op2_large_groups_are_counted_by_window(spark, monkeypatch):
    """What is removed doesn't depend on GROUP. Beyond it a repeat is another union of windows, so the two counts of repeats may."""
    texts = corpus()
    same = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = op2.remove_repeats(table(spark, texts)).select(same).orderBy("doc_id").collect()
    monkeypatch.setattr(op2, "GROUP", 1)
    got = op2.remove_repeats(table(spark, texts))
    assert got.select(same).orderBy("doc_id").collect() == want
    assert got.where("(n_repeats > 0) <> (n_removed > 0) or longest_repeat > n_bytes").isEmpty()


@pytest.mark.parametrize("group", [20_000, 1])
def test_op2_occurrences_are_all_repeats(spark, monkeypatch, group):
    """Each repeat's occurrences have the same bytes, 200 or more, and all occurrences of those bytes are there; they cover what is removed."""
    monkeypatch.setattr(op2, "GROUP", group)
    texts = [t and t[:1200] for t in corpus()]
    data = [(t or "").encode() for t in texts]
    r = op2.Repeats(table(spark, texts))
    groups = collections.defaultdict(set)
    for x in r.occurrences().collect():
        groups[x.repeat_id].add((x.doc_id, x.start, x.end))
    assert len(groups) > 10
    covered = collections.defaultdict(set)
    for members in groups.values():
        strings = {data[d][a:b] for d, a, b in members}
        assert len(strings) == 1
        one = strings.pop()
        assert len(one) >= 200
        assert len(members) > 1
        everywhere = {(d, i) for d, t in enumerate(data) for i in range(len(t) - len(one) + 1) if t.startswith(one, i)}
        assert {(d, a) for d, a, _ in members} <= everywhere
        # Copies of equal texts also form a repeat of their own; all others hold every occurrence.
        assert {(d, a) for d, a, _ in members} == everywhere or len({data[d] for d, _, _ in members}) == 1
        for d, a, b in members:
            covered[d].update(range(a, b))
    for x in r.removed().collect():
        assert sum(len(range(*s)) for s in x.spans) == x.n_removed == len(covered[x.doc_id])


def test_op2_groups_are_all_maximal_repeats(spark):
    """The query's own groups: each can't be made longer, and every pair of contexts is together in a group of just the bytes it shares."""
    texts = [t and t[:1200] for t in corpus()]
    data = [(t or "").encode() for t in texts]
    r = op2.Repeats(table(spark, texts))
    number = {x.rid: x.doc_id for x in r.found.select("rid", "doc_id").collect()}
    near = collections.defaultdict(set)
    for x in r.near.collect():
        near[x.seed, bytes(x.ctx)].add((number[x.rid], x.at))
    members = collections.defaultdict(set)
    for x in r.members().collect():
        members[x.seed, x.set, x.l, x.r] |= near[x.seed, bytes(x.ctx)]
    groups = {(g.seed, g.num, g.l, g.r): g.n for g in r.groups().collect()}
    assert len(groups) > 10
    assert {k: len(v) for k, v in members.items()} == groups
    for (_, _, left, right), places in members.items():
        strings = {data[d][p - left : p + right] for d, p in places}
        assert len(strings) == 1
        assert len(places) > 1
        if left < op2.LENGTH - op2.SEED:
            assert len({data[d][p - left - 1 : p - left] if p > left else (d, p) for d, p in places}) > 1
        if right < op2.LENGTH:
            assert len({data[d][p + right : p + right + 1] or (d, p) for d, p in places}) > 1
    together = {(seed, left, right, a, b) for (seed, _, left, right), places in members.items() for a in places for b in places}
    by_seed = collections.defaultdict(set)
    for (seed, _), places in near.items():
        by_seed[seed] |= places
    pairs = 0
    for seed, places in by_seed.items():
        for a, b in itertools.combinations(sorted(places), 2):
            (d, p), (e, q) = a, b
            x, y = data[d][max(p - 136, 0) : p][::-1], data[e][max(q - 136, 0) : q][::-1]
            sides = [len(os.path.commonprefix(z)) for z in ([x, y], [data[d][p : p + 200], data[e][q : q + 200]])]
            if sum(sides) >= 200:
                pairs += 1
                assert (seed, *sides, a, b) in together
    assert pairs > 10


def test_op2_query_counts_its_repeats(spark):
    texts = [t and t[:1200] for t in corpus()]
    r = op2.Repeats(table(spark, texts))
    rows = {x.doc_id: x for x in r.removed().collect()}
    found, longest = collections.Counter(), collections.Counter()
    for x in r.occurrences().collect():
        found[x.doc_id] += 1
        longest[x.doc_id] = max(longest[x.doc_id], x.end - x.start)
    for d, x in rows.items():
        assert (x.n_repeats > 0) == (x.n_removed > 0) == (found[d] > 0)
        assert x.longest_repeat == longest[d]


def test_op2_rows_that_share_a_doc_id(spark):
    long = " ".join(corpus()[4:8])[:900]
    rows = [(1, long), (1, "a text of its own without any repeat " * 3), (2, long[:500]), (3, "once"), (3, "once")]
    got = op2.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got) == [(1, 111, 0), (1, 900, 500), (2, 500, 500), (3, 4, 0), (3, 4, 0)]


def test_op3_is_brute_force(spark):
    r = random.Random(2)
    texts = ["\n".join([t, "the same line of some length in many", f"item {r.randrange(3)} of a list that is nearly the same in all of its characters and words {r.randrange(3)}", " "]) for t in corpus()[4:40]]
    first, occ = {}, []
    for d, t in enumerate(texts):
        for i, line in enumerate(t.split("\n")):
            if line.strip():
                first.setdefault(line, (d, i))
                occ.append((line, (d, i)))
    ids = list(first)
    sets = [{b[i : i + 10] for i in range(len(b) - 9)} if len(b) >= 10 else {b} for b in (x.lower() for x in ids)]
    root = joined(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    keep = {}
    for k, line in enumerate(ids):
        keep[root[k]] = min(keep.get(root[k], first[line]), first[line])
    gone = {p for line, p in occ if keep[root[ids.index(line)]] != p}
    got = {r.doc_id: r.text for r in op3.dedup_lines(table(spark, texts)).collect()}
    assert gone
    assert got == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in enumerate(texts)}


def test_op1_finds_items_and_wand_is_exact(spark):
    texts = corpus()[4:40]
    r = random.Random(5)
    items = [(k, " ".join(r.choice("abcdefghij") + str(r.randrange(40)) for _ in range(r.randint(8, 50)))) for k in range(30)]
    planted = {d: k for k, d in enumerate(range(0, 20, 2))}
    texts = [f"{t} {items[planted[d]][1].upper()}. {t}" if d in planted else t for d, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in op1.leaks(table(spark, texts), bench).collect()}
    assert got == set(planted.items())
    index = op1.Index(items)
    full = {i: {w: s for w, p in index.postings.items() for d, s in p if d == i} for i in range(30)}
    for i in range(30):
        passage = index.words[i][:40] + index.words[(i + 1) % 30][:30]
        for least in (0.1, 0.3, 0.6):
            want = {j for j in range(30) if sum(s for w, s in full[j].items() if w in set(passage)) >= least - 1e-9}
            assert {j for j, _ in index.wand(passage, least)} == want


@pytest.mark.parametrize("shard", [50_000, 4])
def test_op1_is_brute_force(spark, monkeypatch, shard):
    """All passages of all documents, scored for all items; shards don't change the result."""
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(4, 30)))) for k in range(12)]
    texts = []
    for d in range(30):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 400))]
        if d % 3 == 0:
            at = r.randrange(len(words) + 1)
            words[at:at] = items[d % 12][1].split()[: r.choice([100, 8])]
        texts.append(" ".join(words))
    monkeypatch.setattr(op1, "SHARD_ITEMS", shard)
    got = {(x.doc_id, x.item_id): (x.passage, round(x.score, 9)) for x in op1.leaks(table(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    index = op1.Index(items)
    half, want = index.width // 2, {}
    for d, t in enumerate(texts):
        for _, data, offsets in op1.batches(pa.array([t], pa.large_string())):
            words = op1.hashed_words(data, offsets)[0].tolist()
            for at in range(0, max(len(words), 1), half):
                passage = words[at : at + index.width]
                for k in range(len(items)):
                    score = sum(s for w, p in index.postings.items() if w in set(passage) for i, s in p if i == k)
                    q, a = index.overlaps(k, passage) if passage else (0, 0)
                    if score >= op1.SCORE - 1e-9 and q >= op1.QUESTION and a >= op1.ANSWER and ((d, k) not in want or round(score, 9) > want[d, k][1]):
                        want[d, k] = (at, round(score, 9))
    assert len(want) > 4
    assert got == want


def test_op3_short_lines(spark):
    """Lines of a shingle or less are alike if equal in lower case; one of ten equal letters has the shingle of eleven."""
    texts = ["Read More\nHOME\na\nabcdefghiJ\nÉté", "READ MORE\nhome\nA\nABCDEFGHIJ\nété\n ", "read more\nhomes\nb\nabcdefghik\nÉTÉ\n\n", "x" * 10, "X" * 11]
    got = [r.text for r in op3.dedup_lines(table(spark, texts)).orderBy("doc_id").collect()]
    assert got == [texts[0], "été\n ", "homes\nb\nabcdefghik\nÉTÉ\n\n", "x" * 10, ""]


@pytest.mark.parametrize("small", [0, 5, 2048])
def test_op3_large_buckets_by_either_way(spark, monkeypatch, small):
    """Lines of one stem with ever more of it changed: near ones are linked in chains, far ones share bands only."""
    r = random.Random(8)
    stem = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnr')}{r.choice('aeiou')}" for _ in range(24)]
    lines = []
    for _ in range(120):
        w = list(stem)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(["zuzu", "vivi", "kaka", "popo"])
        lines.append(" ".join(w))
    lines = sorted(set(lines))
    r.shuffle(lines)
    sets = [{x[i : i + 10] for i in range(len(x) - 9)} for x in lines]
    root = joined(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    monkeypatch.setattr(op3, "SMALL", small)
    got = {x.doc_id for x in op3.repeated_lines(table(spark, lines)).collect()}
    assert len(set(root)) > 5
    assert got == {i for i in range(len(lines)) if root[i] != i}


def test_op3_cyrillic_and_long_lines(spark):
    a = "Свет зимнего утра падал на старый деревянный стол у окна комнаты"
    b = a.replace("зимнего", "зимнега")
    c = " ".join(f"слово{i}" for i in range(60_000))  # one line of more than PIECE characters
    texts = [a, b, a[:20], c, c[:-3] + "000", "\n".join(f"line number {i} of many" for i in range(30_000)) + "\n" + a]
    got = {r.doc_id: r for r in op3.dedup_lines(table(spark, texts)).collect()}
    same = {x[i : i + 10] for x in (a,) for i in range(len(a) - 9)}, {b[i : i + 10] for i in range(len(b) - 9)}
    assert (got[1].text == "") == (100 * len(same[0] & same[1]) >= 80 * len(same[0] | same[1]))
    assert [got[i].text for i in (0, 2, 3)] == [texts[i] for i in (0, 2, 3)]
    assert got[4].text == ""
    assert not got[5].text.endswith(a)


def test_op4_counts(spark):
    t = "a b c d e f g h x a b c d e f g h\n#tag one\n#tag one\n \nlast"
    r = op4.quality(table(spark, [t])).first()
    assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.n_symbols, r.base_failed, r.kept) == (22, 16, 1, 2, True, False)


def test_op6_restores_and_learns(spark):
    clean = [f"{t} fine words here" for t in corpus()[4:60]]
    toxic = [f"{t} {'idiot' if i % 2 else 'moron'}" for i, t in enumerate(corpus(3)[4:60])]
    docs = table(spark, clean + toxic)
    labels = spark.createDataFrame([(i, int(i >= len(clean))) for i in range(len(clean) + len(toxic))], "doc_id long, toxic int")
    channel = op6.language_model(docs)
    for s in ("1d10t", "i d i o t", "i.d.i.o.t", "idiooot", "m0r0n"):
        assert channel.restore(s) in ("idiot", "moron")
    model = op6.fit(docs, labels, channel)
    tests = table(spark, ["what an 1d10t he is", "i d i o t", "nothing bad here", None, ""])
    got = [r.score for r in op6.score_toxicity(tests, channel, model).orderBy("doc_id").collect()]
    assert got[0] > 0.5
    assert got[1] > 0.5
    assert max(got[2:]) < 0.5
    texts = ["A Plain line\nan 1d10t\n", "ééé éa s t u p i d b", "x" * 50, "no thing"]
    assert op6.restored(channel, texts) == [channel.restore(t) for t in texts]


def test_op6_keeps_all_features_that_tell(spark):
    """A pure word among 700 words that are common in toxic texts, and seen in clean ones too: those have the larger z."""
    r = random.Random(5)
    common = ["q" + "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(700)]
    toxic = [" ".join([w for w in common if r.random() < 0.7] + (["scoundrel"] if i < 30 else [])) for i in range(400)]
    clean = [" ".join(w for w in common if r.random() < 0.3) for i in range(400)]
    docs = table(spark, toxic + clean)
    labels = spark.createDataFrame([(i, int(i < 400)) for i in range(800)], "doc_id long, toxic int")
    model = op6.fit(docs, labels, op6.language_model(docs))
    assert model.score(op6.Channel(np.zeros(op6.SYMBOLS**3)), ["a scoundrel"])[1] == [["scoundrel"]]


def test_op6_gate_lets_all_of_the_channel_through(spark):
    channel = op6.language_model(table(spark, ["the loser and the idiots and one moron say shit to the ass, ass and ass, big goons and idiot too"] * 50))
    seen = {"5h17": "shit", "1d1075": "idiots", "l053r": "loser", "1053r": "loser", "sh!7": "shit", "a$$": "ass", "i d 1 o t": "idiot", "m 0 r 0 n": "moron", "i d i o t": "idiot", "l - o - s - e - r": "loser", "i! d! i! o! t!": "idiot", "i/d/i/o/t": "idiot", "9oon": "goon", "los€r": "loser", "£oser": "loser", "idiot/moron": "idiot moron"}
    for t in seen:
        assert op6.spans(np.array([*map(ord, t)])) [0] == (0, len(t))
    assert {t: channel.restore(t) for t in seen} == seen
    for t in ("", "plain words.", "1 2 3 4", "a b", "75 $", "(one), two", "aa bb"):
        assert op6.spans(np.array([*map(ord, t)], np.uint32)) == []


def test_op6_decodes_long_spans_whole(spark):
    """Each letter of two words at each distance from a span's start."""
    channel = op6.language_model(table(spark, ["you idiot stupid " * 3] * 50))
    for k in range(12):
        got = channel.restore("y o u " * k + "i d 1 o t s t u p i d " * 30)
        assert got.replace(" ", "") == "you" * k + "idiotstupid" * 30
    assert channel.restore("1d10t." * 5000 + "x").replace(" ", "") == "idiot" * 5000 + "x"


def test_op6_decode_is_the_best_of_all_paths(spark):
    """Every reading of short spans, with its cost, against the lattice."""
    channel = op6.language_model(table(spark, ["the loser and the idiot shit on a moron"] * 20))
    space = op6.symbol(" ")

    def readings(span, i, a, b, cost, text):
        if i == len(span):
            yield (cost if b == space else cost + channel.cost[a][b][space]), text.strip()
            return
        c = span[i]
        if c.isalpha() or c.isspace():
            options = [(c, op6.KEPT if c.isspace() else 0.0)]
        else:
            options = [(x, op6.SIGN) for x in op6.LEET.get(c, "")] + [(" ", op6.KEPT)] * (not c.isalnum())
        run = i and c == span[i - 1] and (i > 1 and span[i - 2] == c or span[i + 1 : i + 2] == c)
        skip = op6.AGAIN if run else op6.SPACED if c.isspace() else op6.BETWEEN if not c.isalnum() else None
        for x, extra in options:
            s = op6.symbol(x)
            if not (s == space == b):
                yield from readings(span, i + 1, b, s, cost + extra + channel.cost[a][b][s], text + x)
        if skip is not None:
            yield from readings(span, i + 1, a, b, cost + skip, text)

    r = random.Random(4)
    for _ in range(300):
        span = "".join(r.choice("losert10537!$. -") for _ in range(r.randint(2, 7)))
        if not any(c.isalpha() for c in span) or any(c.isdigit() and c not in op6.LEET for c in span):
            continue
        best = sorted(readings(span, 0, space, space, 0.0, ""))
        ties = {t for c, t in best if c < best[0][0] + 1e-9}
        assert channel.cheapest(span) in ties, (span, best[:3])


def test_op7_is_plain_naive_bayes(spark):
    r = random.Random(6)
    sounds = {"aa": ["ka", "to", "mi"], "bb": ["ki", "ta", "mo"], "cc": ["ka", "ta", "zu"]}
    texts = [" ".join("".join(r.choice(sounds[lang]) for _ in range(3)) for _ in range(r.randint(1, 6))) for lang in sounds for _ in range(12)]
    langs = {i: list(sounds)[i // 12] for i in range(36)}
    docs = table(spark, texts, langs)
    model = op7.fit(docs.where("doc_id % 3 > 0"))
    got = {x.doc_id: (x.lang_pred, x.score) for x in op7.predict_language(docs, model).collect()}

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower() + " ")
        for n in op7.GRAMS:
            for i in range(len(t) - n + 1):
                if t[i : i + n].strip():
                    h = 0
                    for k in range(n):  # from the last character to the first
                        h = (h * 0x9E3779B1 + ord(t[i + n - 1 - k]) + k + 1) % 2**32
                    h ^= h >> 15
                    h = h * 0x85EBCA6B % 2**32
                    yield (h ^ (h >> 13)) % model.buckets

    train = [i for i in range(36) if i % 3]
    counts = {x: collections.Counter(g for i in train if langs[i] == x for g in grams(texts[i])) for x in sounds}
    for i, t in enumerate(texts):
        logs = {}
        for x, c in counts.items():
            total = sum(c.values()) + op7.SMOOTHING * model.buckets
            logs[x] = math.log(sum(langs[k] == x for k in train) / len(train)) + sum(math.log((c[g] + op7.SMOOTHING) / total) for g in grams(t))
        best = max(sorted(logs), key=lambda x: logs[x])
        assert got[i][0] == best
        assert abs(got[i][1] - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-9


def test_op7_held_out(spark):
    en, fr = "the house and the garden of this town were there ", "la maison et le jardin de cette ville sont là "
    docs = table(spark, [(en if i % 2 else fr) * (i % 4 + 1) for i in range(40)] + [None, "12 34 !"], {i: "en" if i % 2 else "fr" for i in range(40)})
    out = op7.predict_language(docs, op7.fit(docs.where("doc_id < 30"))).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out] == ["en" if i % 2 else "fr" for i in range(40)] + ["und", "und"]
    assert op7.predict_language(docs, op7.fit(docs.where("false"))).select("lang_pred").distinct().collect()[0][0] == "und"


def test_op8_finds_changed_templates(spark):
    full = op8.TEMPLATES[8][1]
    words = full.split()
    words[10:11] = ["quite", "another"]
    got = {(r.doc_id, r.template): r for r in op8.licenses(table(spark, ["été " + full, " ".join(words), "Released under the MIT license", "no licence"])).collect()}
    assert {k for k in got} == {(0, "MIT-grant"), (1, "MIT-grant"), (2, "MIT-notice")}
    assert got[0, "MIT-grant"].coverage == 1.0
    assert 0.9 < got[1, "MIT-grant"].coverage < 1.0
    assert (got[0, "MIT-grant"].start, got[2, "MIT-notice"].end) == (6, 30)


def test_op8_finds_each_of_close_repeats(spark):
    notice, full = op8.TEMPLATES[0][1], op8.TEMPLATES[8][1]
    w = full.split()
    stray = " ".join([*w[12:15], "x y z u", *w[:20], *["more"] * 11, *w[20:]])  # a shared gram just before, and words put between
    texts = ["\n".join([notice] * 4), f"{notice} and then {notice}", notice, stray]
    got = op8.licenses(table(spark, texts)).collect()
    starts = lambda d: sorted(r.start for r in got if r.doc_id == d and r.template == "MIT-notice")
    assert [starts(d) for d in range(3)] == [[i * (len(notice) + 1) for i in range(4)], [0, len(notice) + 10], [0]]
    assert [(r.template, r.coverage) for r in got if r.doc_id == 3] == [("MIT-grant", 1.0)]


def test_op8_is_full_alignment(spark):
    """Templates with words exchanged, put in and left out among other words, against the longest common subsequence with each template."""
    r = random.Random(9)
    plain = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    texts, own = [], []
    for _ in range(120):
        own.append(r.randrange(len(op8.TEMPLATES)))
        words = plain(op8.TEMPLATES[own[-1]][1])
        for _ in range(r.choice([0, 1, len(words) // 12, len(words) // 6, len(words) // 3])):
            at = r.randrange(len(words))
            words[at : at + r.choice([0, 1, 1])] = r.choice([[], ["zzz"], ["qqq"]])
        texts.append(" ".join([f"x{i}" for i in range(r.randint(0, 30))] + words + [f"y{i}" for i in range(r.randint(0, 30))]))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    got = {(x.doc_id, x.template): x.words for x in op8.licenses(table(spark, texts)).collect()}
    want = {}
    for d, t in enumerate(texts):
        for name, template in op8.TEMPLATES:
            n = common(plain(template), plain(t))
            if n >= op8.COVERAGE * len(plain(template)):
                want[d, name] = n
    assert set(got) <= set(want)
    # A subsequence of all of the text may be strewn over it; one of the template that the text was made from is not.
    made = {(d, op8.TEMPLATES[k][0]) for d, k in enumerate(own)} & set(want)
    assert len(made) > 60
    assert len(made & set(got)) >= 0.97 * len(made)  # what shares no fingerprint, or leaves the band
    assert all(n <= want[k] for k, n in got.items())


def test_op8_finds_whole_licenses(spark):
    names = [n for n, _ in op8.LICENSES]
    texts = [t.replace("\n", "\r\n * ") for _, t in op8.LICENSES] + ["Copyright (c) 2020 A. Author\n\n" + op8.LICENSES[0][1].replace("THE SOFTWARE", "THE PROGRAM")]
    got = {(x.doc_id, x.template): x.coverage for x in op8.licenses(table(spark, texts)).collect()}
    assert all(got[i, n] == 1.0 for i, n in enumerate(names))
    assert 0.9 < got[len(names), names[0]] < 1.0


def test_op9_means_and_repeats(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("source"), F.lit("a").alias("copy"))
    w = spark.createDataFrame([("rare", 1.0), ("hot", 1.0)], "source string, weight double")
    got = {r.source: r["count"] for r in op9.mix_sources(docs, w).groupBy("source").count().collect()}
    assert abs(got["rare"] - 10000) < 500
    assert abs(got["hot"] - 10000) < 500
    a = op9.mix_sources(docs, w).select("doc_id", "copy").orderBy("doc_id", "copy").collect()
    assert a == op9.mix_sources(docs.repartition(7), w).select("doc_id", "copy").orderBy("doc_id", "copy").collect()


def test_op10_is_consistent_and_distinct(spark):
    texts = ["Mail a.b1@x.org and A.B1@x.org, +1 (319) 555-5132 or 1 319 555 5132", "4111 1111 1111 1111 then 4111111111111111", "Mr. John Smith and Smith", "10.0.0.1 and 10.0.0.2", None, "password=abc123def"]
    rows = op10.pseudonymize(table(spark, texts), "k").orderBy("doc_id").collect()
    for old, new in zip(texts, rows, strict=True):
        for secret in ("b1@x.org", "5132", "4111", "John", "10.0.0.1", "abc123def"):
            assert old is None or secret not in new.text
    a, b = rows[0].text.split()[1], rows[0].text.split()[3].rstrip(",")
    assert a == b
    card = re.findall(r"\d[\d ]+\d", rows[1].text)
    assert card[0].replace(" ", "") == card[1].replace(" ", "")
    assert op10.luhn(card[1])
    assert rows[4].text is None
    ips = [op10.surrogate("k", "ip", f"10.0.{i // 256}.{i % 256}") for i in range(2000)]
    assert len(set(ips)) == 2000
    assert all(re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", x) for x in ips)


def test_op10_draws_again_when_surrogates_clash(spark, monkeypatch):
    entities = spark.createDataFrame([("ssn", f"{i:09d}") for i in range(50)] + [("ssn", op10.surrogate("k", "ssn", "000000001"))], "kind string, value string")
    again = {(r.value, r.attempt) for r in op10.assign(entities, "k").collect()}
    assert ("000000001", 1) in again


def test_op10_later_bare_mentions(spark):
    texts = ["Mr. John Smith spoke. Smith then left and John stayed; Smithson is no Smith.", "A Smith of no known name, and John too"]
    rows = op10.pseudonymize(table(spark, texts), "k").orderBy("doc_id").collect()
    given, family = rows[0].text.split()[1:3]
    assert rows[0].text == f"Mr. {given} {family} spoke. {family} then left and {given} stayed; Smithson is no {family}."
    assert {given, family}.isdisjoint({"John", "Smith"})
    assert rows[0].n_entities == 5
    assert rows[1].text == texts[1]


def test_op10_draws_are_those_of_brute_force(spark):
    r = random.Random(2)
    values = sorted({"".join(r.choice("ab1") for _ in range(2)) for _ in range(30)} | {f"{i}" for i in range(6)} | {"xy", "qa"})
    found = spark.createDataFrame([("secret", v) for v in values], "kind string, value string")
    got = {x.value: x.attempt for x in op10.assign(found, "k").collect()}
    attempt = dict.fromkeys(values, 0)
    while True:
        new = {v: op10.surrogate("k", "secret", v, a) for v, a in attempt.items()}
        first = {}
        for v in values:
            first.setdefault(new[v], v)
        again = {v for v in values if first[new[v]] != v or new[v] in attempt}
        if not again:
            break
        for v in again:
            attempt[v] += 1
    assert got == {v: a for v, a in attempt.items() if a}
    assert got


def test_op10_full_formats(spark):
    """All values of a format: their surrogates are longer, and still distinct."""
    values = [f"{i:03d}" for i in range(1000)]
    found = spark.createDataFrame([("secret", v) for v in values], "kind string, value string")
    attempts = {r.value: r.attempt for r in op10.assign(found, "k").collect()}
    new = {op10.surrogate("k", "secret", v, attempts.get(v, 0)) for v in values}
    assert len(new) == 1000
    assert new.isdisjoint(values)


def test_op10_search_is_the_whole_alternation():
    """The searches by kind against one alternation of all patterns, tried at every character."""
    patterns = {"secret": (op10.SECRET, op10.SECRET_VALUE), "email": (op10.EMAIL,), **{f"{k}{i}": (p,) for i, (_, k, p) in enumerate(op10.NUMBERS)}, "name": (op10.NAME,)}
    r = random.Random(3)
    parts = ["a.b@x.org", "@", "x@y", "+1 319 555 5132", "(319) 555-5132", "319 555 5132", "4111 1111 1111 1111", "10.0.0.1", "1.2.3.4.5", "123-45-6789", "DE44 5001 0517 5407 3249 31", "Mr. John Smith", "john", "John Smith", "Anna", "Ms Иван Козлов", "password: hunter22", "token=a1b2c3d4e5", "AKIA" + "A1B2" * 4, "sk-" + "a1" * 12, "_x+y@z.co", "12", ".", "-", "Dr", "Smith", "é", "secret"]
    for _ in range(3000):
        text = r.choice(["", " "]).join(r.choice(parts) + r.choice(["", " ", ", ", ". "]) for _ in range(r.randint(1, 6)))
        want, pos = [], 0
        while pos < len(text):
            m = next((m for ps in patterns.values() for p in ps if (m := p.match(text, pos))), None)
            want += [m.span()] if m else []
            pos = m.end() if m else pos + 1
        assert [x[:2] for x in op10.entities(text)] == want, text


def test_sets_share_a_prefix(spark):
    from eventloom.llm.common import prefix_pairs

    r = np.random.default_rng(4)
    base = r.choice(1000, 40, replace=False)
    sets = [sorted(set(np.where(r.random(40) < q, r.integers(0, 1000, 40), base).tolist())) for q in r.random(60) * 0.4]
    df = spark.createDataFrame([(i, i, s) for i, s in enumerate(sets)], "id long, c long, s array<long>")
    got = {(x.a, x.b) for x in prefix_pairs(df, 75, 100)[0].collect()}
    want = {(i, j) for j in range(60) for i in range(j) if 100 * len(set(sets[i]) & set(sets[j])) >= 75 * len(set(sets[i]) | set(sets[j]))}
    assert want
    assert want <= got
