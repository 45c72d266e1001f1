"""op11 to op13 against brute force, and on odd rows."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventloom.llm import op11_prefix_trie as op11
from eventloom.llm import op12_substrings as op12
from eventloom.llm import op13_merkle as op13

TURNS = "conv_id long, turn long, role string, text string, depth string, key string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, place string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- op11


def rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}")), (role, text)))
    seqs = {c: [x for _, x in sorted(t)] for c, t in turns.items()}
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(seqs.get(c - c % 5, [])[:h] + own[h:])
    return out


def brute_trie(rows):
    convs = rebuilt(rows)
    nodes = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    children = defaultdict(list)
    for s in nodes:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(nodes, key=len, reverse=True):
        leaves[s] = sum(leaves[x] for x in children[s]) or 1
        saved[s] = sum(saved[x] for x in children[s]) + ((len(nodes[s]) - 1) * len(s[-1][1].encode()) if s else 0)
    return sorted(
        (min(m), len(s), min(nodes[s[:-1]]) if s else -1, len(m), len(children[s]), leaves[s], saved[s], sha(",".join(str(c) for c in sorted(m) if convs[c] == s))) for s, m in nodes.items()
    )


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def dialogues(seed, n=90):
    r = random.Random(seed)
    say = [f"{'äbc'[i % 3] * (1 + i % 7)}{i}" for i in range(6)]
    rows = []
    for c in range(n):
        # Every third conversation is the same; some begin with the same turns, one is long.
        k = 4 if c % 3 == 0 else 400 if c == 50 else r.randrange(12)
        for t in range(k):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", say[0] if c % 3 == 0 or t < r.randrange(3) else r.choice(say)))
    return rows


ODD_TURNS = [
    (1, None, "user", None), (1, 2, None, "late"), (1, 0, "user", ""), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (7, 0, None, None), (9, 3, "user", "x" * 200_000), (None, 1, "user", "nobody's"),
    (-3, 0, "user", "minus"), (3, 5, "a", "bc"), (4, 5, "ab", "c"),
]


@pytest.mark.parametrize("shard", [op11.SHARD, 30])
@pytest.mark.parametrize("seed", [1, 2])
def test_op11_is_brute_force(spark, shard, seed):
    rows = dialogues(seed)
    df = spark.createDataFrame([(*x, "d", "k") for x in rows], TURNS).repartition(5)
    assert trie_rows(op11.prefix_trie(df, shard)) == brute_trie(rows)


def test_op11_odd_rows(spark):
    df = spark.createDataFrame([(*x, "d", "k") for x in ODD_TURNS], TURNS)
    want = [x for x in ODD_TURNS if x[0] is None or x[0] >= 0]
    got = trie_rows(op11.prefix_trie(df.where("conv_id IS NULL OR conv_id >= 0")))
    assert got == brute_trie(want)
    # Division rounds towards zero: conversation -3 starts like conversation 0, which doesn't exist.
    whole = trie_rows(op11.prefix_trie(df))
    assert [x[3] for x in whole if x[1] == 0] == [len({x[0] for x in ODD_TURNS} - {None})]
    assert op11.prefix_trie(df.where("false")).count() == 0


def test_tree_is_balanced_and_finds_again():
    tree, words = op11.Tree(), list(range(1000))
    paths = {i: tree.path([words[i], 5]) for i in op11.middles(1000)}
    assert sorted(paths) == words
    assert all(tree.path([i, 5]) == p for i, p in paths.items())
    depth, todo = 0, [(tree.down[0], 1)]
    while todo:
        v, d = todo.pop()
        if v:
            depth = max(depth, d)
            todo += [(tree.low[v], d + 1), (tree.high[v], d + 1)]
    assert depth == 10


# --- op12


def brute_repeats(docs):
    first = {}
    rows = [(d, (t or "").encode().split()) for d, t in docs]
    for d, w in rows:
        for s in range(len(w) - 49):
            key = tuple(w[s : s + 50])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in rows:
        gone = set()
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < d:
                gone.update(range(s, s + 50))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        spans = [[i, i + 1] for i in sorted(gone)]
        runs = []
        for a, b in spans:
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest(), tuple(map(tuple, runs))))
    return sorted(out)


def repeat_rows(df):
    out = []
    for r in df.collect():
        runs = []  # spans that touch are one run of removed words
        for x in r.spans:
            if runs and runs[-1][1] == x.start:
                runs[-1][1] = x.end
            else:
                runs.append([x.start, x.end])
        out.append((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, tuple(map(tuple, runs))))
    return sorted(out)


def doc_table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1, "l", "t", "p") for d, t in rows], DOCS)


def passages(seed):
    r = random.Random(seed)
    make = lambda n: [r.choice("abcdefgh") * r.randint(1, 3) for _ in range(n)]
    shared = [make(n) for n in (49, 50, 51, 80, 300)]
    docs = []
    for d in range(60):
        words = make(r.randint(0, 120))
        for _ in range(r.randrange(3)):
            p = r.choice(shared)
            a = r.randrange(max(1, len(p) - 60))
            words += p[a : a + r.randint(40, 200)] + make(r.randint(0, 40))
        docs.append((d, r.choice([" ", "\n", " \t"]).join(words)))
    return docs + [(100 + i, docs[i % 7][1]) for i in range(20)] + [(200, " ".join(["la"] * 500)), (201, " ".join(["la"] * 60)), (202, "é" * 10), (203, None), (204, ""), (5, docs[6][1])]


@pytest.mark.parametrize("group", [op12.GROUP, 1])
def test_op12_is_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(op12, "GROUP", group)
    docs = passages(3)
    got = repeat_rows(op12.repeats(doc_table(spark, docs).repartition(7)))
    assert got == brute_repeats(docs)
    assert sum(x[2] > 0 for x in got) > 30


def test_op12_odd_rows(spark):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(None, long), (3, long), (3, long), (4, f"{long} {long}"), (9, None), (10, " \n")]
    got = {(r.doc_id, r.n_words): r.n_removed for r in op12.repeats(doc_table(spark, rows)).collect()}
    assert got == {(None, 60_000): 0, (3, 60_000): 60_000, (4, 120_000): 120_000, (9, 0): 0, (10, 0): 0}
    assert op12.repeats(doc_table(spark, rows).where("false")).count() == 0


# --- op13


def brute_merkle(docs):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(d, text):
        return sha("".join(map(field, (d["doc_id"], d["source"], d["lang"], d["n_chars"], text))))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            row = levels[-1]
            levels.append([sha("".join(row[i : i + 3])) for i in range(0, len(row), 3)])
        return levels

    def path(levels, i):
        out = []
        for row in levels[:-1]:
            lo = i - i % 3
            out.append(("".join(row[lo:i]), "".join(row[i + 1 : lo + 3])))
            i //= 3
        return out

    by = defaultdict(list)
    for d in docs:
        by[d["source"]].append((d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"]), d))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, h, d) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            way = path(trees[s], i) + path(top, k)
            even = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0
            end = leaf(d, d["text"].replace("\n", "") if even and d["text"] is not None else d["text"])
            for a, b in way:
                end = sha(a + end + b)
            out.append((-1 if d["doc_id"] is None else d["doc_id"], h, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in way)), end, end == top[-1][0]))
    return sorted(out)


def merkle_rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def records(n, sources):
    return [{"doc_id": i, "text": f"text {i}\nline" if i % 3 else "flat", "lang": "en" if i % 4 else None, "source": sources[i % len(sources)], "n_chars": i if i % 5 else None} for i in range(n)]


MERKLE = {
    "one": records(1, ["a"]),
    "odd": [
        {"doc_id": None, "text": "n\n", "lang": None, "source": None, "n_chars": None}, *records(9, ["é", "z", None, "Z", ""]), *records(3, ["z"]), *records(3, ["z"]),
        {"doc_id": 77, "text": "long \n" * 200_000, "lang": "x", "source": "z", "n_chars": 5}, {"doc_id": 78, "text": None, "lang": "", "source": "z", "n_chars": 0},
    ],
    "hot": records(2300, ["hot"] * 9 + ["a", None]),
    "sources": records(1500, [f"s{i}" for i in range(800)]),
}


@pytest.mark.parametrize("name", MERKLE)
def test_op13_is_brute_force(spark, name):
    rows = MERKLE[name]
    df = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"], "l", "t", "p") for d in rows], DOCS).repartition(5)
    got = merkle_rows(op13.merkle(df, op13.tampered()))
    assert got == brute_merkle(rows)
    if len(rows) > 9:
        assert {x[-1] for x in got} == {True, False}


def test_op13_without_tampering_all_is_verified(spark):
    df = spark.createDataFrame([(i, f"x\n{i}", "en", f"s{i % 3}", 1, "l", "t", "p") for i in range(40)], DOCS)
    assert op13.merkle(df).where("verified").count() == 40
    assert op13.merkle(df.where("false")).count() == 0
    swapped = op13.merkle(df, F.when(F.col("doc_id") == 7, F.lit("other")).otherwise(F.col("text")))
    assert [r.doc_id for r in swapped.where("NOT verified").collect()] == [7]


def test_van_emde_boas_addresses():
    for levels in range(1, 8):
        each = [op13.addresses(d, levels) for d in range(levels)]
        assert sorted(itertools.chain(*(x.tolist() for x in each))) == list(range(op13.subtree_size(levels)))
        assert each[0][0] == 0
    # The upper half of the levels comes first; below it each subtree is one stretch.
    top, low = op13.subtree_size(3), op13.subtree_size(4)
    under = [op13.addresses(d, 7).reshape(27, -1) for d in range(3, 7)]
    for k in range(27):
        part = sorted(itertools.chain(*(x[k].tolist() for x in under)))
        assert part == list(range(top + k * low, top + (k + 1) * low))


# --- op10: nothing of a value stays


@pytest.mark.parametrize("value", ["密码密码密码", "contraseña-ñandú", "пароль-ёжик", "κωδικός_μου", "كلمةالسر", "סיסמהסודית", "비밀번호암호", "Abc123!密éя", "!#%&()*+!#", "日本語pass99"])
def test_surrogates_leave_nothing_of_a_secret(value):
    from eventloom.llm import op10_surrogates as op10

    for kind, of in (("secret", value), ("email", f"{value.strip('!#').replace('(', '').replace(')', '') or 'x'}@beispiel.example.org")):
        new = op10.surrogate("k", kind, of)
        a, b = (x.partition("@")[0] if kind == "email" else x for x in (of, new))
        assert a != b
        assert not any(a[i : i + 3] in b for i in range(len(a) - 2) if any(c.isalnum() for c in a[i : i + 3]))
        assert new == op10.surrogate("k", kind, of)
        assert op10.surrogate("k", kind, of, op10.ATTEMPTS).find(a) < 0


def test_surrogates_of_short_and_accented_values():
    from eventloom.llm import op10_surrogates as op10

    assert op10.surrogate("k", "email", "éñü@x.org").partition("@")[0] != "éñü"
    assert not op10.surrogate("k", "given_m", "José").endswith("é")
    iban = "DE" + op10.iban_digits("DE", "370400440532013000") + "370400440532013000"
    assert iban == "DE89370400440532013000"
    new = op10.surrogate("k", "iban", iban)
    assert new != iban
    assert new[2:4] == op10.iban_digits("DE", new[4:])
    found = [(k, v) for _, _, k, v in op10.mentions("I met Mr. Jean-Luc Picard and Mrs. O'Brien. Jean-Luc left.")]
    assert found == [("given_m", "Jean-Luc"), ("family", "Picard"), ("family", "O'Brien"), ("given_m", "Jean-Luc")]


def test_op9_salted_rates_are_the_broadcast_ones(spark, monkeypatch):
    from eventloom.llm import op9_mixing as op9

    df = spark.createDataFrame([(i, f"t{i}", "en", f"s{i % 7}" if i % 11 else None, 1, "l", "t", "p") for i in range(300)], DOCS)
    want = sorted(map(str, op9.mix_sources(df).collect()))
    monkeypatch.setattr(op9, "SOURCES", 0)
    assert sorted(map(str, op9.mix_sources(df).collect())) == want
