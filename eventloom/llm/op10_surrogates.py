"""PII surrogates: each detected entity gets a keyed, type-consistent replacement; distinct ones stay distinct, equal ones equal."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import documents, staged, unstage

#: The registered query's key, if the session sets none; whoever calls pseudonymize gives a key of their own, kept secret.
KEY_SETTING, DEMO_KEY = "spark.eventloom.surrogates.key", "demonstration"
#: Draws of the entity's own format; what clashes that often (its format is all but full) gets a longer one of DIGITS more signs.
ATTEMPTS, DIGITS = 6, 16

#: Given names by script and gender, and family names by script.
NAMES = {
    ("latin", "f"): "Anna Maria Laura Julia Sophie Emma Clara Elena Lucia Marie Sarah Alice Carmen Ines Greta Hannah Linda Susan Karen Nancy".split(),
    ("latin", "m"): "Peter Paul Thomas Martin Lucas David Daniel Pedro Carlos Pierre Louis Hans Karl Oliver James John Robert Michael William Richard".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Юлия Екатерина".split(),
    ("cyrillic", "m"): "Иван Пётр Павел Сергей Андрей Алексей Дмитрий Николай Михаил Олег".split(),
    ("latin", "s"): "Smith Miller Garcia Martin Weber Dubois Lopez Fischer Bernard Moreau Wagner Becker Novak Rossi Jensen Clark Lewis Walker Young Baker".split(),
    ("cyrillic", "s"): "Иванов Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов Волков".split(),
}
TITLES = {"mr": "m", "mister": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "sra": "f", "dr": "", "prof": ""}
GENDER = {n: g for (_, g), names in NAMES.items() if g in "fm" for n in names}

_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
#: A capitalised word, with hyphened parts and an O' or D' before it.
_NAME = rf"(?:[{_UPPER}]['’])?[{_UPPER}][{_LOWER}]+(?:[-'’][{_UPPER}]?[{_LOWER}]+)*"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_KEYWORDS = ("password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "api-key")
SECRET = re.compile(r"\b(?:AKIA[0-9A-Z]{16}\b|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,})")
SECRET_VALUE = re.compile(rf"(?i:\b(?:{'|'.join(_KEYWORDS)})\b[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?)(?P<value>[^\s\"',;]{{6,}})")
EMAIL = re.compile(r"[^\W_](?:[\w.+%-]*[\w+%-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
#: Kinds that a run of digits opens: how many characters before it an entity may start, and its pattern; the first that fits is taken.
NUMBERS = (
    (2, "iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    (1, "phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{8,15})(?!\w)")),
    (0, "ip", re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)")),
    (0, "ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    (0, "card", re.compile(r"(?<![\d-])\d{4}(?P<sep>[ -]?)\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}(?![\d-])|(?<![\d-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\d-])")),
    (0, "phone", re.compile(r"(?<![\w+])\d{2,4}[ .-]\d{3,4}[ .-]?\d{3,4}(?!\w)")),
)
NAME = re.compile(rf"(?i:\b(?:{'|'.join(TITLES)}))\.?[ ]{_NAME}(?:[ ]{_NAME})?|\b(?:{'|'.join(sorted(GENDER))})[ ]{_NAME}")
RUN, CAPITAL = re.compile(r"\d+"), re.compile(rf" [{_UPPER}](?:[{_LOWER}]|['’][{_UPPER}])")
WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
LONGEST = max(map(len, (*TITLES, *GENDER)))

Found = tuple[int, int, str, re.Match]


def next_secret(text: str, pos: int) -> Found | None:
    found = [m for m in (SECRET.search(text, pos), SECRET_VALUE.search(text, pos)) if m]
    m = min(found, key=lambda m: m.start(), default=None)
    return m and (m.start(), m.end(), "secret", m)


def next_email(text: str, pos: int) -> Found | None:
    """Around each at sign: the part before it starts with the first letter or digit of its run."""
    at = text.find("@", pos)
    while at >= 0:
        a = at
        while a > pos and (text[a - 1].isalnum() or text[a - 1] in "_.+%-"):
            a -= 1
        while a < at and not text[a].isalnum():
            a += 1
        if a < at and (m := EMAIL.match(text, a)):
            return a, m.end(), "email", m
        at = text.find("@", at + 1)
    return None


def next_number(text: str, pos: int) -> Found | None:
    """At each run of digits, the kinds in turn."""
    for run in RUN.finditer(text, pos):
        for before, kind, pattern in NUMBERS:
            if (a := run.start() - before) >= pos and (m := pattern.match(text, a)):
                return a, m.end(), kind, m
    return None


def next_name(text: str, pos: int) -> Found | None:
    """At each capital after a space: whether a title or a given name stands before it."""
    for m in CAPITAL.finditer(text, pos):
        e = m.start() - (text[m.start() - 1 : m.start()] == ".")
        w = text[max(pos, e - LONGEST - 1) : e]
        k = len(w)
        while k and w[k - 1].isalpha():
            k -= 1
        if (w[k:].lower() in TITLES or w[k:] in GENDER) and (found := NAME.match(text, e - len(w) + k)):
            return found.start(), found.end(), "name", found
    return None


def finders(text: str) -> list:
    """The searches that may find something in the text, by cheap looks for what each kind must hold."""
    low = text.lower()
    out = []
    if "AKIA" in text or "sk-" in text or "gh" in text and "_" in text or any(w in low for w in _KEYWORDS):
        out.append(next_secret)
    if "@" in text:
        out.append(next_email)
    if RUN.search(text):
        out.append(next_number)
    return [*out, next_name]


def entities(text: str) -> Iterator[Found]:
    """All entities from left to right; of those that start at one place the first kind's. None overlap."""
    pos, ahead = 0, [(f, f(text, 0)) for f in finders(text)]
    while ahead := [(f, m) for f, m in ahead if m]:
        found = min((m for _, m in ahead), key=lambda m: m[0])
        yield found
        pos = found[1]
        ahead = [(f, m if m[0] >= pos else f(text, pos)) for f, m in ahead]


def canonical(kind: str, value: str) -> str:
    """What makes two mentions the same entity: digits of numbers, letters without case of addresses."""
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    return value.lower() if kind == "email" else value


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value): a person's name as its parts, so that a full and a shorter mention agree.

    Once a name is known, its parts are found wherever they stand alone in the text.
    """
    out: list[tuple[int, int, str, str]] = []
    names: dict[str, str] = {}
    for a, b, kind, m in entities(text):
        if kind == "secret" and m.re is SECRET_VALUE:
            out.append((*m.span("value"), kind, m.group("value")))
        elif kind == "name":
            words = [(w.start() + a, w.group(0)) for w in WORD.finditer(m.group(0))]
            gender = ""
            if words[0][1].lower() in TITLES:
                gender = TITLES[words.pop(0)[1].lower()]
            for i, (at, w) in enumerate(words):
                given = len(words) > 1 and i == 0
                part = names.setdefault(w, "family" if not given else "given_" + (GENDER.get(w) or gender or "n"))
                out.append((at, at + len(w), part, w))
        else:
            out.append((a, b, kind, m.group(0)))
    if names:
        taken = [(a, b) for a, b, _, _ in out]
        k = 0
        for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})\b", text):
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if k == len(taken) or m.end() <= taken[k][0]:
                out.append((*m.span(), names[m.group(0)], m.group(0)))
        out.sort()
    return out


def shuffled(key: str, x: int, size: int, tweak: str) -> int:
    """A keyed permutation of range(size): a Feistel network of eight rounds, walked until it falls in the range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(8):
            f = hmac.new(key.encode(), f"{tweak}|{size}|{r}|{b}".encode(), hashlib.sha256).digest()
            a, b = b, a ^ (int.from_bytes(f, "big") & mask)
        x = (a << half) | b
        if x < size:
            return x


def letters(c: str, signs: bool) -> bool:
    """Whether a format leaves c open: letters and digits of any script, and in secrets every sign."""
    return c.isalnum() or signs and not c.isspace() and c not in "\"',;"


@lru_cache(20_000)
def alphabet(c: str, signs: bool = False) -> str:
    """The characters that may stand for c: of its script and case, or digits; in any script those of c's category in its block of 256."""
    if c.isdigit() and c.isascii():
        return "0123456789"
    ranges = (("a", "z"), ("A", "Z"), ("а", "я"), ("А", "Я"))
    for low, high in ranges:
        if low <= c <= high:
            return "".join(map(chr, range(ord(low), ord(high) + 1)))
    if not letters(c, signs):
        return c
    block, kind = ord(c) & ~0xFF, unicodedata.category(c)
    if c.isascii():  # signs, whatever their category
        return "".join(x for x in map(chr, range(0x21, 0x7F)) if not x.isalnum() and letters(x, signs))
    own = (x for x in map(chr, range(block, block + 256)) if unicodedata.category(x) == kind and not x.isascii() and letters(x, signs))
    return "".join(x for x in own if not any(low <= x <= high for low, high in ranges))


def left_over(value: str, new: str) -> bool:
    """Whether a run of three characters of the value, a letter or digit among them, is still in its replacement, or all of a shorter value."""
    if len(value) < 3:
        return value == new
    return any(value[i : i + 3] in new and any(c.isalnum() for c in value[i : i + 3]) for i in range(len(value) - 2)) or value == new


def same_format(key: str, value: str, tweak: str, signs: bool = False) -> str:
    """Another string of the same format. A permutation of all strings of that format, so distinct ones stay distinct."""
    sets = [alphabet(c, signs) for c in value]
    size, x = 1, 0
    for c, s in zip(value, sets, strict=True):
        size *= len(s)
        x = x * len(s) + s.index(c)
    if size == 1:
        return value
    x = shuffled(key, x, size, tweak + "|" + "".join(s[0] for s in sets))
    out = []
    for s in reversed(sets):
        x, k = divmod(x, len(s))
        out.append(s[k])
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def iban_digits(country: str, body: str) -> str:
    """The check digits that make an IBAN's remainder 1."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def keyed(key: str, *parts: object) -> bytes:
    return hmac.new(key.encode(), "|".join(map(str, parts)).encode(), hashlib.sha256).digest()


@lru_cache(100_000)
def surrogate(key: str, kind: str, value: str, attempt: int = 0) -> str:
    """A canonical value's replacement. Never the value itself; the same for every mention; valid for its type.

    From ATTEMPTS on it is longer than the value by DIGITS keyed signs, for then the value's format has no room left.
    """
    if attempt >= ATTEMPTS:
        more = int.from_bytes(keyed(key, kind, value, attempt), "big")
        signs = "0123456789" if value[-1:].isdigit() else "abcdefghijklmnopqrstuvwxyz"
        tail = "".join(signs[more // len(signs) ** i % len(signs)] for i in range(DIGITS))
        if kind == "secret":  # nothing of the value: keyed signs, as long as it and DIGITS more
            return "".join(chr(ord("a") + x % 26) for i in range(len(value) // 32 + 1) for x in keyed(key, kind, value, attempt, i))[: len(value)] + tail
        return tail + value[value.index("@") :] if kind == "email" else same_format(key, value, f"{kind}|{attempt}") + tail
    for step in range(1000):
        tweak = f"{kind}|{attempt}|{step}"
        if kind == "email":
            local, _, domain = value.rpartition("@")
            name, _, top = domain.rpartition(".")
            new = same_format(key, local, tweak)
            if left_over(local, new):
                continue
            out = f"{new}@{same_format(key, name, tweak + local)}.{top}"
        elif kind == "ip":
            x = 0
            for part in value.split("."):
                x = x * 256 + int(part)
            x = shuffled(key, x, 1 << 32, tweak)
            out = ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
        elif kind == "card" and luhn(value):  # a check digit again
            body = same_format(key, value[:-1], tweak)
            out = next(body + c for c in "0123456789" if luhn(body + c))
        elif kind == "phone" and len(value) > 8:  # the first digits are country and area
            out = value[: len(value) - 8] + same_format(key, value[len(value) - 8 :], tweak + value[: len(value) - 8])
        elif kind == "iban" and value[2:4] == iban_digits(value[:2], value[4:]):  # check digits again
            body = same_format(key, value[4:], tweak + value[:2])
            out = value[:2] + iban_digits(value[:2], body) + body
        elif kind == "iban":
            out = value[:2] + same_format(key, value[2:], tweak + value[:2])
        elif kind == "family" or kind.startswith("given"):
            script = "cyrillic" if "а" <= value[0].lower() <= "ё" else "latin"
            names = NAMES[script, "s" if kind == "family" else "m" if kind.endswith("m") else "f"]
            if kind == "given_n":
                names = names + NAMES[script, "m"]
            if value in names and attempt == 0:
                out = names[shuffled(key, names.index(value), len(names), tweak)]
            else:  # a name of the list and a permutation of the value's own letters: distinct for distinct values
                base = names[int.from_bytes(keyed(key, tweak, value)[:8], "big") % len(names)]
                out = base + same_format(key, value, tweak).lower()
        elif kind == "secret" and value.startswith("AKIA"):
            out = "AKIA" + same_format(key, value[4:], tweak)
        elif kind == "secret":
            out = same_format(key, value, tweak, signs=True)
            if left_over(value, out):
                continue
        else:
            out = same_format(key, value, tweak)
        if out != value:
            return out
    return surrogate(key, kind, value, ATTEMPTS + attempt)


def written_as(mention: str, kind: str, new: str) -> str:
    """A canonical surrogate in the mention's format: its punctuation and spaces; what is longer goes on after them."""
    if kind in ("card", "phone", "ssn", "iban"):
        it = iter(new)
        return "".join(next(it, "") if c.isalnum() else c for c in mention) + "".join(it)
    return new


#: A document's mentions: where, of what kind, and the canonical value.
MENTIONS = "mentions array<struct<start: long, end: long, kind: string, value: string>>"


def find_mentions(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, text, mentions (null if there are none)."""
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))
    for rb in batch_iter:
        for lo in range(0, rb.num_rows, 500):
            part = rb.slice(lo, 500)
            found = [[(a, b, k, canonical(k, v)) for a, b, k, v in mentions(t or "")] or None for t in part.column(1).to_pylist()]
            yield pa.record_batch([*part.columns, pa.array(found, shape)], ["doc_id", "text", "mentions"])


def assign(entities: DataFrame, key: str) -> DataFrame:
    """entities(kind, value), distinct -> those whose first surrogate clashes: kind, value, attempt.

    A surrogate clashes if two entities of a kind have it, or if it is itself an entity. The entity with the smallest value
    keeps a shared one; the others draw again until none clashes. Draws after ATTEMPTS come from a far larger space.
    """

    def draw(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batch_iter:
            new = [surrogate(key, k, v, a) for k, v, a in zip(*(c.to_pylist() for c in rb.columns), strict=True)]
            yield pa.record_batch([*rb.columns, pa.array(new, pa.string())], ["kind", "value", "attempt", "new"])

    shape = "kind string, value string, attempt int, new string"
    drawn = staged(entities.select("kind", "value", F.lit(0).alias("attempt")).mapInArrow(draw, shape), "surrogates")
    while True:
        shared = drawn.groupBy("kind", "new").agg(F.min("value").alias("first"), F.count("*").alias("n")).where("n > 1")
        taken = entities.select(F.col("kind").alias("k"), F.col("value").alias("v"))
        lost = drawn.join(shared, ["kind", "new"]).where("value <> first").select("kind", "value", "attempt")
        real = drawn.join(taken, (F.col("kind") == F.col("k")) & (F.col("new") == F.col("v"))).select("kind", "value", "attempt")
        again = staged(lost.union(real).distinct(), "surrogates-again")
        if again.isEmpty():
            return drawn.where("attempt > 0").select("kind", "value", "attempt")
        redrawn = again.withColumn("attempt", F.col("attempt") + 1).mapInArrow(draw, shape)
        kept = drawn.join(again.select("kind", "value"), ["kind", "value"], "left_anti").select(*redrawn.columns)
        new = staged(kept.union(redrawn), "surrogates")
        unstage(drawn, again)
        drawn = new


def rewriter(key: str):
    """doc_id, text, mentions, redrawn -> doc_id, text with surrogates, n_entities, kinds, spans."""

    def rewritten(text: str, found: list[dict], redrawn: list[dict] | None) -> str:
        attempts = {(x["kind"], x["value"]): x["attempt"] for x in redrawn or ()}
        out, at = [], 0
        for x in found:
            entity = x["kind"], x["value"]
            out += [text[at : x["start"]], written_as(text[x["start"] : x["end"]], x["kind"], surrogate(key, *entity, attempts.get(entity, 0)))]
            at = x["end"]
        return "".join([*out, text[at:]])

    def rewrite(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batch_iter:
            for lo in range(0, rb.num_rows, 500):
                part = rb.slice(lo, 500)
                found = part.column(2).to_pylist()
                use = [i for i, x in enumerate(found) if x]
                texts = part.column(1)
                if use:
                    new = texts.to_pylist()
                    for i, redrawn in zip(use, part.column(3).take(pa.array(use)).to_pylist(), strict=True):
                        new[i] = rewritten(new[i], found[i], redrawn)
                    texts = pa.array(new, texts.type)
                kinds = [sorted({x["kind"] for x in f or ()}) for f in found]
                spans = [[[x["start"], x["end"]] for x in f or ()] for f in found]
                yield pa.record_batch(
                    [part.column(0), texts, pa.array([len(f or ()) for f in found], pa.int64()), pa.array(kinds, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                    ["doc_id", "text", "n_entities", "kinds", "spans"],
                )

    return rewrite


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text with surrogates, n_entities, kinds, spans (start and end in characters of the old text).

    Null stays null and empty empty, with no entity; repeated rows are rewritten each, alike; other columns are not read,
    so their names can't clash; an empty table gives an empty result. Texts are searched once; only if documents have
    entities whose first surrogate clashed are those joined, for the number of its draw.
    """
    if not key:
        raise ValueError("a key is needed: who knows it can undo the surrogates")
    found = staged(docs.select("doc_id", "text").mapInArrow(find_mentions, f"doc_id long, text string, {MENTIONS}"), "entities")
    seen = found.where("mentions is not null").select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.kind", "m.value")
    distinct = staged(seen.select("kind", "value").distinct(), "entities-distinct")
    redrawn = staged(assign(distinct, key), "entities-redrawn")
    special = seen.join(redrawn, ["kind", "value"]).groupBy("doc_id").agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("redrawn"))
    special = staged(special, "entities-special")
    unstage(distinct, redrawn)
    out = found.join(special, "doc_id", "left").select("doc_id", "text", "mentions", "redrawn")
    return out.mapInArrow(rewriter(key), "doc_id long, text string, n_entities long, kinds array<string>, spans array<array<long>>")


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, DEMO_KEY)
    return pseudonymize(documents(spark, sf_dir), key).select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))
