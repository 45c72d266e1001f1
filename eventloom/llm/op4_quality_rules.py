"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import documents

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for it as was with on be by at are this from or an "
    "le la les de des du et en un une que qui dans pour par sur est pas au avec "
    "der die das und zu den von mit ist im ein eine nicht auf sich dem für es auch "
    "el los las y del se por con para su lo como más no al a"
).split()

#: (rule, measure, least, most): a text is kept if every measure lies within its bounds.
RULES = (
    ("length", "n_words", 20, None),
    ("word_length", "mean_word_chars", 2.0, 14.0),
    ("symbols", "symbol_ratio", None, 0.4),
    ("stop_words", "stop_ratio", 0.02, None),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
    ("repeated_words", "repeat_ratio", None, 0.30),
)
WINDOW = 8


def window_hashes(hashes: Column, width: int = WINDOW) -> Column:
    """A hash of each window of so many words, from the words' hashes; null if there are fewer words."""
    n = F.size(hashes)
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)])))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures to df, in columns of their own. Null text: no words. Names that clash are replaced."""
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_words", F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+"), ""))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long"),
        "_lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "_wh": F.transform("_words", lambda w: F.xxhash64(w)),
        "_stop": F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS + [w.capitalize() for w in STOP_WORDS]))),
    })
    df = df.withColumn("_h", window_hashes(F.col("_wh")))
    df = df.withColumns({"n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_twice": F.size(F.array_distinct("_h")) < F.size("_h")})
    # Only texts with a repeated window sort their windows by (hash, place).
    df = df.withColumn("_s", F.when(F.col("_twice"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: F.coalesce(F.get("_s", i)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns({
        "mean_word_chars": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "stop_ratio": F.col("_stop") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
    }).drop("_t", "_words", "_wh", "_lines", "_h", "_s", "_p", "_stop", "_twice")


def compiled(rules=RULES) -> tuple[Column, Column]:
    """The table's verdict, and the names of the rules that a row breaks. No rule: all rows are kept."""
    ok = [(name, F.lit(True) if lo is None else F.col(m) >= lo, F.lit(True) if hi is None else F.col(m) <= hi) for name, m, lo, hi in rules]
    verdict = F.lit(True)
    for _, a, b in ok:
        verdict = verdict & a & b
    return verdict, F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(~(a & b), F.lit(name)) for name, a, b in ok]))


def quality(df: DataFrame, rules=RULES, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """df(doc_id, text) -> doc_id, the measures, base_failed, kept, broken. One row for each row of df.

    Null or empty text has no words and fails; repeated rows are judged each; other columns are left out, so that
    their names can't clash, but for those named in keep. No shuffle: a projection over the scan.
    """
    df = measures(df.select("doc_id", F.col(text).alias("text"), *keep))
    verdict, broken = compiled(rules)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumns({"base_failed": base, "kept": ~base & verdict, "broken": broken}).drop("text")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), m AS (
  SELECT doc_id, words, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    len(list_filter(words, lambda x: list_contains([STOP], x))) AS stop
  FROM w
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), p AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
), r AS (SELECT doc_id, sum(least(8, coalesce(j - i, 8))) AS n FROM p GROUP BY doc_id
), a AS (
  SELECT m.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, greatest(len(lines), 1) AS n_lines, greatest(n_words, 1) AS d, stop
  FROM m LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND word_chars / d BETWEEN 2.0 AND 14.0 AND n_symbols / d <= 0.4
    AND stop / d >= 0.02 AND n_dup_lines / n_lines <= 0.5 AND n_repeat_words / d <= 0.30 AS kept
FROM a
""".replace("STOP", ", ".join(f"'{w}'" for w in STOP_WORDS + [w.capitalize() for w in STOP_WORDS]))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
