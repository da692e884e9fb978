"""Line-first quality rules, built-in functions only.

Every line is judged on its own (punctuation, navigation, boilerplate).  Failing lines are removed, and a document that
loses too much of its text that way is rejected.  Base counts over words and three-word windows are taken beside it.

Defined results: a null text counts as empty; an empty text has no words, fails the base rule and is not kept; repeated
rows are judged alike; an empty table gives an empty table; other columns of the input are carried untouched by
``clean_documents`` and play no part.  Texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signaldesk.llm.common import BLANKS, table

#: The characters counted as symbols, as in the contract of the base rule.
SYMBOLS = "#*$%&|<>"
#: Fixed values of the line rules.
END_MARKS = (".", "!", "?", "\u2026", ":", ";", "\"", "'", "\u201d", "\u00bb", ")", "]")
NAVIGATION = ("^(?i:home|menu|log ?in|log ?out|sign (in|up|out)|register|search|next|previous|back|skip to content|contact( us)?|"
              "about( us)?|site ?map|share( this)?|read more|top|share on [a-z]+|follow us.*|page [0-9]+( of [0-9]+)?)[ .!:]*$")
SEPARATOR = " [|>\u00bb\u2192\u2022] "
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookie settings", "accept cookies",
               "uses cookies", "lorem ipsum", "enable javascript", "javascript is", "subscribe to our", "click here", "powered by", "newsletter")


@dataclass(frozen=True)
class LineRules:
    """Parameters of the line rules and of the final verdict."""

    bare_words: int = 4            # a line of at most so many words needs an end mark
    symbol_share: float = 0.10     # of a line's characters
    mark_share: float = 0.30       # exclamation and question marks per word
    separators: int = 2            # bars, arrows or chevrons that stand alone
    lost_share: float = 0.40       # of the characters of a document's lines


def words_of(text: Column) -> Column:
    """Runs of characters other than space and ASCII controls 9 to 13."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def count_of(text: Column, marks: str) -> Column:
    return F.size(F.split(text, marks)) - 1


def holds_any(low: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | low.contains(phrase)
    return found


def line_passes(bare: Column, cue: Column, rules: LineRules = LineRules()) -> Column:
    """True if a line (without the blanks around it) passes the punctuation, navigation and boilerplate rules.

    ``cue`` says whether the document holds a boilerplate phrase at all; only then are its lines searched for one.
    """
    n_words = count_of(bare, " ") + 1
    punctuation = ((F.right(bare, F.lit(1)).isin(*END_MARKS) | (n_words > rules.bare_words))
                   & (count_of(bare, f"[{SYMBOLS}]") <= F.char_length(bare) * rules.symbol_share)
                   & (count_of(bare, "[!?]") <= n_words * rules.mark_share + 1))
    navigation = bare.rlike(NAVIGATION) | (F.size(F.split(bare, SEPARATOR)) > rules.separators)
    return punctuation & ~navigation & ~(cue & holds_any(F.lower(bare), BOILERPLATE))


_INDEX_BITS = 24


def _window_keys(words: Column, n: Column) -> Column:
    """One number a three-word window, sorted: the upper bits hold a hash of the words, the lower ones the place."""
    low = (1 << _INDEX_BITS) - 1

    def key(i):
        h = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return h.bitwiseAND(F.lit(~low).cast("long")).bitwiseOR(i)

    places = F.when(n > 2, F.sequence(F.lit(0).cast("long"), n - 3)).otherwise(F.array().cast("array<long>"))
    return F.sort_array(F.transform(places, key))


def _long_window_keys(words: Column, n: Column) -> Column:
    """The same for texts with more places than the lower bits can hold: (hash, place) pairs."""
    places = F.sequence(F.lit(0).cast("long"), n - 3)
    return F.sort_array(F.transform(places, lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))


def _covered(words: Column, keys: Column, head, place) -> Column:
    """Words that stand in a window found twice or more.  Neighbours of equal hash are compared word by word."""

    def same(x, y):
        a, b = place(x), place(y)
        equal = (F.get(words, a) == F.get(words, b))
        for k in (1, 2):
            equal = equal & (F.get(words, a + k) == F.get(words, b + k))
        return F.coalesce((head(x) == head(y)) & equal, F.lit(False))

    twice = F.filter(keys, lambda x, j: same(x, F.get(keys, j - 1)) | same(x, F.get(keys, j + 1)))
    starts = F.sort_array(F.transform(twice, place))
    zero = F.struct(F.lit(-3).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(starts, zero, lambda acc, s: F.struct(s.alias("at"), (acc["n"] + F.least(F.lit(3).cast("long"), s - acc["at"])).alias("n")),
                       lambda acc: acc["n"])


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_good_lines", "good_chars", "line_chars")


def judge(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row a document: ``row`` (its own columns as a struct), ``MEASURES`` ``clean_text`` and ``at``."""
    low = F.lit((1 << _INDEX_BITS) - 1).cast("long")
    short = F.col("n_words") < (1 << _INDEX_BITS)

    def chars(lines):
        return F.char_length(F.array_join(lines, "")).cast("long")

    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    df = df.withColumn("w", words_of(F.col("t"))).withColumn("n_words", F.size("w").cast("long"))
    df = df.withColumn("keys", F.when(short, _window_keys(F.col("w"), F.col("n_words"))))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    df = df.withColumn("low", F.lower("t")).withColumn("cue", holds_any(F.col("low"), BOILERPLATE))
    df = df.withColumn("bare", F.transform("lines", lambda x: F.btrim(x, F.lit(BLANKS))))
    df = df.withColumn("good", F.filter("lines", lambda x, i: line_passes(F.get("bare", i), F.col("cue"), rules)))
    repeat = F.when(short, _covered(F.col("w"), F.col("keys"), lambda x: F.shiftright(x, _INDEX_BITS), lambda x: x.bitwiseAND(low))).otherwise(
        _covered(F.col("w"), _long_window_keys(F.col("w"), F.col("n_words")), lambda x: x["h"], lambda x: x["i"]))
    df = df.select(
        "row", "n_words", F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"), count_of(F.col("t"), f"[{SYMBOLS}]").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeat.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), F.size("good").cast("long").alias("n_good_lines"), chars("good").alias("good_chars"), chars("lines").alias("line_chars"),
        F.array_join("good", "\n").alias("clean_text"), F.monotonically_increasing_id().alias("at"))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    lost = F.col("line_chars") - F.col("good_chars")
    return df.withColumn("kept", ~F.col("base_failed") & (lost <= F.col("line_chars") * F.lit(rules.lost_share)))


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Documents that pass, whole and with their own columns."""
    # "at" keeps the planner from copying the whole verdict into a filter below the projections, once for each use.
    return judge(docs, rules=rules).where(F.col("kept") & (F.col("at") >= 0)).select("row.*")


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("row.doc_id", *MEASURES)


_LIST = ", ".join("'" + m.replace("'", "''") + "'" for m in END_MARKS)
_HELD = " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
_R = LineRules()
QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT i, p, count(*) OVER (PARTITION BY i, ws[p], ws[p + 1], ws[p + 2]) AS n FROM (SELECT i, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
reps AS (SELECT i, count(DISTINCT p + k) AS n FROM grams, (SELECT unnest([0, 1, 2]) AS k) WHERE grams.n > 1 GROUP BY i),
g AS (SELECT *, list_filter(lines, lambda l: list_transform([trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))], lambda x:
        (right(x, 1) IN ({_LIST}) OR len(string_split(x, ' ')) > {_R.bare_words})
        AND len(regexp_extract_all(x, '[#*$%&|<>]')) <= length(x) * {_R.symbol_share}
        AND len(regexp_extract_all(x, '[!?]')) <= len(string_split(x, ' ')) * {_R.mark_share} + 1
        AND NOT regexp_matches(x, '{NAVIGATION}') AND len(regexp_split_to_array(x, '{SEPARATOR}')) <= {_R.separators}
        AND NOT ({_HELD}))[1]) AS good FROM w),
m AS (SELECT g.i, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(reps.n, 0) AS n_repeat_words, len(lines) AS n_lines, len(good) AS n_good_lines,
             length(array_to_string(good, '')) AS good_chars, length(array_to_string(lines, '')) AS line_chars FROM g LEFT JOIN reps ON g.i = reps.i)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(line_chars, 0) - coalesce(good_chars, 0) <= coalesce(line_chars, 0) * {_R.lost_share} AS kept,
       n_lines, n_good_lines, coalesce(good_chars, 0) AS good_chars, coalesce(line_chars, 0) AS line_chars
FROM m"""
