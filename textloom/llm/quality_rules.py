"""Line-first quality rules, in DataFrame functions only.

Every line with a word is judged by itself: closing punctuation, navigation, boilerplate, shouting, symbols, and
repeats of an earlier line. Lines that fail are removed; a document that loses too much of its text is rejected.
Everything is an expression over one row, so there is no shuffle and no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
#: A line has an ended sentence: one inside it, or one at its end, perhaps before a quotation mark or bracket.
CLOSED = r"[.!?] |[.!?:;\x{2026}][\"')\]\x{201D}\x{00BB}]*[ \t\x0B\f\r]*$"
NAVIGATION = r"(?i)^[ \t]*(home|menu|next|previous|back|top|login|log in|sign in|sign up|search|share|skip to content)[ \t.>|]*$"
BOILERPLATE = r"(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie policy|accept cookies|enable javascript|click here|subscribe to our|powered by)"

#: The shares are in hundredths. Words of at least this many characters in a line are needed for its upper-case rule.
LEAST_WORDS = 10
MOST_REPEATED = 20
MOST_LOST = 30
MOST_SYMBOLS = 10
MOST_UPPER = 50
MOST_BARS = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more."""
    starts = F.sequence(F.lit(0), F.size(words) - 5)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(5))))

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("at")))

        def starts_of(pairs: Column) -> Column:
            same = lambda i, x: F.get(pairs, i)["h"] == x["h"]
            twice = F.filter(pairs, lambda x, i: F.coalesce(same(i - 1, x), F.lit(False)) | F.coalesce(same(i + 1, x), F.lit(False)))
            return F.array_sort(F.transform(twice, lambda x: x["at"]))

        def total(at: Column) -> Column:
            zero = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(at, zero, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(5), i - s["last"])).alias("n")), lambda s: s["n"])

        return let(let(pairs, starts_of), total)

    windows = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(windows)


def line_fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule of its own."""
    letters = F.length(_without(_without(line, UPPER.lower()), UPPER))
    upper = F.length(line) - F.length(_without(line, UPPER))
    symbols = F.length(line) - F.length(_without(line, SYMBOLS))
    bars = F.length(line) - F.length(_without(line, "|"))
    ascii_letters = F.length(line) - letters
    shouting = (ascii_letters >= 10) & (100 * upper > MOST_UPPER * ascii_letters)
    return (bars >= MOST_BARS) | (100 * symbols > MOST_SYMBOLS * F.length(line)) | shouting | ~line.rlike(CLOSED) | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE)


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` columns ``doc_id`` and ``text`` to the rules' counts and verdict, one row per row.

    Gives ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, clean_text,
    kept``. A null text counts as an empty one: no words, and so rejected. Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(_without(x, BLANKS)) > 0)
    words = F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), "")
    words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).cast("long").alias("n_repeat_words")))

    def by_line(lines: Column) -> Column:
        distinct = F.array_distinct(lines)
        good = F.filter(distinct, lambda x: ~line_fails(x))
        return F.struct((F.size(lines) - F.size(distinct)).cast("long").alias("n_dup_lines"), F.array_join(good, "\n").alias("clean_text"))

    one = docs.select("doc_id", body.alias("body"), let(lines, by_line).alias("l"), words.alias("w"))
    counts = one.select(
        "doc_id",
        F.col("w.n_words").alias("n_words"),
        F.length(_without(F.col("body"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("body") - F.length(_without(F.col("body"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.col("l.n_dup_lines").alias("n_dup_lines"),
        F.col("w.n_repeat_words").alias("n_repeat_words"),
        F.col("l.clean_text").alias("clean_text"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    lost = F.col("word_chars") - F.length(_without(F.col("clean_text"), BLANKS))
    judged = counts.withColumn("base_failed", failed).withColumn("lost_chars", lost)
    return judged.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept")


_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_LINE_FAILS = f"""(length(x) - length(replace(x, '|', '')) >= {MOST_BARS}
    OR 100 * (length(x) - length(translate(x, '{SYMBOLS}', ''))) > {MOST_SYMBOLS} * length(x)
    OR (length(x) - length(translate(translate(x, '{UPPER.lower()}', ''), '{UPPER}', '')) >= 10
        AND 100 * (length(x) - length(translate(x, '{UPPER}', ''))) > {MOST_UPPER} * (length(x) - length(translate(translate(x, '{UPPER.lower()}', ''), '{UPPER}', ''))))
    OR NOT regexp_matches(x, '{CLOSED.replace("'", "''")}') OR regexp_matches(x, '{NAVIGATION}') OR regexp_matches(x, '{BOILERPLATE}'))"""
QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {
    "op10_quality_rules": f"""
    WITH base AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
    split AS (SELECT doc_id, body, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS w,
              list_filter(string_split(body, chr(10)), lambda x: length(translate(x, {_BLANKS}, '')) > 0) AS lines FROM base),
    runs AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS run
             FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM split)),
    again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n >= 2),
    covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS k FROM again) GROUP BY doc_id),
    kept_lines AS (SELECT doc_id, sum(length(translate(x, {_BLANKS}, ''))) AS good
             FROM (SELECT DISTINCT doc_id, unnest(lines) AS x FROM split) WHERE NOT {_LINE_FAILS} GROUP BY doc_id),
    counted AS (SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(body, {_BLANKS}, '')) AS BIGINT) AS word_chars,
             CAST(length(body) - length(translate(body, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(length(translate(body, {_BLANKS}, '')) - coalesce(k.good, 0) AS BIGINT) AS lost_chars
             FROM split s LEFT JOIN covered c USING (doc_id) LEFT JOIN kept_lines k USING (doc_id))
    SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
           NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept
    FROM counted
    """
}
