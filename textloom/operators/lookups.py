"""Joins by rule: edge words, best matches, references by levels of keys, versions, edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edge_word_join(texts: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """Texts that equal a word, or start or end with it as a word: an equi-join on first and last words."""
    parts = F.split(text, " ")
    ends = texts.select(text, F.explode(F.array_distinct(F.array(parts[0], F.element_at(parts, -1)))).alias(word))
    return ends.join(words, word).select(text, word)


def best_match(words: DataFrame, key: str, items: DataFrame, item: str, rank: str) -> DataFrame:
    """Each word with the item of its key that ranks highest, the smallest item of equals."""
    best = items.groupBy(key).agg(F.max_by(item, F.struct(rank, -F.col(item))).alias(item))
    return words.join(best, key)


def normal_title(title: Column, least: int = 3) -> Column:
    """Lower-case words of a title, null if there are fewer than ``least``."""
    w = F.regexp_extract_all(F.lower(title), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.when(F.size(w) >= least, F.array_join(w, " "))


def resolve_reference(entries: DataFrame, works: DataFrame, entry: str, work: str, keys: Sequence[str], title: str, year: str) -> DataFrame:
    """``(entry, work, level)``: the work of each of ``entries(entry, keys..., title, year)`` among ``works(work, ...)``.

    The first level that has one wins: the same value of the first of ``keys``, of the next, ..., and at last the same
    normalised title of three words or more with a year at most one apart, met by joining the three years around it. Of
    several works of a level the least id counts; missing values match nothing; entries without a work have nulls.
    """
    found = entries.select(entry, *keys, normal_title(F.col(title)).alias("__title"), F.col(year).alias("__year"))
    for k, key in enumerate(keys, 1):
        found = found.join(works.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(work).alias(f"__w{k}")), key, "left")
    around = works.select(work, normal_title(F.col(title)).alias("__title"), F.explode(F.sequence(F.col(year) - 1, F.col(year) + 1)).alias("__year")).where("__title is not null")
    last = len(keys) + 1
    found = found.join(around.groupBy("__title", "__year").agg(F.min(work).alias(f"__w{last}")), ["__title", "__year"], "left")
    hits = [F.col(f"__w{k}") for k in range(1, last + 1)]
    level = F.coalesce(*(F.when(h.isNotNull(), F.lit(k)) for k, h in enumerate(hits, 1)))
    return found.select(entry, F.coalesce(*hits).alias(work), level.alias("level"))


def version_chain(df: DataFrame, key: str, order: Sequence[str], item: str) -> DataFrame:
    """Each row with the one it replaces and the one that replaces it; rows without the latter are current."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.select(key, item, F.lag(item).over(w).alias("replaces"), F.lead(item).over(w).alias("replaced_by"))


def _pieces(length: Column, radius: int, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and size of piece ``i`` when a word is cut into radius + 1 pieces of even sizes, long ones last."""
    base, long = F.floor(length / (radius + 1)).cast("int"), length % (radius + 1)
    from_ = F.lit(radius + 1) - long
    return i * base + F.greatest(F.lit(0), i - from_), base + F.when(i >= from_, 1).otherwise(0)


def _shortened(word: Column, radius: int) -> Column:
    """All that is left of a word when up to ``radius`` of its letters go."""
    out = last = F.array(word)
    for _ in range(radius):
        cut = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        last = F.array_distinct(F.flatten(F.transform(F.filter(last, lambda x: F.length(x) > 0), cut)))
        out = F.array_union(out, last)
    return out


def within_edits(words: DataFrame, word: str, radius: int) -> DataFrame:
    """Pairs (a, b, distance) of different words, a < b, that are at most ``radius`` edits apart.

    A word is cut into radius + 1 pieces, one of which any word within the radius has unchanged, and only at a few
    places: with d letters more, piece i stands at most i places to the left or right, and at most radius - i places
    from where d letters more would move it. Words meet on (length, i, piece) and are then measured with the radius as
    bound. Words too short for pieces meet on what is left of them without up to ``radius`` letters; those of no more
    letters than the radius are all within it. Null words are left out, repeated ones count once.
    """
    known = words.where(F.col(word).isNotNull()).select(F.col(word).alias("w"), F.length(word).alias("n")).distinct()
    c, every = F.col, F.explode(F.sequence(F.lit(0), F.lit(radius)))
    long = known.where(c("n") > radius)
    start, size = _pieces(c("n"), radius, c("i"))
    index = long.select("w", "n", every.alias("i")).select(c("w").alias("b"), c("n").alias("length"), "i", F.substring(c("w"), start + 1, size).alias("piece"))
    start, size = _pieces(c("length"), radius, c("i"))
    probes = long.select("w", "n", F.explode(F.sequence(F.greatest(c("n") - radius, F.lit(radius + 1)), "n")).alias("length")).select("*", every.alias("i"))
    more, rest = c("n") - c("length"), F.lit(radius) - c("i")
    low = F.greatest(F.lit(0), start - c("i"), start + more - rest)
    high = F.least(c("n") - size, start + c("i"), start + more + rest)
    probes = probes.withColumns({"low": low, "high": high, "size": size}).where("high >= low").select("w", "length", "i", "size", F.explode(F.sequence("low", "high")).alias("at"))
    probes = probes.select(c("w").alias("a"), "length", "i", F.substring(c("w"), c("at") + 1, c("size")).alias("piece"))
    met = probes.join(index, ["length", "i", "piece"]).select("a", "b")
    short = known.where(c("n") <= 2 * radius).select("w", "n", F.explode(_shortened(c("w"), radius)).alias("left"))
    tiny = short.where(c("n") <= radius).select(c("w").alias("a"), "left")
    met = met.union(tiny.join(short.select(c("w").alias("b"), "left"), "left").select("a", "b"))
    pairs = met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", radius).cast("long")).where("distance >= 0")
