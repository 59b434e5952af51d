"""Reproducible samples and splits: every choice follows from a salted hash of an id, never from row order."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.tables import counted_ranks
from textloom.plans.materialize import materialize


def hash_order(key: Column, salt: str) -> Column:
    """A whole number below 2**32 from a salted SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), 1, 8), 16, 10).cast("long")


def split_of(key: Column, salt: str, train: int = 80, dev: int = 10) -> Column:
    at = hash_order(key, salt) % 100
    return F.when(at < train, "train").when(at < train + dev, "dev").otherwise("test")


def first_by_hash(df: DataFrame, strata: Sequence[str], key: str, n: int, salt: str) -> DataFrame:
    """The first ``n`` rows of each stratum in hash order (kept to n in each task before the shuffle)."""
    w = Window.partitionBy(*strata).orderBy(hash_order(F.col(key), salt), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def nested_tiers(df: DataFrame, stratum: str, key: str, tiers: dict[str, int], salt: str) -> DataFrame:
    """Whether a row is in each tier, the first ceil(n / divisor) of its stratum; smaller tiers lie in larger ones."""
    w = Window.partitionBy(stratum)
    ranked = df.select(stratum, key, F.row_number().over(w.orderBy(hash_order(F.col(key), salt), key)).alias("__r"), F.count("*").over(w).alias("__n"))
    return ranked.select(stratum, key, *((F.col("__r") <= F.ceil(F.col("__n") / divisor)).alias(name) for name, divisor in tiers.items()))


def _kth_largest(df: DataFrame, value: str, k: int, top: int) -> tuple[int, int]:
    """The k-th largest of whole numbers from 0 to below ``top``, and how many are larger: the range is narrowed by
    histograms of at most 256 bins, which are all that the driver sees."""
    low, high, above = 0, top, 0
    while True:
        width = max(1, -(-(high - low) // 256))
        bins = df.where((F.col(value) >= low) & (F.col(value) < high)).groupBy(F.expr(f"({value} - {low}L) div {width}L").alias("bin")).agg(F.count("*").alias("n")).collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high = low + r["bin"] * width, min(high, low + (r["bin"] + 1) * width)
                break
            above += r["n"]
        if width == 1:
            return low, above


def quotas(groups: DataFrame, name: str, size: str, room: str, wanted: int) -> DataFrame:
    """``groups(name, size, room)`` with the ``seats`` of each: ``wanted`` in all by largest remainder of the sizes, the
    smaller name of equals, and no group more than its room; what full groups can't take is shared among the others.

    Names are different and not null, and a group with room has a size. A round is a few aggregates over the groups: the
    remainder that still gets a seat is found by histograms, so that no table of groups is read by the driver.
    """
    now = materialize(groups.select(name, F.col(size).cast("long").alias("__n"), F.col(room).cast("long").alias("__room"), F.lit(0).cast("long").alias("seats")), "seats")
    left = min(wanted, now.agg(F.coalesce(F.sum("__room"), F.lit(0))).first()[0])
    while left:
        active = now.where("seats < __room")
        total = active.agg(F.sum("__n")).first()[0]
        part = f"cast({left} as decimal(19,0)) * cast(__n as decimal(19,0))"
        dealt = materialize(active.select(name, F.expr(f"cast({part} div {total} as bigint)").alias("__share"), F.expr(f"cast({part} % {total} as bigint)").alias("__rest")), "shares")
        spare = left - dealt.agg(F.sum("__share")).first()[0]
        more = F.lit(False)
        if spare:
            cut, above = _kth_largest(dealt, "__rest", spare, total)
            ties = dealt.where(F.col("__rest") == cut)
            if ties.count() == spare - above:
                more = F.col("__rest") >= cut
            else:
                last = counted_ranks(ties, [], name).where(F.col("__upto") == spare - above).first()[name]
                more = (F.col("__rest") > cut) | ((F.col("__rest") == cut) & (F.col(name) <= last))
        given = F.least(F.col("__share") + F.when(more, 1).otherwise(0), F.col("__room") - F.col("seats"))
        before = now.agg(F.sum("seats")).first()[0]
        now = materialize(now.join(dealt, name, "left").select(name, "__n", "__room", (F.col("seats") + F.coalesce(given, F.lit(0))).alias("seats")), "seats")
        left -= now.agg(F.sum("seats")).first()[0] - before
    return now.select(name, F.col("__n").alias(size), "seats")


def stratified_select(books: DataFrame, paragraphs: DataFrame, wanted: int, salt: str) -> DataFrame:
    """``wanted`` of ``paragraphs(book, doc, key, kind)``, shared among ``books(book, size)`` by their sizes.

    A book gives no more than it has. Half of its seats go to paragraphs with ``kind`` true and half to the others; where
    one kind is short the other fills up. Within a kind the documents take turns: each gives its first paragraph by
    hash before any gives its second, documents by hash too. A kind of a book may be most of the rows: turns are ranks
    over ranges. Keys are different; a null kind counts as false.
    """
    rows = paragraphs.select("book", "doc", "key", F.coalesce("kind", F.lit(False)).alias("kind"))
    have = rows.groupBy("book").agg(F.count("*").alias("room"), F.count_if("kind").alias("n_kind"))
    seats = quotas(books.join(have, "book"), "book", "size", "room", wanted).join(have, "book")
    first = F.least(F.floor(F.col("seats") / 2), F.col("n_kind"))
    other = F.least(F.col("seats") - first, F.col("room") - F.col("n_kind"))
    seats = seats.select("book", F.least(F.col("seats") - other, F.col("n_kind")).alias("of_kind"), other.alias("of_other"))
    turn = F.row_number().over(Window.partitionBy("book", "doc", "kind").orderBy(hash_order(F.col("key"), salt), "key"))
    placed = rows.withColumn("turn", F.struct(turn.alias("turn"), hash_order(F.col("doc"), salt).alias("h"), "doc", "key"))
    ranks = counted_ranks(placed, ["book", "kind"], "turn").join(seats, "book")
    return ranks.where(F.col("__upto") <= F.when(F.col("kind"), F.col("of_kind")).otherwise(F.col("of_other"))).select("book", "turn.doc", "turn.key", "kind", F.col("__upto").alias("place"))


def pick_examples(df: DataFrame, word: str, doc: str, order: str, n: int) -> DataFrame:
    """Up to ``n`` examples of each word, one of each document before a second of any."""
    inside = df.withColumn("in_doc", F.row_number().over(Window.partitionBy(word, doc).orderBy(order)))
    ranked = inside.withColumn("r", F.row_number().over(Window.partitionBy(word).orderBy("in_doc", doc, order)))
    return ranked.where(F.col("r") <= n).select(word, doc, order, F.col("r").cast("long").alias("r"))


def diverse_examples(df: DataFrame, word: str, doc: str, order: str, text: str, n: int, candidates: int = 50, alike: float = 0.8) -> DataFrame:
    """Examples as ``pick_examples`` gives them, but without one whose words are mostly those of an earlier one.

    Sentences of 6 to 40 words come first. Words that lack examples go on to further rounds until nothing is left; a
    round looks at ``candidates`` of each word, then at twice as many, up to 10,000. Equal texts count once.
    """
    fits = F.size(F.split(text, " ")).between(6, 40)
    inside = df.withColumn("fits", fits).withColumn("in_doc", F.row_number().over(Window.partitionBy(word, doc, "fits").orderBy(order)))
    ranked = inside.withColumn("r", F.row_number().over(Window.partitionBy(word).orderBy(F.desc("fits"), "in_doc", doc, order)))
    firsts = ranked.withColumn("copy", F.row_number().over(Window.partitionBy(word, text).orderBy("r"))).where("copy = 1")
    left = firsts.select(word, doc, order, text, F.row_number().over(Window.partitionBy(word).orderBy("r")).alias("r"))
    left = materialize(left, "examples")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        kept, sets = [], []
        for r in rows.sort_values("r").itertuples():
            if len(kept) == n:
                break
            words = set(getattr(r, text).lower().split())
            if not any(len(words & s) >= alike * len(words | s) for s in sets):
                kept.append(r.Index)
                sets.append(words)
        return rows.loc[kept]

    # Those kept so far have the lowest ranks, so that they are chosen again before any new one.
    kept, past = left.limit(0), 0
    while not left.isEmpty():
        past += candidates
        now = kept.unionByName(left.where(F.col("r") <= past))
        kept = materialize(now.groupBy(word).applyInPandas(choose, left.schema), "examples-kept")
        full = kept.groupBy(word).agg(F.count("*").alias("n")).where(F.col("n") >= n).select(word)
        left = materialize(left.where(F.col("r") > past).join(full, word, "left_anti").select(left.columns), "examples")
        candidates = min(2 * candidates, 10_000)
    return kept.select(word, doc, order)
