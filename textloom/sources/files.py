"""Readers and writers: delimited text, whole files, JSON lines, CoNLL-U, MediaWiki XML, and incremental loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    r"""Tab-separated text without quoting, ``\N`` for null, declared columns; the codec follows the extension."""
    return spark.read.option("sep", "\t").option("quote", "").option("escape", "").option("nullValue", "\\N").schema(schema).csv(path)


def write_tsv(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    r"""The counterpart of ``read_tsv``, one folder for each value of ``by``."""
    writer = df.write.option("sep", "\t").option("quote", "").option("escape", "").option("nullValue", "\\N").option("compression", "gzip")
    (writer.partitionBy(*by) if by else writer).csv(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``, one row for each file."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


CONLLU = ["id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """``(sent_id, text, k, id, form, ... misc)``: every token row in order, those of multiword and empty nodes too."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    comment = lambda name: F.nullif(F.regexp_extract("value", rf"(?m)^# {name} = (.*)$", 1), F.lit(""))
    rows = blocks.select(comment("sent_id").alias("sent_id"), comment("text").alias("text"), F.posexplode(F.filter(F.split("value", "\n"), lambda x: (x != "") & ~x.startswith("#"))).alias("k", "row"))
    cells = F.split("row", "\t")
    return rows.select("sent_id", "text", (F.col("k") + 1).alias("k"), *(cells[n].alias(c) for n, c in enumerate(CONLLU)))


_PAGE = "title string, ns int, id long, redirect struct<_title: string>, revision struct<id: long, timestamp: timestamp, contributor: struct<username: string, ip: string>, text: string>"


def read_wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """``(title, ns, page_id, revision_id, text, redirect, edited, editor, anonymous)`` of each ``<page>``.

    ``redirect`` is the page's target; ``editor`` the name or address of whoever made the last edit. What a page doesn't
    say is null.
    """
    pages = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", False).schema(_PAGE).load(path)
    r = "revision"
    return pages.select(
        "title", "ns", F.col("id").alias("page_id"), F.col(f"{r}.id").alias("revision_id"), F.col(f"{r}.text").alias("text"), F.col("redirect._title").alias("redirect"), F.col(f"{r}.timestamp").alias("edited"),
        F.coalesce(f"{r}.contributor.username", f"{r}.contributor.ip").alias("editor"), F.col(f"{r}.contributor.ip").isNotNull().alias("anonymous"),
    )


def write_wiki_dump(pages: DataFrame, path: str) -> None:
    """The counterpart of ``read_wiki_dump``; columns after ``text`` may be missing."""
    missing = {"redirect": "string", "edited": "timestamp", "editor": "string", "anonymous": "boolean"}
    full = pages.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in pages.columns})
    known = F.coalesce("anonymous", F.lit(False))
    who = F.struct(F.when(~known, F.col("editor")).alias("username"), F.when(known, F.col("editor")).alias("ip"))
    revision = F.struct(F.col("revision_id").alias("id"), F.col("edited").alias("timestamp"), F.when(F.col("editor").isNotNull(), who).alias("contributor"), "text")
    nested = full.select("title", "ns", F.col("page_id").alias("id"), F.when(F.col("redirect").isNotNull(), F.struct(F.col("redirect").alias("_title"))).alias("redirect"), revision.alias("revision"))
    nested.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)


def load_incremental(new: DataFrame, held: DataFrame, key: str, digest: str, number: str) -> DataFrame:
    """Rows of ``new`` with their numbers: known ones (same key and digest) keep theirs, others follow the largest.

    A key whose digest changed makes the job fail, as does one that ``held`` has twice.
    """
    known = held.groupBy(key).agg(F.count("*").alias("__n"), F.first(digest).alias("__digest"), F.first(number).alias(number))
    joined = new.join(known, key, "left")
    fine = F.when(F.col("__n") > 1, F.raise_error(F.lit("a key is held twice"))).when(F.col("__digest") != F.col(digest), F.raise_error(F.lit("a held row has changed"))).otherwise(F.lit(True))
    joined = joined.where(fine).drop("__n", "__digest")
    from textloom.operators.tables import global_rank

    most = F.broadcast(held.agg(F.coalesce(F.max(number), F.lit(0)).alias("__most")))
    fresh = global_rank(joined.where(F.col(number).isNull()).drop(number), [F.col(key)], "__r").join(most)
    return joined.where(F.col(number).isNotNull()).unionByName(fresh.withColumn(number, F.col("__most") + F.col("__r")).drop("__most", "__r"))


def export_sets(tokens: DataFrame, sets: DataFrame, key: str, order: str, **wanted: Sequence) -> DataFrame:
    """Token rows of the sets that pass every filter (column = allowed values), one text block for each set."""
    for column, values in wanted.items():
        sets = sets.where(F.col(column).isin(*values))
    rows = tokens.join(sets.select(key), key, "left_semi")
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"])
    return rows.groupBy(key).agg(F.array_join(lines, "\n").alias("block"))


def match_sentences(new: DataFrame, held: DataFrame) -> DataFrame:
    """``new(sent_id, text, ...)`` with the ``sid`` of each: that of the one held sentence ``(sid, sent_id, text)`` with the
    same id and text, or a new one after the largest. The job fails where a sentence is held twice.

    Missing ids and texts are equal to each other; sentences that repeat in ``new`` share a new number.
    """
    from textloom.operators.tables import global_rank, same_keys

    keys = ["sent_id", "text"]
    known = held.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("sid").alias("sid"))
    kinds = same_keys(new.select(*keys).distinct(), known, keys, "left")
    kinds = kinds.where(F.when(F.col("__n") > 1, F.raise_error(F.lit("a sentence is held twice"))).otherwise(F.lit(True)))
    most = F.broadcast(held.agg(F.coalesce(F.max("sid"), F.lit(0)).alias("__most")))  # one row
    fresh = global_rank(kinds.where("sid is null").select(*keys), [F.col(k) for k in keys], "__r").join(most).select(*keys, (F.col("__most") + F.col("__r")).alias("sid"))
    return same_keys(new, kinds.where("sid is not null").select(*keys, "sid").unionByName(fresh), keys)


def split_cards(rows: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """``rows(collection, split, sent_id, id)`` of CoNLL-U to ``(collection, split, sentences, tokens, words, multiword,
    empty)``, with a row ``total`` for each collection.

    Tokens are words and what stands as one in the text: rows but empty nodes and words of multiword tokens are counted by
    their ids (``3-4``, ``8.1``). ``declared(collection, split, sentences)``: the job fails where a declared size isn't the
    counted one, or where one side has a split that the other lacks.
    """
    multi, empty = F.contains("id", F.lit("-")), F.contains("id", F.lit("."))
    inside = F.when(multi, F.split("id", "-")[1].cast("int") - F.split("id", "-")[0].cast("int") + 1).otherwise(0)
    per = rows.groupBy("collection", "split", "sent_id").agg(F.count_if(~multi & ~empty).alias("words"), F.count_if(multi).alias("multiword"), F.count_if(empty).alias("empty"), F.sum(inside).alias("inside"))
    sums = [F.count("*").alias("sentences"), F.sum(F.col("words") + F.col("multiword") - F.col("inside")).alias("tokens"), *(F.sum(c).alias(c) for c in ("words", "multiword", "empty"))]
    cards = per.groupBy("collection", "split").agg(*sums)
    if declared is not None:
        said = declared.select("collection", "split", F.col("sentences").alias("__said"))
        met = cards.join(said, ["collection", "split"], "full_outer")
        wrong = F.format_string("%s %s: %s sentences counted, %s declared", "collection", "split", F.coalesce(F.col("sentences").cast("string"), F.lit("no")), F.coalesce(F.col("__said").cast("string"), F.lit("no")))
        cards = met.where(F.when(~F.col("sentences").eqNullSafe(F.col("__said")), F.raise_error(wrong)).otherwise(F.lit(True))).drop("__said")
    total = cards.groupBy("collection").agg(*(F.sum(c).alias(c) for c in ("sentences", "tokens", "words", "multiword", "empty"))).withColumn("split", F.lit("total"))
    return cards.unionByName(total)
