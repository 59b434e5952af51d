"""Refusals, edge cases and repetition of loads, cards, lexicon, catalogue, references and tree judgements."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import agreement as ag
from textloom.operators import corpus as cp
from textloom.operators import lookups as lk
from textloom.sources import files as fl


def test_sentences_are_matched_on_id_and_text(spark):
    held = spark.createDataFrame([(4, "a", "x"), (5, "b", "x"), (9, None, "y")], "sid long, sent_id string, text string")
    new = spark.createDataFrame([("a", "x", 1), ("a", "z", 2), ("b", "x", 3), (None, "y", 4), ("c", None, 5), ("a", "z", 6)], "sent_id string, text string, k int")
    got = {r["k"]: r["sid"] for r in fl.match_sentences(new, held).collect()}
    assert (got[1], got[3], got[4]) == (4, 5, 9) and {got[2], got[5]} == {10, 11} and got[6] == got[2]
    with pytest.raises(Exception, match="held twice"):
        fl.match_sentences(new, held.union(held.where("sid = 4"))).collect()
    first = fl.match_sentences(new, held.limit(0)).collect()
    assert sorted({r["sid"] for r in first}) == [1, 2, 3, 4, 5]


def test_cards_refuse_other_sizes(spark):
    ids = ["1-2", "1", "2", "3", "3.1"]
    rows = spark.createDataFrame([("c", s, n, i) for s, n in (("train", 1), ("train", 2), ("dev", 3)) for i in ids], "collection string, split string, sent_id int, id string")
    fine = [("c", "train", 2), ("c", "dev", 1)]
    declare = lambda x: spark.createDataFrame(x, "collection string, split string, sentences long")
    got = {r["split"]: tuple(r[c] for c in ("sentences", "tokens", "words", "multiword", "empty")) for r in fl.split_cards(rows, declare(fine)).collect()}
    assert got == {"train": (2, 4, 6, 2, 2), "dev": (1, 2, 3, 1, 1), "total": (3, 6, 9, 3, 3)}
    for wrong in ([("c", "train", 3), ("c", "dev", 1)], fine[:1], [*fine, ("c", "test", 1)]):
        with pytest.raises(Exception, match="declared"):
            fl.split_cards(rows, declare(wrong)).collect()


def test_personal_tokens(spark):
    yes = ["a.b@mail.org", "Kim_1@x-y.de", "http://a", "HTTPS://b.c", "ftp://x", "mailto:q", "www.x.y", "@kim", "@Kim_1", "202.456.1111", "(202) 456-1111", "+1 202 456 1111", "853-1234", "ab@host"]
    no = ["@", "@1", "s@p", "e@tg", "assh@%$e", "1234", "12-34", "2020-01-01", "word", "", "a@b@", "202 456 111", "1 2 3", None, "www", "x.y.z", "@a b"]
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", tx.personal_token(F.col("t")).alias("p")).collect()
    assert [r["t"] for r in rows if r["p"]] == yes and all(r["p"] is not None for r in rows)


def test_redacting_once_more_changes_nothing(spark):
    lemmas = spark.createDataFrame([(0, "word", "n"), (1, "kim@mail.org", "n"), (2, "853-1234", "x"), (3, "<tag>", "n")], "number long, lemma string, flag string")
    forms = spark.createDataFrame([("words", 0), ("kims@mail.org", 0), ("kim", 1), ("call", 2), ("tags", 3)], "form string, number long")
    one = cp.redact_lexicon(lemmas, forms)
    two = cp.redact_lexicon(*one)
    for got in (one, two):
        assert sorted(map(tuple, got[0].collect())) == [(0, "word", "n"), (1, "<redacted-1>", "-"), (2, "<redacted-2>", "-"), (3, "<tag>", "n")]
        assert sorted(map(tuple, got[1].collect())) == [("tags", 3), ("words", 0)]
    assert cp.redact_lexicon(one[0], forms)[1].count() == 2


def test_dates_and_years_of_death(spark):
    said = {"Wed, 01 Oct 1997 11:48:56 GMT": "1997-10-01", "Mon, 9 Feb 2004 00:00:00 GMT": "2004-02-09", "Wed, 01 Okt 1997 11:48:56 GMT": None, "Wed, 31 Feb 1997 1": None, "1997-10-01": None, "": None, "Wed, 01 anF 1997 x": None}
    rows = spark.createDataFrame([(t,) for t in [*said, None]], "t string").select("t", tx.rfc_date(F.col("t")).cast("string").alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == said | {None: None}
    died = {"Doe, A, 1820-1891": [1891], "A, 1820-1891; B, -1920 (ed.)": [1891, 1920], "C, 70 BCE-8 BCE": [0], "D, 1950-": None, "Anon": None, "": None, ";;": None, "E, 1800-1850; F": None, "G-H, 1801-1870": [1870]}
    rows = spark.createDataFrame([(t,) for t in died], "t string").select("t", tx.death_years(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == died


def test_references_by_levels(spark):
    works = spark.createDataFrame([(1, "d1", None, "The Red and Black", 1990), (2, "d1", "x2", "Of Mice", 1991), (3, None, "x2", "the red, and: black!", 1995), (4, None, None, None, 1990)], "work long, doi string, arxiv string, title string, year long")
    entries = spark.createDataFrame([(1, "d1", "x2", None, None), (2, "d9", "x2", "The red and black", 1990), (3, None, None, "THE RED -- AND BLACK", 1991), (4, None, None, "the red and black", 1992), (5, None, None, "the red and black", 1996), (6, None, None, "Of Mice", 1991), (7, None, None, None, 1990)], "entry long, doi string, arxiv string, title string, year long")
    got = {r["entry"]: (r["work"], r["level"]) for r in lk.resolve_reference(entries, works, "entry", "work", ["doi", "arxiv"], "title", "year").collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (1, 3), 4: (None, None), 5: (3, 3), 6: (None, None), 7: (None, None)}


def test_judged_trees(spark):
    tokens = [(s, i, h, "PUNCT" if i == 4 else "X") for s, heads in ((1, [0, 1, 1, 1]), (2, [0, 0, 1, 1]), (3, [0, 9, 1, 1]), (4, [0, 1, 1, 1]), (5, [0, 1, 1, 1])) for i, h in enumerate(heads, 1)]
    witness = [(1, i, h) for i, h in enumerate([0, 1, 2, 3], 1)] + [(4, i, h) for i, h in enumerate([2, 0, 2, 1], 1)] + [(5, 1, 3)]
    got = ag.judge_trees(spark.createDataFrame([(k,) for k in range(1, 7)], "sid long"), spark.createDataFrame(tokens, "sid long, i long, head long, tag string"), spark.createDataFrame(witness, "sid long, i long, head long"))
    assert {r["sid"]: r["why"] for r in got.collect()} == {2: "roots", 3: "head_outside", 4: "witness", 6: "no_words"}
