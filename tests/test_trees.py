"""Rules of agreed trees one by one, and mention matching against the order stated."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from textloom.operators import trees as tr

BASE = "sid int, i int, form string, lemma string, upos string, tag string, feats string, head int, rel string"
SAID = "sid int, i int, upos string, tag string, head int, rel string"


def sentence(spark, words, one=None, two=None, third=None, keep_third=True):
    """Edits of one sentence of (form, upos, head, rel), with witnesses that differ at the words given: {i: (head, rel, upos)}."""
    base = spark.createDataFrame([(1, i, f, f.lower(), u, f"{u}-t", f"F={u}", h, r) for i, (f, u, h, r) in enumerate(words, 1)], BASE)

    def said(other):
        rows = []
        for i, (_, u, h, r) in enumerate(words, 1):
            h, r, u = (other or {}).get(i, (h, r, u))
            rows.append((1, i, u, f"{u}-t", h, r))
        return spark.createDataFrame(rows, SAID)

    two = one if two is None else two
    got = tr.agreed_edits(base, said(one), said(two), said(one if third is None else third) if keep_third else None)
    return {r["i"]: (r["rule"][:2], r["head"], r["rel"], r["upos"]) for r in got.collect()}


CHAIN = [("runs", "VERB", 0, "root"), (",", "PUNCT", 1, "punct"), ("walks", "VERB", 1, "conj"), ("and", "CCONJ", 3, "cc"), ("up", "ADP", 3, "compound"), ("sits", "VERB", 3, "conj")]


def test_coordination(spark):
    got = sentence(spark, CHAIN, {4: (6, "cc", "CCONJ"), 2: (3, "punct", "PUNCT"), 6: (1, "conj", "VERB")}, two={6: (1, "conj", "VERB")})
    assert got == {2: ("R2", 3, "punct", None), 4: ("R1", 6, "cc", None), 5: ("R4", 3, "compound:prt", None), 6: ("R3", 1, "conj", None)}
    # no witness picks the conjunct: the case of R1 makes no edit, and no later rule takes its place
    assert sentence(spark, CHAIN, {4: (1, "mark", "CCONJ")}) == {5: ("R4", 3, "compound:prt", None)}


def test_a_cycle_of_conjuncts_ends(spark):
    words = [("a", "VERB", 0, "root"), ("b", "VERB", 3, "conj"), ("c", "VERB", 2, "conj"), ("and", "CCONJ", 3, "cc"), ("d", "VERB", 2, "conj")]
    assert sentence(spark, words, {4: (5, "cc", "CCONJ")})[4] == ("R1", 5, "cc", None)


PLAIN = [("she", "PRON", 2, "nsubj"), ("eats", "VERB", 0, "root"), ("red", "ADJ", 2, "obl:tmod"), ("figs", "NOUN", 2, "obj"), (".", "PUNCT", 2, "punct")]


def test_heads_and_relations(spark):
    assert sentence(spark, PLAIN, {3: (4, "amod", "ADJ")}) == {3: ("R5", 4, "amod", None)}
    assert sentence(spark, PLAIN, {3: (4, "obl", "ADJ")}) == {3: ("R5", 4, "obl:tmod", None)}, "the subtype stays"
    assert sentence(spark, PLAIN, {3: (4, "amod:x", "ADJ")}, two={3: (4, "amod", "ADJ")})[3] == ("R5", 4, "amod", None)
    assert sentence(spark, PLAIN, {3: (4, "amod", "ADJ")}, third={}) == {} == sentence(spark, PLAIN, {3: (4, "amod", "ADJ")}, keep_third=False)
    assert sentence(spark, PLAIN, {3: (4, "amod", "ADJ")}, third={3: (4, "pobj", "ADJ"), 4: (2, "prep", "NOUN")}) == {}, "pobj is lifted to the verb"
    assert sentence(spark, PLAIN, {3: (4, "dep", "ADJ")}) == {} == sentence(spark, PLAIN, {3: (4, "root", "ADJ")})
    assert sentence(spark, PLAIN, {4: (0, "obj", "NOUN")})[4] == ("R5", 0, "root", None)
    assert sentence(spark, PLAIN, {5: (4, "punct", "PUNCT")}) == {5: ("R6", 4, "punct", None)}
    assert sentence(spark, PLAIN, {4: (2, "iobj", "NOUN")}) == {4: ("R7", 2, "iobj", None)}
    assert sentence(spark, PLAIN, {4: (2, "iobj", "NOUN")}, two={4: (2, "obl", "NOUN")}) == {}


def test_tags_and_frozen_words(spark):
    assert sentence(spark, PLAIN, {3: (2, "obl", "NOUN")}) == {3: ("R8", 2, "obl:tmod", "NOUN")}
    assert sentence(spark, PLAIN, {3: (2, "amod", "NOUN")}) == {3: ("R7", 2, "amod", "NOUN")}, "rides on the other edit"
    assert sentence(spark, PLAIN, {3: (1, "obl", "NOUN")}, two={3: (2, "amod", "NOUN")}) == {}, "not alone under another relation"
    assert sentence(spark, PLAIN, {3: (2, "obl", "INTJ")}) == {}, "tags that the base never uses"
    for frozen in [("red", "X", 2, "obl"), ("red", "ADJ", 2, "flat"), ("red", "ADJ", None, "obl"), ("red", "ADJ", 2, None)]:
        assert 3 not in sentence(spark, [*PLAIN[:2], frozen, *PLAIN[3:]], {3: (4, "amod", "NOUN")})
    conj = [("he", "PRON", 2, "nsubj"), ("is", "VERB", 0, "root"), ("or", "CCONJ", 4, "cc"), ("was", "VERB", 2, "conj")]
    assert sentence(spark, conj, {4: (2, "advcl", "VERB")}) == {}, "a conjunct with its own cc stays one"
    assert tr.agreed_edits(spark.createDataFrame([], BASE), spark.createDataFrame([], SAID), spark.createDataFrame([], SAID)).count() == 0


def test_the_most_frequent_analysis(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "z"), ("b", "w"), ("c", None)], "k string, v string")
    assert {r["k"]: r["v"] for r in tr.most_frequent(rows, ["k"], ["v"]).collect()} == {"a": "y", "b": "w"}


def test_mentions_are_matched_in_order(spark):
    rng = random.Random(5)
    rows = {side: [(doc, m, a := rng.randrange(12), a + rng.randrange(5)) for doc in range(40) for m in range(rng.randrange(9))] for side in ("gold", "system")}
    rows["system"] += [(90, 1, 0, 3), (91, 1, None, 2)]
    schema = "doc int, mention int, first int, last int"
    got = tr.match_mentions(*(spark.createDataFrame(rows[s], schema) for s in ("gold", "system")), ["doc"])
    want = set()
    for doc in range(40):
        g, s = ([r[1:] for r in rows[side] if r[0] == doc] for side in ("gold", "system"))
        left_g, left_s = list(g), list(s)
        for x in s:
            same = next((y for y in left_g if y[1:] == x[1:]), None)
            if same:
                left_g.remove(same)
                left_s.remove(x)
                want.add((doc, x[0], same[0], True))
        edges = sorted((-(min(x[2], y[2]) - max(x[1], y[1]) + 1), x[0], y[0]) for x in left_s for y in left_g if min(x[2], y[2]) >= max(x[1], y[1]))
        used_g, used_s = set(), set()
        for _, x, y in edges:
            if x not in used_s and y not in used_g:
                used_s.add(x)
                used_g.add(y)
                want.add((doc, x, y, False))
    assert {(r["doc"], r["system"], r["gold"], r["exact"]) for r in got.collect()} == want and len(want) > 60
    empty = spark.createDataFrame([], schema)
    assert tr.match_mentions(empty, empty, ["doc"]).count() == 0


def test_matched_entities_keep_every_mention_once(spark):
    schema = "doc int, mention int, first int, last int, entity string"
    gold = spark.createDataFrame([(1, 1, 0, 2, "A"), (1, 2, 5, 6, "B")], schema)
    system = spark.createDataFrame([(1, 1, 1, 2, "p"), (1, 2, 9, 9, "q"), (1, 3, 0, 2, "q")], schema)
    got = tr.matched_entities(gold, system, ["doc"]).select(F.coalesce("gold", F.lit("-")), F.coalesce("system", F.lit("-"))).collect()
    assert sorted(map(tuple, got)) == [("-", "p"), ("-", "q"), ("A", "q"), ("B", "-")]
