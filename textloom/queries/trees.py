"""Agreed trees and matched mentions over the words of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import agreement as ag
from textloom.operators import trees as tr
from textloom.plans.materialize import materialize
from textloom.queries.graphs import _annotated, annotated
from textloom.registry import register, table

# Expressions that Spark and the oracle share: a base tree over the words, then two witnesses and a third.
_BASE = {
    "k": "(length(form) * 3 + i) % 11",
    "rel": "CASE WHEN i = 1 THEN 'root' WHEN k <= 2 THEN 'conj' WHEN k = 3 THEN 'cc' WHEN k = 4 THEN 'punct' WHEN k = 5 THEN 'compound' WHEN k = 6 THEN 'nsubj:pass' WHEN k = 7 THEN 'flat' WHEN k = 8 THEN 'obj' ELSE 'nmod' END",
    "head": "CASE WHEN i = 1 THEN 0 ELSE greatest(1, i - 1 - k % 2) END",
    "upos": "CASE WHEN k = 5 THEN 'ADP' WHEN k = 3 THEN 'CCONJ' WHEN k = 4 THEN 'PUNCT' WHEN k % 4 = 0 THEN 'VERB' ELSE 'NOUN' END",
    "tag": "concat(upos, CASE WHEN length(form) % 2 = 0 THEN 'A' ELSE 'B' END)",
    "feats": "CASE WHEN (length(form) + i) % 3 = 0 THEN 'F=1' ELSE 'F=2' END",
    "lemma": "lower(form)",
}
_ONE = {
    "rel": "CASE WHEN (length(form) + 2 * i) % 5 = 0 THEN 'obl:agent' WHEN rel = 'nsubj:pass' THEN 'nsubj' ELSE rel END",
    "head": "CASE WHEN i = 1 THEN 0 WHEN (length(form) + i) % 4 = 0 THEN i + 1 WHEN (length(form) + i) % 4 = 1 THEN greatest(i - 2, 0) ELSE head END",
    "upos": "CASE WHEN length(form) % 5 = 0 THEN 'VERB' ELSE upos END",
}
_TWO = {
    "rel": "CASE WHEN i % 6 = 0 THEN rel WHEN (length(form) + 2 * i) % 5 = 0 THEN 'obl' ELSE rel END",
    "head": "CASE WHEN i % 7 = 0 THEN head WHEN i = 1 THEN 0 WHEN (length(form) + i) % 4 = 0 THEN i + 1 WHEN (length(form) + i) % 4 = 1 THEN greatest(i - 2, 0) ELSE head END",
    "upos": "CASE WHEN i % 9 <> 0 AND length(form) % 5 = 0 THEN 'VERB' ELSE upos END",
}
_THIRD = {"rel": "CASE WHEN length(form) % 8 = 0 THEN 'pobj' ELSE 'x' END", "head": "CASE WHEN i % 5 = 0 THEN 1 WHEN (length(form) + i) % 4 = 0 THEN i + 1 WHEN (length(form) + i) % 4 = 1 THEN greatest(i - 2, 0) ELSE head END"}
_PUNCT = "CASE WHEN k = 4 THEN ',' ELSE form END"


def _layers() -> str:
    base = "SELECT sid, i, form FROM (" + _annotated(False) + ")"
    for name, said in _BASE.items():
        base = f"SELECT *, {said} AS {name} FROM ({base})"
    witness = lambda w: f"SELECT sid, i, {w['rel']} AS rel, {w['head']} AS head, {w['upos']} AS upos, concat({w['upos']}, CASE WHEN length(form) % 2 = 0 THEN 'A' ELSE 'B' END) AS tag FROM u"
    return f"u AS ({base}), a AS (SELECT * REPLACE ({_PUNCT} AS form) FROM u), b AS ({witness(_ONE)}), c AS ({witness(_TWO)}), t AS (SELECT sid, i, {_THIRD['rel']} AS rel, {_THIRD['head']} AS head FROM u)"


_RULES_SQL = f"""WITH RECURSIVE {_layers()},
    up AS (SELECT sid, i AS conj, head AS above FROM a WHERE rel = 'conj' UNION SELECT up.sid, conj, a.head FROM up JOIN a ON a.sid = up.sid AND a.i = above WHERE a.rel = 'conj'),
    nx AS (SELECT a.sid, a.i, min(conj) AS nx FROM a JOIN up ON up.sid = a.sid AND above = a.head AND conj > a.i WHERE rel IN ('cc', 'punct') AND head > 0 AND head < a.i GROUP BY ALL),
    ff AS (SELECT form, upos, tag, feats, lemma, row_number() OVER (PARTITION BY form, upos, tag ORDER BY count(*) DESC, feats, lemma) AS r FROM a GROUP BY form, upos, tag, feats, lemma),
    ft AS (SELECT upos, tag, feats, row_number() OVER (PARTITION BY upos, tag ORDER BY count(*) DESC, feats) AS r FROM a GROUP BY upos, tag, feats),
    j AS (SELECT a.*, b.head AS h1, c.head AS h2, b.upos AS u1, c.upos AS u2, b.tag AS t1, c.tag AS t2, b.rel AS w1, c.rel AS w2, split_part(b.rel, ':', 1) AS r1, split_part(c.rel, ':', 1) AS r2, split_part(a.rel, ':', 1) AS r0,
          p.rel AS prel, p.head AS phead, p.upos AS pupos, nx, CASE WHEN t.rel = 'pobj' AND t.head > 0 THEN tp.head ELSE t.head END AS h3, EXISTS (SELECT 1 FROM a x WHERE x.sid = a.sid AND x.head = a.i AND x.rel = 'cc') AS cc, ff.feats AS f1, ff.lemma AS l1, ft.feats AS f2
          FROM a JOIN b ON b.sid = a.sid AND b.i = a.i JOIN c ON c.sid = a.sid AND c.i = a.i JOIN t ON t.sid = a.sid AND t.i = a.i LEFT JOIN t tp ON tp.sid = t.sid AND tp.i = t.head LEFT JOIN a p ON p.sid = a.sid AND p.i = a.head LEFT JOIN nx ON nx.sid = a.sid AND nx.i = a.i
          LEFT JOIN ff ON ff.form = a.form AND ff.upos = b.upos AND ff.tag = b.tag AND ff.r = 1 LEFT JOIN ft ON ft.upos = b.upos AND ft.tag = b.tag AND ft.r = 1 WHERE a.rel <> 'flat'),
    k AS (SELECT *, CASE WHEN r1 = r2 THEN r1 END AS w, u1 = u2 AND t1 = t2 AND (u1 <> upos OR t1 <> tag) AND f2 IS NOT NULL AS retag, rel = 'conj' AND cc AS stays FROM j),
    q AS (SELECT *, CASE WHEN rel = 'cc' AND head > 0 AND head < i THEN CASE WHEN h1 = nx OR h2 = nx THEN 'R1-cc-next' END WHEN rel = 'punct' AND head > 0 AND head < i AND (h1 = nx OR h2 = nx) THEN 'R2-punct-next'
        WHEN rel = 'conj' AND prel = 'conj' AND phead > 0 AND h1 = h2 AND h1 = phead THEN 'R3-conj-first' WHEN rel = 'compound' AND upos = 'ADP' AND head > 0 AND head < i AND pupos = 'VERB' THEN 'R4-particle'
        WHEN rel <> 'punct' AND h1 = h2 AND h1 <> head AND h3 = h1 THEN CASE WHEN w IS NOT NULL AND NOT (stays AND w <> 'conj') AND (h1 = 0 OR w <> 'root') THEN 'R5-strong' END
        WHEN rel = 'punct' AND h1 = h2 AND h1 <> head AND h1 > 0 AND w1 = 'punct' AND w2 = 'punct' THEN 'R6-punct-agree'
        WHEN head > 0 AND h1 = head AND h2 = head AND rel <> 'punct' THEN CASE WHEN w <> r0 AND w NOT IN ('root', 'punct') AND NOT stays THEN 'R7-rel-agree' END END AS rule0 FROM k),
    e AS (SELECT *, coalesce(rule0, CASE WHEN retag AND r1 = r0 AND r2 = r0 THEN 'R8-pos-agree' END) AS rule FROM q)"""
_EDITED = """SELECT sid, i, rule, (CASE left(rule, 2) WHEN 'R1' THEN nx WHEN 'R2' THEN nx WHEN 'R3' THEN phead WHEN 'R5' THEN h1 WHEN 'R6' THEN h1 ELSE head END)::BIGINT AS head,
    CASE left(rule, 2) WHEN 'R4' THEN 'compound:prt' WHEN 'R5' THEN CASE WHEN h1 = 0 THEN 'root' WHEN w = r0 THEN rel ELSE w END WHEN 'R7' THEN w ELSE rel END AS rel,
    CASE WHEN retag THEN u1 END AS upos, CASE WHEN retag THEN t1 END AS tag, CASE WHEN retag THEN coalesce(f1, f2) END AS feats, CASE WHEN retag THEN coalesce(l1, lemma) END AS lemma FROM e WHERE rule IS NOT NULL"""


def edits(spark: SparkSession, d: str) -> DataFrame:
    words = annotated(spark, d, False).select("sid", "i", "form")
    for name, said in _BASE.items():
        words = words.withColumn(name, F.expr(said))
    words = materialize(words, "tree-words")  # a base tree is a stored table; its formulas aren't part of the plan
    tag = "concat({}, CASE WHEN length(form) % 2 = 0 THEN 'A' ELSE 'B' END) AS tag"
    one, two = (words.selectExpr("sid", "i", *(f"{said} AS {c}" for c, said in w.items()), tag.format(w["upos"])) for w in (_ONE, _TWO))
    third = words.selectExpr("sid", "i", *(f"{said} AS {c}" for c, said in _THIRD.items()))
    return tr.agreed_edits(words.withColumn("form", F.expr(_PUNCT)).drop("k"), one, two, third)


@register("e6_agreed_edits", f"{_RULES_SQL} {_EDITED}")
def agreed_edits(spark: SparkSession, d: str) -> DataFrame:
    return edits(spark, d)


@register("e6_rule_counts", f"{_RULES_SQL} SELECT rule, count(*) AS edits, count(*) FILTER (retag) AS retagged FROM e WHERE rule IS NOT NULL GROUP BY rule")
def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return tr.rule_counts(edits(spark, d))


def mentions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders are documents; each line is a gold mention and a system mention that is moved and cut."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("mention"), (F.col("l_quantity").cast("long") % 40).alias("first"), (F.col("l_partkey") % 6).alias("n"), F.col("l_suppkey") % 3, "l_returnflag", "l_linestatus")
    gold = l.select("doc", "mention", "first", (F.col("first") + F.col("n")).alias("last"), F.col("l_returnflag").alias("entity"))
    moved = F.col("first") + F.when(F.col("n") % 3 == 0, 0).otherwise(F.col("mention") % 4)
    return gold, l.select("doc", "mention", moved.alias("first"), (moved + F.col("n")).alias("last"), F.col("l_linestatus").alias("entity"))


@register("e10_matched_mentions")
def matched_mentions(spark: SparkSession, d: str) -> DataFrame:
    gold, system = mentions(spark, d)
    return tr.match_mentions(gold.drop("entity"), system.drop("entity"), ["doc"])


@register("e10_matched_scores")
def matched_scores(spark: SparkSession, d: str) -> DataFrame:
    """CEAF-e after matching."""
    gold, system = mentions(spark, d)
    found = tr.matched_entities(gold, system, ["doc"])
    return ag.ceaf_e(found.select("doc", "gold", "system")).select(F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))
