"""Graph, agreement, join and catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import agreement as ag
from textloom.operators import graph as gr
from textloom.operators import lookups as lk
from textloom.operators.components import connected_components
from textloom.registry import register, table


def parents(spark: SparkSession, d: str) -> DataFrame:
    """Customers under the one of half their number: a tree."""
    c = table(spark, d, "customer").where("c_custkey > 0")
    return c.select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 2).alias("parent"))


_TREE = "WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 0), t(node, ancestor, depth) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT node, parent, depth + 1 FROM t JOIN e ON e.child = t.ancestor)"


@register("g1_ancestors", f"{_TREE} SELECT node, ancestor, depth FROM t WHERE node IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("node"))
    return gr.closure(parents(spark, d), starts)


@register("g2_closure", f"{_TREE} SELECT node, ancestor, depth FROM t")
def closure(spark: SparkSession, d: str) -> DataFrame:
    return gr.closure(parents(spark, d))


@register("j10_closure_categories", f"{_TREE}, u AS (SELECT node, ancestor, depth FROM t UNION ALL SELECT c_custkey, c_custkey, 0 FROM customer) SELECT node, c_mktsegment AS category, min(depth) AS depth FROM u JOIN customer ON c_custkey = ancestor GROUP BY ALL")
def closure_categories(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    own = c.select(F.col("c_custkey").alias("node"), F.col("c_custkey").alias("ancestor"), F.lit(0).alias("depth"))
    named = c.select(F.col("c_custkey").alias("ancestor"), F.col("c_mktsegment").alias("category"))
    return gr.closure(parents(spark, d)).unionByName(own).join(named, "ancestor").groupBy("node", "category").agg(F.min("depth").alias("depth"))


@register("j10_closure_categories_whole", f"{_TREE}, u AS (SELECT node, ancestor, depth FROM t UNION ALL SELECT c_custkey, c_custkey, 0 FROM customer) SELECT node, c_mktsegment AS category, min(depth) AS depth FROM u JOIN customer ON c_custkey = ancestor GROUP BY ALL")
def closure_categories_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same rows as ``j10_closure_categories``, which once left ancestors out."""
    return closure_categories(spark, d)


@register("g3_strong_components")
def strong(spark: SparkSession, d: str) -> DataFrame:
    return gr.strongly_connected(order_edges(spark, d))


def order_edges(spark: SparkSession, d: str) -> DataFrame:
    """A part leads to the next part (by line) of the same order."""
    l = table(spark, d, "lineitem")
    return l.alias("x").join(l.alias("y"), "l_orderkey").where("x.l_linenumber + 1 = y.l_linenumber").select(F.col("x.l_partkey").alias("src"), F.col("y.l_partkey").alias("dst")).distinct()


@register("g4_topological_levels", f"{_TREE}, h AS (SELECT ancestor AS node, max(depth) AS level FROM t GROUP BY ancestor) SELECT node, level FROM h UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT node FROM h)")
def levels(spark: SparkSession, d: str) -> DataFrame:
    return gr.topological_levels(parents(spark, d).select(F.col("child").alias("src"), F.col("parent").alias("dst")))[0]


@register("g5_components", """WITH RECURSIVE e AS (SELECT DISTINCT x.c_custkey AS u, x.c_custkey + 60 AS v FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 60 WHERE x.c_nationkey <> 3), t AS (SELECT u AS node, u AS root FROM e WHERE u NOT IN (SELECT v FROM e) UNION ALL SELECT v, root FROM t JOIN e ON e.u = t.node) SELECT node, root AS component FROM t""")
def components(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    ahead = c.select((F.col("c_custkey") - 60).alias("u")).join(c.where("c_nationkey <> 3").select(F.col("c_custkey").alias("u")), "u", "left_semi")
    return connected_components(ahead.select("u", (F.col("u") + 60).alias("v")))


@register("g6_k_core")
def k_core(spark: SparkSession, d: str) -> DataFrame:
    return gr.k_core(order_edges(spark, d), 2)


_POWER = "WITH e AS (SELECT DISTINCT x.l_partkey AS i, y.l_partkey AS j FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber + 1 = y.l_linenumber), b AS (SELECT i, j FROM e UNION SELECT j, i FROM e), v0 AS (SELECT DISTINCT i AS node, 1.0::DOUBLE AS value FROM b)" + "".join(f", p{k} AS MATERIALIZED (SELECT i AS node, sum(value) AS value FROM b JOIN v{k} ON j = node GROUP BY i), v{k + 1} AS MATERIALIZED (SELECT node, value / (SELECT sqrt(sum(value * value)) FROM p{k}) AS value FROM p{k})" for k in range(10))


@register("g7_power_iteration", f"{_POWER} SELECT node, round(value, 6) AS value FROM v10")
def power(spark: SparkSession, d: str) -> DataFrame:
    e = order_edges(spark, d)
    both = e.union(e.select("dst", "src")).distinct().select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("w"))
    return gr.power_iteration(both, 10).select("node", F.round("value", 6).alias("value"))


@register("g8_similar_documents")
def similar(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(tx.words(F.col("text"), "\\p{L}{7,}"))).alias("key"))
    return gr.similar_documents(keys)


@register("g8_similar_works", r"""WITH k AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}{7,}')) AS key FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM k), i AS (SELECT key, greatest(0.0::DOUBLE, ln(n / (1 + count(*)))) AS idf FROM k, n GROUP BY key, n),
    w AS (SELECT doc_id, key, idf FROM k JOIN i USING (key)), l AS (SELECT doc_id, sqrt(sum(idf * idf)) AS length FROM w GROUP BY doc_id), s AS (SELECT a.doc_id, b.doc_id AS other, sum(a.idf * a.idf) AS dot FROM w a JOIN w b USING (key) WHERE a.doc_id <> b.doc_id AND a.idf > 0 GROUP BY ALL),
    t AS (SELECT doc_id, list_distinct([source, lang]) AS t, n_chars // 500 AS c FROM documents),
    z AS (SELECT a.doc_id, b.doc_id AS other, coalesce(dot / (x.length * y.length), 0) AS cosine, len(list_intersect(a.t, b.t)) AS many, len(a.t) AS n, coalesce(a.c = b.c, false) AS same FROM t a JOIN t b ON a.doc_id <> b.doc_id LEFT JOIN s ON s.doc_id = a.doc_id AND s.other = b.doc_id LEFT JOIN l x ON x.doc_id = a.doc_id LEFT JOIN l y ON y.doc_id = b.doc_id),
    f AS (SELECT doc_id, other, round(cosine + CASE WHEN n > 0 THEN 0.5::DOUBLE * many / n ELSE 0 END + CASE WHEN same THEN 0.2::DOUBLE ELSE 0 END, 4) AS score FROM z WHERE cosine >= 0.05 OR many > 0)
    SELECT * FROM (SELECT doc_id, other, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, other) AS r FROM f) WHERE r <= 5""")
def similar_works(spark: SparkSession, d: str) -> DataFrame:
    """Source and language are topics, the size in steps of 500 characters is the concept."""
    docs = table(spark, d, "documents")
    keys = docs.select("doc_id", F.explode(F.array_distinct(tx.words(F.col("text"), "\\p{L}{7,}"))).alias("key"))
    works = docs.select("doc_id", F.array("source", "lang").alias("topics"), F.array(F.floor(F.col("n_chars") / 500).cast("string")).alias("concepts"))
    return gr.similar_works(keys, works)


@register("g10_neighbourhood", """WITH e AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst, sum(l_quantity) AS strength FROM lineitem GROUP BY 1, 2), ways AS (SELECT * FROM e UNION ALL SELECT dst, src, strength FROM e), one AS (SELECT s_suppkey AS start, dst AS node, strength FROM supplier JOIN ways ON src = s_suppkey),
    two AS (SELECT start, b.dst AS node, max(least(o.strength, b.strength)) AS strength FROM one o JOIN ways b ON b.src = o.node WHERE b.dst <> start AND NOT EXISTS (SELECT 1 FROM one x WHERE x.start = o.start AND x.node = b.dst) GROUP BY start, b.dst),
    r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY distance, strength DESC, node) AS r FROM (SELECT start, node, 1 AS distance, strength FROM one UNION ALL SELECT start, node, 2, strength FROM two)) SELECT start, node, distance, strength FROM r WHERE r <= 25""")
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst")).agg(F.sum("l_quantity").alias("strength"))
    starts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    return gr.neighbourhood(l, starts, 2, 25)


@register("g12_missing_works", """SELECT l_partkey AS work, count(*) AS citations, count(DISTINCT l_suppkey) AS citing, CASE WHEN count(*) > 30 THEN 'order' ELSE 'wait' END AS route FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY l_partkey""")
def missing(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    out = table(spark, d, "lineitem").join(held, "l_partkey", "left_anti").groupBy(F.col("l_partkey").alias("work")).agg(F.count("*").alias("citations"), F.count_distinct("l_suppkey").alias("citing"))
    return out.withColumn("route", F.when(F.col("citations") > 30, "order").otherwise("wait"))


@register("g14_category_priority", """SELECT l_partkey, f AS flag FROM (SELECT DISTINCT l_partkey, l_returnflag AS f FROM lineitem) x WHERE NOT (f = 'N' AND EXISTS (SELECT 1 FROM lineitem y WHERE y.l_partkey = x.l_partkey AND l_returnflag IN ('A', 'R')))""")
def priority(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.collect_set("l_returnflag").alias("f"))
    kept = F.when(F.arrays_overlap("f", F.array(F.lit("A"), F.lit("R"))), F.array_remove("f", "N")).otherwise(F.col("f"))
    return sets.select("l_partkey", F.explode(kept).alias("flag"))


# --- two annotators of the same tokens, made by one rule in Spark and in SQL --------------------------------------


def annotated(spark: SparkSession, d: str, second: bool) -> DataFrame:
    t = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("sid"), F.posexplode(F.split("text", " ")).alias("p", "form"))
    i, n = F.col("p") + 1, F.length("form")
    head = F.when(i == 1, 0).otherwise(F.when((n % 3 == 0) & F.lit(second), 1).otherwise(i - 1))
    rel = F.when(i == 1, "root").when((n % 5 == 0) & F.lit(second), "obj").when(n > 4, "nsubj").otherwise("det")
    tag = F.when((n % 7 == 0) & F.lit(second), "X").when(n > 4, "NOUN").otherwise("DET")
    return t.select("sid", i.cast("long").alias("i"), "form", head.cast("long").alias("head"), rel.alias("rel"), tag.alias("tag"))


_T = "SELECT conv_id * 100 + turn AS sid, CAST(generate_subscripts(string_split(text, ' '), 1) AS BIGINT) AS i, unnest(string_split(text, ' ')) AS form FROM conversations"


def _annotated(second: bool) -> str:
    s = "TRUE" if second else "FALSE"
    return f"""SELECT *, CASE WHEN i = 1 THEN 0 WHEN length(form) % 3 = 0 AND {s} THEN 1 ELSE i - 1 END AS head, CASE WHEN i = 1 THEN 'root' WHEN length(form) % 5 = 0 AND {s} THEN 'obj' WHEN length(form) > 4 THEN 'nsubj' ELSE 'det' END AS rel,
    CASE WHEN length(form) % 7 = 0 AND {s} THEN 'X' WHEN length(form) > 4 THEN 'NOUN' ELSE 'DET' END AS tag FROM ({_T})"""


_BOTH = f"WITH a AS ({_annotated(False)}), b AS ({_annotated(True)}), j AS (SELECT a.*, b.head AS hb, b.rel AS rb, b.tag AS tb FROM a JOIN b ON a.sid = b.sid AND a.i = b.i)"


@register("e1_compare_annotators", f"{_BOTH} SELECT sid, count(*) AS words, count(*) FILTER (WHERE head <> hb OR rel <> rb) AS tree_diff, count(*) FILTER (WHERE tag <> tb) AS tag_diff FROM j GROUP BY sid")
def compare(spark: SparkSession, d: str) -> DataFrame:
    return ag.compare_annotators(annotated(spark, d, False), annotated(spark, d, True))


@register("e3_ud_scores", f"""{_BOTH} SELECT round(100.0 * count(*) FILTER (WHERE tag = tb) / count(*), 4) AS tags, round(100.0 * count(*) FILTER (WHERE head = hb) / count(*), 4) AS uas, round(100.0 * count(*) FILTER (WHERE head = hb AND rel = rb) / count(*), 4) AS las,
    round(200.0 * count(*) FILTER (WHERE head = hb AND rel = rb AND rel IN ('nsubj', 'obj', 'root')) / (count(*) FILTER (WHERE rel IN ('nsubj', 'obj', 'root')) + count(*) FILTER (WHERE rb IN ('nsubj', 'obj', 'root'))), 4) AS clas FROM j""")
def ud_scores(spark: SparkSession, d: str) -> DataFrame:
    return ag.scores(annotated(spark, d, False), annotated(spark, d, True), ["nsubj", "obj", "root"])


_MORPH = """SELECT *, tag || (length(form) % 2) AS xpos, CASE WHEN length(form) % 11 = 0 THEN '_' ELSE 'Number=' || CASE WHEN ends_with(form, 's') THEN 'Plur' ELSE 'Sing' END END AS feats, CASE WHEN i % 9 = 0 AND rel = 'nsubj' THEN form ELSE lower(form) END AS lemma"""
_FUNCTION = """SELECT sid, head, list_sort(list(rel || '|' || tag || '|' || feats)) AS kids FROM {} WHERE rel = 'det' GROUP BY sid, head"""


@register("e3_ud_scores_full", f"""WITH a AS ({_MORPH} FROM ({_annotated(False)})), b AS (SELECT * REPLACE (CASE WHEN length(form) % 7 = 0 THEN upper(lemma) ELSE lemma END AS lemma) FROM ({_MORPH} FROM ({_annotated(True)}))), ka AS ({_FUNCTION.format('a')}), kb AS ({_FUNCTION.format('b')}),
    j AS (SELECT a.*, b.head AS hb, b.rel AS rb, b.tag AS tb, b.xpos AS xb, b.feats AS fb, b.lemma AS lb, ka.kids AS k, kb.kids AS kb, a.rel IN ('nsubj', 'obj', 'root') AS c, b.rel IN ('nsubj', 'obj', 'root') AS cb FROM a JOIN b ON a.sid = b.sid AND a.i = b.i LEFT JOIN ka ON ka.sid = a.sid AND ka.head = a.i LEFT JOIN kb ON kb.sid = a.sid AND kb.head = a.i),
    m AS (SELECT *, head = hb AND rel = rb AS las FROM j) SELECT count(*) AS words, round(100.0 * count(*) FILTER (WHERE tag = tb) / count(*), 4) AS upos, round(100.0 * count(*) FILTER (WHERE xpos = xb) / count(*), 4) AS xpos, round(100.0 * count(*) FILTER (WHERE feats = fb) / count(*), 4) AS ufeats,
    round(100.0 * count(*) FILTER (WHERE tag = tb AND xpos = xb AND feats = fb) / count(*), 4) AS alltags, round(100.0 * count(*) FILTER (WHERE lemma = lb) / count(*), 4) AS lemmas, round(100.0 * count(*) FILTER (WHERE head = hb) / count(*), 4) AS uas, round(100.0 * count(*) FILTER (WHERE las) / count(*), 4) AS las,
    round(200.0 * count(*) FILTER (WHERE las AND c) / (count(*) FILTER (WHERE c) + count(*) FILTER (WHERE cb)), 4) AS clas, round(200.0 * count(*) FILTER (WHERE las AND c AND tag = tb AND feats = fb AND k IS NOT DISTINCT FROM kb) / (count(*) FILTER (WHERE c) + count(*) FILTER (WHERE cb)), 4) AS mlas,
    round(200.0 * count(*) FILTER (WHERE las AND c AND lemma = lb) / (count(*) FILTER (WHERE c) + count(*) FILTER (WHERE cb)), 4) AS blex FROM m""")
def ud_scores_full(spark: SparkSession, d: str) -> DataFrame:
    n, form = F.length("form"), F.col("form")
    feats = F.when(n % 11 == 0, "_").otherwise(F.concat(F.lit("Number="), F.when(form.endswith("s"), "Plur").otherwise("Sing")))
    lemma = F.when((F.col("i") % 9 == 0) & (F.col("rel") == "nsubj"), form).otherwise(F.lower(form))
    a, b = (annotated(spark, d, x).withColumns({"xpos": F.concat("tag", (n % 2).cast("string")), "feats": feats, "lemma": lemma}) for x in (False, True))
    b = b.withColumn("lemma", F.when(n % 7 == 0, F.upper("lemma")).otherwise(F.col("lemma")))
    return ag.full_scores(a, b, ["nsubj", "obj", "root"], ["det"])


@register("e15_mwe_match")
def mwe_match(spark: SparkSession, d: str) -> DataFrame:
    """Greedy matching isn't SQL; a test holds it to plain Python."""
    t = annotated(spark, d, True).select("sid", "i", F.length("form").alias("n"))
    spans = lambda k, *to: t.where(F.col("n") % 5 == k).select("sid", F.col("i").alias("ord"), F.array(F.col("i"), *(F.col("i") + x for x in to)).alias("members"))
    return ag.match_spans(spans(0, 1, 2), spans(1, 1).unionByName(spans(0, 2)), t.where("n % 4 = 0").select("sid", "i"))


@register("p13_tree_judge", f"""WITH b AS (SELECT sid, i, CASE WHEN i % 11 = 0 THEN 0 WHEN i % 13 = 0 THEN 99 ELSE head END AS head FROM ({_annotated(True)})), p AS (SELECT sid, count(*) AS n, count(*) FILTER (WHERE head = 0) AS roots, max(head) AS most FROM b GROUP BY sid)
    SELECT sid, n, roots, CASE WHEN roots <> 1 THEN 'roots' ELSE 'outside' END AS why FROM p WHERE roots <> 1 OR most > n""")
def tree_judge(spark: SparkSession, d: str) -> DataFrame:
    b = annotated(spark, d, True)
    return ag.tree_judge(b.withColumn("head", F.when(F.col("i") % 11 == 0, 0).when(F.col("i") % 13 == 0, 99).otherwise(F.col("head"))))


@register("e2_field_match", "SELECT count(*) AS n, round(avg(CAST(quality = toxic AS INT)), 6) AS same, round(avg(quality), 6) AS quality FROM labels")
def field_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == F.col("toxic")).cast("int")), 6).alias("same"), F.round(F.avg("quality"), 6).alias("quality"))


@register("e5_bracket_f1", f"{_BOTH}, g AS (SELECT sid, rel AS label, count(*) AS n FROM j GROUP BY ALL), s AS (SELECT sid, rb AS label, count(*) AS n FROM j GROUP BY ALL), m AS (SELECT coalesce(g.n, 0) AS g, coalesce(s.n, 0) AS s FROM g FULL JOIN s ON g.sid = s.sid AND g.label = s.label) SELECT sum(least(g, s))::BIGINT AS matched, sum(g)::BIGINT AS gold, sum(s)::BIGINT AS system, round(2.0 * sum(least(g, s)) / (sum(g) + sum(s)), 6) AS f1 FROM m")
def bracket_f1(spark: SparkSession, d: str) -> DataFrame:
    a, b = (annotated(spark, d, x).select("sid", F.col("rel").alias("label")) for x in (False, True))
    return ag.span_f1(a, b, ["sid", "label"])


@register("e7_weighted_vote", "SELECT l_partkey, l_returnflag, weight FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY weight DESC, l_returnflag) AS r FROM (SELECT l_partkey, l_returnflag, sum(l_quantity) AS weight FROM lineitem GROUP BY l_partkey, l_returnflag)) WHERE r = 1")
def vote(spark: SparkSession, d: str) -> DataFrame:
    return ag.weighted_vote(table(spark, d, "lineitem"), "l_partkey", "l_returnflag", "l_quantity")


@register("e8_annotation_changes", f"{_BOTH} SELECT rel AS before, rb AS after, count(*) AS n, count(*) FILTER (WHERE head <> hb) AS moved FROM j WHERE head <> hb OR rel <> rb GROUP BY ALL")
def changes(spark: SparkSession, d: str) -> DataFrame:
    both = ag.pair_annotations(annotated(spark, d, False), annotated(spark, d, True))
    moved = F.col("head") != F.col("head_b")
    return both.where(moved | (F.col("rel") != F.col("rel_b"))).groupBy(F.col("rel").alias("before"), F.col("rel_b").alias("after")).agg(F.count("*").alias("n"), F.count_if(moved).alias("moved"))


@register("e11_paired_bootstrap")
def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    per = ag.compare_annotators(annotated(spark, d, False), annotated(spark, d, True)).select("sid", (F.col("tree_diff") - F.col("tag_diff")).alias("x"))
    return ag.paired_bootstrap(per, "sid", "x", 200)


@register("e12_grouped_scores", "SELECT source, count(*) AS n, round(avg(quality), 6) AS score FROM documents JOIN labels USING (doc_id) GROUP BY source UNION ALL SELECT 'all', count(*), round(avg(quality), 6) FROM documents JOIN labels USING (doc_id)")
def grouped(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("source", "quality")
    return j.unionByName(j.withColumn("source", F.lit("all"))).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("score"))


@register("e13_tally", "SELECT lang, count(*) FILTER (WHERE quality = 1) AS correct, count(*) FILTER (WHERE quality IS NULL) AS \"unknown\", count(*) FILTER (WHERE quality = 0) AS wrong FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def tally(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return ag.tally(j, "lang", F.col("quality") == 1, F.col("quality").isNotNull())


@register("e14_precision_recall", """WITH g AS (SELECT doc_id FROM labels WHERE toxic = 1), s AS (SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'idiot|moron|worthless|stupid|pathetic|loser|clown') AND doc_id IN (SELECT doc_id FROM labels)), h AS (SELECT count(*) AS hit FROM g JOIN s USING (doc_id))
    SELECT hit, round(hit / (SELECT count(*) FROM s), 6) AS precision, round(hit / (SELECT count(*) FROM g), 6) AS recall FROM h""")
def rules_against_gold(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    found = table(spark, d, "documents").where(F.lower("text").rlike("idiot|moron|worthless|stupid|pathetic|loser|clown")).select("doc_id").join(labels, "doc_id", "left_semi")
    return ag.precision_recall(labels.where("toxic = 1"), found, "doc_id")


@register("e14_shifted_control", """WITH n AS (SELECT count(*) AS n FROM documents), g AS (SELECT (doc_id - 3 + n) % n AS doc_id FROM labels, n WHERE toxic = 1), s AS (SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'idiot|moron|worthless|stupid|pathetic|loser|clown')), h AS (SELECT count(*) AS hit FROM g JOIN s USING (doc_id))
    SELECT hit, round(hit / (SELECT count(*) FROM s), 6) AS precision, round(hit / (SELECT count(*) FROM g), 6) AS recall FROM h""")
def shifted_control(spark: SparkSession, d: str) -> DataFrame:
    """The rules against the labels of the document three places later: what chance alone gives."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    found = docs.where(F.lower("text").rlike("idiot|moron|worthless|stupid|pathetic|loser|clown")).select("doc_id")
    return ag.precision_recall(ag.shifted(labels.where("toxic = 1"), docs, "doc_id", 3), found, "doc_id")


@register("e19_class_report", """WITH p AS (SELECT lang AS gold, CASE WHEN regexp_matches(text, '[äöüß]') THEN 'de' WHEN regexp_matches(text, '[ñóí]') THEN 'es' WHEN regexp_matches(text, '[éèêç]') THEN 'fr' ELSE 'en' END AS s FROM documents)
    SELECT gold, count(*) FILTER (WHERE s = 'de') AS de, count(*) FILTER (WHERE s = 'en') AS en, count(*) FILTER (WHERE s = 'es') AS es, count(*) FILTER (WHERE s = 'fr') AS fr, round(count(*) FILTER (WHERE s = gold) / count(*), 4) AS accuracy FROM p GROUP BY gold""")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    said = F.when(t.rlike("[äöüß]"), "de").when(t.rlike("[ñóí]"), "es").when(t.rlike("[éèêç]"), "fr").otherwise("en")
    return ag.class_report(table(spark, d, "documents").select(F.col("lang").alias("gold"), said.alias("said")), "gold", "said", ["de", "en", "es", "fr"])


# --- joins by rule -------------------------------------------------------------------------------------------------


@register("j6_pair_annotations", """SELECT x.l_orderkey, x.l_linenumber AS a, y.l_linenumber AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber AND (x.l_suppkey = y.l_suppkey OR y.l_returnflag = 'R') GROUP BY ALL""")
def or_join(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    either = "x.l_linenumber < y.l_linenumber and (x.l_suppkey = y.l_suppkey or y.l_returnflag = 'R')"
    return l.alias("x").join(l.alias("y"), "l_orderkey").where(either).select("l_orderkey", F.col("x.l_linenumber").alias("a"), F.col("y.l_linenumber").alias("b")).distinct()


@register("j7_pattern_join", """WITH w AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS w FROM part), t AS (SELECT DISTINCT p_name FROM part) SELECT p_name, w FROM t JOIN w ON p_name = w OR ends_with(p_name, ' ' || w) OR starts_with(p_name, w || ' ')""")
def pattern_join(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select("p_name").distinct()
    return lk.edge_word_join(names, "p_name", names.select(F.split("p_name", " ")[0].alias("w")).distinct(), "w")


@register("j8_best_sense", "SELECT p_name, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS best FROM part GROUP BY p_name")
def best_sense(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select(F.lower("p_name").alias("label"), "p_name").distinct()
    return lk.best_match(words, "label", table(spark, d, "part").withColumn("label", F.lower("p_name")).drop("p_name"), "p_partkey", "p_retailprice").select("p_name", F.col("p_partkey").alias("best"))


@register("j9_label_fallback", """SELECT c_nationkey, coalesce(min(c_name) FILTER (WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9900), min(c_name) FILTER (WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9000), min(c_name)) AS label FROM customer GROUP BY c_nationkey""")
def label_fallback(spark: SparkSession, d: str) -> DataFrame:
    when = lambda cond: F.min(F.when(F.expr(cond), F.col("c_name")))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.coalesce(when("c_mktsegment = 'BUILDING' and c_acctbal > 9900"), when("c_mktsegment = 'MACHINERY' and c_acctbal > 9000"), F.min("c_name")).alias("label"))


@register("j11_outer_index", """SELECT o_orderdate AS verse, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS f, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS o, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def outer_index(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda s: F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey")))), ","), F.lit(""))
    return table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("verse")).agg(ids("F").alias("f"), ids("O").alias("o"), ids("P").alias("p"))


@register("j13_replace_versions", """SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS replaces, lead(o_orderkey) OVER w AS replaced_by FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def versions(spark: SparkSession, d: str) -> DataFrame:
    return lk.version_chain(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


#: Letters of the tables outside a-z stand for themselves in Spark; the SQL function counts bytes, so there each becomes one byte.
_LETTERS, _BYTES = "ßäçèéêíñóöüàâáîïôúùûœæ", "ABCDEFGHIJKLMNOPQRSTUV"


def _edit_sql(radius: int) -> str:
    return f"""WITH w AS (SELECT w, translate(w, '{_LETTERS}', '{_BYTES}') AS t FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM benchmark))
    SELECT a.w AS a, b.w AS b, levenshtein(a.t, b.t) AS distance FROM w a JOIN w b ON a.w < b.w AND abs(length(a.w) - length(b.w)) <= {radius} WHERE levenshtein(a.t, b.t) <= {radius}"""


def _edit_query(radius: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return lk.within_edits(table(spark, d, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("w")), "w", radius)

    return run


for _name, _radius in (("join", 1), ("two", 2), ("three", 3)):
    register(f"j14_edit_distance_{_name}", _edit_sql(_radius))(_edit_query(_radius))


@register("j14_edit_distance_join_whole")
def edit_join_whole(spark: SparkSession, d: str) -> DataFrame:
    """The words of documents and benchmark; all pairs of them are too many for SQL."""
    texts = table(spark, d, "benchmark").select("text").union(table(spark, d, "documents").select("text"))
    return lk.within_edits(texts.select(F.explode(tx.words(F.col("text"))).alias("w")), "w", 1)


@register("a19_tests", """WITH g AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), x AS (SELECT * FROM g WHERE g = 'A'), y AS (SELECT * FROM g WHERE g = 'R')
    SELECT round((x.m - y.m) / sqrt(x.v / x.n + y.v / y.n), 5) AS t, round((x.v / x.n + y.v / y.n) ** 2 / ((x.v / x.n) ** 2 / (x.n - 1) + (y.v / y.n) ** 2 / (y.n - 1)), 3) AS df FROM x, y""")
def welch(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators import statistics as st

    out = st.welch(table(spark, d, "lineitem"), "l_returnflag", "A", "R", "l_quantity")
    return out.select(F.round("t", 5).alias("t"), F.round("df", 3).alias("df"))


@register("a19_chi2", """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e FROM c) SELECT round(sum((n - e) ** 2 / e), 5) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM t""")
def chi2(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators import statistics as st

    return st.chi2(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("chi2", 5).alias("chi2"), "df")


@register("a19_crosstab", """WITH c AS (SELECT l_shipmode AS a, l_linestatus AS b, count(*) AS n FROM (SELECT *, CAST(l_suppkey % 5 AS VARCHAR) AS l_shipmode FROM lineitem) GROUP BY ALL) SELECT a, b, n, round(sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER (), 5) AS expected FROM c""")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators import statistics as st

    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).cast("string").alias("a"), F.col("l_linestatus").alias("b"))
    return st.crosstab(rows, "a", "b").withColumn("expected", F.round("expected", 5))


@register("a19_t_tests", """WITH g AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), x AS (SELECT * FROM g WHERE g = 'A'), y AS (SELECT * FROM g WHERE g = 'R'), o AS (SELECT count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem)
    SELECT 'one sample' AS test, round((m - 25) / sqrt(v / n), 5) AS t, round(n - 1, 3)::DOUBLE AS df FROM o UNION ALL SELECT 'pooled', round((x.m - y.m) / sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2) * (1 / x.n + 1 / y.n)), 5), round(x.n + y.n - 2, 3) FROM x, y
    UNION ALL SELECT 'welch', round((x.m - y.m) / sqrt(x.v / x.n + y.v / y.n), 5), round((x.v / x.n + y.v / y.n) ** 2 / ((x.v / x.n) ** 2 / (x.n - 1) + (y.v / y.n) ** 2 / (y.n - 1)), 3) FROM x, y""")
def t_tests(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators import statistics as st

    return st.t_tests(table(spark, d, "lineitem"), "l_returnflag", "A", "R", "l_quantity", 25.0).select("test", F.round("t", 5).alias("t"), F.round("df", 3).alias("df"))


@register("a19_anova1", """WITH g AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) * (count(*) - 1) AS ss FROM lineitem GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS grand FROM g)
    SELECT round((sum(n * (m - grand) ** 2) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), 5) AS f, count(*) - 1 AS df_between, (sum(n) - count(*))::BIGINT AS df_within FROM g, t""")
def anova1(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators import statistics as st

    return st.anova1(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice").select(F.round("f", 5).alias("f"), "df_between", "df_within")


@register("a19_correlation_test", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n, round(corr(l_quantity, l_extendedprice) * sqrt((count(*) - 2) / (1 - corr(l_quantity, l_extendedprice) ** 2)), 3) AS t FROM lineitem")
def correlation_test(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators import statistics as st

    return st.correlation_test(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("r", 6).alias("r"), "n", F.round("t", 3).alias("t"))


@register("a19_p_values")
def p_values(spark: SparkSession, d: str) -> DataFrame:
    """The probabilities of all tests; the distributions aren't in SQL, tests hold them to integrals."""
    from textloom.operators import statistics as st

    t = table(spark, d, "lineitem")
    out = st.t_tests(t, "l_returnflag", "A", "R", "l_quantity", 25.0).select("test", "p")
    for name, one in (("anova1", st.anova1(t, "l_returnflag", "l_extendedprice")), ("correlation", st.correlation_test(t, "l_discount", "l_quantity")), ("chi2", st.chi2(t, "l_returnflag", "l_linestatus"))):
        out = out.unionByName(one.select(F.lit(name).alias("test"), "p"))
    return out


@register("a20_fitlm", """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem""")
def fitlm(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators import statistics as st

    fit = st.linear_model(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    value = lambda name, digits: F.round(F.max(F.when(F.col("term") == name, F.col("estimate"))), digits)
    return fit.agg(value("l_quantity", 4).alias("slope"), value("intercept", 3).alias("intercept"), F.round(F.max("r2"), 6).alias("r2"), F.max("n").alias("n"))


@register("a22_heavy_hitters", "SELECT l_partkey AS value, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 0.002 * (SELECT count(*) FROM lineitem)")
def heavy(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators import statistics as st

    return st.heavy_hitters(table(spark, d, "lineitem"), "l_partkey", 0.002)


@register("e6_agree_trees", f"""WITH a AS ({_annotated(False)}), b AS ({_annotated(True)}), j AS (SELECT a.sid, a.i, a.head, a.rel, a.tag, b.head AS h1, b.rel AS r1, b.tag AS t1, CASE WHEN a.i % 4 = 0 THEN a.head ELSE b.head END AS h2, CASE WHEN a.i % 3 = 0 THEN a.rel ELSE b.rel END AS r2, b.tag AS t2 FROM a JOIN b ON a.sid = b.sid AND a.i = b.i),
    r AS (SELECT *, CASE WHEN h1 = h2 AND h1 <> head AND h1 = 0 THEN 'root' WHEN h1 = h2 AND h1 <> head THEN 'head' WHEN r1 = r2 AND r1 <> rel AND h1 = h2 THEN 'relation' WHEN t1 = t2 AND t1 <> tag THEN 'tag' END AS rule FROM j) SELECT rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY rule""")
def agree_trees(spark: SparkSession, d: str) -> DataFrame:
    a, b = annotated(spark, d, False), annotated(spark, d, True)
    other = a.select("sid", "i", F.col("head").alias("ha"), F.col("rel").alias("ra"))
    c = b.join(other, ["sid", "i"]).withColumns({"head": F.when(F.col("i") % 4 == 0, F.col("ha")).otherwise(F.col("head")), "rel": F.when(F.col("i") % 3 == 0, F.col("ra")).otherwise(F.col("rel"))}).drop("ha", "ra")
    return ag.agree_trees(a, b, c).groupBy("rule").agg(F.count("*").alias("n"))


@register("e10_coref_scores", """WITH c AS (SELECT l_suppkey AS doc, l_returnflag AS g, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY ALL), g AS (SELECT doc, g, sum(n) AS size, count(*) AS parts FROM c GROUP BY doc, g), s AS (SELECT doc, s, sum(n) AS size, count(*) AS parts FROM c GROUP BY doc, s)
    SELECT (SELECT round(sum(size - parts) / sum(size - 1), 6) FROM g) AS muc_recall, (SELECT round(sum(size - parts) / sum(size - 1), 6) FROM s) AS muc_precision, (SELECT round(sum(n * n / size) / sum(n), 6) FROM c JOIN g USING (doc, g)) AS b3_recall, (SELECT round(sum(n * n / size) / sum(n), 6) FROM c JOIN s USING (doc, s)) AS b3_precision""")
def coref_scores(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_returnflag").alias("gold"), F.col("l_linestatus").alias("system"))
    out = ag.coref_scores(m)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@register("e10_ceaf_e", """WITH c AS (SELECT l_suppkey AS doc, l_returnflag AS g, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT doc, g, s, 2 * n / (sum(n) OVER (PARTITION BY doc, g) + sum(n) OVER (PARTITION BY doc, s)) AS v FROM c),
    b AS (SELECT doc, v FROM p UNION ALL SELECT f.doc, f.v + o.v FROM p f JOIN p o ON f.doc = o.doc AND f.s = 'F' AND o.s = 'O' AND f.g <> o.g), m AS (SELECT doc, max(v) AS v FROM b GROUP BY doc)
    SELECT round((SELECT sum(v) FROM m) / (SELECT count(*) FROM (SELECT DISTINCT doc, g FROM c)), 6) AS recall, round((SELECT sum(v) FROM m) / (SELECT count(*) FROM (SELECT DISTINCT doc, s FROM c)), 6) AS precision""")
def ceaf_e(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_returnflag").alias("gold"), F.col("l_linestatus").alias("system"))
    return ag.ceaf_e(m).select(F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@register("e20_select_candidate")
def select_candidate(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select((F.col("l_suppkey") % 6).alias("candidate"), F.col("l_orderkey").alias("item"), (F.col("l_orderkey") % 2 == 0).alias("held"), (F.col("l_discount") - 0.0495).alias("gain"))
    out = ag.select_candidate(l)
    return out.select("candidate", F.round("dev", 8).alias("dev"), F.round("held_gain", 8).alias("held_gain"), "p", "chosen")


@register("g13_align_concepts", """WITH p AS (SELECT p_partkey, p_name, p_brand, p_type FROM part), c AS (SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(a.p_brand = b.p_brand AS INT) + CAST(a.p_type = b.p_type AS INT) AS support FROM p a JOIN p b ON a.p_name = b.p_name AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1)
    SELECT a, b, support::BIGINT AS support FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY support DESC, b) AS r FROM c WHERE support > 0) WHERE r = 1""")
def align(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    a, b = p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1")
    above = lambda df, key, anc: df.select(F.col("p_partkey").alias(key), F.explode(F.array("p_brand", "p_type")).alias(anc))
    names = p.select(F.explode(F.array("p_brand", "p_type")).alias("x")).distinct()
    named = lambda df, key: df.select(F.col("p_partkey").alias(key), F.col("p_name").alias("key"))
    return gr.align_by_key(named(a, "a"), named(b, "b"), above(a, "a", "x"), above(b, "b", "y"), names.select("x", F.col("x").alias("y")))


@register("g13_supported_alignment", """WITH RECURSIVE pa AS (SELECT p_partkey AS k, * FROM part), c AS (SELECT a.k AS a, b.k AS b, a.p_size = b.p_size AS label, a.p_type = b.p_type AS lex, a.k % 10 = b.k % 10 - 1 AS direct, a.p_retailprice > b.p_retailprice AS wn, b.p_size % 4 AS gloss, b.p_size AS weight FROM pa a JOIN pa b ON a.p_brand = b.p_brand AND a.k % 2 = 0 AND b.k % 2 = 1 AND abs(a.k - b.k) < 200),
    ua AS (SELECT k AS node, k // 4 * 2 AS anc, 1 AS depth FROM pa WHERE k % 2 = 0 AND k // 4 * 2 <> k UNION ALL SELECT node, anc // 4 * 2, depth + 1 FROM ua WHERE anc // 4 * 2 <> anc), ub AS (SELECT k AS node, k // 4 * 2 + 1 AS anc, 1 AS depth FROM pa WHERE k % 2 = 1 AND k // 4 * 2 + 1 <> k UNION ALL SELECT node, anc // 4 * 2 + 1, depth + 1 FROM ub WHERE anc // 4 * 2 + 1 <> anc),
    n AS (SELECT count(DISTINCT x) AS n FROM (SELECT node AS x FROM ua UNION ALL SELECT anc FROM ua)), g AS (SELECT anc FROM ua, n GROUP BY anc, n HAVING count(*) > floor(n * 0.2)),
    s AS (SELECT c.a, c.b, min(ua.depth + ub.depth) AS depth FROM c JOIN ua ON ua.node = c.a AND ua.depth <= 10 JOIN ub ON ub.node = c.b AND ub.depth <= 20 JOIN c x ON x.a = ua.anc AND x.b = ub.anc WHERE ua.anc NOT IN (SELECT anc FROM g) GROUP BY c.a, c.b),
    o AS (SELECT c.a, c.b, label::INT + lex::INT + (direct OR wn)::INT AS sources, depth, direct, gloss >= 2 AS told, weight, depth IS NOT NULL AND label::INT + lex::INT + (direct OR wn)::INT >= 2 AS fit FROM c LEFT JOIN s ON s.a = c.a AND s.b = c.b),
    r AS (SELECT *, CASE WHEN fit THEN row_number() OVER (PARTITION BY a, fit ORDER BY direct DESC, told DESC, depth, weight DESC, b) END AS r FROM o)
    SELECT a, b, sources, depth, CASE WHEN depth IS NULL THEN 'unsupported' WHEN sources < 2 THEN 'single' WHEN r = 1 THEN 'accepted' ELSE 'also' END AS verdict, r FROM r""")
def supported_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Parts of even and of odd keys are the concepts of two hierarchies; those of one brand with near keys are candidates."""
    p = table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    a, b = p.where("k % 2 = 0").alias("a"), p.where("k % 2 = 1").alias("b")
    near = (F.col("a.p_brand") == F.col("b.p_brand")) & (F.floor(F.col("a.k") / 200) + F.col("step") == F.floor(F.col("b.k") / 200)) & (F.abs(F.col("a.k") - F.col("b.k")) < 200)
    c = a.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).join(b, near)
    c = c.select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.expr("a.p_size = b.p_size").alias("label"), F.expr("a.p_type = b.p_type").alias("lex"), F.expr("a.k % 10 = b.k % 10 - 1").alias("direct"), F.expr("a.p_retailprice > b.p_retailprice").alias("wn"), F.expr("b.p_size % 4").alias("gloss"), F.col("b.p_size").alias("weight"))
    up = lambda df, rest: df.select(F.col("k").alias("child"), (F.floor(F.col("k") / 4) * 2 + rest).alias("parent")).where("child <> parent")
    return gr.supported_alignment(c, up(p.where("k % 2 = 0"), 0), up(p.where("k % 2 = 1"), 1), share=0.2)


@register("g15_entity_claims", "SELECT c_custkey AS q, 31 AS p, CAST(c_nationkey AS BIGINT) AS o, 'normal' AS rank FROM customer UNION ALL SELECT c_custkey, 279, c_custkey // 2, 'preferred' FROM customer WHERE c_custkey > 0")
def entity_claims(spark: SparkSession, d: str) -> DataFrame:
    from textloom.plans.materialize import new_path

    claim = lambda v, rank: F.array(F.struct(v.cast("long").alias("v"), F.lit(rank).alias("rank")))
    half = F.floor(F.col("c_custkey") / 2)
    claims = F.when(F.col("c_custkey") > 0, F.create_map(F.lit("P31"), claim(F.col("c_nationkey"), "normal"), F.lit("P279"), claim(half, "preferred"))).otherwise(F.create_map(F.lit("P31"), claim(F.col("c_nationkey"), "normal")))
    path = new_path(spark, "entities")
    table(spark, d, "customer").select(F.to_json(F.struct(F.concat(F.lit("Q"), F.col("c_custkey")).alias("id"), F.create_map(F.lit("en"), "c_name").alias("labels"), claims.alias("claims"))).alias("value")).write.text(path)
    return gr.entity_claims(spark.read.text(path))
