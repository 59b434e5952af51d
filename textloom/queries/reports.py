"""References, annotators, lexicon, catalogue, loads and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import agreement as ag
from textloom.operators import corpus as cp
from textloom.operators import lookups as lk
from textloom.operators import tables as tb
from textloom.queries.graphs import _annotated, annotated
from textloom.registry import register, table
from textloom.sources import files as fl

_WORDS = r"array_to_string(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), ' ')"


@register("j12_resolve_reference", f"""WITH w AS (SELECT p_partkey AS work, CASE WHEN p_partkey % 5 = 0 THEN 'd' || p_partkey // 10 END AS doi, CASE WHEN p_partkey % 5 = 1 THEN 'x' || p_partkey END AS arxiv, CASE WHEN p_partkey % 5 = 2 THEN 'l' || p_partkey END AS acl, p_name || ' ' || p_type AS title, 1990 + p_size % 12 AS year FROM part),
    e AS (SELECT l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS entry, CASE WHEN l_linenumber = 1 THEN 'd' || l_partkey // 10 END AS doi, CASE WHEN l_linenumber <= 2 THEN 'x' || l_partkey END AS arxiv, CASE WHEN l_linenumber <= 3 THEN 'l' || l_partkey END AS acl, upper(p_name) || ': ' || p_type || '!' AS title, 1990 + CAST(l_quantity AS BIGINT) % 12 AS year FROM lineitem JOIN part ON p_partkey = l_partkey),
    t AS (SELECT work, year, {_WORDS.format("title")} AS t FROM w WHERE len(regexp_extract_all(title, '[\\p{{L}}\\p{{N}}]+')) >= 3), d AS (SELECT doi, min(work) AS w FROM w GROUP BY doi), x AS (SELECT arxiv, min(work) AS w FROM w GROUP BY arxiv), l AS (SELECT acl, min(work) AS w FROM w GROUP BY acl),
    y AS (SELECT t, y, min(work) AS w FROM (SELECT t, work, unnest([year - 1, year, year + 1]) AS y FROM t) GROUP BY t, y)
    SELECT entry, coalesce(d.w, x.w, l.w, y.w) AS work, CASE WHEN d.w IS NOT NULL THEN 1 WHEN x.w IS NOT NULL THEN 2 WHEN l.w IS NOT NULL THEN 3 WHEN y.w IS NOT NULL THEN 4 END AS level
    FROM e LEFT JOIN d ON d.doi = e.doi LEFT JOIN x ON x.arxiv = e.arxiv LEFT JOIN l ON l.acl = e.acl LEFT JOIN y ON y.t = {_WORDS.format("e.title")} AND y.y = e.year""")
def resolve(spark: SparkSession, d: str) -> DataFrame:
    """Order lines cite parts, by one of three ids or by title and year."""
    c = F.col
    named = lambda ok, letter, of: F.when(ok, F.concat(F.lit(letter), of.cast("string")))
    part = table(spark, d, "part")
    key, tenth = c("p_partkey"), F.floor(c("p_partkey") / 10)
    works = part.select(key.alias("work"), named(key % 5 == 0, "d", tenth).alias("doi"), named(key % 5 == 1, "x", key).alias("arxiv"), named(key % 5 == 2, "l", key).alias("acl"), F.concat_ws(" ", "p_name", "p_type").alias("title"), (1990 + c("p_size") % 12).cast("long").alias("year"))
    lines = table(spark, d, "lineitem").join(part.select(key.alias("l_partkey"), "p_name", "p_type"), "l_partkey")
    n, key, tenth = c("l_linenumber"), c("l_partkey"), F.floor(c("l_partkey") / 10)
    entries = lines.select((c("l_orderkey") * 1000000 + n * 100000 + key).alias("entry"), named(n == 1, "d", tenth).alias("doi"), named(n <= 2, "x", key).alias("arxiv"), named(n <= 3, "l", key).alias("acl"), F.concat(F.upper("p_name"), F.lit(": "), "p_type", F.lit("!")).alias("title"), (1990 + c("l_quantity").cast("long") % 12).alias("year"))
    return lk.resolve_reference(entries, works, "entry", "work", ["doi", "arxiv", "acl"], "title", "year")


_ORIGINS = f"""WITH a AS ({_annotated(False)}), b AS (SELECT *, CASE WHEN sid % 3 = 0 THEN 'final' ELSE 'silver' END AS origin, CASE WHEN sid % 29 = 0 AND i = 2 THEN form || 'x' ELSE form END AS fb FROM ({_annotated(True)})),
    c AS (SELECT a.sid, origin, count(*) AS words, count(*) FILTER (a.head IS DISTINCT FROM b.head OR a.rel <> b.rel) AS tree_diff, count(*) FILTER (a.tag <> b.tag) AS tag_diff, bool_and(a.form = fb) AS same,
          string_agg(CASE WHEN a.head IS DISTINCT FROM b.head OR a.rel <> b.rel THEN a.form || ' ' || a.head || ':' || a.rel || '→' || b.head || ':' || b.rel END, '; ' ORDER BY a.i) AS tree FROM a JOIN b ON a.sid = b.sid AND a.i = b.i GROUP BY a.sid, origin), p AS (SELECT * FROM c WHERE same)"""


def compared(spark: SparkSession, d: str) -> DataFrame:
    b = annotated(spark, d, True).withColumn("origin", F.when(F.col("sid") % 3 == 0, "final").otherwise("silver"))
    b = b.withColumn("form", F.when((F.col("sid") % 29 == 0) & (F.col("i") == 2), F.concat("form", F.lit("x"))).otherwise(F.col("form")))
    return ag.compared(annotated(spark, d, False), b)


@register("e1_agreement_by_origin", f"{_ORIGINS} SELECT origin, count(*) AS pairs, count(*) FILTER (tree_diff > 0 OR tag_diff > 0) AS disagree, round(100.0 * sum(words - tree_diff) / sum(words), 1) AS las, round(100.0 * sum(words - tag_diff) / sum(words), 1) AS tags FROM p GROUP BY origin")
def agreement_by_origin(spark: SparkSession, d: str) -> DataFrame:
    return ag.agreement_by_origin(compared(spark, d))


@register("e1_largest_differences", f"{_ORIGINS} SELECT sid, origin, words, tree_diff, left(tree, 80) AS tree FROM p WHERE tree_diff > 0 ORDER BY tree_diff DESC, words, sid, origin LIMIT 5")
def largest_differences(spark: SparkSession, d: str) -> DataFrame:
    return ag.largest_differences(compared(spark, d))


@register("p13_judge_trees", f"""WITH s AS (SELECT conv_id * 100 + turn AS sid FROM conversations), t AS (SELECT sid, i, CASE WHEN length(form) = 3 THEN 'PUNCT' ELSE tag END AS tag, CASE WHEN i % 31 = 0 THEN 0 WHEN i % 37 = 0 THEN 999 ELSE head END AS head FROM ({_annotated(False)}) WHERE sid % 17 <> 0),
    w AS (SELECT sid, i, head FROM ({_annotated(True)}) WHERE sid % 5 <> 0 OR i > 1), n AS (SELECT sid, count(*) AS w_n FROM w GROUP BY sid),
    p AS (SELECT t.sid, count(*) AS n, count(*) FILTER (t.head = 0) AS roots, max(t.head) AS most, count(*) FILTER (tag <> 'PUNCT') AS asked, count(*) FILTER (tag <> 'PUNCT' AND t.head = w.head) AS agreed FROM t LEFT JOIN w ON w.sid = t.sid AND w.i = t.i GROUP BY t.sid),
    r AS (SELECT s.sid, concat_ws(' ', CASE WHEN n IS NULL THEN 'no_words' END, CASE WHEN roots <> 1 THEN 'roots' END, CASE WHEN most > n THEN 'head_outside' END, CASE WHEN most <= n AND w_n = n AND asked > 0 AND agreed < 0.6 * asked THEN 'witness' END) AS why FROM s LEFT JOIN p ON p.sid = s.sid LEFT JOIN n ON n.sid = s.sid)
    SELECT sid, why FROM r WHERE why <> ''""")
def judge_trees(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    sentences = table(spark, d, "conversations").select((c("conv_id") * 100 + c("turn")).alias("sid"))
    tokens = annotated(spark, d, False).where("sid % 17 <> 0").select("sid", "i", F.when(F.length("form") == 3, "PUNCT").otherwise(c("tag")).alias("tag"), F.when(c("i") % 31 == 0, 0).when(c("i") % 37 == 0, 999).otherwise(c("head")).alias("head"))
    return ag.judge_trees(sentences, tokens, annotated(spark, d, True).where("sid % 5 <> 0 or i > 1"))


_TALLY = "SELECT source AS layer, lang AS class, count(*) AS items, sum(n_chars)::BIGINT AS bits FROM documents WHERE {} GROUP BY source, lang"


@register("e16_compare_tallies", f"""WITH b AS ({_TALLY.format("doc_id % 2 = 0 AND lang <> 'de'")}), a AS ({_TALLY.format("doc_id % 2 = 1 AND lang <> 'fr'")})
    SELECT layer, class, coalesce(b.items, 0) AS items_before, coalesce(b.bits, 0) AS bits_before, coalesce(a.items, 0) AS items_after, coalesce(a.bits, 0) AS bits_after, coalesce(a.items, 0) - coalesce(b.items, 0) AS items_change, coalesce(a.bits, 0) - coalesce(b.bits, 0) AS bits_change FROM b FULL JOIN a USING (layer, class)""")
def compare_tallies(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    tally = lambda ok: docs.where(ok).groupBy(F.col("source").alias("layer"), F.col("lang").alias("class")).agg(F.count("*").alias("items"), F.sum("n_chars").alias("bits"))
    return ag.compare_tallies(tally("doc_id % 2 = 0 and lang <> 'de'"), tally("doc_id % 2 = 1 and lang <> 'fr'"))


_LEXICON = r"l AS (SELECT w AS lemma, dense_rank() OVER (ORDER BY w) AS number FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \n,;]+')) AS w FROM documents))"


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n,;]+"), 0)).alias("w")).distinct()
    return tb.global_rank(w, [F.col("w")], "number").select(F.col("number").cast("long"), F.col("w").alias("lemma"), F.lit("w").alias("flag"))


@register("p11_redacted_lemmas", f"WITH {_LEXICON} SELECT number, CASE WHEN gone THEN '<redacted-' || number || '>' ELSE lemma END AS lemma, CASE WHEN gone THEN '-' ELSE 'w' END AS flag FROM (SELECT *, {tx.PERSONAL_SQL.format(t='lower(lemma)')} AS gone FROM l)")
def redacted_lemmas(spark: SparkSession, d: str) -> DataFrame:
    words = lexicon(spark, d)
    return cp.redact_lexicon(words, words.select(F.col("lemma").alias("form"), "number"))[0]


@register("p11_redacted_forms", f"WITH {_LEXICON}, g AS (SELECT *, {tx.PERSONAL_SQL.format(t='lower(lemma)')} AS gone FROM l), f AS (SELECT CASE WHEN number % 50 = 0 THEN lemma || '@example.org' ELSE lemma END AS form, number FROM g) SELECT form, number FROM f WHERE number NOT IN (SELECT number FROM g WHERE gone) AND NOT ({tx.PERSONAL_SQL.format(t='lower(form)')})")
def redacted_forms(spark: SparkSession, d: str) -> DataFrame:
    words = lexicon(spark, d)
    forms = words.select(F.when(F.col("number") % 50 == 0, F.concat("lemma", F.lit("@example.org"))).otherwise(F.col("lemma")).alias("form"), "number")
    return cp.redact_lexicon(words, forms)[1]


@register("p8_catalogue_by_death", """WITH w AS (SELECT p_partkey AS id, lower(p_type || ' ; ' || p_name) AS hay, p_size, CASE p_partkey % 5 WHEN 0 THEN 'Doe, A, ' || (1780 + p_size) || '-' || (1840 + p_size * 3) WHEN 1 THEN 'Doe, A, 1850-1901; Roe, B, 1860-' || (1890 + p_size * 2) WHEN 2 THEN 'Old, C, 70 BCE-8 BCE' WHEN 3 THEN 'Young, D, 1950-' ELSE '' END AS authors FROM part),
    g AS (SELECT *, CASE WHEN contains(hay, 'red') OR contains(hay, 'brass') THEN 'first' WHEN contains(hay, 'economy') THEN 'second' WHEN contains(hay, 'steel') THEN 'third' END AS grp, CASE id % 5 WHEN 0 THEN 1840 + p_size * 3 WHEN 1 THEN greatest(1901, 1890 + p_size * 2) WHEN 2 THEN 0 END AS died FROM w)
    SELECT id, grp, died::INTEGER AS died FROM g WHERE grp IS NOT NULL AND died <= 1950 AND NOT (grp = 'first' AND (contains(hay, 'promo') OR contains(hay, 'ring'))) AND id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)""")
def catalogue_by_death(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_size")
    authors = F.when(k == 0, F.format_string("Doe, A, %d-%d", 1780 + n, 1840 + n * 3)).when(k == 1, F.format_string("Doe, A, 1850-1901; Roe, B, 1860-%d", 1890 + n * 2)).when(k == 2, "Old, C, 70 BCE-8 BCE").when(k == 3, "Young, D, 1950-").otherwise("")
    works = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ; ", "p_type", "p_name").alias("subjects"), authors.alias("authors"))
    held = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("id"))
    return cp.select_catalogue(works, [("first", ["red", "brass"]), ("second", ["economy"]), ("third", ["steel"])], {"first": ["promo", "ring"]}, 1950, held)


@register("s8_match_sentences", """WITH c AS (SELECT conv_id || '-' || turn AS sent_id, text, conv_id, turn FROM conversations), h AS (SELECT sent_id, CASE WHEN turn = 2 THEN text || '.' ELSE text END AS text, row_number() OVER (ORDER BY conv_id, turn) AS sid FROM c WHERE conv_id % 2 = 0),
    m AS (SELECT c.sent_id, c.text, h.sid FROM (SELECT DISTINCT sent_id, text FROM c) c LEFT JOIN h ON h.sent_id = c.sent_id AND h.text = c.text), f AS (SELECT sent_id, text, (SELECT max(sid) FROM h) + row_number() OVER (ORDER BY sent_id, text) AS sid FROM m WHERE sid IS NULL)
    SELECT sent_id, sid FROM m WHERE sid IS NOT NULL UNION ALL SELECT sent_id, sid FROM f""")
def match_sentences(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sent_id"), "text", "conv_id", "turn")
    held = tb.global_rank(c.where("conv_id % 2 = 0"), [F.col("conv_id"), F.col("turn")], "sid").select("sid", "sent_id", F.when(F.col("turn") == 2, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"))
    return fl.match_sentences(c.select("sent_id", "text"), held).select("sent_id", "sid")


@register("a25_cards_of_rows", r"""WITH t AS (SELECT role AS collection, CASE WHEN conv_id % 10 < 8 THEN 'train' WHEN conv_id % 10 = 8 THEN 'dev' ELSE 'test' END AS split, conv_id * 100 + turn AS sent_id, CAST(generate_subscripts(string_split(text, ' '), 1) AS BIGINT) AS i FROM conversations),
    n AS (SELECT collection, split, count(DISTINCT sent_id) AS sentences, count(*) AS words, count(*) FILTER (i % 7 = 1) AS multiword, count(*) FILTER (i % 11 = 0) AS empty FROM t GROUP BY collection, split), a AS (SELECT * FROM n UNION ALL SELECT collection, 'total', sum(sentences), sum(words), sum(multiword), sum(empty) FROM n GROUP BY collection)
    SELECT collection, split, sentences::BIGINT AS sentences, (words - multiword)::BIGINT AS tokens, words::BIGINT AS words, multiword::BIGINT AS multiword, empty::BIGINT AS empty FROM a""")
def cards_of_rows(spark: SparkSession, d: str) -> DataFrame:
    """Token rows in which every seventh word begins a token of two, and an empty node follows every eleventh."""
    c, k = F.col, F.col("conv_id") % 10
    split = F.when(k < 8, "train").when(k == 8, "dev").otherwise("test")
    turns = table(spark, d, "conversations").select(c("role").alias("collection"), split.alias("split"), (c("conv_id") * 100 + c("turn")).alias("sent_id"), F.size(F.split("text", " ")).alias("n"))
    i = turns.select("collection", "split", "sent_id", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    said = F.array_compact(F.array(F.when(c("i") % 7 == 1, F.format_string("%d-%d", "i", c("i") + 1)), c("i").cast("string"), F.when(c("i") % 11 == 0, F.format_string("%d.1", "i"))))
    declared = turns.groupBy("collection", "split").agg(F.count("*").alias("sentences"))
    return fl.split_cards(i.select("collection", "split", "sent_id", F.explode(said).alias("id")), declared)


@register("f7_rfc_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def rfc_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates written out with day and month names and read again."""
    return table(spark, d, "orders").select("o_orderkey", tx.rfc_date(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).alias("day"))


_TOKENS = r"""m AS (SELECT doc_id, regexp_replace(text, '(?i)(\p{L})(n''t|''(?:s|m|re|ve|ll|d))\b', '\1' || chr(1) || '\2', 'g') AS t FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, regexp_extract_all(t, p, 1) AS a, regexp_extract_all(t, p, 2) AS b
    FROM m, (SELECT '(\x01(?:[nN]''[tT]|''[a-zA-Z]+)|[\p{L}\p{N}]+(?:[''-][\p{L}\p{N}]+)*|[^\p{L}\p{N}\s\x01])(\s*)' AS p)), e AS (SELECT doc_id, unnest(generate_series(1, len(a))) AS i, a, b FROM r)"""


@register("c2_token_rows", f"""WITH {_TOKENS} SELECT doc_id, i, replace(a[i], chr(1), '') AS token, CASE WHEN starts_with(a[i], chr(1)) THEN 'clitic' WHEN regexp_matches(a[i], '^\\p{{N}}+$') THEN 'number' WHEN regexp_matches(a[i], '^[\\p{{L}}\\p{{N}}]') THEN 'word' ELSE 'mark' END AS kind, b[i] <> '' AS space_after FROM e""")
def token_rows(spark: SparkSession, d: str) -> DataFrame:
    return cp.token_rows(table(spark, d, "documents"))


_UNITS = r"""u AS (SELECT conv_id * 100 + turn AS id, conv_id AS doc, role AS class, text, unnest(regexp_extract_all(text, '\p{L}+(?:[''-]\p{L}+)*')) AS form FROM conversations), t AS (SELECT id, doc, class, text, lower(form) AS lemma, ['NOUN', 'VERB', 'DET', 'ADJ', 'ADV'][length(form) % 5 + 1] AS upos0, CASE WHEN id % 4 = 0 THEN 'NOUN' END AS other FROM u),
    w AS (SELECT id, doc, class, text, lemma, CASE WHEN upos0 <> 'DET' AND other IS NOT NULL THEN other ELSE upos0 END AS upos FROM t WHERE length(lemma) >= 2), k AS (SELECT * FROM w WHERE upos IN ('NOUN', 'VERB', 'ADJ', 'ADV')),
    top AS (SELECT lemma, count(*) AS uses, count(DISTINCT doc) AS docs FROM k GROUP BY lemma ORDER BY uses DESC, docs DESC, lemma LIMIT 60),
    pos AS (SELECT lemma, string_agg(upos || ' ' || printf('%.1f', round(100.0 * n / uses, 1)), ', ' ORDER BY n DESC, upos) AS pos FROM (SELECT lemma, upos, count(*) AS n, any_value(uses) AS uses FROM k JOIN top USING (lemma) GROUP BY lemma, upos) GROUP BY lemma),
    cls AS (SELECT lemma, string_agg(class || ' ' || n, ', ' ORDER BY n DESC, class) AS classes FROM (SELECT lemma, class, count(DISTINCT doc) AS n FROM k JOIN top USING (lemma) GROUP BY lemma, class) GROUP BY lemma),
    iu AS (SELECT DISTINCT id, lemma FROM k), pr AS (SELECT a.lemma, b.lemma AS other, count(*) AS n FROM iu a JOIN top USING (lemma) JOIN iu b ON a.id = b.id AND a.lemma <> b.lemma GROUP BY a.lemma, b.lemma),
    com AS (SELECT lemma, string_agg(other, ', ' ORDER BY r) AS companions FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY n DESC, other) AS r FROM pr) WHERE r <= 5 GROUP BY lemma),
    sn AS (SELECT DISTINCT id, doc, lemma, text FROM k JOIN top USING (lemma) WHERE length(text) BETWEEN 20 AND 220), ind AS (SELECT *, row_number() OVER (PARTITION BY lemma, doc ORDER BY id) AS in_doc FROM sn),
    ex AS (SELECT lemma, list(text ORDER BY r) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY in_doc, doc, id) AS r FROM ind) WHERE r <= 3 GROUP BY lemma)"""


@register("c13_dictionary_layer", f"""WITH {_UNITS} SELECT lemma, uses, docs, pos, classes, coalesce(companions, '') AS companions, coalesce(examples, []) AS examples, CASE WHEN lemma < 'm' THEN 'has ' || length(lemma) END AS meaning FROM top LEFT JOIN pos USING (lemma) LEFT JOIN cls USING (lemma) LEFT JOIN com USING (lemma) LEFT JOIN ex USING (lemma)""")
def dictionary_layer(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations are units, with parts of speech made from the length of a word."""
    c, n = F.col, F.col("conv_id") * 100 + F.col("turn")
    parts = F.array(*(F.lit(x) for x in ("NOUN", "VERB", "DET", "ADJ", "ADV")))
    forms = F.regexp_extract_all("text", F.lit(r"\p{L}+(?:['-]\p{L}+)*"), 0)
    own = lambda x: F.get(parts, F.length(x) % 5)
    word = lambda x: F.struct(x.alias("form"), F.lower(x).alias("lemma"), F.when((own(x) != "DET") & (n % 4 == 0), "NOUN").otherwise(own(x)).alias("upos"))
    units = table(spark, d, "conversations").select(n.alias("id"), c("conv_id").alias("doc"), c("role").alias("class"), "text", F.transform(forms, word).alias("words"))
    words = units.select(F.explode("words.lemma").alias("lemma")).distinct().where("lemma < 'm'")
    return cp.dictionary_layer(units, words.select("lemma", F.format_string("has %d", F.length("lemma")).alias("meaning")), 60)


_VOTES = f"""b AS ({_annotated(True)}), a AS ({_annotated(False)}), v AS (SELECT sid % 4 AS file, sid, i, parser, CASE parser WHEN 'p' THEN b.head WHEN 'q' THEN CASE WHEN i % 3 = 0 THEN 1 ELSE b.head END WHEN 'r' THEN CASE WHEN i % 2 = 0 THEN 0 ELSE b.head END ELSE a.head END AS head,
    CASE parser WHEN 's' THEN a.rel ELSE b.rel END AS rel, CASE WHEN length(b.form) = 3 THEN 'PUNCT' ELSE b.tag END AS tag, a.head AS gold FROM b JOIN a USING (sid, i), (SELECT unnest(['p', 'q', 'r', 's']) AS parser))"""


def votes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    a, b = annotated(spark, d, False).select("sid", "i", c("head").alias("gold"), c("rel").alias("rel_a")), annotated(spark, d, True)
    both = b.join(a, ["sid", "i"]).withColumn("parser", F.explode(F.array(*(F.lit(x) for x in "pqrs"))))
    head = F.when(c("parser") == "p", c("head")).when(c("parser") == "q", F.when(c("i") % 3 == 0, 1).otherwise(c("head"))).when(c("parser") == "r", F.when(c("i") % 2 == 0, 0).otherwise(c("head"))).otherwise(c("gold"))
    return both.select((c("sid") % 4).alias("file"), "sid", "i", "parser", head.cast("long").alias("head"), F.when(c("parser") == "s", c("rel_a")).otherwise(c("rel")).alias("rel"), F.when(F.length("form") == 3, "PUNCT").otherwise(c("tag")).alias("tag"), "gold")


@register("e4_pairs_by_file", f"""WITH {_VOTES}, x AS (SELECT l.file, l.parser AS a, r.parser AS b, l.head IS NOT DISTINCT FROM r.head AS h, l.head IS NOT DISTINCT FROM r.head AND l.rel = r.rel AS k FROM v l JOIN v r ON l.sid = r.sid AND l.i = r.i AND l.parser < r.parser WHERE l.tag <> 'PUNCT')
    SELECT file, a, b, count(*) AS words, round(100.0 * count(*) FILTER (h) / count(*), 2) AS uas, round(100.0 * count(*) FILTER (k) / count(*), 2) AS las FROM x GROUP BY file, a, b""")
def pairs_by_file(spark: SparkSession, d: str) -> DataFrame:
    return ag.parser_agreement(votes(spark, d).drop("gold"))


@register("e4_suspects", f"""WITH {_VOTES}, g AS (SELECT sid, i, any_value(gold) AS head, head AS given, count(*) AS n FROM v GROUP BY sid, i, v.head), p AS (SELECT sid, i, any_value(head) AS head, sum(n)::BIGINT AS voters, coalesce(sum(n) FILTER (given <> head), 0)::BIGINT AS against, arg_max(given, (n, -given)) AS best, max(n) AS votes FROM g GROUP BY sid, i)
    SELECT * FROM p WHERE against >= 0.75 * voters""")
def suspects(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d)
    return ag.suspects(v, v.where("parser = 'p'").select("sid", "i", F.col("gold").alias("head")))


_WITNESS = "SELECT doc_id AS id, {label} AS label, {p} AS p FROM labels WHERE {ok}"
_ONE, _TWO = ("CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END", "(doc_id * 7 % 100) / 100", "doc_id % 13 <> 0"), ("CASE WHEN doc_id % 2 = 0 THEN 1 - quality ELSE quality END", "(doc_id * 11 % 100) / 100", "doc_id % 17 <> 0")


@register("e9_label_moves", f"""WITH o AS ({_WITNESS.format(label=_ONE[0], p=_ONE[1], ok=_ONE[2])}), t AS ({_WITNESS.format(label=_TWO[0], p=_TWO[1], ok=_TWO[2])}),
    r AS (SELECT quality AS label, CASE WHEN o.label IS NULL OR t.label IS NULL THEN 'alone' WHEN o.label <> t.label THEN 'split' WHEN o.label = quality THEN 'confirmed' WHEN o.p >= 0.5 AND t.p >= 0.5 THEN 'changed' ELSE 'unsure' END AS rule, o.label AS said FROM labels LEFT JOIN o ON o.id = doc_id LEFT JOIN t ON t.id = doc_id)
    SELECT rule, label, CASE WHEN rule = 'changed' THEN said ELSE label END AS new, count(*) AS n FROM r GROUP BY ALL""")
def label_moves(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    one, two = (labels.where(ok).selectExpr("doc_id AS id", f"{label} AS label", f"{p} AS p") for label, p, ok in (_ONE, _TWO))
    return ag.label_moves(ag.agree_labels(labels.selectExpr("doc_id AS id", "quality AS label"), one, two, 0.5))
