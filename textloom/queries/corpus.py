"""Corpus queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import corpus as cp
from textloom.operators.products import shared_best
from textloom.registry import register, table

_WORDS = "regexp_extract_all(lower(text), '\\p{L}+')"


@register("flagship", f"""
    WITH clean AS (SELECT min(doc_id) AS doc_id, min(lang) AS lang, any_value(text) AS text FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text) GROUP BY text),
    pool AS (SELECT * FROM clean WHERE lower(text) NOT IN (SELECT lower(text) FROM benchmark))
    SELECT lang, word, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, lang, unnest({_WORDS}) AS word FROM pool) GROUP BY lang, word HAVING count(*) >= 3""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    firsts = cp.dedup_by_content(docs).select("doc_id")
    clean = docs.select("doc_id", "lang", "text").join(firsts, "doc_id", "left_semi")
    pool = cp.without_held_out(clean, table(spark, d, "benchmark").select("text"), "text")
    used = pool.select("doc_id", "lang", F.explode(tx.words(F.col("text"))).alias("word"))
    per_doc = used.groupBy("lang", "word", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("lang", "word").agg(F.sum("n").alias("uses"), F.count("*").alias("docs")).where("uses >= 3")


@register("p6_licence_class", f"SELECT doc_id, {tx.LICENCE_SQL.format(t='lower(text)')} AS class FROM documents")
def licence_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.licence_class(F.col("text")).alias("class"))


@register("p7_public_admissible", f"SELECT doc_id, source <> 'src0' AND {tx.LICENCE_SQL.format(t='lower(text)')} IN ('by', 'public domain') AS admissible FROM documents")
def admissible(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", ((F.col("source") != "src0") & tx.licence_class(F.col("text")).isin("by", "public domain")).alias("admissible"))


@register("p8_select_catalogue", """WITH g AS (SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'first' WHEN contains(p_type, 'ECONOMY') THEN 'second' WHEN p_size < 10 THEN 'third' END AS grp FROM part WHERE NOT contains(p_name, 'ring'))
    SELECT grp, count(*) AS n FROM g WHERE grp IS NOT NULL AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) GROUP BY grp""")
def catalogue(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    group = F.when(F.col("p_name").contains("red"), "first").when(F.col("p_type").contains("ECONOMY"), "second").when(F.col("p_size") < 10, "third")
    fits = table(spark, d, "part").where(~F.col("p_name").contains("ring")).select("p_partkey", group.alias("grp")).where("grp is not null")
    return fits.join(held, "p_partkey", "left_anti").groupBy("grp").agg(F.count("*").alias("n"))


@register("p9_priority_tiers", """SELECT page_id, CASE WHEN regexp_matches(url, '/en/') THEN 1 WHEN regexp_matches(url, '[?]page=') THEN 2 WHEN regexp_matches(html, '<table') THEN 3 ELSE 4 END AS tier,
    CAST(regexp_matches(html, '<h[12]') AS INT) * 3 + CAST(regexp_matches(url, 'https') AS INT) * 2 + CAST(length(html) > 2000 AS INT) AS score FROM pages""")
def tiers(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: c.cast("int")
    url, html = F.col("url"), F.col("html")
    tier = F.when(url.rlike("/en/"), 1).when(url.rlike("[?]page="), 2).when(html.rlike("<table"), 3).otherwise(4)
    return table(spark, d, "pages").select("page_id", tier.alias("tier"), (one(html.rlike("<h[12]")) * 3 + one(url.rlike("https")) * 2 + one(F.length(html) > 2000)).alias("score"))


@register("p10_markup_filter", r"""SELECT doc_id, n FROM (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS n, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE NOT regexp_matches(line, '</?[a-z]+>|\{\{|\]\]') AND length(line) - length(replace(line, '|', '')) < 3""")
def markup(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    clean = ~F.col("line").rlike(r"</?[a-z]+>|\{\{|\]\]") & (F.length("line") - F.length(F.translate("line", "|", "")) < 3)
    return lines.where(clean).select("doc_id", (F.col("n") + 1).cast("long").alias("n"))


@register("p11_personal_tokens", f"""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\n]+')) AS t FROM documents)
    WHERE regexp_matches(t, '^{tx.EMAIL}$') OR regexp_matches(t, '^https?://[^ \\n]+$') OR regexp_matches(t, '{tx.HANDLE}') OR regexp_matches(t, '^\\+?[0-9][0-9() -]{{6,}}[0-9]$') GROUP BY doc_id""")
def personal_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), 0)).alias("t"))
    return t.where(tx.personal(F.col("t"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@register("p11_redact", f"SELECT doc_id, sha256(regexp_replace(text, '{tx.EMAIL}', '<redacted>', 'g')) AS text_sha256 FROM documents")
def redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.regexp_replace("text", tx.EMAIL, "<redacted>"), 256).alias("text_sha256"))


@register("p12_held_out_name", "SELECT page_id, regexp_matches(lower(url), '(test|dev|held|gold|eval)') AS held_out FROM pages")
def held_out_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.lower("url").rlike("(test|dev|held|gold|eval)").alias("held_out"))


@register("p14_topic_rules", """WITH r(topic, pattern, priority) AS (VALUES ('a', 'the', 3), ('a', 'ation', 1), ('b', 'ment', 2), ('c', 'keit', 1), ('b', 'http', 1))
    SELECT doc_id, topic, min(priority) AS priority FROM documents JOIN r ON contains(lower(text), pattern) GROUP BY doc_id, topic""")
def topic_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("a", "the", 3), ("a", "ation", 1), ("b", "ment", 2), ("c", "keit", 1), ("b", "http", 1)], "topic string, pattern string, priority int")
    return table(spark, d, "documents").join(F.broadcast(rules), F.contains(F.lower("text"), F.col("pattern"))).groupBy("doc_id", "topic").agg(F.min("priority").alias("priority"))


@register("c1_sentences", r"""WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS para, unnest(string_split(text, chr(10))) AS line FROM documents),
    s AS (SELECT doc_id, para, CAST(generate_subscripts(regexp_extract_all(line, '[^.!?]+[.!?]*'), 1) AS BIGINT) AS k, trim(unnest(regexp_extract_all(line, '[^.!?]+[.!?]*'))) AS sentence FROM l)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para, k) AS n, sentence FROM s WHERE len(regexp_split_to_array(sentence, ' +')) BETWEEN 3 AND 60""")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    return cp.sentences(table(spark, d, "documents"))


@register("c1_book_sentences", r"""WITH p AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS p, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t\r\n]+', ' ', 'g')) AS para FROM documents),
    s AS (SELECT doc_id, p, CAST(generate_subscripts(regexp_extract_all(para, '[^.!?]+[.!?]*'), 1) AS BIGINT) AS k, trim(unnest(regexp_extract_all(para, '[^.!?]+[.!?]*'))) AS sentence FROM p WHERE length(para) >= 20 AND 2 * length(regexp_replace(para, '[^\p{Lu}]', '', 'g')) <= length(para))
    SELECT doc_id::VARCHAR || ':' || row_number() OVER (PARTITION BY doc_id ORDER BY p, k) AS id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) AS n, sentence FROM s WHERE len(string_split(sentence, ' ')) BETWEEN 3 AND 60""")
def book_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the documents as books with markers, CR LF, a heading and a licence that aren't read."""
    head, foot = "Title of a book.\r\n\r\n*** START OF THIS BOOK ***\r\n\r\nCHAPTER ONE OF THE BOOK OF ALL\r\n\r\n", "\r\n\r\n*** END OF THIS BOOK ***\r\n\r\nThe licence of the book says a lot. It is not read at all.\r\n"
    blank = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    book = F.when(F.col("doc_id") % 3 == 0, blank).otherwise(F.concat(F.lit(head), F.replace(blank, F.lit("\n"), F.lit("\r\n")), F.lit(foot)))
    return cp.book_sentences(table(spark, d, "documents").select("doc_id", book.alias("text")))


@register("c2_tokens", r"""SELECT kind, token, count(*) AS n FROM (SELECT token, CASE WHEN regexp_matches(token, '^\p{N}+$') THEN 'number' WHEN regexp_matches(token, '^[\p{L}\p{N}]') THEN 'word' ELSE 'mark' END AS kind
    FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''-][\p{L}\p{N}]+)*|[^\p{L}\p{N} \n]')) AS token FROM documents)) GROUP BY kind, token""")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    return cp.tokens(table(spark, d, "documents")).groupBy("kind", "token").agg(F.count("*").alias("n"))


@register("c3_chunks", r"""WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS para, unnest(string_split(text, chr(10))) AS line FROM documents),
    s AS (SELECT doc_id, para, CAST(generate_subscripts(regexp_extract_all(line, '[^.!?]+[.!?]*'), 1) AS BIGINT) AS k, trim(unnest(regexp_extract_all(line, '[^.!?]+[.!?]*'))) AS sentence FROM l),
    n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para, k) AS n, regexp_split_to_array(sentence, ' +') AS w FROM s), p AS (SELECT doc_id, n, w, unnest(generate_series(0, (len(w) - 1) // 25)) AS k FROM n)
    SELECT doc_id, n, k, array_to_string(w[k * 25 + 1 : k * 25 + 25], ' ') AS chunk, len(w[k * 25 + 1 : k * 25 + 25]) AS words FROM p WHERE len(w[k * 25 + 1 : k * 25 + 25]) >= 3""")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    return cp.chunks(table(spark, d, "documents"))


@register("c3_clean_chunks", r"""WITH c AS (SELECT page_id AS doc_id, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(html, '<[^<>]*>', ' ', 'g'), '&nbsp;|&thinsp;', ' ', 'g'), '&amp;', '&'), '\([^()]{0,60}\)|\[[^\[\]]{0,60}\]|\{[^{}]{0,60}\}', '', 'g'), '[ \t\r\n]+', ' ', 'g')) AS t FROM pages),
    e AS (SELECT doc_id, regexp_extract_all(t, '(?:[^ ]+ ){0,24}?[^ ]*[.:?!;](?: |$)|(?:[^ ]+(?: |$)){1,25}') AS e FROM c), p AS (SELECT doc_id, unnest(e) AS chunk, CAST(generate_subscripts(e, 1) AS BIGINT) AS k FROM e)
    SELECT doc_id, k, trim(chunk) AS chunk, len(regexp_extract_all(chunk, '[^ ]*\p{L}[^ ]*')) AS words FROM p WHERE len(regexp_extract_all(chunk, '[^ ]*\p{L}[^ ]*')) >= 3""")
def clean_chunks(spark: SparkSession, d: str) -> DataFrame:
    return cp.clean_chunks(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


@register("c4_sentence_pool", """WITH s AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS sentence FROM documents UNION ALL SELECT conv_id + 1000000 AS doc_id, trim(unnest(string_split(text, chr(10)))) FROM conversations)
    SELECT doc_id, count(*) AS n FROM s WHERE len(string_split(sentence, ' ')) BETWEEN 3 AND 200 AND lower(sentence) NOT IN (SELECT lower(trim(unnest(string_split(text, chr(10))))) FROM benchmark) GROUP BY doc_id""")
def sentence_pool(spark: SparkSession, d: str) -> DataFrame:
    cut = lambda df, key: df.select(key.alias("doc_id"), F.explode(F.split("text", "\n")).alias("sentence")).withColumn("sentence", F.trim("sentence"))
    pool = cut(table(spark, d, "documents"), F.col("doc_id")).union(cut(table(spark, d, "conversations"), F.col("conv_id") + 1000000))
    pool = pool.where(F.size(F.split("sentence", " ")).between(3, 200))
    held = cut(table(spark, d, "benchmark"), F.col("item_id")).select(F.lower("sentence").alias("key")).distinct()
    return pool.join(held, F.lower(pool["sentence"]) == held["key"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))


@register("c7_page_licence", r"""SELECT page_id, coalesce(nullif(regexp_extract(html, 'rel="license"[^>]*href="([^"]*)"', 1), ''), nullif(regexp_extract(html, '(https?://creativecommons\.org/[^"'' <>]*)', 1), ''),
    nullif(regexp_extract(html, '<meta name="license" content="([^"]*)"', 1), ''), CASE WHEN contains(lower(html), 'all rights reserved') THEN 'all rights reserved' END) AS licence FROM pages""")
def page_licence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", cp.page_licence(F.col("html")).alias("licence"))


@register("c8_wordcount", f"""SELECT {tx.SINGULAR_SQL.format(w='w')} AS word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM documents) WHERE length(w) >= 3 GROUP BY 1 HAVING count(*) >= 3""")
def wordcount(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.explode(tx.words(F.col("text"))).alias("w")).where("length(w) >= 3")
    return w.groupBy(tx.singular(F.col("w")).alias("word")).agg(F.count("*").alias("n")).where("n >= 3")


@register("c9_register_lexicon", f"""WITH a AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM conversations) GROUP BY 1), b AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM documents) GROUP BY 1),
    j AS (SELECT coalesce(a.word, b.word) AS word, coalesce(a.n, 0) AS ya, coalesce(b.n, 0) AS yb FROM a FULL JOIN b USING (word)), t AS (SELECT *, sum(ya) OVER () AS na, sum(yb) OVER () AS nb FROM j),
    p AS (SELECT *, 1000.0::DOUBLE * (ya + yb) / (na + nb) AS al FROM t), z AS (SELECT word, ya, yb, (ln((ya + al) / (na + 1000.0 - ya - al)) - ln((yb + al) / (nb + 1000.0 - yb - al))) / sqrt(1 / (ya + al) + 1 / (yb + al)) AS z FROM p)
    SELECT word, ya, yb, round(z, 4) AS z FROM z WHERE z >= 2.0 AND ya >= 5""")
def register_lexicon(spark: SparkSession, d: str) -> DataFrame:
    count = lambda t: table(spark, d, t).select(F.explode(tx.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return cp.register_lexicon(count("conversations"), count("documents")).withColumn("z", F.round("z", 4))


_PAIRS = f"SELECT doc_id, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents))"


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", tx.words(F.col("text")).alias("w")).where("size(w) > 1")
    return w.select("doc_id", F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("p")).select("doc_id", "p.a", "p.b")


@register("c10_collocations", f"""WITH c AS (SELECT a, b, sum(n)::BIGINT AS n, count(*) AS docs FROM (SELECT a, b, doc_id, count(*) AS n FROM ({_PAIRS}) GROUP BY ALL) GROUP BY a, b), x AS (SELECT a, sum(n) AS na FROM c GROUP BY a), y AS (SELECT b, sum(n) AS nb FROM c GROUP BY b)
    SELECT a, b, n, docs, round(log2(n::DOUBLE * (SELECT sum(n) FROM c) / (na * nb)), 4) AS pmi FROM c JOIN x USING (a) JOIN y USING (b) WHERE n >= 3 AND docs >= 2""")
def collocations(spark: SparkSession, d: str) -> DataFrame:
    return cp.collocations(neighbours(spark, d)).withColumn("pmi", F.round("pmi", 4))


_KIND = "CASE (length(a) + length(b)) % 9 WHEN 0 THEN 'idiom' WHEN 1 THEN 'verb-phrase' WHEN 2 THEN 'phrase' ELSE 'other' END"
_LIGHT = (*cp.LIGHT_VERBS, "the", "der", "el", "la", "le", "les", "und")


def _adjacent(of: str) -> str:
    return f"SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM (SELECT {_WORDS} AS w FROM {of}))"


@register("c10_collocation_kinds", f"""WITH c AS (SELECT a, b, sum(n)::BIGINT AS n, count(*) AS docs FROM (SELECT a, b, doc_id, count(*) AS n FROM ({_PAIRS}) GROUP BY ALL) GROUP BY a, b), x AS (SELECT a, sum(n) AS na FROM c GROUP BY a), y AS (SELECT b, sum(n) AS nb FROM c GROUP BY b),
    e AS (SELECT a, b, 'user: ' || a || ' ' || b AS title, {_KIND} AS kind, 1 AS layer FROM ({_adjacent("conversations WHERE role = 'user'")}) UNION ALL SELECT a, b, 'assistant: ' || a || ' ' || b, CASE WHEN length(a) % 5 = 0 THEN 'idiom' ELSE 'verb-phrase' END, 2 FROM ({_adjacent("conversations WHERE role = 'assistant'")})),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY kind <> 'idiom', layer, title) AS r FROM e) WHERE r = 1), o AS (SELECT a, b, length(b) % 4 AS score FROM ({_adjacent("benchmark")})),
    p AS (SELECT c.a, c.b, n, docs, log2(n::DOUBLE * (SELECT sum(n) FROM c) / (na * nb)) AS pmi, title, kind, coalesce(score >= 2, false) AS odd, c.a IN {_LIGHT} AS light FROM c JOIN x ON x.a = c.a JOIN y ON y.b = c.b LEFT JOIN m ON m.a = c.a AND m.b = c.b LEFT JOIN o ON o.a = c.a AND o.b = c.b WHERE n >= 3 AND (kind IS NOT NULL OR (n >= 5 AND docs >= 2))),
    k AS (SELECT a, b, n, docs, pmi, title, CASE WHEN kind = 'idiom' THEN 'idiom' WHEN light AND (odd OR kind IS NOT NULL) THEN 'light-verb' WHEN odd AND NOT light AND pmi >= 3 THEN 'idiom' WHEN kind IS NOT NULL OR (NOT odd AND pmi >= 5) THEN 'collocation' END AS kind FROM p)
    SELECT a, b, kind, n, docs, round(pmi, 4) AS pmi, title FROM k WHERE kind IS NOT NULL""")
def collocation_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of words of the turns of a role are the two dictionary layers, those of the benchmark have scores of oddness."""

    def pairs(df: DataFrame) -> DataFrame:
        w = df.select(tx.words(F.col("text")).alias("w")).where("size(w) > 1")
        return w.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("p")).select("p.a", "p.b").distinct()

    said = lambda role: pairs(table(spark, d, "conversations").where(F.col("role") == role))
    title = lambda role: F.concat(F.lit(f"{role}: "), "a", F.lit(" "), "b").alias("title")
    user = said("user").select("a", "b", title("user"), F.expr(_KIND).alias("kind"))
    assistant = said("assistant").select("a", "b", title("assistant"), F.when(F.length("a") % 5 == 0, "idiom").otherwise("verb-phrase").alias("kind"))
    odd = pairs(table(spark, d, "benchmark")).withColumn("score", F.length("b") % 4)
    return cp.collocation_kinds(neighbours(spark, d), cp.merge_entries([user, assistant]), odd, _LIGHT).withColumn("pmi", F.round("pmi", 4))


@register("c12_ability_table", f"""WITH g AS (SELECT p.a AS head, p.b AS action, lang AS relation, count(*) AS n FROM ({_PAIRS}) p JOIN documents USING (doc_id) WHERE length(p.b) >= 3 GROUP BY ALL HAVING count(*) >= 2), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY relation, head ORDER BY n DESC, action) AS k FROM g) WHERE k <= 6)
    SELECT relation || '_' || action AS name, count(*) AS n, string_agg(head, ' ' ORDER BY head) AS words FROM t GROUP BY relation, action HAVING count(*) >= 2""")
def ability_table(spark: SparkSession, d: str) -> DataFrame:
    lang = table(spark, d, "documents").select("doc_id", F.col("lang").alias("relation"))
    uses = neighbours(spark, d).where(F.length("b") >= 3).join(lang, "doc_id").select("relation", F.col("a").alias("head"), F.col("b").alias("action"))
    return cp.ability_table(uses)


@register("a23_cells", f"SELECT a, b, sum(n)::BIGINT AS n, count(*) AS books FROM (SELECT a, b, doc_id, count(*) AS n FROM ({_PAIRS}) GROUP BY ALL) GROUP BY a, b HAVING sum(n) >= 2")
def cells(spark: SparkSession, d: str) -> DataFrame:
    per = neighbours(spark, d).groupBy("a", "b", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("a", "b").agg(F.sum("n").alias("n"), F.count("*").alias("books")).where("n >= 2")


@register("a24_interactions", """WITH e AS (SELECT DISTINCT user_id, event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM events)
    SELECT least(x.user_id, y.user_id) AS a, greatest(x.user_id, y.user_id) AS b, count(*) AS n FROM e x JOIN e y ON x.hour = y.hour AND x.event_type = y.event_type AND x.user_id < y.user_id GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 30""")
def interactions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", F.floor(F.unix_timestamp("ts") / 3600).alias("hour")).distinct()
    entries = e.where("event_type is not null and hour is not null").select(F.col("user_id").alias("a"), F.struct("event_type", "hour").alias("f"), F.lit(1.0).alias("v"))
    best = shared_best(entries, 30, each=False)
    return best.select("a", "b", F.col("s").cast("long").alias("n")).orderBy(F.desc("n"), "a", "b").limit(30)


@register("c11_lift", f"""WITH w AS (SELECT unnest({_WORDS}) AS word, lang FROM documents), c AS (SELECT word, lang, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT word, sum(n) AS tot FROM c GROUP BY word), b AS (SELECT lang, sum(n) / (SELECT sum(n) FROM c) AS share FROM c GROUP BY lang),
    l AS (SELECT word, lang, n, (n / tot) / share AS lift FROM c JOIN t USING (word) JOIN b USING (lang) WHERE tot >= 6 AND n >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY round(lift, 6) DESC, lang) AS r FROM l) SELECT word, lang, n, round(lift, 4) AS lift FROM r WHERE r = 1 AND lift >= 2""")
def lift(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select(F.explode(tx.words(F.col("text"))).alias("word"), "lang").groupBy("word", "lang").agg(F.count("*").alias("n"))
    tot = c.groupBy("word").agg(F.sum("n").alias("tot"))
    base = c.groupBy("lang").agg(F.sum("n").alias("m")).join(F.broadcast(c.agg(F.sum("n").alias("every")))).select("lang", (F.col("m") / F.col("every")).alias("share"))
    rows = c.join(tot, "word").join(base, "lang").where("tot >= 6 and n >= 3").withColumn("lift", F.col("n") / F.col("tot") / F.col("share"))
    best = rows.groupBy("word").agg(F.min(F.struct(-F.round("lift", 6), F.col("lang"), F.col("n"), F.col("lift"))).alias("b"))
    return best.where("b.lift >= 2").select("word", "b.lang", "b.n", F.round("b.lift", 4).alias("lift"))


@register("c13_companions", """WITH u AS (SELECT DISTINCT conv_id AS doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}{6,}')) AS word FROM conversations), p AS (SELECT x.word, y.word AS other, count(*) AS n FROM u x JOIN u y USING (doc_id) WHERE x.word <> y.word GROUP BY ALL)
    SELECT word, other, n, r FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS r FROM p) WHERE r <= 5""")
def companions(spark: SparkSession, d: str) -> DataFrame:
    return cp.companions(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.explode(tx.words(F.col("text"), "\\p{L}{6,}")).alias("word")))


@register("d1_union_distinct", f"SELECT DISTINCT unnest({_WORDS}) AS word FROM documents UNION SELECT unnest({_WORDS}) FROM benchmark UNION SELECT unnest({_WORDS}) FROM conversations")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t: table(spark, d, t).select(F.explode(tx.words(F.col("text"))).alias("word"))
    return one("documents").unionByName(one("benchmark")).unionByName(one("conversations")).distinct()


@register("d2_content_key", "SELECT substr(sha256(trim(text)), 1, 16) AS key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_key(spark: SparkSession, d: str) -> DataFrame:
    return cp.dedup_by_content(table(spark, d, "documents"))


@register("d3_heldout_filter", r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS sentence FROM documents), h AS (SELECT DISTINCT trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[ \t\r\n]+', ' ', 'g')) AS key FROM benchmark)
    SELECT doc_id, count(*) AS n FROM s WHERE trim(regexp_replace(lower(sentence), '[ \t\r\n]+', ' ', 'g')) NOT IN (SELECT key FROM h) GROUP BY doc_id""")
def heldout(spark: SparkSession, d: str) -> DataFrame:
    cut = lambda t: table(spark, d, t).select("*", F.explode(F.split("text", "\n")).alias("sentence")).drop("text")
    return cp.without_held_out(cut("documents"), cut("benchmark")).groupBy("doc_id").agg(F.count("*").alias("n"))


@register("d4_near_duplicate", """WITH s AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '\\p{L}{3,}'))) AS w FROM documents), c AS (SELECT w, min(doc_id) AS class_id FROM s WHERE len(w) > 0 GROUP BY w),
    p AS (SELECT a.class_id AS a, b.class_id AS b FROM c a JOIN c b ON a.class_id <> b.class_id AND len(a.w) >= 4 AND len(b.w) >= 4 AND len(a.w) >= 0.8 * len(b.w) AND len(b.w) >= 0.8 * len(a.w) WHERE len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
    n AS (SELECT a, count(*) AS links FROM p GROUP BY a) SELECT doc_id, class_id, coalesce(links, 0) AS links FROM s JOIN c USING (w) LEFT JOIN n ON n.a = class_id""")
def near_duplicate(spark: SparkSession, d: str) -> DataFrame:
    return cp.near_duplicate_words(table(spark, d, "documents"))


_RUNS = """WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), bw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
    dg AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 6], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 6)) AS p FROM dw WHERE len(w) >= 6)),
    bg AS (SELECT item_id, q, array_to_string(w[q + 1 : q + 6], ' ') AS gram FROM (SELECT item_id, w, unnest(generate_series(0, len(w) - 6)) AS q FROM bw WHERE len(w) >= 6)),
    m AS (SELECT doc_id, item_id, p, p - q AS d, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS island FROM dg JOIN bg USING (gram)),
    r AS (SELECT doc_id, item_id, max(length) AS longest FROM (SELECT doc_id, item_id, count(*) + 5 AS length FROM m GROUP BY doc_id, item_id, d, island) GROUP BY doc_id, item_id)"""


@register("d5_verbatim_run", f"{_RUNS} SELECT doc_id, item_id, longest FROM r")
def verbatim_run(spark: SparkSession, d: str) -> DataFrame:
    return cp.shared_runs(table(spark, d, "documents"), table(spark, d, "benchmark"))


def _grams_sql(name: str, of: str, key: str, n: int) -> str:
    return f"{name} AS (SELECT {key}, i - 1 AS p, md5(array_to_string(list_slice(w, i, i + {n - 1}), ' ')) AS h FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM {of} WHERE len(w) >= {n}))"


def _prints_sql(name: str, of: str, key: str) -> str:
    least = f"min({{'h': h, 'p': p}}) OVER (PARTITION BY {key} ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)"
    return f"{name} AS (SELECT DISTINCT {key}, f.h AS h, f.p AS p FROM (SELECT {key}, p, {least} AS f, count(*) OVER (PARTITION BY {key}) AS n FROM {of}) WHERE p <= greatest(n - 4, 0))"


_SAID = "coalesce(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), [])"


@register("d7_originality_gate", f"""WITH dw AS (SELECT doc_id, {_SAID} AS w FROM documents), bw AS (SELECT item_id, {_SAID} AS w FROM benchmark),
    {_grams_sql("d6", "dw", "doc_id", 6)}, {_grams_sql("b6", "bw", "item_id", 6)}, {_grams_sql("d13", "dw", "doc_id", 13)}, {_grams_sql("b13", "bw", "item_id", 13)}, {_grams_sql("d3", "dw", "doc_id", 3)}, {_grams_sql("b3", "bw", "item_id", 3)},
    {_prints_sql("df", "d3", "doc_id")}, {_prints_sql("bf", "b3", "item_id")},
    cover AS (SELECT doc_id, count(DISTINCT k) AS covered FROM (SELECT doc_id, unnest(generate_series(p, p + 5)) AS k FROM d6 WHERE h IN (SELECT h FROM b6)) GROUP BY doc_id),
    exact AS (SELECT doc_id, count(*) AS exact FROM d13 WHERE h IN (SELECT h FROM b13) GROUP BY doc_id),
    met AS (SELECT d.doc_id, d.p, d.n AS n_all, b.item_id FROM (SELECT *, count(*) OVER (PARTITION BY doc_id ORDER BY p RANGE BETWEEN CURRENT ROW AND 23 FOLLOWING) AS n FROM df) d JOIN (SELECT DISTINCT h, item_id FROM bf) b ON b.h = d.h),
    windows AS (SELECT doc_id, count(DISTINCT p) AS near FROM (SELECT doc_id, p, n_all, count(*) OVER (PARTITION BY doc_id, item_id ORDER BY p RANGE BETWEEN CURRENT ROW AND 23 FOLLOWING) AS n FROM met) WHERE n >= 4 AND 100 * n >= 60 * n_all GROUP BY doc_id),
    r AS (SELECT dw.doc_id, len(w) AS words, coalesce(exact, 0) AS exact, coalesce(covered, 0) AS covered, coalesce(near, 0) AS near FROM dw LEFT JOIN exact USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN windows USING (doc_id))
    SELECT *, CASE WHEN exact > 0 OR near > 0 OR (covered >= 24 AND 100 * covered >= 20 * words) THEN 'blocked' WHEN covered > 0 OR words = 0 THEN 'pending' ELSE 'clear' END AS state FROM r""")
def originality(spark: SparkSession, d: str) -> DataFrame:
    return cp.originality(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text"))


@register("d9_sync_source", """WITH cur AS (SELECT doc_id FROM documents WHERE n_chars > 1000), st AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT 'found' AS event, doc_id FROM cur WHERE doc_id NOT IN (SELECT doc_id FROM st)
    UNION ALL SELECT 'learned', doc_id FROM st WHERE doc_id NOT IN (SELECT doc_id FROM cur)""")
def sync_source(spark: SparkSession, d: str) -> DataFrame:
    now, state = table(spark, d, "documents").where("n_chars > 1000").select("doc_id"), table(spark, d, "labels").where("quality = 1").select("doc_id")
    return now.join(state, "doc_id", "left_anti").select(F.lit("found").alias("event"), "doc_id").unionByName(state.join(now, "doc_id", "left_anti").select(F.lit("learned").alias("event"), "doc_id"))


@register("d10_same_text_transfer", """WITH b AS (SELECT d.text, max(l.quality) AS quality FROM documents d JOIN labels l USING (doc_id) GROUP BY d.text) SELECT d.doc_id, b.quality FROM documents d JOIN b ON b.text = d.text WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def same_text(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key")), table(spark, d, "labels")
    best = docs.join(labels, "doc_id").groupBy("key").agg(F.max("quality").alias("quality"))
    return docs.join(labels, "doc_id", "left_anti").join(best, "key").select("doc_id", "quality")


@register("f3_singular", f"SELECT DISTINCT w, {tx.SINGULAR_SQL.format(w='w')} AS lemma FROM (SELECT unnest({_WORDS}) AS w FROM benchmark)")
def singular(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("w")).distinct()
    return w.select("w", tx.singular(F.col("w")).alias("lemma"))


@register("f4_slug", "SELECT doc_id, substr(regexp_replace(regexp_replace(lower(concat_ws('-', source, substr(text, 1, 90))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 70) AS slug FROM documents")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.slug(F.col("source"), F.substring("text", 1, 90)).alias("slug"))


@register("f5_lists", """SELECT doc_id, list_contains(w, 'the') AS has, list_has_any(w, ['of', 'de']) AS any_of, len(list_filter(w, lambda x: length(x) > 8)) AS long_words FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents)""")
def lists(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", tx.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.array_contains("w", "the").alias("has"), F.arrays_overlap("w", F.array(F.lit("of"), F.lit("de"))).alias("any_of"), F.size(F.filter("w", lambda x: F.length(x) > 8)).cast("long").alias("long_words"))


@register("f6_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("f7_dates", "SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719529 AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS text, CAST(o_orderdate + INTERVAL 5 MONTH AS DATE) AS later FROM orders")
def dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", tx.day_number(day).cast("long").alias("day"), F.date_format(day, "yyyy-MM-dd HH:mm:ss").alias("text"), F.add_months(day, 5).alias("later"))


@register("f8_units", "SELECT event_id, CAST(ceil(CASE WHEN event_id % 2 = 0 THEN value ELSE value * 1024 END) AS BIGINT) AS kb FROM events")
def units(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.col("value").cast("string"), F.when(F.col("event_id") % 2 == 0, "kb").otherwise(" MB"))
    return table(spark, d, "events").select("event_id", tx.kilobytes(said).alias("kb"))


@register("f10_levenshtein", "SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def levenshtein(spark: SparkSession, d: str) -> DataFrame:
    """Each name against that of the next part."""
    names = table(spark, d, "part").select("p_partkey", "p_name")
    after = names.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return names.join(after, "p_partkey").select("p_partkey", F.levenshtein("p_name", "other").cast("long").alias("distance"))


@register("f1_string", "SELECT p_partkey, lower(p_name) AS low, substr(p_name, 2, 3) AS middle, length(p_name) AS size, split_part(p_brand, '#', 2) AS brand, replace(p_type, 'S', 's') AS kind, trim('  ' || p_name || ' ') AS trimmed, left(p_name, 4) AS start, p_type LIKE '%STEEL%' AS steel, contains(p_name, 'a') AS has_a FROM part")
def strings(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", F.lower(n).alias("low"), F.substring(n, 2, 3).alias("middle"), F.length(n).cast("long").alias("size"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand"), F.replace("p_type", F.lit("S"), F.lit("s")).alias("kind"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("trimmed"),
        F.left(n, F.lit(4)).alias("start"), F.col("p_type").like("%STEEL%").alias("steel"), F.contains(n, F.lit("a")).alias("has_a"),
    )


@register("f2_regex", r"SELECT doc_id, regexp_extract(text, '([A-Z][a-z]+)', 1) AS first_name, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS masked, regexp_matches(text, '[0-9]{3}') AS has_number, len(regexp_split_to_array(text, '[ \n]+')) AS parts FROM documents")
def regexes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.regexp_extract(t, "([A-Z][a-z]+)", 1).alias("first_name"), F.md5(F.regexp_replace(t, "[0-9]+", "#")).alias("masked"), t.rlike("[0-9]{3}").alias("has_number"), F.size(F.split(t, r"[ \n]+")).cast("long").alias("parts"))
