"""Windows over ordered rows, sampling and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import sampling as sm
from textloom.operators import sequences as sq
from textloom.registry import register, table


@register("w6_previous_context", """SELECT conv_id, turn, len(string_split(text, ' ')) AS words, lag(role, 1) OVER w AS role_before, right(lag(text, 1) OVER w, 40) AS tail_before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def previous_context(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("text").over(w)
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(F.split("text", " ")).cast("long").alias("words"), F.lag("role").over(w).alias("role_before"), F.when(before.isNotNull(), F.right(before, F.lit(40))).alias("tail_before"))


@register("w7_cumulative", """SELECT user_id, event_id, round(sum(value) OVER r, 3) AS cumsum, round(value - lag(value) OVER w, 4) AS diff1, round(value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w, 4) AS diff2
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def cumulative(spark: SparkSession, d: str) -> DataFrame:
    out = sq.cumulative(table(spark, d, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value")
    return out.select("user_id", "event_id", F.round("cumsum", 3).alias("cumsum"), F.round("diff1", 4).alias("diff1"), F.round("diff2", 4).alias("diff2"))


@register("w7_cumprod", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(ln(product(round(100 - 100 * l_discount)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)), 9) AS log_cumprod FROM lineitem""")
def cumprod(spark: SparkSession, d: str) -> DataFrame:
    """Of what is left in percent; its logarithm, as products of decimals often end in the digit that rounding turns on."""
    kept = table(spark, d, "lineitem").withColumn("kept", F.round(100 - 100 * F.col("l_discount")))
    out = sq.cumulative(kept, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "kept")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.ln("cumprod"), 9).alias("log_cumprod"))


@register("w8_moving", """SELECT user_id, event_id, round(avg(value) OVER w, 4) AS movmean, round(sum(value) OVER w, 3) AS movsum, min(value) OVER w AS movmin, max(value) OVER w AS movmax, round(median(value) OVER w, 4) AS movmedian
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""")
def moving(spark: SparkSession, d: str) -> DataFrame:
    out = sq.moving(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 4)
    return out.select("user_id", "event_id", F.round("movmean", 4).alias("movmean"), F.round("movsum", 3).alias("movsum"), "movmin", "movmax", F.round("movmedian", 4).alias("movmedian"))


@register("w9_sliding_minimum", """SELECT user_id, event_id, least, least_at FROM (SELECT user_id, event_id, min(value) OVER w AS least, arg_min(event_id, (value, event_id)) OVER w AS least_at, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE r >= 5""")
def sliding_minimum(spark: SparkSession, d: str) -> DataFrame:
    return sq.sliding_minimum(table(spark, d, "events"), ["user_id"], "event_id", "value", 5)


@register("w10_interval_union", """WITH i AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(ts)) AS BIGINT) + 600 + CAST(value * 60 AS BIGINT) AS b FROM events), m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
    s AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT user_id, island::BIGINT AS island, min(a) AS start, max(b) AS "end", max(b) - min(a) AS length FROM s GROUP BY user_id, island""")
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    start = F.unix_timestamp("ts")
    e = table(spark, d, "events").select("user_id", start.alias("a"), (start + 600 + F.round(F.col("value") * 60).cast("long")).alias("b"))
    return sq.interval_union(e, ["user_id"], "a", "b")


@register("w11_interval_schedule")
def interval_schedule(spark: SparkSession, d: str) -> DataFrame:
    start = F.unix_timestamp("ts")
    e = table(spark, d, "events").select("user_id", "event_id", start.alias("a"), (start + 600 + F.round(F.col("value") * 60).cast("long")).alias("b"), F.round(F.col("value") * 100).cast("long").alias("weight")).where("weight > 0")
    return sq.weighted_schedule(e, "user_id", "event_id", "a", "b", "weight")


@register("w12_run_lengths", """WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT user_id, run::BIGINT AS run, min(event_type) AS value, min(event_id) AS first_at, count(*) AS length FROM r GROUP BY user_id, run""")
def run_lengths(spark: SparkSession, d: str) -> DataFrame:
    return sq.run_lengths(table(spark, d, "events"), ["user_id"], "event_id", "event_type")


@register("w11_schedule_totals", """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(ts)) AS BIGINT) + 600 + CAST(value * 60 AS BIGINT) AS b, CAST(round(value * 100) AS BIGINT) AS weight FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY b, a, event_id) AS k FROM e WHERE weight > 0),
    p AS (SELECT x.user_id, x.k, any_value(x.weight) AS weight, count(y.k) AS q FROM r x LEFT JOIN r y ON y.user_id = x.user_id AND y.b <= x.a GROUP BY x.user_id, x.k),
    t AS (SELECT user_id, 0::BIGINT AS k, [0::BIGINT] AS best FROM r GROUP BY user_id UNION ALL SELECT t.user_id, p.k, list_append(t.best, greatest(t.best[len(t.best)], t.best[p.q + 1] + p.weight)) FROM t JOIN p ON p.user_id = t.user_id AND p.k = t.k + 1)
    SELECT user_id, max(best[len(best)]) AS weight FROM t GROUP BY user_id""")
def schedule_totals(spark: SparkSession, d: str) -> DataFrame:
    return interval_schedule(spark, d).groupBy("user_id").agg(F.sum("weight").alias("weight"))


_U = "CAST(('0x' || substr(sha256({}), 1, 8)) AS BIGINT)"


@register("w13_isotonic", """WITH g AS (SELECT l_quantity AS x, avg(l_extendedprice) AS y, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT a.x AS a, b.x AS b, sum(g.y * g.n) / sum(g.n) AS m FROM g a JOIN g b ON a.x <= b.x JOIN g ON g.x BETWEEN a.x AND b.x GROUP BY 1, 2)
    SELECT g.x AS l_quantity, round(any_value(g.y), 4) AS price, round(max(low), 4) AS fitted FROM g JOIN (SELECT g.x, s.a, min(s.m) AS low FROM g JOIN s ON s.a <= g.x AND s.b >= g.x GROUP BY g.x, s.a) t ON t.x = g.x GROUP BY g.x""")
def isotonic(spark: SparkSession, d: str) -> DataFrame:
    out = sq.isotonic(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("l_quantity", F.round("mean", 4).alias("price"), F.round("fitted", 4).alias("fitted"))


@register("w14_context_batches", """WITH RECURSIVE c AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), t AS (SELECT conv_id, turn, words, k, 0::BIGINT AS batch, words AS used FROM c WHERE k = 1
    UNION ALL SELECT c.conv_id, c.turn, c.words, c.k, CASE WHEN t.used > 0 AND t.used + c.words > 120 THEN t.batch + 1 ELSE t.batch END, CASE WHEN t.used > 0 AND t.used + c.words > 120 THEN c.words ELSE t.used + c.words END FROM t JOIN c ON c.conv_id = t.conv_id AND c.k = t.k + 1)
    SELECT conv_id, turn, words::INTEGER AS words, batch, lag(turn, 1) OVER w AS before1, lag(turn, 2) OVER w AS before2 FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def context_batches(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.size(F.split("text", " ")).alias("words"))
    return sq.greedy_batches(c, "conv_id", "turn", "words", 120)


@register("w15_paragraph_windows", f"""WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) > 0) AS p FROM documents), a AS (SELECT doc_id, {_U.format("'seed' || doc_id")} % len(p) AS start, unnest(generate_series(0, len(p) - 1)) AS k, p FROM p WHERE len(p) > 0),
    n AS (SELECT doc_id, k, len(regexp_extract_all(p[k + 1], '[.!?]+')) AS n FROM a WHERE k >= start), u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM n) SELECT doc_id, min(k)::INTEGER AS first, max(k)::INTEGER AS last, sum(n)::BIGINT AS sentences FROM u WHERE upto < 6 GROUP BY doc_id""")
def paragraph_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return sq.paragraph_windows(docs, "doc_id", "text", 6, "seed")

_WINDOWS = f"""p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) > 0) AS p FROM documents), a AS (SELECT doc_id, {_U.format("'seed' || doc_id")} % len(p) AS start, unnest(generate_series(0, len(p) - 1)) AS k, p FROM p WHERE len(p) > 0),
    n AS (SELECT doc_id, k, len(regexp_extract_all(p[k + 1], '[.!?]+')) AS n FROM a WHERE k >= start), u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM n), win AS (SELECT doc_id, min(k)::INTEGER AS first, max(k)::INTEGER AS last, sum(n)::BIGINT AS sentences FROM u WHERE upto < 6 GROUP BY doc_id)"""


@register("w15_windows_within_quotas", f"""WITH {_WINDOWS}, s AS (SELECT source, sum(len(regexp_extract_all(text, '[.!?]+'))) AS weight FROM documents GROUP BY source), q AS (SELECT source, CAST(round(600 * weight / sum(weight) OVER ()) AS BIGINT) AS quota FROM s),
    r AS (SELECT doc_id, source, first, last, sentences, sum(sentences) OVER (PARTITION BY source ORDER BY {_U.format("'order' || doc_id")}, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM win JOIN documents USING (doc_id)) SELECT doc_id, source, first, last, sentences FROM r JOIN q USING (source) WHERE upto <= quota""")
def windows_within_quotas(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    books = docs.groupBy("source").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[.!?]+"), 0))).alias("weight"))
    windows = paragraph_windows(spark, d).join(docs.select("doc_id", "source"), "doc_id").withColumn("h", sm.hash_order(F.col("doc_id"), "order"))
    return sq.within_quotas(windows, books, "doc_id", "source", "h", "sentences", 600).select("doc_id", "source", "first", "last", "sentences")



_SEATS = """seats_(name, n, room, seats, left_, round_) AS (SELECT name, n, room, 0::BIGINT, least({wanted}, sum(room) OVER ())::BIGINT, 0 FROM groups_ UNION ALL
    SELECT name, n, room, (seats + given)::BIGINT, (left_ - sum(given) OVER ())::BIGINT, round_ + 1 FROM (SELECT *, CASE WHEN seats < room THEN least(share + CASE WHEN place <= left_ - sum(CASE WHEN seats < room THEN share ELSE 0 END) OVER () THEN 1 ELSE 0 END, room - seats) ELSE 0 END AS given FROM
    (SELECT *, left_ * n // total AS share, row_number() OVER (ORDER BY seats >= room, left_ * n % total DESC, name) AS place FROM (SELECT *, (sum(CASE WHEN seats < room THEN n ELSE 0 END) OVER ())::BIGINT AS total FROM seats_ WHERE left_ > 0)))),
    dealt_ AS (SELECT name, n, seats FROM seats_ QUALIFY round_ = max(round_) OVER ())"""


@register("t4_quotas", f"WITH RECURSIVE groups_ AS (SELECT source AS name, count(*) AS n, least(count(*), 40) AS room FROM documents GROUP BY source), {_SEATS.format(wanted=300)} SELECT name AS source, n AS size, seats FROM dealt_")
def quotas(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("size"), F.least(F.count("*"), F.lit(40)).alias("room"))
    return sm.quotas(sizes, "source", "size", "room", 300)


@register("t4_quotas_of_users", f"WITH RECURSIVE groups_ AS (SELECT user_id AS name, count(*) AS n, least(count(*), 3) AS room FROM events GROUP BY user_id), {_SEATS.format(wanted=700)} SELECT name AS user_id, n AS size, seats FROM dealt_")
def quotas_of_users(spark: SparkSession, d: str) -> DataFrame:
    """Many groups of like sizes: remainders and names decide."""
    sizes = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("size"), F.least(F.count("*"), F.lit(3)).alias("room"))
    return sm.quotas(sizes, "user_id", "size", "room", 700)


@register("t5_stratified_select", f"""WITH RECURSIVE lines AS (SELECT source AS book, doc_id AS doc, k, list_extract(l, k::INTEGER) AS line FROM (SELECT source, doc_id, l, unnest(generate_series(1, len(l))) AS k FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
    paras AS (SELECT book, doc, doc || ':' || (k - 1) AS key, contains(line, ',') AS kind FROM lines WHERE length(line) BETWEEN 20 AND 400), have AS (SELECT book, count(*) AS room, count(*) FILTER (kind) AS n_kind FROM paras GROUP BY book),
    groups_ AS (SELECT book AS name, count(*) AS n, any_value(room) AS room FROM lines JOIN have USING (book) GROUP BY book), {_SEATS.format(wanted=200)},
    a AS (SELECT name AS book, seats, room, n_kind, least(seats // 2, n_kind) AS first FROM dealt_ JOIN have ON have.book = name), b AS (SELECT *, least(seats - first, room - n_kind) AS of_other FROM a), c AS (SELECT *, least(seats - of_other, n_kind) AS of_kind FROM b),
    t AS (SELECT *, row_number() OVER (PARTITION BY book, doc, kind ORDER BY {_U.format("'s' || key")}, key) AS turn FROM paras), r AS (SELECT *, row_number() OVER (PARTITION BY book, kind ORDER BY turn, {_U.format("'s' || doc")}, doc, key) AS place FROM t)
    SELECT r.book, r.doc, r.key, r.kind, r.place FROM r JOIN c USING (book) WHERE place <= CASE WHEN kind THEN of_kind ELSE of_other END""")
def stratified(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents, half of them with a comma, by source."""
    lines = table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("k", "line"))
    paragraphs = lines.where(F.length("line").between(20, 400)).select("book", "doc", F.concat("doc", F.lit(":"), "k").alias("key"), F.contains("line", F.lit(",")).alias("kind"))
    return sm.stratified_select(lines.groupBy("book").agg(F.count("*").alias("size")), paragraphs, 200, "s")


@register("t6_hash_split", f"""SELECT doc_id, CASE WHEN {_U.format("'split' || doc_id")} % 100 < 80 THEN 'train' WHEN {_U.format("'split' || doc_id")} % 100 < 90 THEN 'dev' ELSE 'test' END AS split FROM documents""")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", sm.split_of(F.col("doc_id"), "split").alias("split"))


@register("t7_nested_tiers", f"""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_U.format("'tier' || doc_id")}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, doc_id, r <= ceil(n / 2.0) AS half, r <= ceil(n / 4.0) AS quarter, r <= ceil(n / 16.0) AS sixteenth FROM r""")
def nested_tiers(spark: SparkSession, d: str) -> DataFrame:
    return sm.nested_tiers(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", {"half": 2, "quarter": 4, "sixteenth": 16}, "tier")


@register("t8_sample_per_type", f"""WITH a AS (SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {_U.format("'one' || event_id")}, event_id) AS r FROM events) WHERE r <= 50)
    SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {_U.format("'two' || event_id")}, event_id) AS r FROM events WHERE event_id NOT IN (SELECT event_id FROM a)) WHERE r <= 50""")
def sample_per_type(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id")
    first = sm.first_by_hash(e, ["event_type"], "event_id", 50, "one")
    return sm.first_by_hash(e.join(first.select("event_id"), "event_id", "left_anti"), ["event_type"], "event_id", 50, "two").select("event_type", "event_id")


@register("t9_distinct_short", f"""WITH s AS (SELECT doc_id, text FROM documents WHERE len(string_split(text, ' ')) BETWEEN 1 AND 60 AND NOT contains(text, chr(10))), u AS (SELECT lower(text) AS key, min(doc_id) AS doc_id FROM s GROUP BY 1)
    SELECT doc_id, key FROM u ORDER BY {_U.format("'short' || doc_id")}, doc_id LIMIT 30""")
def distinct_short(spark: SparkSession, d: str) -> DataFrame:
    words = F.size(F.split("text", " "))
    short = table(spark, d, "documents").where((words >= 1) & (words <= 60) & ~F.col("text").contains("\n"))
    one = short.groupBy(F.lower("text").alias("key")).agg(F.min("doc_id").alias("doc_id"))
    return one.orderBy(sm.hash_order(F.col("doc_id"), "short"), "doc_id").limit(30).select("doc_id", "key")


@register("t10_example_picker", """WITH w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '\\p{L}{4,}')) AS word, text FROM conversations WHERE length(text) BETWEEN 20 AND 220),
    a AS (SELECT *, row_number() OVER (PARTITION BY word, conv_id ORDER BY turn) AS in_doc FROM w), b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY in_doc, conv_id, turn) AS r FROM a) SELECT word, conv_id, turn, r FROM b WHERE r <= 3""")
def example_picker(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("length(text) between 20 and 220")
    w = c.select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}{4,}"), 0))).alias("word")).distinct()
    return sm.pick_examples(w, "word", "conv_id", "turn", 3)


@register("t11_hard_first", """WITH q AS (SELECT text, min(doc_id) AS doc_id, count(*) AS reasons FROM documents GROUP BY text) SELECT q.doc_id, q.reasons FROM q WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
    ORDER BY reasons DESC, doc_id LIMIT 40""")
def hard_first(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "labels").where("quality = 1").select("doc_id")
    cases = table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("reasons"))
    return cases.select("doc_id", "reasons").join(known, "doc_id", "left_anti").orderBy(F.desc("reasons"), "doc_id").limit(40)


@register("t12_diverse_examples")
def diverse_examples(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    w = c.select("conv_id", "turn", "text", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}{5,}"), 0))).alias("word"))
    return sm.diverse_examples(w, "word", "conv_id", "turn", "text", 4)


@register("t13_cap_per_class", f"""SELECT lang, split, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, split ORDER BY {_U.format("'cap' || doc_id")}, doc_id) AS r FROM
    (SELECT doc_id, lang, CASE WHEN {_U.format("'split' || doc_id")} % 100 < 80 THEN 'train' WHEN {_U.format("'split' || doc_id")} % 100 < 90 THEN 'dev' ELSE 'test' END AS split FROM documents)) WHERE r <= 20""")
def cap_per_class(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", sm.split_of(F.col("doc_id"), "split").alias("split"))
    return sm.first_by_hash(docs, ["lang", "split"], "doc_id", 20, "cap").select("lang", "split", "doc_id")
