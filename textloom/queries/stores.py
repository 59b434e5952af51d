"""Sources, stores, and keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import tables as tb
from textloom.plans.materialize import new_path
from textloom.registry import register, table
from textloom.sources import files as fl
from textloom.streaming import cases as cs


@register("s1_read_tsv", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def read_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "tsv")
    c = table(spark, d, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    fl.write_tsv(c, path)
    return fl.read_tsv(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@register("s2_read_text_files", "SELECT lang, count(*) AS docs, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY lang")
def text_files(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "texts")
    table(spark, d, "documents").select("lang", F.regexp_replace("text", "\n", " ").alias("value")).write.option("maxRecordsPerFile", 500).partitionBy("lang").text(path)
    got = fl.read_text_files(spark, path).select(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang"), F.explode(F.split(F.rtrim("text"), "\n")).alias("doc"))
    return got.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size(F.split("doc", " "))).alias("lines"))


@register("s3_read_json", "SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def read_json(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "json")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns")).write.json(path)
    got = fl.read_json_lines(spark, path, "conv_id long, turns array<struct<turn: long, role: string, text: string>>")
    return got.select("conv_id", F.size("turns").cast("long").alias("turns"), F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"))


def conllu_blocks(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.regexp_replace("text", r"[ \t\n]+", " "), " ")
    row = lambda w, i: F.concat_ws("\t", (i + 1).cast("string"), w, F.lower(w), *(F.lit(x) for x in ("X", "_", "_")), i.cast("string"), F.when(i == 0, "root").otherwise("dep"), F.lit("_"), F.lit("_"))
    lines = F.array_join(F.transform(words, row), "\n")
    sid = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return table(spark, d, "conversations").select(F.concat(F.lit("# sent_id = "), sid, F.lit("\n"), lines, F.lit("\n")).alias("value"))


@register("s4_read_conllu", r"""SELECT sent_id, CAST(generate_subscripts(w, 1) AS INTEGER) AS k, unnest(w) AS form FROM (SELECT conv_id || '-' || turn AS sent_id, string_split(regexp_replace(text, '[ \t\n]+', ' ', 'g'), ' ') AS w FROM conversations)""")
def conllu(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "conllu")
    conllu_blocks(spark, d).write.text(path)
    return fl.read_conllu(spark, path).select("sent_id", "k", "form")


@register("s5_read_wiki_dump", "SELECT url AS title, CAST(page_id % 5 AS INTEGER) AS ns, page_id, page_id * 10 AS revision_id, CAST(length(html) AS INTEGER) AS size FROM pages")
def wiki_dump(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "dump")
    text = F.translate("html", "\u0000\u0001\u0002\u0003\u0004\u0005\u0006\u0007\u0008\u000b\u000c", "")
    p = table(spark, d, "pages").select(F.col("url").alias("title"), (F.col("page_id") % 5).cast("int").alias("ns"), "page_id", (F.col("page_id") * 10).alias("revision_id"), text.alias("text"))
    fl.write_wiki_dump(p, path)
    return fl.read_wiki_dump(spark, path).select("title", "ns", "page_id", "revision_id", F.length("text").alias("size"))


@register("s6_union_by_name", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL AS kind FROM customer WHERE c_nationkey <> 0 UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier WHERE s_nationkey <> 0 UNION ALL SELECT p_partkey, p_name, NULL, p_type FROM part")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    take = lambda t, p, **c: table(spark, d, t).select(*(F.col(v).alias(k) for k, v in c.items()))
    c = take("customer", "c", id="c_custkey", name="c_name", balance="c_acctbal", nation="c_nationkey").where("nation <> 0").drop("nation")
    s = take("supplier", "s", id="s_suppkey", name="s_name", balance="s_acctbal", nation="s_nationkey").where("nation <> 0").drop("nation")
    return tb.union_rows([c, s, take("part", "p", id="p_partkey", name="p_name", kind="p_type")])


@register("s7_write_partitioned", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def write_partitioned(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "split")
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    fl.write_tsv(docs, path, ["lang", "source"])
    return fl.read_tsv(spark, path, "doc_id long, n_chars long, lang string, source string").groupBy("lang", "source").agg(F.count("*").alias("n"))


@register("s8_load_incremental", """WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS number FROM documents WHERE lang <> 'en'), m AS (SELECT max(number) AS most FROM h)
    SELECT doc_id, number FROM h UNION ALL SELECT doc_id, most + row_number() OVER (ORDER BY doc_id) FROM documents, m WHERE lang = 'en'""")
def incremental(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    held = tb.global_rank(docs.where("lang <> 'en'"), [F.col("doc_id")], "number").select("doc_id", "sha", "number")
    return fl.load_incremental(docs.select("doc_id", "sha"), held, "doc_id", "sha", "number").select("doc_id", "number")


@register("s9_export_sets", "SELECT conv_id, string_agg(turn || chr(9) || role, chr(10) ORDER BY turn) AS block FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) IN (2, 3)) GROUP BY conv_id")
def export_sets(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    sets = c.groupBy("conv_id").agg(F.count("*").alias("turns"))
    tokens = c.select("conv_id", "turn", F.concat_ws("\t", F.col("turn").cast("string"), "role").alias("line"))
    return fl.export_sets(tokens, sets, "conv_id", "turn", turns=[2, 3])


@register("a7_layers_by_source", "SELECT source, lang, count(*) AS sets, sum(len(string_split(text, ' ')))::BIGINT AS words, round(100.0 * avg(CAST(coalesce(quality, 0) = 1 AS INT)), 4) AS ok FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang")
def layers(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "documents").select("doc_id", "source", "lang", F.size(F.split("text", " ")).alias("words")).join(table(spark, d, "labels"), "doc_id", "left")
    return sets.groupBy("source", "lang").agg(F.count("*").alias("sets"), F.sum("words").alias("words"), F.round(100.0 * F.avg((F.coalesce("quality", F.lit(0)) == 1).cast("int")), 4).alias("ok"))


@register("a8_verify_counts", "SELECT source, sum(n_chars)::BIGINT AS stored, sum(length(text))::BIGINT AS counted, count(*) FILTER (WHERE n_chars <> length(text)) AS wrong FROM documents GROUP BY source")
def verify_counts(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("stored"), F.sum(n).alias("counted"), F.count_if(F.col("n_chars") != n).alias("wrong"))


@register("a25_split_cards", """SELECT source, count(*) FILTER (WHERE doc_id % 10 < 8) AS train, count(*) FILTER (WHERE doc_id % 10 = 8) AS dev, count(*) FILTER (WHERE doc_id % 10 = 9) AS test, count(*) AS total FROM documents GROUP BY source""")
def split_cards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 10
    split = F.when(k < 8, "train").when(k == 8, "dev").otherwise("test")
    wide = table(spark, d, "documents").withColumn("split", split).groupBy("source").pivot("split", ["train", "dev", "test"]).agg(F.count(F.lit(1))).fillna(0)
    return wide.withColumn("total", F.col("train") + F.col("dev") + F.col("test"))


def as_case_events(events: DataFrame) -> DataFrame:
    """The event table as a log of cases: users are keys, tens of the value are parsers."""
    kind = F.when(F.col("event_type") == "error", "found").when(F.col("event_type") == "click", "learned").otherwise("open")
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.floor(F.col("value") / 10).alias("parser"), kind.alias("event"))


def case_events(spark: SparkSession, d: str) -> DataFrame:
    return as_case_events(table(spark, d, "events"))


_LOG = "SELECT event_id AS seq, user_id AS key, CAST(floor(value / 10) AS BIGINT) AS parser, CASE event_type WHEN 'error' THEN 'found' WHEN 'click' THEN 'learned' ELSE 'open' END AS event FROM events"
_STATE = f"l AS ({_LOG}), f AS (SELECT key, min(seq) AS first, count(*) AS found FROM l WHERE event = 'found' GROUP BY key), s AS (SELECT l.key, parser, any_value(found) AS found, arg_max(CASE WHEN event = 'learned' THEN 'learned' ELSE 'open' END, seq) AS state FROM l JOIN f ON f.key = l.key AND seq >= first GROUP BY l.key, parser)"


@register("r1_case_state", f"WITH {_STATE} SELECT * FROM s")
def case_state(spark: SparkSession, d: str) -> DataFrame:
    return cs.case_state(case_events(spark, d))


@register("r1_case_state_stream", f"WITH {_STATE} SELECT * FROM s")
def case_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same fold with state kept by a stream over the event log; the last row of each key is its state.

    The path is a pattern, since a stream refuses the plain path of a table that is one file.
    """
    log = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    out = new_path(spark, "cases")
    cs.append_batches(cs.case_state_stream(as_case_events(log)), out, new_path(spark, "cases-log")).awaitTermination()
    rows = spark.read.schema("key long, found long, views string, batch long").parquet(out)
    last = rows.groupBy("key").agg(F.max_by(F.struct("found", "views"), "batch").alias("s")).where("s.found > 0")
    views = last.select("key", F.col("s.found").alias("found"), F.explode(F.split("s.views", ";")).alias("view"))
    return views.withColumn("v", F.split("view", "=")).select("key", F.col("v")[0].cast("long").alias("parser"), "found", F.col("v")[1].alias("state"))


@register("r2_record", f"WITH {_STATE}, n AS (SELECT DISTINCT key, parser FROM l WHERE event = 'found') SELECT n.key, n.parser FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.key = n.key AND s.parser = n.parser AND state = 'open')")
def record(spark: SparkSession, d: str) -> DataFrame:
    events = case_events(spark, d)
    return cs.new_cases(events.where("event = 'found'").select("key", "parser").distinct(), cs.case_state(events))


_HALVES = f"""l AS (SELECT seq, key, parser::VARCHAR AS parser, event, CASE WHEN seq % 3 = 0 THEN 'by' ELSE '' END AS licence, seq > (SELECT max(event_id) // 2 FROM events) AS late FROM ({_LOG})),
    w0 AS (SELECT min(seq) AS seq, key, parser, arg_min(licence, seq) AS licence FROM l WHERE NOT late AND event = 'found' GROUP BY key, parser), k0 AS (SELECT key, min(seq) AS first, arg_max(licence, seq) AS licence FROM w0 GROUP BY key),
    t0 AS (SELECT seq, key, parser, 'open' AS view FROM w0 UNION ALL SELECT l.seq, l.key, l.parser, CASE WHEN event = 'learned' THEN 'learned' ELSE 'open' END FROM l JOIN k0 ON k0.key = l.key AND l.seq > first WHERE NOT late AND event <> 'found'),
    s0 AS (SELECT key, parser, arg_max(view, seq) AS view FROM t0 GROUP BY key, parser),
    w1 AS (SELECT min(l.seq) AS seq, l.key, l.parser, arg_min(l.licence, l.seq) AS licence FROM l LEFT JOIN s0 ON s0.key = l.key AND s0.parser = l.parser LEFT JOIN k0 ON k0.key = l.key
           WHERE late AND event = 'found' AND (coalesce(view, '') <> 'open' OR (k0.licence = '' AND l.licence <> '')) GROUP BY l.key, l.parser)"""


@register("r2_record_stream", f"WITH {_HALVES} SELECT 0 AS batch, seq, key, parser, licence FROM w0 UNION ALL SELECT 1, seq, key, parser, licence FROM w1")
def record_stream(spark: SparkSession, d: str) -> DataFrame:
    """The event log in two halves, the second of which comes when the stream has read the first."""
    log = case_events(spark, d).select("seq", "key", "parser", "event", F.when(F.col("seq") % 3 == 0, "by").otherwise("").alias("licence"))
    half = log.agg(F.floor(F.max("seq") / 2)).first()[0]
    came, out, at = (new_path(spark, name) for name in ("cases-in", "cases-list", "cases-log"))
    for part in (log.where(F.col("seq") <= half), log.where(F.col("seq") > half)):
        part.write.mode("append").parquet(came)
        cs.record_stream(spark.readStream.schema(log.schema).parquet(came), out, at).awaitTermination()
    rows = spark.read.schema("seq long, key long, parser string, event string, licence string, batch int").parquet(f"{out}/events")
    return rows.where("event = 'found'").select("batch", "seq", "key", "parser", "licence")


@register("r3_recheck", f"WITH {_STATE} SELECT key, parser, CASE WHEN state = 'open' THEN 'learned' ELSE 'open' END AS event FROM s WHERE (state = 'open' AND (key + parser) % 2 = 0) OR (state = 'learned' AND (key + parser) % 2 <> 0)")
def recheck(spark: SparkSession, d: str) -> DataFrame:
    state = cs.case_state(case_events(spark, d))
    return cs.recheck(state, state.select("key", "parser", ((F.col("key") + F.col("parser")) % 2 == 0).alias("right")))


@register("r4_online_regression", """WITH e AS (SELECT user_id, event_id, value AS y, hour(ts)::DOUBLE AS x FROM events), s AS (SELECT *, 1 + count(*) OVER w AS a, coalesce(sum(x) OVER w, 0) AS b, 1 + coalesce(sum(x * x) OVER w, 0) AS c, coalesce(sum(y) OVER w, 0) AS p, coalesce(sum(x * y) OVER w, 0) AS q FROM e
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), f AS (SELECT user_id, event_id, y, ((c * p - b * q) + (a * q - b * p) * x) / (a * c - b * b) AS forecast, ((c - b * x) + (a * x - b) * x) / (a * c - b * b) AS leverage FROM s)
    SELECT user_id, event_id, round(forecast, 6) AS forecast, round(leverage, 9) AS leverage, round(sum((y - forecast) ** 2) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS squared_error FROM f""")
def online(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "value", F.hour("ts").cast("double").alias("hour"))
    out = cs.online_regression(e, "user_id", "event_id", "value", ["hour"])
    return out.select("user_id", "event_id", F.round("forecast", 6).alias("forecast"), F.round("leverage", 9).alias("leverage"), F.round("squared_error", 4).alias("squared_error"))


@register("r5_incremental_harvest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tags FROM events GROUP BY user_id")
def harvest(spark: SparkSession, d: str) -> DataFrame:
    return cs.latest_records(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_id", "event_type")


@register("r5_harvest_stream", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tags FROM events GROUP BY user_id")
def harvest_stream(spark: SparkSession, d: str) -> DataFrame:
    """The table that a stream over the events appends to, and the latest record of each key in it."""
    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    out = new_path(spark, "harvest")
    cs.harvest_stream(rows, out, new_path(spark, "harvest-log")).awaitTermination()
    return cs.latest_records(spark.read.schema(rows.schema).parquet(out), "user_id", ["ts", "event_id"], "event_id", "event_type")


@register("r6_first_valid_reply", """WITH v AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'assistant' AND length(text) > 100 GROUP BY conv_id) SELECT conv_id, turn, length(text) AS size FROM v JOIN conversations USING (conv_id, turn) WHERE conv_id NOT IN (SELECT item_id FROM benchmark)""")
def first_reply(spark: SparkSession, d: str) -> DataFrame:
    valid = table(spark, d, "conversations").where("role = 'assistant' and length(text) > 100")
    w = Window.partitionBy("conv_id").orderBy("turn")
    first = valid.withColumn("r", F.row_number().over(w)).where("r = 1").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return first.join(table(spark, d, "benchmark").select(F.col("item_id").alias("conv_id")), "conv_id", "left_anti")


@register("f9_hash", "SELECT doc_id, substr(sha256(text), 1, 12) AS key, CAST(('0x' || substr(sha256('seed' || source), 1, 8)) AS BIGINT) % 1000 AS bucket FROM documents")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators.sampling import hash_order

    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("key"), (hash_order(F.col("source"), "seed") % 1000).alias("bucket"))
