"""Relational queries: projections, joins, aggregates, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import tables as tb
from textloom.registry import register, table


@register("p1_words", r"""
    SELECT doc_id, CAST(i AS INTEGER) AS i, w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \n]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^ \n]+'), 1) AS i FROM documents)
    WHERE NOT contains(w, '-') AND NOT contains(w, '.') AND try_cast(w AS INTEGER) IS NULL""")
def words(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), 0)).alias("i", "w"))
    return tokens.where(~F.col("w").contains("-") & ~F.col("w").contains(".") & F.expr("try_cast(w as int)").isNull()).select("doc_id", (F.col("i") + 1).alias("i"), "w")


@register("p2_set_var", "SELECT o_orderkey, o_totalprice, round(o_totalprice * 0.1, 4) AS tax, 'EUR' AS currency FROM orders")
def set_var(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").withColumns({"tax": F.round(F.col("o_totalprice") * 0.1, 4), "currency": F.lit("EUR")})


@register("p3_mask_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R' AND l_shipdate < TIMESTAMP '2000-01-01'")
def mask_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_quantity > 30 and l_returnflag = 'R' and l_shipdate < timestamp'2000-01-01'").select("l_orderkey", "l_linenumber", "l_quantity")


_HOLES = "SELECT event_id, CASE WHEN value > 50 THEN NULL ELSE value END AS value, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS event_type FROM events"


def with_holes(spark: SparkSession, d: str) -> DataFrame:
    """Events with missing cells: NaN numbers and null texts."""
    e = table(spark, d, "events")
    return e.select("event_id", F.when(F.col("value") > 50, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"))


@register("p4_missing_mask", f"SELECT sum(CAST(value IS NULL AS INT))::BIGINT AS value, sum(CAST(event_type IS NULL AS INT))::BIGINT AS event_type, count(*) AS n FROM ({_HOLES})")
def missing_mask(spark: SparkSession, d: str) -> DataFrame:
    mask = tb.is_missing(with_holes(spark, d))
    return mask.agg(F.count_if("value").alias("value"), F.count_if("event_type").alias("event_type"), F.count("*").alias("n"))


@register("p4_drop_missing", f"SELECT * FROM ({_HOLES}) WHERE value IS NOT NULL AND event_type IS NOT NULL")
def drop_missing(spark: SparkSession, d: str) -> DataFrame:
    return tb.drop_missing(with_holes(spark, d))


@register("p5_flag_bits", "SELECT p_partkey, (p_size & 1) > 0 AS odd, (p_size & 4) > 0 AS four, (p_size & 16) > 0 AS sixteen FROM part")
def flag_bits(spark: SparkSession, d: str) -> DataFrame:
    bit = lambda n: (F.col("p_size").bitwiseAND(n) > 0)
    return table(spark, d, "part").select("p_partkey", bit(1).alias("odd"), bit(4).alias("four"), bit(16).alias("sixteen"))


@register("j1_innerjoin", """SELECT o.o_orderkey AS key, o_custkey, o_totalprice AS price_left, l_extendedprice AS price_right, l_linenumber FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey""")
def innerjoin(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey", F.col("o_totalprice").alias("price"))
    right = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("price"), "l_linenumber")
    return tb.inner_join(left, right, ["key"])


@register("j2_join_lookup", "SELECT c_custkey, c_nationkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_lookup(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return tb.lookup_join(left, table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"])


@register("j3_star_join", """SELECT l_orderkey, l_linenumber, p_name, s_name, n_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey""")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    l, p, s, n = (table(spark, d, t) for t in ("lineitem", "part", "supplier", "nation"))
    return l.join(p, l.l_partkey == p.p_partkey).join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey, "left").select("l_orderkey", "l_linenumber", "p_name", "s_name", "n_name")


@register("j4_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(wanted, "c_custkey", "left_semi")


@register("j4_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(held, "c_custkey", "left_anti")


@register("j5_exists_flags", """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_f,
    EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS has_urgent,
    (SELECT count(DISTINCT o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS days FROM customer""")
def exists_flags(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("u"), F.count_distinct("o_orderdate").alias("n"))
    none = F.lit(False)
    return table(spark, d, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("f", none).alias("has_f"), F.coalesce("u", none).alias("has_urgent"), F.coalesce("n", F.lit(0)).alias("days"))


@register("a1_groupsummary", """SELECT l_suppkey, l_returnflag, count(*) AS "GroupCount", sum(l_quantity) AS sum_l_quantity, round(avg(l_quantity), 6) AS mean_l_quantity, min(l_quantity) AS min_l_quantity,
    max(l_quantity) AS max_l_quantity, median(l_quantity) AS median_l_quantity, round(CASE WHEN count(*) = 1 THEN 0 ELSE var_samp(l_quantity) END, 6) AS var_l_quantity FROM lineitem GROUP BY ALL""")
def groupsummary(spark: SparkSession, d: str) -> DataFrame:
    out = tb.group_summary(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], ["sum", "mean", "min", "max", "median", "var"], ["l_quantity"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_l_quantity", "var_l_quantity")})


@register("a1_mode_std", """WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_suppkey, l_quantity AS mode_l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) AS r FROM c) WHERE r = 1),
    s AS (SELECT l_suppkey, count(*) AS "GroupCount", round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(l_quantity) END, 6) AS std_l_quantity FROM lineitem GROUP BY ALL) SELECT * FROM s JOIN m USING (l_suppkey)""")
def mode_std(spark: SparkSession, d: str) -> DataFrame:
    out = tb.group_summary(table(spark, d, "lineitem"), ["l_suppkey"], ["mode", "std"], ["l_quantity"])
    return out.withColumn("std_l_quantity", F.round("std_l_quantity", 6))


@register("a2_grouptransform", """SELECT o_custkey, o_orderkey, o_totalprice, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS cumsum,
    round(o_totalprice - max(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS below_most FROM orders""")
def grouptransform(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return tb.group_transform(o, ["o_custkey"], ["o_orderkey"], {"cumsum": lambda _, run: F.round(F.sum("o_totalprice").over(run), 2), "below_most": lambda whole, _: F.round(F.col("o_totalprice") - F.max("o_totalprice").over(whole), 2)})


@register("a3_pivot", """SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS "O", count(*) FILTER (WHERE l_linestatus = 'F') AS "F" FROM lineitem GROUP BY l_returnflag""")
def pivot(spark: SparkSession, d: str) -> DataFrame:
    return tb.pivot_table(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"], "count", "l_quantity")


@register("a4_rollup", "SELECT p_brand, p_type, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY ROLLUP (p_brand, p_type)")
def rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@register("a5_filtered_aggregates", """SELECT l_shipdate, count(*) FILTER (WHERE l_discount > 0.05) AS n, sum(l_quantity) FILTER (WHERE l_tax < 0.04) AS q, median(l_quantity) FILTER (WHERE l_returnflag = 'R') AS med,
    round(count(*) FILTER (WHERE l_discount > 0.05) / nullif(count(*) FILTER (WHERE l_tax < 0.04), 0), 6) AS ratio FROM lineitem GROUP BY l_shipdate""")
def filtered(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.count_if(F.col("l_discount") > 0.05), F.count_if(F.col("l_tax") < 0.04)
    items = table(spark, d, "lineitem")
    per = items.groupBy("l_shipdate").agg(n.alias("n"), F.sum(F.when(F.col("l_tax") < 0.04, F.col("l_quantity"))).alias("q"), F.round(n / F.nullif(k, F.lit(0)), 6).alias("ratio"))
    middle = tb.group_medians(items.where("l_returnflag = 'R'"), ["l_shipdate"], ["l_quantity"]).withColumnRenamed("median_l_quantity", "med")
    return tb.same_keys(per, middle, ["l_shipdate"], "left")


@register("a6_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderdate) AS days, count(*) AS n FROM orders GROUP BY o_orderstatus")
def distincts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderdate").alias("days"), F.count("*").alias("n"))


@register("a9_table_overview", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("orders", "lineitem", "documents", "events", "pages")))
def overview(spark: SparkSession, d: str) -> DataFrame:
    return tb.union_rows([table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("orders", "lineitem", "documents", "events", "pages")])


@register("a10_string_agg", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, string_agg(c_name, ';' ORDER BY c_custkey) AS names FROM customer GROUP BY c_nationkey")
def string_agg(spark: SparkSession, d: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"])
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"), F.array_join(ordered, ";").alias("names"))


@register("a11_arg_max", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best, max(o_totalprice) AS price FROM orders GROUP BY o_custkey")
def arg_max(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"), F.max("o_totalprice").alias("price"))


@register("a12_descriptive", "SELECT l_suppkey % 7 AS g, round(stddev_samp(l_quantity), 6) AS std, round(var_pop(l_quantity), 6) AS var_pop, median(l_quantity) AS median, bool_or(l_discount <> 0) AS any, bool_and(l_discount <> 0) AS all, count(*) FILTER (WHERE l_discount <> 0) AS nnz FROM lineitem GROUP BY g".replace("AS all", 'AS "all"').replace("AS any", 'AS "any"'))
def descriptive(spark: SparkSession, d: str) -> DataFrame:
    c, q = F.col("l_discount"), "l_quantity"
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("g"), "l_quantity", "l_discount")
    middle = tb.hazen_quantiles(rows, ["g"], q, [0.5]).withColumnRenamed("q50", "median")
    per = rows.groupBy("g").agg(F.round(F.stddev_samp(q), 6).alias("std"), F.round(F.var_pop(q), 6).alias("var_pop"), F.bool_or(c != 0).alias("any"), F.bool_and(c != 0).alias("all"), F.count_if(c != 0).alias("nnz"))
    return per.join(middle, "g").select("g", "std", "var_pop", "median", "any", "all", "nnz")


@register("a13_summary", """SELECT 'c_custkey' AS "column", 'number' AS kind, count(*) - count(c_custkey) AS missing, min(c_custkey)::DOUBLE AS least, median(c_custkey)::DOUBLE AS median, max(c_custkey)::DOUBLE AS most, NULL::BIGINT AS distinct_values FROM customer
    UNION ALL SELECT 'c_acctbal', 'number', count(*) - count(c_acctbal), min(c_acctbal), median(c_acctbal), max(c_acctbal), NULL FROM customer
    UNION ALL SELECT 'c_mktsegment', 'text', count(*) - count(c_mktsegment), NULL, NULL, NULL, count(DISTINCT c_mktsegment) FROM customer""")
def summary(spark: SparkSession, d: str) -> DataFrame:
    return tb.summarize(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"))


@register("a14_quantile", """WITH r AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
    p AS (SELECT *, greatest(1.0, least(n::DOUBLE, n * 0.25 + 0.5)) AS a25, greatest(1.0, least(n::DOUBLE, n * 0.9 + 0.5)) AS a90 FROM r)
    SELECT l_suppkey, round(sum(CASE WHEN r = floor(a25) THEN (1 - (a25 - floor(a25))) * v WHEN r = floor(a25) + 1 THEN (a25 - floor(a25)) * v END), 4) AS q25,
    round(sum(CASE WHEN r = floor(a90) THEN (1 - (a90 - floor(a90))) * v WHEN r = floor(a90) + 1 THEN (a90 - floor(a90)) * v END), 4) AS q90 FROM p GROUP BY l_suppkey""")
def quantile(spark: SparkSession, d: str) -> DataFrame:
    out = tb.hazen_quantiles(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", [0.25, 0.9])
    return out.withColumns({c: F.round(c, 4) for c in ("q25", "q90")})


@register("a15_histogram", "SELECT CASE WHEN value >= 0 AND value < 10 THEN 0 WHEN value >= 10 AND value < 25 THEN 1 WHEN value >= 25 AND value < 60 THEN 2 WHEN value >= 60 AND value <= 100 THEN 3 END AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 100 GROUP BY bin")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return tb.histogram(table(spark, d, "events"), "value", [0, 10, 25, 60, 100])


_PAIRS = [("l_discount", "l_discount"), ("l_discount", "l_quantity"), ("l_discount", "l_tax"), ("l_quantity", "l_quantity"), ("l_quantity", "l_tax"), ("l_tax", "l_tax")]


@register("a16_cov_corr", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(covar_samp({a}, {b}), 6) AS cov, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a, b in _PAIRS))
def cov_corr(spark: SparkSession, d: str) -> DataFrame:
    out = tb.covariances(table(spark, d, "lineitem"), ["l_discount", "l_quantity", "l_tax"])
    return out.select("x", "y", F.round("cov", 6).alias("cov"), F.round("corr", 6).alias("corr"))


@register("a17_weighted_covariance", """WITH m AS (SELECT l_returnflag, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS mx, sum(l_discount * l_quantity) / sum(l_quantity) AS my FROM lineitem GROUP BY 1)
    SELECT l_returnflag, sum(l_quantity) AS weight, round(sum(l_quantity * (l_extendedprice - mx) * (l_discount - my)) / sum(l_quantity), 4) AS cov FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1""")
def weighted_cov(spark: SparkSession, d: str) -> DataFrame:
    return tb.weighted_covariance(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_discount", "l_quantity").withColumn("cov", F.round("cov", 4))


@register("a18_streaming_moments", """SELECT label, i, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var_pop, round(var_samp(x), 6) AS var_samp FROM
    (SELECT label, unnest(embedding)::DOUBLE AS x, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS i FROM embeddings) GROUP BY label, i""")
def moments(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy("label", (F.col("i") + 1).alias("i")).agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.var_pop("x"), 6).alias("var_pop"), F.round(F.var_samp("x"), 6).alias("var_samp"))


@register("a21_histogram_quantile", """WITH c AS (SELECT CAST(floor(value / 5) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1), s AS (SELECT bucket, n, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS total FROM c),
    w AS (SELECT *, unnest([0.1, 0.5, 0.99])::DOUBLE AS share FROM s), r AS (SELECT *, greatest(1, ceil(share * total))::BIGINT AS rank FROM w)
    SELECT share, rank, bucket, (upto - n + 1)::BIGINT AS from_rank, upto::BIGINT AS to_rank FROM r WHERE rank > upto - n AND rank <= upto""")
def histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.floor(F.col("value") / 5).alias("bucket"))
    return tb.bucket_ranks(e, "bucket", [0.1, 0.5, 0.99])


@register("t1_sortrows", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey")
def sortrows(spark: SparkSession, d: str) -> DataFrame:
    return tb.sort_rows(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), [("o_orderpriority", False), ("o_totalprice", True)], "o_orderkey")


@register("t2_top_k", "SELECT l_partkey, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_partkey ORDER BY n DESC, orders DESC, l_partkey LIMIT 50")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"))
    return out.orderBy(F.desc("n"), F.desc("orders"), "l_partkey").limit(50)


@register("t3_unique", "SELECT o_orderdate, min(o_orderkey) AS first_position, count(*) AS n, row_number() OVER (ORDER BY o_orderdate) AS rank FROM orders GROUP BY o_orderdate")
def unique(spark: SparkSession, d: str) -> DataFrame:
    return tb.unique_values(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), "o_orderdate", "o_orderkey")


@register("w1_row_number_dedup", "SELECT o_custkey, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def row_number_dedup(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey", "o_orderdate").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderdate", "o_orderkey")


@register("w2_top_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, r FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS r FROM lineitem) WHERE r <= 3")
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "r")


@register("w3_share_of_total", "SELECT event_type, user_id, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type, user_id")
def share(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    total = table(spark, d, "events").agg(F.count("*").alias("total"))
    return n.join(F.broadcast(total)).select("event_type", "user_id", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("share"))


@register("w4_running_sum", "SELECT o_orderdate, n, sum(n) OVER (ORDER BY o_orderdate)::BIGINT AS upto FROM (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1)")
def running_sum(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators.sequences import running_total

    return running_total(table(spark, d, "orders").groupBy("o_orderdate").agg(F.count("*").alias("n")), "o_orderdate", "n", "upto")


@register("w5_first_value", "SELECT DISTINCT conv_id, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS opener, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations")
def first_value(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("opener"), F.count("*").alias("turns"))
