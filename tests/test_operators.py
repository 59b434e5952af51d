"""Operators that SQL can't express, against plain Python, with faults that have to be refused."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from textloom import registry
from textloom.functions import distributions as di
from textloom.functions import pages as pg
from textloom.operators import agreement as ag
from textloom.operators import components as cm
from textloom.operators import corpus as cp
from textloom.operators import graph as gr
from textloom.operators import models as md
from textloom.operators import sampling as sm
from textloom.operators import sequences as sq
from textloom.operators import statistics as st
from textloom.operators import tables as tb
from textloom.sources import files as fl
from textloom.streaming import cases as cs


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5), (None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in cm.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(up)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert {r["component"] for r in cm.connected_components(chain).collect()} == {0}
    assert cm.connected_components(chain.limit(0)).count() == 0


def test_strong_components(spark):
    rng = random.Random(2)
    edges = {(rng.randrange(25), rng.randrange(25)) for _ in range(40)}
    reach = {a: {a} for a in range(25)}
    for _ in range(25):
        for a, b in edges:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {}
    for a in range(25):
        both = [b for b in range(25) if b in reach[a] and a in reach[b]]
        if len(both) > 1:
            want[a] = min(both)
    got = {r["node"]: r["component"] for r in gr.strongly_connected(spark.createDataFrame(list(edges), "src long, dst long")).collect()}
    assert got == want


def test_k_core(spark):
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(60)}
    now = set(edges)
    while True:
        degree = {}
        for a, b in now:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        kept = {(a, b) for a, b in now if degree[a] >= 4 and degree[b] >= 4}
        if kept == now:
            break
        now = kept
    got = {r["node"]: r["degree"] for r in gr.k_core(spark.createDataFrame(list(edges), "src long, dst long"), 4).collect()}
    assert got == degree


def test_cycles_stay_behind(spark):
    levels, left = gr.topological_levels(spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4)], "src long, dst long"))
    assert {r["node"]: r["level"] for r in levels.collect()} == {1: 0} and left.count() == 3


def test_weighted_schedule(spark):
    rng = random.Random(4)
    rows = [(k, i, a := rng.randrange(50), a + rng.randrange(1, 15), rng.randrange(1, 20)) for k in range(3) for i in range(9)]
    got = sq.weighted_schedule(spark.createDataFrame(rows, "k long, i long, a long, b long, w long"), "k", "i", "a", "b", "w").groupBy("k").agg(F.sum("w").alias("w")).collect()
    for r in got:
        own = [x for x in rows if x[0] == r["k"]]
        best = 0
        for n in range(len(own) + 1):
            for some in itertools.combinations(own, n):
                s = sorted(some, key=lambda x: x[2])
                if all(x[3] <= y[2] for x, y in zip(s, s[1:])):
                    best = max(best, sum(x[4] for x in s))
        assert r["w"] == best


def test_lookup_refuses(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string")
    fine = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k long, v long")
    assert {r["v"] for r in tb.lookup_join(left, fine, ["k"]).collect()} == {10, 20}
    for bad in (fine.where("k <> 2"), fine.union(fine)):
        with pytest.raises(Exception, match="match|repeats"):
            tb.lookup_join(left, bad, ["k"]).collect()


def test_missing_keys_never_match(spark):
    a = spark.createDataFrame([(float("nan"), 1), (None, 2), (1.0, 3)], "k double, x int")
    assert [r["x_left"] for r in tb.inner_join(a, a, ["k"]).collect()] == [3]


def test_incremental_refuses(spark):
    held = spark.createDataFrame([("a", "1", 7)], "key string, sha string, number long")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, sha string")
    assert {r["key"]: r["number"] for r in fl.load_incremental(new, held, "key", "sha", "number").collect()} == {"a": 7, "b": 8, "c": 9}
    with pytest.raises(Exception, match="changed"):
        fl.load_incremental(spark.createDataFrame([("a", "9")], "key string, sha string"), held, "key", "sha", "number").collect()


def test_heavy_hitters(spark):
    rng = random.Random(5)
    values = [rng.randrange(138) for _ in range(3000)] + [7] * 900
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    assert {(r["value"], r["n"]) for r in st.heavy_hitters(df, "v", 0.05).collect()} == {(v, values.count(v)) for v in set(values) if values.count(v) > 0.05 * len(values)}


def test_linear_model(spark):
    rng = random.Random(6)
    rows = [(x := rng.random(), z := rng.random(), 3 + 2 * x - 5 * z) for _ in range(200)]
    fit = {r["term"]: r for r in st.linear_model(spark.createDataFrame(rows, "x double, z double, y double"), ["x", "z"], "y").collect()}
    assert [round(fit[t]["estimate"], 6) for t in ("intercept", "x", "z")] == [3, 2, -5]


def test_longest_run(spark):
    docs = spark.createDataFrame([(1, "x y the quick brown fox jumps over the lazy dog today z"), (2, "nothing alike here at all my friend of old")], "doc_id long, text string")
    src = spark.createDataFrame([(9, "see the quick brown fox jumps over the lazy dog again")], "item_id long, text string")
    assert [tuple(r) for r in cp.shared_runs(docs, src).collect()] == [(1, 9, 9)]


def test_word_align_finds_pairs(spark):
    pairs = spark.createDataFrame([(1, ["das", "haus"], ["the", "house"]), (2, ["das", "buch"], ["the", "book"]), (3, ["ein", "buch"], ["a", "book"])], "id long, src array<string>, dst array<string>")
    t = {(r["f"], r["e"]): r["t"] for r in md.word_align(pairs, 8).collect()}
    assert t["das", "the"] > t["das", "house"] and t["buch", "book"] > t["buch", "a"]


def test_pair_merges(spark):
    docs = spark.createDataFrame([("aaab aaab abab",)], "text string")
    got = [tuple(r) for r in md.pair_merges(docs, 2).orderBy("step").collect()]
    # aaab twice and abab once: a+a stands four times, a+b four times; the least of equals comes first.
    assert got[0] == (0, "a", "a", 4) and got[1][3] >= 2


def test_pages():
    page = '<html><head><title>T &amp; U</title><base href="http://b.org/x/"></head><body><nav>menu</nav><h1>Head</h1><p>One<script>no</script> two</p><a href="y?utm_s=1&k=2#f">l</a><a rel="nofollow" href="mailto:a@b">m</a></body></html>'
    assert pg.page_text(page) == "T & U\n## Head\nOne two\nlm"
    assert pg.normal_url("http://b.org/x/", "y?utm_s=1&k=2#f") == "http://b.org/x/y?k=2"
    assert pg.normal_url("http://b.org/", "a.png") is None and pg.normal_url(None, "javascript:x") is None
    assert pg.page_text(None) == "" and pg.page_text("<p>broken <b>x") == "broken x"
    assert pg.lcs_length("abcde", "xacxe") == 3 and pg.chrf("same text", "same text") == 1.0 and pg.chrf("abc", "xyz") == 0.0


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.randrange(6), rng.randrange(3), rng.choice(["found", "learned", "open"])) for i in range(120)]
    events = spark.createDataFrame(rows, "seq long, key long, parser long, event string")
    want = {}
    for seq, key, parser, event in rows:
        n, views = want.setdefault(key, (0, {}))
        if event == "found":
            want[key] = (n + 1, {**views, parser: "open"})
        elif n:
            views[parser] = event
    batch = {}
    for r in cs.case_state(events).collect():
        batch.setdefault(r["key"], (r["found"], {}))[1][r["parser"]] = r["state"]
    assert batch == {k: v for k, v in want.items() if v[0]}
    for k in range(3):
        events.where(f"seq >= {k * 40} and seq < {k * 40 + 40}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = cs.case_state_stream(stream).writeStream.outputMode("update").format("memory").queryName("cases").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    last = {r["key"]: (r["found"], {int(k): v for k, v in (x.split("=") for x in r["views"].split(";") if x)}) for r in spark.table("cases").groupBy("key").agg(F.max_by("views", "found").alias("views"), F.max("found").alias("found")).collect()}
    assert {k: v[0] for k, v in last.items() if v[0]} == {k: v[0] for k, v in want.items() if v[0]}


def test_harvest_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "y"), (2, 1, "c", "x")], "id long, stamp long, body string, tag string")
    rows.write.parquet(str(tmp_path / "in"))
    query = cs.harvest_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    got = cs.latest_records(spark.read.parquet(str(tmp_path / "out")), "id", ["stamp"], "body", "tag")
    assert {(r["id"], r["body"], r["tags"]) for r in got.collect()} == {(1, "b", "x,y"), (2, "c", "x")}


def test_similar_documents_count_every_shared_key(spark):
    keys = {(d, f"own{d}") for d in range(2400)} | {(d, "hot") for d in range(1100)} | {(d, f"few{d // 3}") for d in range(0, 2400, 2)}
    df = {}
    for _, k in keys:
        df[k] = df.get(k, 0) + 1
    idf = {k: max(0.0, math.log(2400 / (1 + n))) for k, n in df.items()}
    mine = {d: {f"own{d}", *(["hot"] if d < 1100 else []), *([f"few{d // 3}"] if d % 2 == 0 else [])} for d in range(2400)}
    length = {d: math.sqrt(sum(idf[k] ** 2 for k in ks)) for d, ks in mine.items()}
    got = {}
    for r in gr.similar_documents(spark.createDataFrame(sorted(keys), "doc_id long, key string"), top=2).collect():
        got.setdefault(r["doc_id"], []).append((r["r"], r["other"], r["score"]))
    for d in (0, 1, 2, 501, 1099, 1100, 1101, 1200):
        scores = [(-round(sum(idf[k] ** 2 for k in mine[d] & mine[o]) / (length[d] * length[o]), 4), o) for o in mine if o != d]
        want = [(k, o, -s) for k, (s, o) in enumerate([x for x in sorted(scores) if x[0] <= -0.005][:2], 1) if -s >= 0.05]
        assert sorted(got.get(d, [])) == want
    alike = spark.createDataFrame([(d, k) for d in range(201) for k in ("all", f"own{d}")] + [(d, "else") for d in range(201, 100_000)], "doc_id long, key string")
    assert gr.similar_documents(alike.where("key <> 'else' or doc_id % 50 = 0")).where("doc_id = 7").count() == 5


def test_diverse_examples_go_past_copies(spark):
    near = [(0, i, " ".join(["sun", *"a b c d e f g h i j k l m n o p q r s t".split(), f"x{i}"])) for i in range(300)]
    rows = near + [(0, 300, "sun short"), (0, 301, "sun over the quiet hills today again"), (0, 302, "no more sun for all of us now")]
    df = spark.createDataFrame([("sun", *r) for r in rows] + [("sun", 1, i, "sun short one") for i in range(200)], "word string, doc long, at long, text string")
    got = sm.diverse_examples(df, "word", "doc", "at", "text", 4).collect()
    assert {(r["doc"], r["at"]) for r in got} == {(0, 0), (0, 301), (0, 302), (0, 300)}


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_whole_texts_are_scored_and_aligned(spark, tmp_path):
    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randint(0, 90))) for _ in "ab")
        assert pg.lcs_length(a, b) == plain_lcs(a, b)
    q, a = ("".join(rng.choice("abcd ") for _ in range(n)) for n in (700, 500))
    long = " ".join(f"w{chr(97 + k)}" for k in range(20))
    rows = [(1, 0, "user", q), (1, 1, "assistant", a), (2, 0, "user", long), (2, 1, "assistant", "yes")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in registry.queries()["f10_chrf_lcs"](spark, str(tmp_path)).collect()}
    assert got[1]["lcs"] == plain_lcs(a, q) and abs(got[1]["chrf"] - pg.chrf(a, q)) < 1e-6
    aligned = {r["f"] for r in registry.queries()["c19_word_align"](spark, str(tmp_path)).where("e = 'yes'").collect()}
    assert aligned == {"<null>", *long.split()}


def test_edit_join_takes_whole_words(spark, tmp_path):
    for name, text in (("benchmark", "cat extraordinary a internationalize"), ("documents", "cats cut extraordinarx internationalise no extra")):
        spark.createDataFrame([(text,), (None,)], "text string").write.parquet(str(tmp_path / f"{name}.parquet"))
    words = "cat extraordinary a internationalize cats cut extraordinarx internationalise no extra".split()
    edit = lambda x, y: len(x) + len(y) - 2 * plain_lcs(x, y) <= 1 or (len(x) == len(y) and sum(p != q for p, q in zip(x, y)) == 1)
    got = {(r["a"], r["b"]) for r in registry.queries()["j14_edit_distance_join_whole"](spark, str(tmp_path)).collect()}
    assert got == {(x, y) for x in words for y in words if x < y and edit(x, y)} and ("cat", "cut") in got


def test_queries_answer_for_all_ids(spark, tmp_path):
    # Part k leads to part k + 1 in order k, with small quantities; the last leads back to the first.
    lines = [(1000 + k, n, (k + n) % 6, 1.0) for k in range(6) for n in (0, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, f"s{k}") for k in range(1, 201)], "c_custkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert {(r["node"], r["component"]) for r in run("g3_strong_components")} == {(k, 0) for k in range(6)}
    assert {(r["node"], r["degree"]) for r in run("g6_k_core")} == {(k, 2) for k in range(6)}
    assert {(r["node"], r["value"]) for r in run("g7_power_iteration")} == {(k, round(6**-0.5, 6)) for k in range(6)}
    assert {(r["doc"], r["other"], r["strength"]) for r in run("g9_related_documents_whole")} == {(1000 + k, 1000 + (k + s) % 6, 2.5) for k in range(6) for s in (1, 5)}
    want = {(n, f"s{n >> k}", k) for n in range(1, 201) for k in range(8) if n >> k}
    assert {(r["node"], r["category"], r["depth"]) for r in run("j10_closure_categories_whole")} == want


def test_loops_raise_before_the_fixed_point(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(8)], "src long, dst long")
    up = chain.toDF("child", "parent")
    assert gr.closure(up, most=8).count() == 36 and gr.topological_levels(chain, 9)[0].count() == 9
    assert gr.k_core(chain, 2, 8).count() == 0
    loops = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 3), (3, 2)], "src long, dst long")
    assert gr.strongly_connected(loops).count() == 4
    for unfinished in (lambda: gr.closure(up, most=7), lambda: gr.topological_levels(chain, 8), lambda: gr.k_core(chain, 2, 2), lambda: gr.strongly_connected(loops, 1)):
        with pytest.raises(RuntimeError):
            unfinished()


def test_ranks_and_totals_over_many_rows(spark, tmp_path):
    """Three million rows in their own order of files: ranges are dealt once, so no rank is missing or twice there."""
    n = 3_000_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), (F.col("id") % 10).alias("v"))
    rows.repartition(12).write.parquet(str(tmp_path / "in"))
    read = spark.read.parquet(str(tmp_path / "in"))
    tb.global_rank(read, [F.col("k")], "rank").write.parquet(str(tmp_path / "ranks"))
    got = spark.read.parquet(str(tmp_path / "ranks"))
    assert got.agg(F.count("*"), F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.count_if(F.col("rank") != F.col("k") + 1)).first() == (n, n, 1, n, 0)
    sq.running_total(read, "k", "v", "upto").write.parquet(str(tmp_path / "totals"))
    upto = spark.read.parquet(str(tmp_path / "totals"))
    assert upto.agg(F.max("upto"), F.count_if(F.col("upto") < 0)).first() == (n // 10 * 45, 0)
    want = rows.where("k < 1000").toPandas().sort_values("k")["v"].cumsum().tolist()
    assert [r["upto"] for r in upto.where("k < 1000").orderBy("k").collect()] == want


def test_quantiles_of_groups_and_medians(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([1.0, 2.0, 5.5, rng.random(), None, math.nan])) for g in [1] * 400 + [2] * 3 + [None] * 6 for _ in range(1)] + [(3, None)]
    got = {r["g"]: (r["q25"], r["q50"]) for r in tb.hazen_quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", [0.25, 0.5]).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        x = sorted(v for h, v in rows if h == g and v is not None and not math.isnan(v))
        at = lambda p: min(max(len(x) * p + 0.5, 1), len(x))  # noqa: E731, B023
        if x:
            want[g] = tuple(x[int(at(p)) - 1] * (1 - at(p) % 1) + (x[int(at(p))] * (at(p) % 1) if at(p) % 1 else 0) for p in (0.25, 0.5))
    assert set(got) == set(want) and all(abs(a - b) < 1e-12 for g in got for a, b in zip(got[g], want[g], strict=True))
    one = tb.describe(spark.createDataFrame([(3.0,), (1.0,), (None,), (2.5,), (8.0,)], "v double"), "v").first()
    assert one["median"] == 2.75 and one["nnz"] == 4
    assert tb.describe(spark.createDataFrame([], "v double"), "v").first()["median"] is None


def test_tail_probabilities():
    """Against integrals of the densities by Simpson's rule."""

    def area(f, a, b, n=4000):
        h = (b - a) / n
        return h / 3 * sum((1 if k in (0, n) else 4 if k % 2 else 2) * f(a + k * h) for k in range(n + 1))

    for df in (1.5, 4, 30, 400):
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        for t in (0.2, 1.7, 3.1):
            inside = 2 * area(lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2), 0, t)  # noqa: B023
            assert abs(di.beta_share(df / (df + t * t), df / 2, 0.5) - (1 - inside)) < 1e-9
    for df in (2, 5, 60):
        c = 1 / (2 ** (df / 2) * math.gamma(df / 2))
        for x in (0.7, 4.0, 70.0):
            below = area(lambda y: c * y ** (df / 2 - 1) * math.exp(-y / 2), 0, x)  # noqa: B023
            assert abs(di.gamma_tail(df / 2, x / 2) - (1 - below)) < 1e-5


def test_p_values_of_small_tables(spark):
    rows = spark.createDataFrame([("a", 5.1), ("a", 4.9), ("a", 6.2), ("a", 5.8), ("b", 6.5), ("b", 7.1), ("b", 6.9), ("b", 8.0), (None, None)], "g string, v double")
    got = {r["test"]: r for r in st.t_tests(rows, "g", "a", "b", "v", 6.0).collect()}
    f = st.anova1(rows, "g", "v").first()
    assert abs(got["pooled"]["t"] ** 2 - f["f"]) < 1e-9 and abs(got["pooled"]["p"] - f["p"]) < 1e-9  # two groups: F is t squared
    assert got["one sample"]["df"] == 7 and 0 < got["one sample"]["p"] < 1 and abs(got["welch"]["t"] - got["pooled"]["t"]) < 1e-9
    pairs = spark.createDataFrame([(float(i), 2.0 * i + (i % 3)) for i in range(12)] + [(None, 1.0)], "x double, y double")
    r = st.correlation_test(pairs, "x", "y").first()
    assert r["n"] == 12 and r["r"] > 0.99 and r["p"] < 1e-9
    cells = spark.createDataFrame([("x", "1")] * 8 + [("x", "2")] * 2 + [("y", "2")] * 9 + [("z", "1")] * 3 + [(None, "1")], "a string, b string")
    want, n = 0.0, 22
    for a, na in (("x", 10), ("y", 9), ("z", 3)):
        for b, nb in (("1", 11), ("2", 11)):
            e = na * nb / n
            want += ({("x", "1"): 8, ("x", "2"): 2, ("y", "2"): 9, ("z", "1"): 3}.get((a, b), 0) - e) ** 2 / e
    c = st.chi2(cells, "a", "b").first()
    assert abs(c["chi2"] - want) < 1e-9 and c["df"] == 2 and abs(c["p"] - math.exp(-want / 2)) < 1e-9


def test_spans_are_matched_in_order(spark):
    rng = random.Random(6)
    data = {s: ([sorted(rng.sample(range(8), 3)) for _ in range(rng.randint(0, 4))], [sorted(rng.sample(range(8), 2)) for _ in range(rng.randint(0, 4))], set(rng.sample(range(8), 3))) for s in range(60)}
    right = wrong = 0
    for system, gold, verbs in data.values():
        used = set()
        for p in system:
            hit = next((k for k, g in enumerate(gold) if k not in used and len({*p} & {*g}) >= 2 and {*p} & {*g} & verbs), None)
            right, wrong = right + (hit is not None), wrong + (hit is None)
            used.add(hit)
    frame = lambda k: spark.createDataFrame([(s, o, m) for s, x in data.items() for o, m in enumerate(x[k])], "sid long, ord int, members array<int>")
    verbs = spark.createDataFrame([(s, i) for s, x in data.items() for i in x[2]], "sid long, i int")
    got = ag.match_spans(frame(0), frame(1), verbs).first()
    assert tuple(got) == (right, wrong, sum(len(x[1]) for x in data.values())) and right > 10
    assert tuple(ag.match_spans(frame(0).limit(0), frame(1).limit(0), verbs).first()) == (0, 0, 0)


def test_online_regression_equals_the_recursion(spark):
    import numpy as np

    rng = random.Random(9)
    rows = [(k, i, rng.random(), rng.choice([0.0, 1.0, 3.5]), rng.random() * 9) for k in (1, 2) for i in range(40)] + [(3, 0, 1.0, 2.0, 3.0)]
    got = {(r["k"], r["i"]): (r["forecast"], r["leverage"], r["squared_error"]) for r in cs.online_regression(spark.createDataFrame(rows, "k long, i long, a double, b double, y double"), "k", "i", "y", ["a", "b"], 0.5).collect()}
    for key in (1, 2, 3):
        p, theta, total = np.eye(3) / 0.5, np.zeros(3), 0.0
        for k, i, a, b, y in rows:
            if k == key:
                x = np.array([1, a, b])
                px, forecast = p @ x, float(x @ theta)
                h, e = float(x @ px), y - forecast
                theta, p, total = theta + px * e / (1 + h), p - np.outer(px, px) / (1 + h), total + e * e
                assert np.allclose(got[k, i], (forecast, h, total), atol=1e-8)
    assert len(got) == 81


def test_best_assignment_of_all():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(200):
        gain = np.round(rng.random((rng.integers(1, 5), rng.integers(1, 5))) * (rng.random() < 0.9), 1)
        small = gain if gain.shape[0] <= gain.shape[1] else gain.T
        want = max(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
        assert abs(ag.best_assignment(gain) - want) < 1e-9


def test_entities_matched_one_to_one(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (1, "b", "y"), (1, None, "y"), (1, "c", None), (2, "a", "z")]
    got = ag.ceaf_e(spark.createDataFrame(rows, "doc long, gold string, system string")).first()
    phi = 2 * 2 / (3 + 2) + 2 * 1 / (1 + 3) + 1
    assert abs(got["recall"] - phi / 4) < 1e-9 and abs(got["precision"] - phi / 3) < 1e-9
    assert ag.ceaf_e(spark.createDataFrame([], "doc long, gold string, system string")).first()["recall"] is None


def test_gaps_between_common_words(spark):
    rng = random.Random(5)
    for _ in range(200):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 7))] for _ in "xy")
        got = md._anchors(x, y)
        longest = max(k for k in range(8) for c in itertools.combinations(range(len(x)), k) if k == 0 or _within([x[i] for i in c], y))
        assert len(got) == longest and all(x[i] == y[j] for i, j in got) and all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(got))
    pairs = [(["a", "old", "b", "c"], ["a", "new", "b", "so", "very", "c"])] * 6 + [(["a", "um", "b", "x"], ["a", "b", "x"])] * 5 + [(["q", "r"], ["q", "s"])] * 2
    got = {tuple(r) for r in md.gap_tables(spark.createDataFrame(pairs, "x array<string>, y array<string>")).collect()}
    assert got == {("swap", "old", "new", 6), ("insert", "c", "so very", 6), ("drop", "um", "", 5)}
    assert md.gap_tables(spark.createDataFrame([(None, ["a"]), ([], [])], "x array<string>, y array<string>")).count() == 0


def _within(part, whole) -> bool:
    at = iter(whole)
    return all(w in at for w in part)
