"""Operators against versions written out in plain Python: nothing of the operator decides what is right."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_ops import SCHEMA, WIDE, components, contaminated, frame, low, prose, texts
from textloom.llm import decontaminate as dc
from textloom.llm import language_id as li
from textloom.llm import license_scan as ls
from textloom.llm import line_dedup as ld
from textloom.llm import quality_model as qm
from textloom.llm import sharding as sh
from textloom.llm import textbytes as tb

# --- licenses -------------------------------------------------------------------------------------------------------


def license_places(text: str, templates) -> set[str]:
    """Names of templates whose word pairs are contained enough in the surroundings of any window, without bands."""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    w, out = words(text), set()
    pairs = list(zip(w[:-1], w[1:], strict=True))
    for name, template in templates:
        t = words(template)
        wanted, window = set(zip(t[:-1], t[1:], strict=True)), ls.LEAST_WINDOW
        while window < len(t):
            window *= 2
        for start in range(0, max(len(pairs), 1), window // 4):
            around = pairs[max(0, start - window // 2) : start + window - 1 + window // 2]
            if start < max(len(pairs), 1) and 100 * len(wanted & set(around)) >= ls.CONTAINED * len(wanted):
                out.add(name)
    return out


def test_license_scan_around_the_limit(spark):
    rng, rows = random.Random(12), []
    for k in range(120):
        name, text = rng.choice([t for t in ls.TEMPLATES if len(t[1].split()) > 30])
        w = text.split()
        for at in rng.sample(range(len(w)), round(len(w) * rng.choice([0.0, 0.03, 0.06, 0.075, 0.08, 0.09, 0.15, 0.3]))):
            w[at] = f"other{at}"
        w = w[: round(len(w) * rng.choice([1, 1, 0.9, 0.84, 0.5]))]
        rows.append((k, prose(rng, rng.randint(0, 200)) + " " + " ".join(w) + " " + prose(rng, rng.randint(0, 200)), "", "", 0))
    rows += [(500, None, "", "", 0), (501, "", "", "", 0), (502, rows[0][1], "", "", 0), (None, rows[0][1], "", "", 0)]
    got: dict = {}
    for r in ls.license_matches(frame(spark, rows, WIDE)).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    want = {i: license_places(t or "", ls.TEMPLATES) for i, t, *_ in rows}
    assert {i: s for i, s in want.items() if s} == got
    assert 30 < sum(bool(s) for s in want.values()) < 110


# --- language -------------------------------------------------------------------------------------------------------


def test_ftrl_equals_the_plain_recursion(monkeypatch):
    """Per coordinate: w = 0 if |z| <= l1, else -(z - sign(z) l1) / ((beta + sqrt n) / alpha + l2)."""
    monkeypatch.setattr(li, "EPOCHS", 2)
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(50, 6, replace=False)), rng.random(6) + 0.5, int(rng.integers(3))) for _ in range(40)]
    z, n = Counter(), Counter()

    def w(i: int, c: int) -> float:
        s = z[i, c]
        return 0.0 if abs(s) <= li.L1 else -(s - math.copysign(li.L1, s)) / ((li.BETA + math.sqrt(n[i, c])) / li.ALPHA + li.L2)

    order = np.random.default_rng(5)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            now = {(i, c): w(i, c) for i in at.tolist() for c in range(3)}
            logits = [sum(v * now[i, c] for i, v in zip(at.tolist(), x.tolist(), strict=True)) for c in range(3)]
            top = max(logits)
            e = [math.exp(q - top) for q in logits]
            for i, v in zip(at.tolist(), x.tolist(), strict=True):
                for c in range(3):
                    g = (e[c] / sum(e) - (c == y)) * v
                    sigma = (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / li.ALPHA
                    z[i, c] += g - sigma * now[i, c]
                    n[i, c] += g * g
    got = li.ftrl(rows, 3)
    assert np.allclose(got[:50], [[w(i, c) for c in range(3)] for i in range(50)], atol=1e-12) and (got[:50] != 0).mean() > 0.3


def test_idf_counts_all_rows_to_learn_from(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(["ab", "ab cd", "ef", None, "", "ab ab ab", "12"] * 8)]
    learn = [t for i, t, *_ in rows if __import__("zlib").crc32(str(i).encode()) % 4 != 2]
    model = li.train(frame(spark, rows), most=3)
    df: Counter = Counter()
    for t in learn:
        got = li.counts(t)
        df.update(got[0].tolist() if got else [])
    want = np.array([math.log((1 + len(learn)) / (1 + df[k])) + 1 for k in range(li.DIM)])
    assert np.allclose(model.idf, want) and len(df) > 5


def test_temperature_is_the_best_of_a_fine_grid():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 400)
    logits = rng.normal(size=(400, 3)) * 4
    logits[np.arange(400), y] += 2

    def loss(t: float) -> float:
        p = np.exp(logits / t - (logits / t).max(axis=1, keepdims=True))
        return float(-np.log((p / p.sum(axis=1, keepdims=True))[np.arange(400), y]).mean())

    fine = min(np.linspace(0.2, 5, 4000), key=loss)
    assert abs(li.temperature(logits, y) / fine - 1) < 0.06 and loss(li.temperature(logits, y)) <= loss(1.0)


def test_held_out_languages_and_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = li.languages(docs).where("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").toPandas()
    right = got["lang_pred"] == got["lang"]
    assert len(got) > 150 and right.mean() > 0.97 and got["score"].mean() > 0.9


# --- quality --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("depth", [1, 2])
def test_each_split_is_the_best_of_all(depth):
    rng = np.random.default_rng(depth)
    width = len(qm.FEATURES)
    x = np.round(rng.normal(size=(300, width)), 1)
    y = ((x[:, 3] > 0.2) ^ (x[:, 5] > -0.1) ^ (rng.random(300) < 0.1)).astype(float)
    model = qm.grow(x, y, trees=3, depth=depth)
    total = np.full(300, math.log(y.mean() / (1 - y.mean())))
    for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.ones(300, int)
        for _ in range(depth):
            after = node * 2
            for k in np.unique(node):
                mine = node == k

                def gain(f: int, t: float, mine=mine) -> float:
                    side = mine & (x[:, f] <= t)
                    a, b = side, mine & ~side
                    if hess[a].sum() < qm.LEAST_HESSIAN or hess[b].sum() < qm.LEAST_HESSIAN:
                        return 0.0
                    s = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + qm.RIDGE)
                    return s(a) + s(b) - s(mine)

                cuts = [(f, t) for f in range(width) for t in np.unique(np.quantile(x[:, f], np.linspace(0, 1, qm.BINS + 1)[1:-1], method="lower"))]
                best = max(gain(f, t) for f, t in cuts)
                if math.isinf(threshold[k]):
                    assert best <= 1e-6 + 1e-9
                else:
                    assert abs(gain(int(feature[k]), threshold[k]) - best) < 1e-9
                after[mine] += x[mine, feature[k]] > threshold[k]
            node = after
        for k in range(1 << depth):
            mine = node == (1 << depth) + k
            if mine.any():
                assert abs(value[k] + qm.RATE * grad[mine].sum() / (hess[mine].sum() + qm.RIDGE)) < 1e-9
                total[mine] += value[k]
    assert len(model.feature) == 3


def test_quality_of_repeated_rows_and_ties(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60) if i % 2 else "### " * 40, "", "", 0) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(3, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    twice = frame(spark, rows + rows[:7] + [(None, rows[1][1], "", "", 0)])
    got = [(r["doc_id"], round(r["score"], 9)) for r in qm.quality_scores(twice, labels).collect()]
    assert len(got) == 88 and all(len({s for i, s in got if i == k}) == 1 for k in range(7))
    again = sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in qm.quality_scores(twice.repartition(5), labels.repartition(3)).collect())
    assert again == sorted((i or -1, s) for i, s in got)
    assert li.languages(frame(spark, [(1, "abc", "en", "", 0)] * 3)).count() == 3


# --- shards ---------------------------------------------------------------------------------------------------------


def test_two_writers_lose_nothing(spark, tmp_path):
    docs = frame(spark)
    a, b = (sh.ShardStore(spark, str(tmp_path / "s"), fan_in=2) for _ in "ab")
    a.append(docs)
    run = b._write(docs.limit(4), 0)  # written, not yet committed
    old = a.read()
    a.append(docs.limit(2))
    a.compact()
    a.vacuum()
    assert b.add(run, docs.schema) == b.versions()[-1] and b.read().count() == docs.count() + 6
    assert old.count() == docs.count()  # a reader of the first version keeps its files
    with pytest.raises(RuntimeError):
        a.commit({**b.manifest(), "version": b.versions()[-1] - 1})
    time.sleep(0.1)
    a.vacuum(grace_seconds=0)
    assert len(a.versions()) == 1 and a.read().count() == docs.count() + 6
    on_disk = {p.name for p in (tmp_path / "s" / "runs").iterdir()}
    assert on_disk == {r["name"].split("/")[1] for r in a.manifest()["runs"]}


def test_a_writer_that_died_after_its_claim(spark, tmp_path):
    store = sh.ShardStore(spark, str(tmp_path / "s"))
    store.append(frame(spark))
    store._fs.create(store._at("manifest/v00000002.claim"), False).close()
    with pytest.raises(RuntimeError):
        store.append(frame(spark))
    time.sleep(0.1)
    store.vacuum(grace_seconds=0)
    store.append(frame(spark))
    assert store.versions()[-1] == 2


def test_shards_keep_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "a", "en", "s", 1), (None, "a", "en", "s", 1), (5, "b", None, None, None), (5, "b", None, None, None), (6, None, "", "", 0), (-3, "", "", "", 0)]
    store = sh.shard_documents(frame(spark, rows, WIDE), 4, str(tmp_path / "s"), fan_in=2)
    key = lambda rows: sorted(map(repr, rows))
    assert key(store.read().select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")).collect()) == key(frame(spark, rows).collect())
    assert len(store.read().columns) == len(WIDE.split(","))


# --- hashes ---------------------------------------------------------------------------------------------------------


def test_identity_is_of_the_bytes_alone():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.integers(0, 3000, 3000)
    ends = starts + rng.choice([1, 3, 20, 255, 256, 400], 3000)
    by: dict = {}
    for h, a, b in zip(tb.identity(data, starts, ends).tolist(), starts.tolist(), ends.tolist(), strict=True):
        by.setdefault(h, set()).add(data[a:b].tobytes())
    assert all(len(s) == 1 for s in by.values()) and len(by) == len({data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)})


# --- pipeline -------------------------------------------------------------------------------------------------------


def alike(a: str, b: str) -> bool:
    x, y = ({t[k : k + 8] for k in range(max(1, len(t) - 7))} for t in (a, b))
    return 100 * min(len(x), len(y)) >= 75 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y)


def lines_left(docs: dict[int, str | None]) -> dict[int, str | None]:
    blank = lambda x: not x.strip(" \t\r\x0b\f")
    lines = [(i, k, low(x)) for i in sorted(docs) for k, x in enumerate((docs[i] or "").split("\n")) if not blank(x)]
    kinds = sorted({x for *_, x in lines}, key=len)
    near = []
    for k, a in enumerate(kinds):
        for b in kinds[k + 1 :]:
            if 100 * (len(a) - 7) < 75 * (len(b) - 7) * 0.5 and len(b) > 40:  # far fewer shingles, even if b repeats half of its own
                break
            if alike(a, b):
                near.append((a, b))
    part = components(kinds, near)
    seen, gone = set(), {}
    for i, k, x in lines:
        if part[x] in seen:
            gone.setdefault(i, set()).add(k)
        seen.add(part[x])
    out = {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in docs.items()}
    return {i: t for i, t in out.items() if not (gone.get(i) and blank(t.replace("\n", "")))}


def test_each_stage_of_the_pipeline(spark, tmp_path):
    import corpus_pipeline as cp
    import sentencepiece

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    stages = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "near duplicates", "decontamination", "sentencepiece"]

    def step(name: str, before):
        out = stages[name](spark, before, folder)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    text_of = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    one = step("quality classifier", docs)
    good = {r["doc_id"] for r in qm.quality_scores(docs, labels).collect() if r["score"] >= 0.3}
    assert one.columns == docs.columns and text_of(one) == {i: t for i, t in text_of(docs).items() if i in good} and 100 < len(good) < 200
    two = step("line dedup", one)
    assert two.columns == docs.columns and text_of(two) == lines_left(text_of(one))
    three = step("near duplicates", two)
    sets = {}
    for i, t in text_of(two).items():
        w = re.findall("[^\x20\x09-\x0d]+", low(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    first = {i for i, c in components(list(sets), links).items() if i == c}
    assert three.columns == docs.columns and text_of(three) == {i: t for i, t in text_of(two).items() if i in first}
    four = step("decontamination", three)
    dirty = {i for i, r in contaminated(list(text_of(three).items()), bench).items() if r[4]}
    assert four.columns == docs.columns and text_of(four) == {i: t for i, t in text_of(three).items() if i not in dirty}
    five = step("sentencepiece", four)
    library = sentencepiece.SentencePieceProcessor(model_file=cp.pieces.DEFAULT_MODEL)
    left = text_of(four)
    got = {r["doc_id"]: r["piece_ids"] for r in five.collect()}
    assert got == {i: library.encode(t or "") for i, t in left.items()} and len(left) > 50


def test_documents_that_lose_all_lines(spark):
    rows = [(1, "the first line of some words\nand another one"), (2, "the first line of some words"), (3, None), (4, " \n"), (5, "and another one\n\n"), (6, "")]
    kept = ld.drop_repeated_lines(frame(spark, [(i, t, "", "", 0) for i, t in rows], WIDE), drop_emptied=True)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"] is not None) == [(1, rows[0][1]), (4, " \n"), (6, "")] and kept.count() == 4
    assert ld.drop_repeated_lines(frame(spark, [(i, t, "", "", 0) for i, t in rows])).count() == 6


def test_both_ways_of_decontamination_agree(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 11, 40]))) for i in range(30)]
    items += [(31, items[2][1]), (32, items[3][1].upper())]
    docs = [(i if i % 9 else None, prose(rng, 30) + " " + " ".join(rng.choice(items)[1].split()[: rng.randint(5, 14)]) + " " + prose(rng, 20), "", "", 0) for i in range(120)] + [(i, t, "", "", 0) for i, t in enumerate(texts())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted(map(repr, df.collect()))
    a, b = (dc.contamination(frame(spark, docs), bench, max_windows=m) for m in (10_000, 1))
    assert rows(a) == rows(b) and a.where("contaminated").count() > 20
    a, b = (dc.decontaminate(frame(spark, docs), bench, remove="spans", max_windows=m) for m in (10_000, 1))
    assert rows(a) == rows(b)
    assert {hashlib.sha256(b"").hexdigest()} == {r["items_sha256"] for r in dc.contamination(frame(spark, docs), bench).where(~F.col("contaminated")).collect()}
