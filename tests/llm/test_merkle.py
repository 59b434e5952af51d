"""The manifest against a tree in plain Python, and its query against SQL."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple, more: int = 0) -> str:
    i, text, lang, source, n = row
    told = [i, source, lang, None if n is None else n + more, text]
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in told))


def tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def path(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        side = level[other] if other < len(level) else ""
        out.append((side, "") if at % 2 else ("", side))
        at //= 2
    return out


def plain(rows: list[tuple]) -> list[tuple]:
    parts: dict = {}
    for r in rows:
        parts.setdefault(r[2], []).append(r)
    langs = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    ranked = {x: sorted(parts[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in ranked[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for at, r in enumerate(ranked[x]):
            steps = path(trees[x], at) + path(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf(r, 1 if bad else 0)
            for a, b in steps:
                now = h(a, now, b)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], h(*(a + b for a, b in steps)), now, now == top[-1][0]))
    return out


def made(seed: int, n: int, langs: list) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(rng.randrange(-5, 3 * n), rng.choice(["", "text ü", None, "x" * 5000, f"t{k}"]), rng.choice(langs), rng.choice(["s", None, ""]), rng.choice([None, k, 2**63 - 1, -3])) for k in range(n)]
    rows += [(None, "t", langs[0], "s", 1), (None, "t", langs[0], "s", 1), (None, None, langs[0], None, None)] + rows[:3]
    return rows


@pytest.mark.parametrize(("levels", "n", "langs"), [(2, 150, ["en", "en", "en", None, "Ä", "ab"]), (1, 21, ["en", None]), (3, 64, ["en"]), (8, 300, ["en", "de", "z"])])
def test_manifest_equals_the_tree(spark, tmp_path, monkeypatch, levels, n, langs):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = made(n, n, langs)
    spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("x")).withColumn("at", F.lit(3)).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows), key=repr)
    assert {r["verified"] for r in got} == {True, False}


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "FEW_ROWS", 5)
    rows = [(k, f"t{k}", f"l{k % 37}", "s", k) for k in range(80)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {w[0]: w for w in plain(rows)}
    assert len(got) == 80 and all((r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) == want[r["doc_id"]][1:5] and r["verified"] for r in got)


def test_one_row_and_none(spark):
    row = (7, "a", None, None, 0)
    got = merkle.manifest(spark.createDataFrame([row], SCHEMA)).collect()
    assert [(r["leaf"], r["subroot"], r["root"], r["path"], r["proof_sha256"], r["verified"]) for r in got] == [(leaf(row), leaf(row), leaf(row), [], h(""), True)]
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    cur = con.execute(merkle.ORACLES["op12_merkle_manifest"])
    names = [x[0] for x in cur.description]
    df = merkle.QUERIES["op12_merkle_manifest"](spark, folder)
    assert df.columns == names and sorted(map(tuple, df.collect())) == sorted(cur.fetchall())
