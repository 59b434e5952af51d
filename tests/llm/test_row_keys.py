"""Null and repeated ids, clashing columns and periodic texts, against brute force over rows."""

from __future__ import annotations

import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_ops import components, cut, low, prose
from textloom.llm import line_dedup as ld
from textloom.llm import near_dup as nd
from textloom.llm import suffix_dedup as sd
from textloom.llm import textbytes as tb

SCHEMA = "doc_id long, text string"


def cut_rows(rows: list[tuple]) -> Counter:
    found = cut(list(enumerate(t for _, t in rows)))
    return Counter((i, *found[k]) for k, (i, _) in enumerate(rows))


def got_cut(spark, rows: list[tuple]) -> Counter:
    out = sd.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect())


def test_suffix_dedup_of_null_and_repeated_ids(spark):
    rng = random.Random(1)
    a, q, head, tail = prose(rng, 150), prose(rng, 300), prose(rng, 40), prose(rng, 50)
    rows = [(1, a + tail), (1, q), (2, head + a), (None, prose(rng, 30) + a), (None, q[100:900]), (None, None), (None, ""), (3, prose(rng, 200)), (2, head), (2, head + a)]
    want = cut_rows(rows)
    assert sum(n for (_, _, gone, *_), n in want.items() if gone) == 6
    assert got_cut(spark, rows) == want


@pytest.mark.parametrize("unit", ["a", "ab", "xyz123", "line of a list\n", "0123456789" * 13])
def test_suffix_dedup_of_periodic_texts(spark, unit):
    rng = random.Random(len(unit))
    texts = [unit * (3000 // len(unit)), prose(rng, 60) + unit * (900 // len(unit)) + prose(rng, 90), unit * (399 // len(unit)), prose(rng, 70) + unit * (420 // len(unit) + 1), prose(rng, 200)]
    rows = list(enumerate([*texts, texts[0] + texts[1][:500] + texts[0]]))
    assert got_cut(spark, rows) == cut_rows(rows)


def test_a_long_text_of_blanks_is_a_few_rows(spark):
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([" " * 5_000_000, "ab" * 1_000_000])], ["doc_id", "text"])
    began = time.time()
    assert sum(b.num_rows for b in sd._occurrences([batch])) < 12 and time.time() - began < 90
    rows = [(1, " " * 5_000_000), (2, "x" * 300)]
    assert got_cut(spark, rows) == Counter({(1, 5_000_000, 5_000_000, 1, b""): 1, (2, 300, 0, 0, b"x" * 300): 1})


def sets_of(text: str | None) -> set:
    w = low(text or "").split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rng = random.Random(2)
    t = [prose(rng, 60) for _ in range(4)]
    near = t[0].split(" ")
    near[30] = "other"
    rows = [(1, t[0]), (2, t[1]), (2, t[0]), (2, " ".join(near)), (5, t[2]), (5, t[2]), (5, t[3]), (4, t[3]), (None, t[0]), (None, None), (9, None), (9, ""), (7, t[1] + " x")]
    s = [sets_of(x) for _, x in rows]
    named = [k for k, (i, _) in enumerate(rows) if i is not None]
    part = components(list(range(len(rows))), [(a, b) for a in named for b in named if a < b and s[a] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])])
    least = {p: min(rows[k][0] for k in named if part[k] == p) for p in {part[k] for k in named}}
    want = Counter((i, len(s[k]), least.get(part[k]), i == least.get(part[k])) for k, (i, _) in enumerate(rows))
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"__row": F.lit("mine"), "node": F.lit(1), "part": F.lit(2)})
    got = Counter(tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in nd.near_duplicates(docs).collect())
    assert got == want
    kept = nd.keep_first(docs)
    assert kept.columns == docs.columns and {r["__row"] for r in kept.collect()} == {"mine"}
    left = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert left == Counter([(1, t[0]), (2, t[1]), (5, t[2]), (4, t[3]), (None, t[0]), (None, None), (9, None), (9, "")])


def test_lines_of_null_and_repeated_ids(spark):
    line, other = "a line that is long enough to be like another one", "UNIQUE line that must not be lost"
    rows = [(1, f"{line}\n1 one"), (2, f"{line}\n2 two"), (2, f"{other}\n3 three"), (2, f"4 four\n{line}s"), (None, f"{line}\n1 one"), (None, None), (2, None), (3, f"{other}\n{other}")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"__row": F.lit("mine"), "__lines_to_drop": F.array(F.lit(0)), "__doc": F.lit(1)})
    out = ld.drop_repeated_lines(docs)
    assert out.columns == docs.columns and {r["__row"] for r in out.collect()} == {"mine"}
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(1, f"{line}\n1 one"), (2, "2 two"), (2, f"{other}\n3 three"), (2, "4 four"), (None, f"{line}\n1 one"), (None, None), (2, None), (3, "")])


def test_rows_that_share_id_and_line_number_keep_one_line(spark):
    line = "a line that is long enough to be like another one"
    left = [r["text"] for r in ld.drop_repeated_lines(spark.createDataFrame([(1, f"{line}\nx"), (1, f"{line}\ny")], SCHEMA)).collect()]
    assert sum(t.startswith(line) for t in left) == 1 and {t[-1] for t in left} == {"x", "y"}
