"""Small cases for the operators: brute force, nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import apart as ap
from textloom.llm import decontaminate as dc
from textloom.llm import language_id as li
from textloom.llm import license_scan as ls
from textloom.llm import line_dedup as ld
from textloom.llm import near_dup as nd
from textloom.llm import pieces as pc
from textloom.llm import quality_model as qm
from textloom.llm import quality_rules as qr
from textloom.llm import sharding as sh
from textloom.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WIDE = SCHEMA + ", key long, node long, n int, a string, b string, u int, v int, first int, last int, size int, part string, line string, spans string, component string"
RNG = random.Random(7)
VOCAB = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCAB) + ("." if i % 9 == 8 else "") + ("\n" if i % 30 == 29 else "") for i in range(n)).replace("\n ", "\n")


def texts() -> list[str | None]:
    rng = random.Random(11)
    base = [prose(rng, rng.choice([8, 40, 150, 400])) for _ in range(24)]
    near = []
    for t in base[:10]:
        w = t.split(" ")
        for k in range(0, len(w), max(20, len(w) // 4)):
            w[k] = "changed"
        near.append(" ".join(w))
    shared = prose(rng, 90)
    return [None, "", " \t\n ", "one", "ONE", "a b c d", "\n\n", *base, *near, *base[:6], base[3].upper(), shared + " " + base[1], base[2] + "\n" + shared, prose(rng, 6000), "é漢字🙂 " * 40, "aaaa " * 300, "x" * 3000]


def frame(spark, rows=None, schema=SCHEMA):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts())] if rows is None else rows
    wide = len(schema.split(",")) - 5
    return spark.createDataFrame([(*r, *[None] * wide) for r in rows], schema)


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def components(n: list, links) -> dict:
    up = {x: x for x in n}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in n}


# --- near duplicates ------------------------------------------------------------------------------------------------


def test_near_duplicates(spark):
    sets = {}
    for i, t in enumerate(texts()):
        w = re.findall("[^\x20\x09-\x0d]+", low(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components(list(sets), links)
    assert sum(a != b for a, b in want.items()) > 8
    for schema in (SCHEMA, WIDE):
        got = {r["doc_id"]: r for r in nd.near_duplicates(frame(spark, schema=schema).repartition(3)).collect()}
        assert {i: (len(s), want[i], want[i] == i) for i, s in sets.items()} == {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()}
    kept = nd.keep_first(frame(spark, schema=WIDE))
    assert len(kept.columns) == len(WIDE.split(",")) and {r["doc_id"] for r in kept.collect()} == {i for i in sets if want[i] == i}
    assert nd.near_duplicates(frame(spark, [])).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = prose(rng, 120).split(" ")
    rows = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w), None, None, None))
    assert {r["component_id"] for r in nd.near_duplicates(frame(spark, rows)).collect()} == {0}


def test_near_copies_around_the_limit(spark, monkeypatch):
    """A group in which half the pairs aren't links: equal to brute force, in small units, and no row is made for a pair."""
    rng = random.Random(8)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(150):
        w = list(base)
        for k in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(60)] = f"x{i}y{k}"
        rows.append((i, " ".join(w), "en", "s", 0))
    sets = {i: {tuple(t.split(" ")[k : k + 5]) for k in range(56)} for i, t, *_ in rows}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components(list(sets), links)
    made = {}

    def counted(df, name, write=ap.materialize):
        out = write(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    for unit, share in ((1024, 1 << 21), (8, 1 << 21), (1024, 150), (1024, 1)):
        made.clear()
        monkeypatch.setattr(ap, "UNIT", unit)
        monkeypatch.setattr(ap, "SHARE", share)
        monkeypatch.setattr(ap, "materialize", counted)
        got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(frame(spark, rows)).collect()}
        assert got == want and len(set(want.values())) > 20 and len(links) < 150 * 149 / 4
        assert made.get("more-links", 0) < 150 and made["partners"] > 0
        assert share < 1 << 21 or made["partners"] <= made["open"] * (1 if unit == 1024 else 150 / 8 + 2)


def test_shares_are_bounded_in_elements(monkeypatch):
    monkeypatch.setattr(ap, "SHARE", 100)
    n = np.array([40, 60, 1, 500, 99, 1, 1])
    assert ap.shares(n, np.arange(7)).tolist() == [0, 0, 1, 2, 3, 3, 4]
    assert ap.shares(n, np.array([0, 4, 5])).tolist() == [0, 0, 0, 0, 1, 1, 0]


def test_words_that_collide_by_their_form_are_different(spark):
    """Thue-Morse words have equal polynomials modulo 2**64; their texts share no shingle and their lines aren't equal."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    words = [f"q{i}" for i in range(4)]
    rows = [(1, " ".join([*words[:3], a, words[3]]), "en", "s", 0), (2, " ".join([*words[:3], b, words[3]]), "en", "s", 0)]
    assert [r["component_id"] for r in nd.near_duplicates(frame(spark, rows)).orderBy("doc_id").collect()] == [1, 2]
    raw = np.frombuffer((a + b).encode(), np.uint8)
    lines = ld.split(np.concatenate([raw[:1024], np.frombuffer(b"\n", np.uint8), raw[1024:]]), np.array([0, 2049]))
    assert len(set(lines[4].tolist())) == 2
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    for bound in (10, 0):
        assert [r["n_hit"] for r in dc.contamination(frame(spark, [(1, a, "", "", 0), (2, b, "", "", 0)]), bench, max_windows=bound).orderBy("doc_id").collect()] == [1, 0]
    assert len(np.unique(ls.word_pairs(*_bytes(f"{a} z {b} z"))[0])) == 3


def _bytes(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


# --- decontamination ------------------------------------------------------------------------------------------------


def contaminated(docs, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t or ""))
    windows = set()
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        if n and i is not None:
            windows |= {(tuple(w[k : k + n]), str(i)) for k in range(len(w) - n + 1)}
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for win, i in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(i)
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("bound", [10_000, 1])
def test_decontamination(spark, bound):
    docs = list(enumerate(texts()))
    some = [t for t in texts() if t and len(t.split()) > 60]
    items = [(1, some[0][40:300].upper()), (10, some[1][:200]), (2, "a b c"), (3, None), (4, ""), (None, some[2]), (5, some[0][40:300]), (5, some[3][10:150])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in dc.contamination(frame(spark, schema=WIDE), bench, max_windows=bound).collect()}
    want = contaminated(docs, items)
    assert got == want and sum(w[4] for w in want.values()) > 3
    kept = dc.decontaminate(frame(spark, schema=WIDE), bench, max_windows=bound)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, w in want.items() if not w[4]}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(frame(spark), empty, max_windows=bound).where("contaminated").count() == 0
    assert dc.contamination(frame(spark, []), bench, max_windows=bound).count() == 0


@pytest.mark.parametrize("bound", [10_000, 1])
def test_null_and_repeated_ids_are_decontaminated(spark, bound):
    bench = spark.createDataFrame([(1, "one two three"), (2, "four five")], "item_id long, text string")
    rows = [(None, "Zero ONE, two three! four é"), (None, "clean"), (7, "Four five one two three"), (7, "clean too"), (8, None)]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in rows])
    got = dc.contamination(docs, bench, max_windows=bound).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"]) for r in got) == [(0, 1, 0, 0), (0, 6, 3, 1), (7, 2, 0, 0), (7, 5, 5, 2), (8, 0, 0, 0)]
    kept = dc.decontaminate(docs, bench, max_windows=bound).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, "clean"), (7, "clean too"), (8, "")]
    cut = dc.decontaminate(docs, bench, remove="spans", max_windows=bound).collect()
    assert {(r["doc_id"], r["text"]) for r in cut} == {(None, "Zero ,  ! four é"), (None, "clean"), (7, "    "), (7, "clean too"), (8, None)}


def test_equal_keys_of_other_words_are_no_hit(spark):
    windows = dc.item_windows(spark.createDataFrame([(1, "one two three")], "item_id long, text string"))
    docs = frame(spark, [(1, "one two three", "en", "s", 0)])
    other = windows.withColumn("words", F.encode(F.lit("six seven eight"), "utf-8"))
    assert [r["n_hit"] for w in (windows, other) for r in dc._by_shuffle(docs.select("doc_id", "text"), w).collect()] == [3, 0]


def test_spans_are_cut(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = frame(spark, [(1, "Zero ONE, two three! four é", "en", "s", 0), (2, None, "en", "s", 0)])
    assert [r["text"] for r in dc.decontaminate(docs, bench, remove="spans").orderBy("doc_id").collect()] == ["Zero ,  ! four é", None]


# --- suffix arrays --------------------------------------------------------------------------------------------------


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(600):
        x = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))] + [0]
        assert sd.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def cut(docs):
    raw = {i: (t or "").encode() for i, t in docs}
    seen = Counter(x[k : k + 400] for x in raw.values() for k in range(len(x) - 399))
    out = {}
    for i, x in raw.items():
        gone = [False] * len(x)
        for k in range(len(x) - 399):
            if seen[x[k : k + 400]] > 1:
                gone[k : k + 400] = [True] * 400
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone) if not g))
    return out


@pytest.mark.parametrize("many", [2_000, 1])
def test_suffix_dedup(spark, monkeypatch, many):
    monkeypatch.setattr(sd, "MANY_RUNS", many)
    docs = list(enumerate(texts()))
    rng = random.Random(2)
    shared = prose(rng, 200)
    for k in range(12):
        docs.append((100 + k, prose(rng, 40) + shared[k * 7 : 420 + k * 11] + prose(rng, 40)))
    want = cut(docs)
    assert sum(w[1] > 0 for w in want.values()) > 15
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in sd.remove_repeats(frame(spark, [(i, t, "en", "s", 0) for i, t in docs], WIDE)).collect()}
    assert got == want
    assert sd.remove_repeats(frame(spark, [])).count() == 0


# --- lines ----------------------------------------------------------------------------------------------------------


def test_buckets_over_small_batches():
    rng = random.Random(0)
    for _ in range(300):
        rows = sorted((rng.randint(0, 3), rng.randint(0, 3)) for _ in range(rng.randint(0, 14)))

        def batches():
            at = 0
            while at < len(rows):
                m = rng.randint(1, 4)
                p, at = rows[at : at + m], at + m
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in p]), pa.array([b for _, b in p])], ["key", "flipped"])

        got = sorted((r["key"], r["node"], r["pivot"]) for b in ld._buckets(batches()) for r in b.to_pylist())
        want = []
        for k in range(4):
            m = sorted({v for kk, v in rows if kk == k})
            want += [(k, v ^ k, m[0] ^ k) for v in m] if len(m) > 1 else []
        assert got == sorted(want)


def _dealt_rows(*sent: list[np.ndarray]) -> list[dict]:
    return sorted((r for columns in sent for r in ld._dealt(columns).to_pylist()), key=lambda r: r["range"])


@pytest.mark.parametrize("piece", [1, 3, 1 << 20])
def test_ranges_in_pieces_of_any_size(monkeypatch, piece):
    monkeypatch.setattr(ld, "PIECE", piece)
    rng = random.Random(1)
    for _ in range(100):
        near = [(rng.randint(0, 2) << 52) + rng.randint(0, 3) for _ in range(rng.randint(1, 30))]
        key, node = np.array(near), np.array([rng.randint(0, 5) for _ in near])
        rows = _dealt_rows([key[::2], (node ^ key)[::2]], *([[key[1::2], (node ^ key)[1::2]]] if len(key) > 1 else []))
        batches = [pa.RecordBatch.from_pylist(rows[k : k + 2], pa.schema([("range", pa.int32()), ("entries", pa.binary())])) for k in range(0, len(rows), 2)]
        got = [r for b in ld._members(iter(batches)) for r in b.to_pylist()]
        want = {}
        for k, v in zip(key.tolist(), node.tolist(), strict=True):
            want.setdefault(k, set()).add(v)
        assert {(r["key"], r["node"]) for r in got} == {(k, v) for k, vs in want.items() if len(vs) > 1 for v in vs}
        assert all(len(want[r["key"]]) < 3 or r["many"] for r in got) and all(r["pivot"] in want[r["key"]] for r in got)
        for k, vs in want.items():  # pivots hold all members of a bucket together
            links = [(r["node"], r["pivot"]) for r in got if r["key"] == k and r["node"] != r["pivot"]]
            assert len(set(components(sorted(vs), links).values())) == 1

        places = [np.array([(rng.randint(0, 2) << 52) + rng.randint(0, 2) for _ in near]), *(np.array([rng.randint(0, 3) for _ in near]) for _ in range(2)), np.arange(len(near))]
        told = {v: v % 7 for v in set(places[0].tolist()) if rng.random() < 0.5}
        rows = [{"range": v >> 52, "node": v, "component": c} for v, c in told.items()] + _dealt_rows(places)
        rows.sort(key=lambda r: (r["range"], "entries" in r))
        schema = pa.schema([("range", pa.int32()), ("entries", pa.binary()), ("node", pa.int64()), ("component", pa.int64())])
        batches = [pa.RecordBatch.from_pylist(rows[k : k + 2], schema) for k in range(0, len(rows), 2)]
        got = sorted((-1 if r["part"] is None else r["part"], r["doc_id"], r["line_no"], r["row"]) for b in ld._judged(iter(batches)) for r in b.to_pylist())
        seen, expect = set(), []
        for v, *place in sorted(zip(*(x.tolist() for x in places), strict=True)):
            expect += [(-1, *place)] if v in seen else [(told[v], *place)] if v in told else []
            seen.add(v)
        assert got == sorted(expect)


def test_pairs_of_a_bucket_share_one_row_a_range():
    """10,000 lines send their bucket keys in at most one row for each range of hashes (before: a row a line and band)."""
    text = "\n".join(f"line number {k} of many different ones {k * k}" for k in range(10_000))
    sent = list(ld._bands(iter([pa.RecordBatch.from_arrays([pa.array([text])], ["text"])])))
    assert sum(b.num_rows for b in sent) <= 1 << ld.RANGE_BITS
    assert sum(len(x) for b in sent for x in b.column("entries").to_pylist()) == 10_000 * ld.BANDS * 16


def test_buckets_of_two_are_known_in_every_piece(monkeypatch):
    """Only a bucket of a range that is cut may count as larger than it is (before: all of a piece that ended within a
    range, so that the join of open buckets grew with the size of a task)."""
    monkeypatch.setattr(ld, "PIECE", 8)
    key = np.array([(r << 52) + k for r in range(40) for k in (1, 1, 2, 2, 2)])
    node = np.arange(len(key))
    rows = _dealt_rows([key, node ^ key])
    batches = [pa.RecordBatch.from_pylist(rows[k : k + 7], pa.schema([("range", pa.int32()), ("entries", pa.binary())])) for k in range(0, len(rows), 7)]
    got = [r for b in ld._members(iter(batches)) for r in b.to_pylist()]
    assert len(got) == len(key) and all(r["many"] == (r["key"] % 4096 == 2) for r in got)


def test_only_marked_lines_are_sent():
    """Lines that no bucket asks for stay where they are (before: every different line was shuffled); places all go."""
    text = "\n".join(f"line number {k} of many different ones {k * k}" for k in range(5_000))
    raw = np.frombuffer(text.encode(), np.uint8)
    ids = ld.split(raw, np.array([0, len(raw)]))[4]
    batch = lambda x: iter([pa.RecordBatch.from_arrays([pa.array(x)], ["node"])])
    asked = sorted((r for b in ld._asked(batch(ids[::50])) for r in b.to_pylist()), key=lambda r: r["range"])
    schema = pa.schema([("range", pa.int32()), ("want", pa.binary())])
    marks = np.zeros(1 << (ld.MARK_BITS - 3), np.uint8)
    width = len(marks) >> ld.RANGE_BITS
    for b in ld._marks(iter([pa.RecordBatch.from_pylist(asked, schema)])):
        for r in b.to_pylist():
            marks[r["range"] * width : (r["range"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    docs = pa.RecordBatch.from_pydict({"row": [1], "doc_id": [1], "text": [text]})
    sent = [r for b in ld._texts(iter([docs]), marks) for r in b.to_pylist()]
    told = np.concatenate([np.frombuffer(r["nodes"], np.int64) for r in sent if r["nodes"]])
    assert set(ids[::50].tolist()) <= set(told.tolist()) and len(told) < 120
    assert sum(len(r["entries"]) for r in sent if r["entries"]) == 5_000 * 32
    assert not [r for b in ld._texts(iter([docs]), np.zeros_like(marks)) for r in b.to_pylist() if r["nodes"]]


def test_shingles_of_any_script():
    rng = random.Random(11)
    lines = ["".join(rng.choice("abAB 1é漢字😀\t") if k % 2 else rng.choice("abAB 1") for _ in range(rng.randint(1, 60))) for k in range(400)]
    lines += ["漢字漢字漢字漢字", "字漢字漢字漢字漢", "abcdefgh", "ABCDEFGHabcdefgh", "x" * 400]
    got = ld.hashed([x.encode() for x in lines])
    sets = [set(t[k : k + 8] for k in range(max(1, len(t) - 7))) for t in map(low, lines)]
    hashes = [set(x.tolist()) for x in ld.shingles(got)]
    assert [len(x) for x in hashes] == [len(x) for x in sets]
    for _ in range(3000):
        i, j = rng.randrange(len(lines)), rng.randrange(len(lines))
        assert len(hashes[i] & hashes[j]) == len(sets[i] & sets[j])
    mins = ld.minima(got, ld._A[:5])
    for x, m in zip(ld.shingles(got), mins, strict=True):
        assert (m == (x.astype(np.uint32)[None, :] * ld._A[:5, None]).min(axis=1)).all()


def test_small_units_compared_together(monkeypatch):
    """The same members with partners whether units are compared one at a time (before) or together."""
    rng, rows = np.random.default_rng(5), []
    for u in range(150):
        band, base, keys = int(rng.integers(0, 24)), rng.integers(0, 256, ap.SIGNS, dtype=np.uint8), rng.integers(0, 3, (24, 8), dtype=np.uint8)
        for _ in range(int(rng.choice([2, 3, 9, 40]))):
            sign, key = base.copy(), keys.copy()
            other = rng.random(ap.SIGNS) < rng.choice([0.1, 0.3])
            sign[other] = rng.integers(0, 256, other.sum(), dtype=np.uint8)
            key[:band][rng.random(band) < 0.7] = 9
            rows.append({"key": u << 7 | band, "i": 0, "j": 0, "block": 0, "node": len(rows), "part": int(rng.integers(0, 4)), "n": int(rng.integers(90, 130)), "sign": sign.tobytes() + key.tobytes()})
    types = {"key": pa.int64(), "node": pa.int64(), "part": pa.int64(), "sign": pa.binary()}
    table = pa.Table.from_pylist(rows, pa.schema([(c, types.get(c, pa.int32())) for c in rows[0]]))
    found = []
    for few in (0, 10, 64):
        monkeypatch.setattr(ap, "FEW", few)
        out = [r for b in ap.partners(ap.SIGNS, 24)(iter(table.to_batches(max_chunksize=100))) for r in b.to_pylist()]
        found.append(sorted((tuple(map(str, r.values())) for r in out)))
    assert found[0] and found[0] == found[1] == found[2]


def alike_lines(a: str, b: str) -> bool:
    x, y = ({t[k : k + 8] for k in range(max(1, len(t) - 7))} for t in (a, b))
    return 100 * len(x & y) >= 75 * len(x | y)


def test_line_dedup(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(200, "Home\nHome\nhome\n\nshort\nSHORT"), (201, "the quick brown fox jumps over the lazy dog and runs away from the angry bear today\nother"), (202, "the quick brown fox jumps over the lazy dog and runs away from the angry bears today")]
    blank = lambda x: not x.strip(" \t\r\x0b\f")
    lines = [(i, k, low(x)) for i, t in rows for k, x in enumerate((t or "").split("\n")) if not blank(x)]
    kinds = sorted({x for _, _, x in lines})
    near = [(a, b) for a in kinds for b in kinds if a < b and alike_lines(a, b)]
    part = components(kinds, near)
    first, gone = set(), {}
    for i, k, x in lines:
        if part[x] in first:
            gone.setdefault(i, set()).add(k)
        first.add(part[x])
    want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows}
    assert near and 202 in gone
    for schema in (SCHEMA, WIDE):
        out = ld.drop_repeated_lines(frame(spark, [(i, t, "en", "s", 0) for i, t in rows], schema))
        assert {r["doc_id"]: r["text"] for r in out.collect()} == want and len(out.columns) == len(schema.split(","))
    assert ld.drop_repeated_lines(frame(spark, [])).count() == 0
    assert ld.drop_repeated_lines(frame(spark, [(None, "x y\nx y", None, None, None)])).first()["text"] == "x y\nx y"


def test_isolated_pairs_of_lines_at_the_limit(spark):
    rng = random.Random(75)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for i in range(600):  # 60 shingles, all of them among the 80 of the other line
        line = letters(67)
        assert alike_lines(line, line + "0" + (tail := letters(19))) and not alike_lines(line, line + "0" + tail + "1")
        rows += [(2 * i, line, "en", "s", 0), (2 * i + 1, line + "0" + tail, "en", "s", 0)]
    left = ld.drop_repeated_lines(frame(spark, rows)).where("text <> ''")
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(0, 1200, 2))


# --- rules ----------------------------------------------------------------------------------------------------------


def test_quality_rules(spark):
    got = {r["doc_id"]: r for r in qr.quality_rules(frame(spark, schema=WIDE)).collect()}
    for i, t in enumerate(texts()):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        many = Counter(runs)
        again = {j for k, x in enumerate(runs) if many[x] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if x.strip(" \t\r\x0b\f")]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["kept"] and r["base_failed"])
    assert qr.quality_rules(frame(spark, [])).count() == 0
    junk = [(1, "WORDS!! IN!! CAPITALS!! SHOUTING!! AT!! EVERY!! READER!! ALL!! DAY!! LONG!!"), (2, "a | b | c | d | e | f | g | h | i | j | k"), (3, "This is a clean line of some words.\nAnd here is another one, with more words.")]
    assert [r["kept"] for r in qr.quality_rules(frame(spark, [(i, t, "", "", 0) for i, t in junk])).orderBy("doc_id").collect()] == [False, False, True]


# --- licenses -------------------------------------------------------------------------------------------------------


def test_license_scan(spark):
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(texts())]
    for k, (name, text) in enumerate(ls.TEMPLATES):
        rows.append((100 + k, prose(rng, rng.randint(0, 50)) + " " + text.upper() + "\n" + prose(rng, 30)))
    got = {(r["doc_id"], r["license"]) for r in ls.license_matches(frame(spark, [(i, t, "", "", 0) for i, t in rows], WIDE)).collect()}
    assert {(100 + k, name) for k, (name, _) in enumerate(ls.TEMPLATES)} <= got and all(d >= 100 for d, _ in got)
    one = ls.license_matches(frame(spark, [(1, "we say: Released under the MIT License. Yes", "", "", 0)])).collect()
    assert [(r["license"], r["first_word"], r["n_words"], r["containment"]) for r in one] == [("MIT", 2, 5, 1.0)]
    assert len(list(ls.blocks(ls.TEMPLATES, 300))) > 3
    assert ls.license_matches(frame(spark, [])).count() == 0 and ls.license_matches(frame(spark), []).count() == 0


# --- shards ---------------------------------------------------------------------------------------------------------


def test_shards(spark, tmp_path):
    docs = frame(spark, schema=WIDE)
    store = sh.shard_documents(docs, 5, str(tmp_path / "s"), fan_in=2, target_bytes=30_000, least_run_bytes=1_000)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    tiers = Counter(store.tier(r) for r in store.manifest()["runs"])
    assert max(tiers.values()) < 2 and len(store.versions()) == 1
    now = store.manifest()
    before = store.read().count()
    store.append(docs.limit(3))
    assert store.read().count() == before + 3 and store.read(now["version"]).count() == before
    with pytest.raises(RuntimeError):
        store.commit(now)
    with pytest.raises(ValueError):
        store.append(docs.select("doc_id"))
    assert sh.shard_documents(frame(spark, []), 2, str(tmp_path / "e")).read().count() == 0


# --- classifiers ----------------------------------------------------------------------------------------------------


def test_flat_trees_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, len(qm.FEATURES)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = qm.grow(x, y, trees=30, depth=3)

    def walk(row) -> float:
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value):
            node = 1
            while node < len(v):
                node = 2 * node + int(row[f[node]] > t[node])
            total += v[node - len(v)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x[:50]), [walk(r) for r in x[:50]])
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    assert qm.grow(np.zeros((0, len(qm.FEATURES))), np.zeros(0)).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_model(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 80) if i % 3 else " ".join(rng.choice(VOCAB).upper() + "###" for _ in range(60)), "", "", 0) for i in range(240)]
    rows += [(900, None, "", "", 0), (901, "", "", "", 0), (902, "é" * 5000, "", "", 0)]
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(240)] + [(5, None, 0), (None, 1, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in qm.quality_scores(frame(spark, rows, WIDE), labels).collect()}
    held = [r for i, r in got.items() if r["held_out"] and i < 240]
    assert len(held) > 20 and all(r["predicted"] == int(bool(r["doc_id"] % 3)) for r in held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 243
    kept = qm.keep_quality(frame(spark, rows, WIDE), labels)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    assert qm.quality_scores(frame(spark), labels.limit(0)).where("score <> 0.5").count() == 0
    assert qm.quality_scores(frame(spark, []), labels).count() == 0


def test_language_id(spark):
    rng = random.Random(4)
    alphabets = {"aa": "abcdefg", "bb": "hijklmn", "cc": "абвгде"}
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(20)), name, "s", 0) for i in range(150) for name, a in [list(alphabets.items())[i % 3]]]
    rows += [(900, None, "aa", "s", 0), (901, "", "aa", "s", 0), (902, "12 34 !", None, "s", 0), (903, "gfedcba " * 5000, None, "s", 0)]
    got = {r["doc_id"]: r for r in li.languages(frame(spark, rows, WIDE)).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(150)) and any(r["held_out"] for r in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in li.languages(frame(spark, [(1, "abc", None, "", 0)])).collect()} == {"und"}
    assert li.languages(frame(spark, [])).count() == 0


# --- pieces ---------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(monkeypatch):
    import sentencepiece

    arcs, library = pc.compile_model(open(pc.DEFAULT_MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=pc.DEFAULT_MODEL)
    rng = random.Random(1)
    some = [t or "" for t in texts()] + ["".join(rng.choice("aaabbee theiong ▁ \n\t01.,éß漢字🙂\u0000") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    for most, slice_chars in ((pc.BLOCK_CHARS, pc.SLICE_CHARS), (3, 200)):  # runs in arrays; runs one by one, and texts in parts
        monkeypatch.setattr(pc, "BLOCK_CHARS", most)
        monkeypatch.setattr(pc, "SLICE_CHARS", slice_chars)
        model = pc.Transducer(arcs)
        ids = [np.frombuffer(i, np.int32) for i in model.encode(some)]
        assert [i.tolist() for i in ids] == library.encode(some)
        assert [b.decode() for b in model.decode(ids)] == [t.replace("▁", " ") for t in some]


def test_pieces_stay_apart_as_merging_says():
    arcs = pc.compile_model(open(pc.DEFAULT_MODEL, "rb").read())
    model = pc.Transducer(arcs)
    assert arcs.plain.mean() > 0.99
    rng = np.random.default_rng(0)
    named = np.array([bool(n) for n in arcs.names])
    good = np.flatnonzero(arcs.stable & named)
    a, b = rng.choice(good, 4000), rng.choice(good, 4000)
    joined = arcs.pair_keys[rng.integers(0, len(arcs.pair_keys), 2000)]
    a, b = np.concatenate([a, joined // len(arcs.names)]), np.concatenate([b, joined % len(arcs.names)])
    want = [pc.merged(model.score, arcs.names[i] + arcs.names[j])[0] == [arcs.names[i], arcs.names[j]] for i, j in zip(a, b, strict=True)]
    assert model.stay_apart(a, b).tolist() == want and 0.5 < sum(want) / 6000 < 0.7


def test_unigram_path_is_the_best_of_all():
    """A made vocabulary: every segmentation is enumerated."""
    score = {"▁": -2.0, "a": -1.5, "b": -2.5, "ab": -2.0, "▁a": -2.2, "ba": -3.1, "aba": -5.5, "bb": -4.0}
    text = lambda number, raw: bytes([number << 3 | 2, len(raw)]) + raw
    piece = lambda p, s, kind: text(1, text(1, p.encode()) + b"\x15" + np.float32(s).tobytes() + b"\x18" + bytes([kind]))
    proto = b"".join(piece(p, s, pc.NORMAL) for p, s in score.items()) + b"".join(piece(f"<0x{b:02X}>", 0, pc.BYTE) for b in range(256)) + text(3, b"\x20\x00")
    arcs = pc.compile_model(proto)
    assert not arcs.bpe
    model = pc.Transducer(arcs)

    def best(t: str) -> float:
        cost = [0.0] + [1e18] * len(t)
        for j in range(1, len(t) + 1):
            cost[j] = min([cost[i] - float(np.float32(score[t[i:j]])) for i in range(j) if t[i:j] in score] + ([cost[j - 1] + 1e6] if t[j - 1] not in score else []) + [1e18])
        return cost[-1]

    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 12)))
        ids = np.frombuffer(model.encode([t])[0], np.int32)
        assert model.decode([ids])[0].decode() == t
        spelled = sum(1e6 for i in ids if i >= len(score))
        assert abs(sum(arcs.cost[i] for i in ids if i < len(score)) + spelled - best("▁" + t.replace(" ", "▁"))) < 1e-4


def test_pieces_frame(spark):
    got = {r["doc_id"]: r for r in pc.encode(frame(spark, schema=WIDE)).collect()}
    assert all(r["round_trip"] and r["n_pieces"] == len(r["piece_ids"]) for r in got.values())
    back = {r["doc_id"]: r["text"] for r in pc.decode(pc.encode(frame(spark))).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts())}
    assert pc.encode(frame(spark, [])).count() == 0


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = got.collect()
    assert 0 < len(rows) < 200 and len({r["doc_id"] for r in rows}) == len(rows) and all(r["round_trip"] for r in rows)
