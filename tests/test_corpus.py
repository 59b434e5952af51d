"""The originality gate against its rules written out in plain Python."""

from __future__ import annotations

import hashlib
import random
import re

from textloom.operators import corpus as cp


def plain(docs: list[tuple], sources: list[tuple]) -> dict:
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, n: [hashlib.md5(" ".join(w[k : k + n]).encode()).hexdigest() for k in range(len(w) - n + 1)]

    def prints(w: list[str]) -> set[tuple[str, int]]:
        g = [(h, k) for k, h in enumerate(grams(w, 3))]
        return {min(g[s : s + 4]) for s in range(max(len(g) - 3, 1))} if g else set()

    held = {n: {h for _, t in sources for h in grams(words(t), n)} for n in (6, 13)}
    theirs = [{h for h, _ in prints(words(t))} for _, t in sources]
    out = {}
    for i, t in docs:
        w = words(t)
        covered = {k for p, h in enumerate(grams(w, 6)) if h in held[6] for k in range(p, p + 6)}
        exact = sum(h in held[13] for h in grams(w, 13))
        mine = prints(w)
        near = set()
        for s in theirs:
            for _, p in (f for f in mine if f[0] in s):
                inside = [f for f in mine if p <= f[1] < p + 24]
                n = sum(f[0] in s for f in inside)
                if n >= 4 and 100 * n >= 60 * len(inside):
                    near.add(p)
        much = len(covered) >= 24 and 100 * len(covered) >= 20 * len(w)
        out[i] = (len(w), exact, len(covered), len(near), "blocked" if exact or near or much else "pending" if covered or not w else "clear")
    return out


def test_originality_equals_its_rules(spark):
    rng = random.Random(7)
    some = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    sources = [(k, " ".join(some(rng.choice([3, 8, 60, 120])))) for k in range(12)] + [(90, None), (91, "")]
    sources.append((92, sources[2][1]))
    full = [t.split() for _, t in sources if t and len(t.split()) > 50]
    docs = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "one two three"), (6, "a b c d e f")]
    for i in range(100, 190):
        w = some(rng.choice([20, 60, 200]))
        part = rng.choice(full)
        at, n = rng.randrange(len(part) - 30), rng.choice([5, 6, 8, 12, 13, 20, 40])
        part = part[at : at + n]
        for k in range(0, len(part), rng.choice([4, 7, 9, 1000])):
            part[k] = "changed" if rng.random() < 0.7 else part[k]
        k = rng.randrange(len(w))
        docs.append((i, rng.choice([" ", ", "]).join(w[:k] + part + w[k:]).upper() if i % 3 else " ".join(w[:k] + part + w[k:])))
    got = {r["doc_id"]: (r["words"], r["exact"], r["covered"], r["near"], r["state"]) for r in cp.originality(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(sources, "item_id long, text string")).collect()}
    want = plain(docs, sources)
    assert got == want
    assert {s for *_, s in want.values()} == {"blocked", "pending", "clear"}
    assert any(not x[1] and x[3] for x in want.values())  # a near copy without an exact run


def test_a_copy_with_changed_words_is_blocked_by_its_windows_alone(spark):
    rng = random.Random(3)
    text = [f"w{rng.randrange(10_000)}" for _ in range(80)]
    changed = ["other" if k % 11 == 10 else w for k, w in enumerate(text)]
    got = cp.originality(spark.createDataFrame([(1, " ".join(changed + [f"x{k}" for k in range(900)]))], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(text))], "item_id long, text string")).first()
    assert (got["exact"], got["state"]) == (0, "blocked") and got["near"] > 0 and 100 * got["covered"] < 20 * got["words"]


def test_tokens_with_clitics_and_spaces(spark):
    rows = [(1, "Don't stop: it's  Kim's\nwell-known X-ray (3 times)."), (2, None), (3, ""), (4, "they'll've I'd 'tis o'clock")]
    got: dict = {}
    for r in cp.token_rows(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "i").collect():
        got.setdefault(r["doc_id"], []).append((r["token"], r["kind"][0], r["space_after"]))
    assert [t for t, *_ in got[1]] == ["Do", "n't", "stop", ":", "it", "'s", "Kim", "'s", "well-known", "X-ray", "(", "3", "times", ")", "."]
    assert [k for _, k, _ in got[1]] == list("wcwmwcwcwwmnwmm") and [s for *_, s in got[1]] == [False, True, False, True, False, True, False, True, True, True, False, True, False, False, False]
    assert 2 not in got and 3 not in got and [t for t, *_ in got[4]][-1] == "o'clock"


def test_dictionary_layer(spark):
    word = lambda f, u="NOUN": (f, f, u)
    units = [
        (1, "d1", "a", "the cat sat on the mat today", [word("Cat"), word("sat", "VERB"), word("the", "DET"), word("mat"), word("x")]), (2, "d1", "a", "a cat and a mat, again and again", [word("cat"), word("mat"), word("cat")]),
        (3, "d2", "b", "cat people are not dog people", [word("cat", "ADJ"), word("dog"), word("ice-cream"), word("9th")]), (4, "d2", "b", "short cat", [word("cat")]), (5, "d3", None, None, None),
    ]
    docs = spark.createDataFrame(units, "id long, doc string, class string, text string, words array<struct<form:string,lemma:string,upos:string>>")
    base = spark.createDataFrame([("cat", "an animal"), ("none", "x")], "lemma string, meaning string")
    got = {r["lemma"]: r for r in cp.dictionary_layer(docs, base, 3).collect()}
    assert list(got) and set(got) == {"cat", "mat", "dog"}
    cat = got["cat"]
    assert (cat["uses"], cat["docs"], cat["pos"], cat["classes"], cat["companions"], cat["meaning"]) == (5, 2, "NOUN 80.0, ADJ 20.0", "a 1, b 1", "mat, dog, ice-cream, sat", "an animal")
    assert cat["examples"] == [units[0][3], units[2][3], units[1][3]] and got["dog"]["meaning"] is None
