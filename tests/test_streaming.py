"""The list of cases as a stream: batches against a plain fold, and batches that are run twice."""

from __future__ import annotations

import random
import shutil

from textloom.streaming import cases as cs

SCHEMA = "seq long, key long, parser string, event string, licence string"


def fold(batches: list[list[tuple]]) -> tuple[list[set], dict]:
    state: dict = {}
    told = []
    for rows in batches:
        before = {k: (lic, dict(views)) for k, (lic, views) in state.items()}
        out: list[tuple] = []
        seen = set()
        for seq, key, parser, event, licence in sorted(r for r in rows if r[1] is not None):
            if event == "found" and (key, parser) not in seen:
                held, views = before.get(key, ("", {}))
                if views.get(parser) != "open" or (held == "" and licence):
                    out.append((seq, key, parser, event, licence or ""))
                    seen.add((key, parser))
            elif event != "found" and (key in before or any(w[1] == key and w[3] == "found" for w in out)):
                out.append((seq, key, parser, event, licence or ""))
        for _, key, parser, event, licence in sorted(out):
            lic, views = state.setdefault(key, ("", {}))
            views[parser] = "learned" if event == "learned" else "open"
            state[key] = (licence if event == "found" else lic, views)
        told.append(set(out))
    return told, state


def made(seed: int) -> list[list[tuple]]:
    rng, seq, batches = random.Random(seed), 0, []
    for _ in range(4):
        rows = []
        for _ in range(rng.randint(0, 60)):
            seq += 1
            rows.append((seq, rng.choice([1, 2, 3, 4, 5, None]), rng.choice("pq"), rng.choice(["found", "found", "learned", "open"]), rng.choice(["", None, "by", "pd"])))
        batches.append(rows)
    return batches


def test_batches_equal_the_fold(spark):
    for seed in (1, 2):
        batches = made(seed)
        want, state = fold(batches)
        now = spark.createDataFrame([], cs._CASE_STATE)
        for rows, told in zip(batches, want, strict=True):
            written, after = cs.record_batch(spark.createDataFrame(rows, SCHEMA), now)
            assert {tuple(r[c] for c in ("seq", "key", "parser", "event", "licence")) for r in written.collect()} == told
            now = spark.createDataFrame(after.collect(), cs._CASE_STATE)
        assert {r["key"]: (r["licence"], r["views"]) for r in now.collect()} == state


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    batches, came, out = made(3), str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: cs.record_stream(spark.readStream.schema(SCHEMA).parquet(came), out, str(tmp_path / "log")).awaitTermination()
    for rows in batches:
        spark.createDataFrame(rows or [(None, None, None, None, None)], SCHEMA).write.mode("append").parquet(came)
        stream()
    read = lambda what: sorted(map(str, spark.read.parquet(f"{out}/{what}").collect()))
    first = read("events"), read("state")
    told, state = fold(batches)
    assert len(first[0]) == sum(map(len, told))
    last = spark.read.parquet(f"{out}/state/batch={len(batches) - 1}").collect()
    assert {r["key"]: (r["licence"], r["views"]) for r in last} == state
    # A run that died after it had written: the log doesn't know the last batch, which comes again.
    for f in (tmp_path / "log" / "commits").glob(f"*{len(batches) - 1}*"):
        shutil.move(f, tmp_path / f.name)
    stream()
    assert (read("events"), read("state")) == first
