"""Keyed state over an event log: the same fold in batch and as a stream, and what a harvest keeps.

An event is ``(seq, key, parser, event)``. ``found`` opens a case and counts; ``learned`` and ``open`` set the view of
a parser, and count for nothing before the first ``found`` of the key.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def case_state(events: DataFrame) -> DataFrame:
    """``(key, parser, found, state)``: how often the key was found and the last state of each parser's view."""
    first = events.where("event = 'found'").groupBy("key").agg(F.min("seq").alias("first"), F.count("*").alias("found"))
    live = events.join(first, "key").where("seq >= first")
    state = F.max_by(F.when(F.col("event") == "learned", "learned").otherwise("open"), "seq")
    return live.groupBy("key", "parser").agg(F.first("found").alias("found"), state.alias("state"))


def case_state_stream(events: DataFrame) -> DataFrame:
    """The fold over a stream, one row for each key that a batch touches: ``(key, found, views)`` with the views of all
    parsers as JSON text. Events of a key have to arrive in the order of ``seq`` between batches."""

    def fold(key: tuple, batches: Iterable[pd.DataFrame], state):
        found, views = (state.get[0], dict(v.split("=", 1) for v in state.get[1].split(";") if v)) if state.exists else (0, {})
        for e in pd.concat(list(batches)).sort_values("seq").itertuples():
            if e.event == "found":
                found += 1
                views[str(e.parser)] = "open"
            elif found:
                views[str(e.parser)] = "learned" if e.event == "learned" else "open"
        text = ";".join(f"{k}={v}" for k, v in sorted(views.items()))
        state.update((found, text))
        yield pd.DataFrame({"key": [key[0]], "found": [found], "views": [text]})

    return events.groupBy("key").applyInPandasWithState(fold, "key long, found long, views string", "found long, views string", "update", "NoTimeout")


def new_cases(found: DataFrame, state: DataFrame) -> DataFrame:
    """Found cases that aren't open already for their parser."""
    open_now = state.where("state = 'open'").select("key", "parser")
    return found.join(open_now, ["key", "parser"], "left_anti")


def record_batch(events: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a batch of ``(seq, key, parser, event, licence)`` adds to a list of cases, and the state after it.

    ``state(key, licence, views)``: the licence of the last found record of a case, and what each parser thinks of it. A
    found case is written if its parser doesn't have it open, or if it brings a licence that the case lacks; of several
    of one key and parser the first that may be written. ``learned`` and ``open`` of known keys set the parser's view.
    A null licence is an empty one; rows without a key are left out.
    """
    rows = events.where("key is not null").select("seq", "key", F.col("parser").cast("string").alias("parser"), "event", F.coalesce("licence", F.lit("")).alias("licence"))
    known = state.select("key", F.col("licence").alias("held"), "views")
    met = rows.join(known, "key", "left")
    is_open = F.coalesce(F.try_element_at("views", "parser") == "open", F.lit(False))
    may = ~is_open | ((F.col("held") == "") & (F.col("licence") != ""))
    found = met.where((F.col("event") == "found") & may).groupBy("key", "parser").agg(F.min(F.struct("seq", "licence")).alias("f")).select("f.seq", "key", "parser", F.lit("found").alias("event"), "f.licence")
    first = found.groupBy("key").agg(F.min("seq").alias("first"))
    told = met.where("event <> 'found'").join(first, "key", "left").where("views is not null or seq > first").select("seq", "key", "parser", "event", "licence")
    written = found.unionByName(told)
    view = F.when(F.col("event") == "learned", "learned").otherwise("open")
    views = written.groupBy("key", "parser").agg(F.max_by(view, "seq").alias("view")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("parser", "view"))).alias("new"))
    licences = found.groupBy("key").agg(F.max_by("licence", "seq").alias("brought"))
    both = known.join(views, "key", "full_outer").join(licences, "key", "left")
    none = F.expr("cast(map() as map<string,string>)")
    old = F.map_filter(F.coalesce("views", none), lambda k, _: ~F.map_contains_key(F.coalesce("new", none), k))
    return written, both.select("key", F.coalesce("brought", "held").alias("licence"), F.map_concat(old, F.coalesce("new", none)).alias("views"))


_CASE_STATE = "key long, licence string, views map<string,string>"


def record_stream(events: DataFrame, path: str, checkpoint: str):
    """``record_batch`` over a stream: what is written goes to ``path/events``, the state after a batch to ``path/state``.

    A batch reads the state that the batch before it left and replaces its own folders, so a batch that is run again
    after a failure changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = spark.read.schema(_CASE_STATE).parquet(f"{path}/state/batch={number - 1}") if number else spark.createDataFrame([], _CASE_STATE)
        kept = batch.persist()
        written, after = record_batch(kept, state)
        written.write.mode("overwrite").parquet(f"{path}/events/batch={number}")
        after.write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        kept.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recheck(state: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Events that follow from verdicts ``(key, parser, right)``: open cases now right, learned ones now wrong."""
    joined = state.join(verdicts, ["key", "parser"])
    event = F.when((F.col("state") == "open") & F.col("right"), "learned").when((F.col("state") == "learned") & ~F.col("right"), "open")
    return joined.select("key", "parser", event.alias("event")).where("event is not null")


def latest_records(rows: DataFrame, key: str, stamp: list[str], value: str, tag: str) -> DataFrame:
    """The record of the latest stamp of each key and the set of all its tags."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*stamp)).alias(value), F.array_join(F.array_sort(F.collect_set(tag)), ",").alias("tags"))


def harvest_stream(rows: DataFrame, path: str, checkpoint: str):
    """Appends what a stream brings to the Parquet table ``path``, a folder for each batch so that a repeated batch
    replaces itself; ``latest_records`` over the table gives the current state."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates().write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_batches(rows: DataFrame, path: str, checkpoint: str):
    """Writes the updates of a stream with state to ``path``, a folder for each batch; ends when all input is read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def online_regression(rows: DataFrame, key: str, order: str, y: str, xs: list[str], ridge: float = 1.0) -> DataFrame:
    """Recursive least squares for each key in order: forecast before the update, leverage and summed squared error.

    What the recursion knows at a row are sums over the rows before it: they are running sums, and each row then solves
    its own small system, so no task gathers the rows of a key.
    """
    import numpy as np

    terms = [F.lit(1.0), *(F.col(c).cast("double") for c in xs)]
    k = len(terms)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    known = rows.select(key, order, F.array(*terms).alias("x"), F.col(y).cast("double").alias("y"), F.array(*(total(terms[i] * terms[j]) for i, j in upper)).alias("gram"), F.array(*(total(t * F.col(y)) for t in terms)).alias("xy"))

    def solve(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            x, g = np.stack(b["x"].to_numpy()), np.stack(b["gram"].to_numpy())
            gram = np.zeros((len(b), k, k)) + ridge * np.eye(k)
            for at, (i, j) in enumerate(upper):
                gram[:, i, j] += g[:, at]
                if i != j:
                    gram[:, j, i] += g[:, at]
            both = np.linalg.solve(gram, np.stack([x, np.stack(b["xy"].to_numpy())], axis=2))
            forecast = (x * both[:, :, 1]).sum(axis=1)
            yield pd.DataFrame({key: b[key], order: b[order], "forecast": forecast, "leverage": (x * both[:, :, 0]).sum(axis=1), "error": (b["y"].to_numpy() - forecast) ** 2})

    found = known.mapInPandas(solve, f"{key} long, {order} long, forecast double, leverage double, error double")
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("squared_error", F.sum("error").over(upto)).drop("error")
