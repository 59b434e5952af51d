"""Tests and models from group moments: one pass over the data, then a few numbers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import distributions as ds
from textloom.operators.tables import same_keys


def t_tests(df: DataFrame, group: str, a: str, b: str, value: str, mean: float = 0.0) -> DataFrame:
    """``(test, t, df, p)``: one sample against ``mean`` (all rows), two groups with a pooled variance, and Welch's."""
    of = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    pairs = [(n, f) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    m = df.agg(*(of(f, g).alias(f"{n}{k}") for k, g in (("a", a), ("b", b)) for n, f in pairs), *(f(F.col(value)).alias(f"{n}o") for n, f in pairs))
    gap, va, vb = F.col("ma") - F.col("mb"), F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    freedom = F.col("na") + F.col("nb") - 2
    shared = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / freedom
    rows = [
        ("one sample", (F.col("mo") - mean) / F.sqrt(F.col("vo") / F.col("no")), F.col("no") - 1),
        ("pooled", gap / F.sqrt(shared * (1 / F.col("na") + 1 / F.col("nb"))), freedom),
        ("welch", gap / F.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (F.col("na") - 1) + vb**2 / (F.col("nb") - 1))),
    ]
    out = m.select(F.explode(F.array(*(F.struct(F.lit(n).alias("test"), t.alias("t"), d.cast("double").alias("df")) for n, t, d in rows))).alias("r")).select("r.*")
    return out.withColumn("p", ds.t_p(F.col("t"), F.col("df")))


def welch(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """Welch's t and degrees of freedom between two groups."""
    return t_tests(df, group, a, b, value).where("test = 'welch'").select("t", "df")


def anova1(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance: one row ``(f, df_between, df_within, p)``."""
    per = df.dropna(subset=[group, value]).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value) * (F.count("*") - 1), F.lit(0.0)).alias("ss"))
    whole = per.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))  # one row
    sums = per.join(F.broadcast(whole)).agg(F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between"), F.sum("ss").alias("within"), (F.count("*") - 1).alias("d1"), (F.sum("n") - F.count("*")).alias("d2"))
    f = (F.col("between") / F.col("d1")) / (F.col("within") / F.col("d2"))
    return sums.select(f.alias("f"), F.col("d1").alias("df_between"), F.col("d2").alias("df_within"), ds.f_p(f, F.col("d1"), F.col("d2")).alias("p"))


def correlation_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's r with its t test: one row ``(r, n, t, df, p)``."""
    one = df.dropna(subset=[x, y]).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))
    freedom = (F.col("n") - 2).cast("double")
    t = F.col("r") * F.sqrt(freedom / (1 - F.col("r") ** 2))
    return one.select("r", "n", t.alias("t"), freedom.alias("df"), ds.t_p(t, freedom).alias("p"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cells that have rows: ``(a, b, n, expected)``."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows, columns, total = cells.groupBy(a).agg(F.sum("n").alias("na")), cells.groupBy(b).agg(F.sum("n").alias("nb")), cells.agg(F.sum("n").alias("total"))
    joined = same_keys(same_keys(cells, rows, [a]), columns, [b]).join(F.broadcast(total))  # one row
    return joined.select(a, b, "n", (F.col("na") * F.col("nb") / F.col("total")).alias("expected"))


def chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-squared of independence, one row ``(chi2, df, p)``; rows with a missing value don't count.

    Empty cells add their expected counts, and all expected counts add up to n: only cells with rows are met.
    """
    cells = crosstab(df.dropna(subset=[a, b]), a, b)
    x = F.sum(F.col("n") ** 2 / F.col("expected")) - F.sum("n")
    out = cells.agg(x.alias("chi2"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("df"))
    return out.withColumn("p", ds.chi2_p(F.col("chi2"), F.col("df")))


def linear_model(df: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """Ordinary least squares: a row for each term with estimate, standard error and t, and R² and n.

    The Gram matrix comes from one aggregate; the driver solves a system of as many rows as there are terms.
    """
    rows = df.dropna(subset=[*xs, y])
    means = rows.agg(*(F.avg(c).alias(c) for c in [*xs, y])).first()
    centred = rows.select(*((F.col(c) - F.lit(means[c])).alias(c) for c in [*xs, y]))
    cols = [*xs, y]
    g = centred.agg(F.count("*").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j)).first()
    k, n = len(xs), g["n"]
    gram = np.array([[g[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    xy, yy = np.array([g[f"{i}_{k}"] for i in range(k)], float), float(g[f"{k}_{k}"])
    beta = np.linalg.solve(gram, xy)
    rss = max(0.0, float(yy - beta @ xy))
    cov = np.linalg.inv(gram) * rss / (n - k - 1)
    m = np.array([means[c] for c in xs])
    rows_out = [("intercept", float(means[y] - beta @ m), float(np.sqrt(rss / (n - k - 1) / n + m @ cov @ m)))] + [(c, float(b), float(np.sqrt(cov[i, i]))) for i, (c, b) in enumerate(zip(xs, beta, strict=True))]
    out = [(t, e, s, e / s if s else float("inf"), float(1 - rss / yy), n) for t, e, s in rows_out]
    return df.sparkSession.createDataFrame(out, "term string, estimate double, error double, t double, r2 double, n long")


def heavy_hitters(df: DataFrame, value: str, share: float) -> DataFrame:
    """Values of more than ``share`` of all rows with their exact counts.

    Each partition keeps a Misra-Gries sketch of at most 1/share counters; a value above the share in all is above it
    in some partition, so only candidates (at most 1/share a partition) are counted exactly in a second pass.
    """
    size = int(np.ceil(1 / share))
    kind = df.schema[value].dataType.simpleString()

    def sketch(batches):
        import pandas as pd

        counters: dict = {}
        for batch in batches:
            for v, n in batch[value].value_counts(sort=False).items():
                counters[v] = counters.get(v, 0) + int(n)
            if len(counters) > size:
                cut = sorted(counters.values(), reverse=True)[size]
                counters = {v: n - cut for v, n in counters.items() if n > cut}
        yield pd.DataFrame({"value": list(counters)})

    candidates = df.select(value).where(F.col(value).isNotNull()).mapInPandas(sketch, f"value {kind}").distinct()
    total = F.broadcast(df.agg(F.count("*").alias("total")))
    counted = df.select(F.col(value).alias("value")).join(candidates, "value", "left_semi").groupBy("value").agg(F.count("*").alias("n"))
    return counted.join(total).where(F.col("n") > share * F.col("total")).select("value", "n")
