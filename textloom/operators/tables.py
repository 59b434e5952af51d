"""Table operators: joins with missing keys, group summaries and transforms, pivots, order, quantiles, summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.plans.materialize import materialize


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: it never matches in a join and no aggregate counts it."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def is_missing(df: DataFrame) -> DataFrame:
    """The same columns as booleans: true where a cell is missing."""
    return nan_to_null(df).select(*(F.col(c).isNull().alias(c) for c in df.columns))


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing cell (in ``columns``)."""
    return nan_to_null(df).dropna(subset=list(columns) if columns else None)


def inner_join(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """All matches; missing keys match nothing; the right keys go and columns of both sides get suffixes."""
    both = (set(left.columns) & set(right.columns)) - set(keys)
    rename = lambda df, s: nan_to_null(df).select(*(F.col(c).alias(c + s if c in both else c) for c in df.columns))
    return rename(left, suffixes[0]).join(rename(right, suffixes[1]), list(keys), "inner")


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every left row with its one right row. The job fails if a right key repeats or a left row finds none."""
    keys = list(keys)
    unique = right.groupBy(*keys).agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in right.columns if c not in keys))
    found = left.join(unique, keys, "left")
    problem = F.when(F.col("__n").isNull(), F.raise_error(F.lit("a row has no match"))).when(F.col("__n") > 1, F.raise_error(F.lit("a key of the right table repeats"))).otherwise(F.lit(True))
    return found.where(problem).drop("__n")


_METHODS: dict[str, Callable[[str], Column]] = {
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "numel": F.count,
    "range": lambda c: F.max(c) - F.min(c),
    "var": lambda c: F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.var_samp(c)),
    "std": lambda c: F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c)),
}


def group_summary(df: DataFrame, keys: Sequence[str], methods: Sequence[str] = (), columns: Sequence[str] = ()) -> DataFrame:
    """``GroupCount`` and a ``method_column`` for each pair. Missing cells are left out by all methods.

    Medians and modes come from counted values, so that no group's values meet in one buffer: of equal modes the least.
    """
    df = nan_to_null(df)
    made = [_METHODS[m](c).alias(f"{m}_{c}") for c in columns for m in methods if m not in ("median", "mode")]
    out = df.groupBy(*keys).agg(F.count("*").alias("GroupCount"), *made)
    if "median" in methods and columns:
        out = same_keys(out, group_medians(df, keys, columns), keys, "left")
    for c in columns if "mode" in methods else ():
        counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("__n"))
        out = same_keys(out, counts.groupBy(*keys).agg(F.min_by(c, F.struct(-F.col("__n"), c)).alias(f"mode_{c}")), keys, "left")
    return out.select(*keys, "GroupCount", *(f"{m}_{c}" for c in columns for m in methods))


def group_transform(df: DataFrame, keys: Sequence[str], order: Sequence[str], made: dict[str, Callable]) -> DataFrame:
    """New columns from whole groups (a function of the group's window and its running window)."""
    whole = Window.partitionBy(*keys)
    running = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: f(whole, running) for name, f in made.items()})


def group_apply(df: DataFrame, keys: Sequence[str], f: Callable, schema: str) -> DataFrame:
    """A pandas function over each group, for what no expression says; a group has to fit a task."""
    return df.groupBy(*keys).applyInPandas(f, schema)


def pivot_table(df: DataFrame, row: str, column: str, values: Sequence, method: str, of: str) -> DataFrame:
    """A wide table; an empty cell is 0 for counts and missing for others."""
    made = {"count": lambda _: F.count(F.lit(1)), "median": F.median, "mode": lambda c: F.mode(c, True)} | _METHODS
    wide = df.groupBy(row).pivot(column, list(values)).agg(made[method](of))
    return wide.fillna(0, [str(v) for v in values]) if method == "count" else wide


def sort_rows(df: DataFrame, keys: Sequence[tuple[str, bool]], position: str) -> DataFrame:
    """By several keys (name, ascending), missing last when ascending and first when descending, then by position."""
    order = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in keys]
    return df.orderBy(*order, F.col(position))


def ranged(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """The rows dealt into ranges of ``order``, with the number of their range in ``__part``.

    The rows are written once: the bounds of ranges are sampled, so a second reading could deal them otherwise.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranged")


def global_rank(df: DataFrame, order: Sequence[Column], name: str, partitions: int | None = None) -> DataFrame:
    """``row_number`` over everything without a single task: rows are ranged, ranked within a range, and offset."""
    rows = ranged(df, order, partitions)
    local = Window.partitionBy("__part").orderBy(*order)
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # one row a range
    ranked = rows.withColumn("__rank", F.row_number().over(local)).join(F.broadcast(before), "__part")
    return ranked.withColumn(name, F.col("__rank") + F.col("__before")).drop("__part", "__rank", "__before")


def counted_ranks(df: DataFrame, keys: Sequence[str], value: str, partitions: int | None = None) -> DataFrame:
    """Each value of each group once: ``(keys, value, __n, __upto, __total)``, how often it occurs, the rank of its last
    occurrence in the group and the group's size. Missing values are left out.

    Equal values are counted before anything is dealt out, so ranges of (keys, value) are even whatever repeats, and
    neither a large group nor a frequent value is one task. The ranks are running sums within a range, begun with what
    the group has in the ranges before.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    rows = ranged(counts, [*(F.col(k) for k in keys), F.col(value)], partitions)
    sizes = rows.groupBy("__part", *keys).agg(F.sum("__n").alias("__sum"))
    mine = Window.partitionBy(*keys)  # a row for each range that the group lies in
    heads = sizes.select("__part", *keys, (F.sum("__sum").over(mine.orderBy("__part")) - F.col("__sum")).alias("__n"), F.sum("__sum").over(mine).alias("__total"))
    both = rows.unionByName(heads, allowMissingColumns=True)
    here = Window.partitionBy("__part", *keys)
    run = here.orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranks = both.select(*keys, value, "__n", F.sum("__n").over(run).alias("__upto"), F.max("__total").over(here).alias("__total"))
    return ranks.where(F.col(value).isNotNull())


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which missing keys are equal; the keys of ``right`` go. Without keys both sides have one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(other, met, how).drop(*(f"__right_{k}" for k in keys))


def unique_values(df: DataFrame, value: str, position: str) -> DataFrame:
    """Each value with its first position and its rank among the values."""
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(position).alias("first_position"), F.count("*").alias("n"))
    return global_rank(first, [F.col(value)], "rank")


def describe(df: DataFrame, column: str) -> DataFrame:
    """Median, deviation and variance (sample and population), any, all and how many are not zero; one row."""
    c, df = F.col(column), nan_to_null(df)
    moments = df.agg(F.stddev_samp(c).alias("std"), F.var_samp(c).alias("var"), F.var_pop(c).alias("var_pop"), F.bool_or(c != 0).alias("any"), F.bool_and(c != 0).alias("all"), F.count_if(c != 0).alias("nnz"))
    return medians(df, [column]).select(F.col(column).alias("median")).crossJoin(moments)


def group_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``median_column`` of each column and group, all columns in one pass over counted values."""
    cells = F.array(*(F.struct(F.lit(c).alias("__column"), F.col(c).cast("double").alias("__cell")) for c in columns))
    found = hazen_quantiles(df.select(*keys, F.explode(cells).alias("__x")).select(*keys, "__x.*"), [*keys, "__column"], "__cell", [0.5])
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("__column") == c, F.col("q50"))).alias(f"median_{c}") for c in columns))


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the median of each column, null where nothing is known."""
    if not columns:
        return df.limit(0).agg(F.lit(1).alias("__one")).drop("__one")
    return group_medians(df, [], columns).withColumnsRenamed({f"median_{c}": c for c in columns})


def summarize(df: DataFrame) -> DataFrame:
    """One row a column: kind, missing, least and greatest as text, distinct values of text, trues of booleans."""
    df = nan_to_null(df)
    parts = []
    for f in df.schema:
        number = isinstance(f.dataType, T.NumericType)
        text = isinstance(f.dataType, T.StringType)
        c = F.col(f.name)
        parts.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit("number" if number else "text" if text else f.dataType.simpleString()).alias("kind"),
                F.count_if(c.isNull()).alias("missing"),
                (F.min(c).cast("double") if number else F.lit(None).cast("double")).alias("least"),
                (F.max(c).cast("double") if number else F.lit(None).cast("double")).alias("most"),
                (F.count_distinct(c) if text else F.lit(None).cast("long")).alias("distinct_values"),
            ).alias(f"__{f.name}")
        )
    wide = df.agg(*parts)
    rows = wide.select(F.explode(F.array(*(F.col(c) for c in wide.columns))).alias("s")).select("s.*")
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    middle = medians(df, numbers)
    named = F.create_map(*(x for c in numbers for x in (F.lit(c), F.col(c)))) if numbers else F.create_map(F.lit(""), F.lit(None).cast("double"))
    return rows.crossJoin(F.broadcast(middle.select(named.alias("__m")))).select("column", "kind", "missing", "least", F.try_element_at("__m", F.col("column")).alias("median"), "most", "distinct_values")


def hazen_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Quantiles at position n * p + 0.5, linear between neighbours, clamped to the ends; values are doubles."""
    known = nan_to_null(df).select(*keys, F.col(value).cast("double").alias("__v"))
    ranks = counted_ranks(known, keys, "__v")
    holds = lambda r: (F.col("__upto") - F.col("__n") < r) & (F.col("__upto") >= r)
    parts = {}
    for p in shares:
        at = F.greatest(F.lit(1.0), F.least(F.col("__total").cast("double"), F.col("__total") * F.lit(p) + F.lit(0.5)))
        low = F.floor(at)
        weight = F.when(holds(low), 1 - (at - low)).otherwise(0.0) + F.when(holds(low + 1), at - low).otherwise(0.0)
        parts[f"q{round(p * 100):02d}"] = weight
    near = ranks.select(*keys, *((w * F.col("__v")).alias(c) for c, w in parts.items()), sum(parts.values(), F.lit(0.0)).alias("__weight")).where("__weight > 0")
    return near.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in parts))


def histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Counts between edges; the last bin holds its right edge. Values outside aren't counted."""
    c = F.col(value)
    bins = F.lit(None).cast("int")
    for k in range(len(edges) - 1, 0, -1):
        top = c <= edges[k] if k == len(edges) - 1 else c < edges[k]
        bins = F.when((c >= edges[k - 1]) & top, F.lit(k - 1)).otherwise(bins)
    return df.select(bins.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def covariances(df: DataFrame, columns: Sequence[str], population: bool = False) -> DataFrame:
    """Covariance and correlation of every pair of columns, as rows (x, y, cov, corr)."""
    pairs = [(a, b) for a in columns for b in columns if a <= b]
    cov = F.covar_pop if population else F.covar_samp
    wide = nan_to_null(df).agg(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), cov(a, b).alias("cov"), F.corr(a, b).alias("corr")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(F.array(*(F.col(c) for c in wide.columns))).alias("s")).select("s.*")


def weighted_covariance(df: DataFrame, keys: Sequence[str], x: str, y: str, weight: str) -> DataFrame:
    """Population covariance with weights, in two passes: weighted means first, then centred products."""
    mean = lambda c: (F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(f"__mean_{c}")
    means = df.groupBy(*keys).agg(mean(x), mean(y))
    centred = df.join(means, list(keys)).select(*keys, F.col(weight).alias("__w"), ((F.col(x) - F.col(f"__mean_{x}")) * (F.col(y) - F.col(f"__mean_{y}")) * F.col(weight)).alias("__p"))
    return centred.groupBy(*keys).agg(F.sum("__w").alias("weight"), (F.sum("__p") / F.sum("__w")).alias("cov"))


def union_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def bucket_ranks(df: DataFrame, bucket: str, ranks: Sequence[float]) -> DataFrame:
    """For shares of all rows, the bucket that holds that rank and the ranks the bucket spans."""
    counts = df.groupBy(bucket).agg(F.count("*").alias("n"))
    w = Window.orderBy(bucket)  # one row a bucket
    spans = counts.select(bucket, "n", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    wanted = spans.select("*", F.explode(F.array(*(F.lit(float(r)) for r in ranks))).alias("share")).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("total"))))
    return wanted.where("rank > upto - n and rank <= upto").select("share", "rank", bucket, (F.col("upto") - F.col("n") + 1).alias("from_rank"), F.col("upto").alias("to_rank"))
