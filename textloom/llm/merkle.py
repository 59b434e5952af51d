"""A Merkle tree over the rows of a dataset, one subtree a language, with a proof for every row.

Leaves are ranked within their language by id. The binary digits of the rank are columns; grouping by all but the lowest
digit joins two nodes to their parent, a struct that holds them, and so on, digit by digit. That goes on within a block of
``2 ** LEVELS`` nodes, which becomes one nested row. The roots of blocks are the leaves of the next tier, up to one root a
language; the roots of languages make a tree of the same kind. Then each nested row is transformed from its top down to an
array of its nodes with their paths, and exploded. A block gets the path above it from the tier above by grouping with it.

Scale: only digests are shuffled, text stays where it is read. A block is bounded, so no row, key or task grows with a
language. Ranks come from ranges that are sorted and written once, with the number of rows of each language before them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.plans.materialize import materialize, row_count_within

#: Levels of the tree in one block.
LEVELS = 8
#: Broadcast the counts of ranges up to so many rows.
FEW_ROWS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the value's length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column, change: dict[str, Column]) -> DataFrame:
    """``(part, doc_id, leaf, other)``: the digest of each row, and of the row with ``change`` where it is tampered."""
    leaf = lambda new: digest(*(encoded(new.get(c, F.col(c))) for c in FIELDS))
    return docs.select(F.col("lang").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), leaf({}).alias("leaf"), F.when(tampered, leaf(change)).alias("other"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows(part, ...)`` with the rank ``at`` (from 0) of each within its part by ``order``, nulls first, and the
    ``depth`` of the part's tree. Rows that ``order`` doesn't tell apart stand in any order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in ("part", *order, "__tie")]
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__tie")
    dealt = materialize(dealt.withColumn("__place", F.monotonically_increasing_id()), "merkle-sorted")
    of = F.shiftright("__place", 33)
    sizes = dealt.groupBy("part", of.alias("__range")).agg(F.count("*").alias("n"), F.min("__place").alias("first"))
    mine = Window.partitionBy("part")  # a row for each range that the part lies in
    before = F.sum("n").over(mine.orderBy("__range")) - F.col("n")
    total = F.sum("n").over(mine)
    depth = F.when(total == 1, 0).otherwise(F.length(F.bin(total - 1)))
    sizes = sizes.select(F.col("part").alias("__part"), "__range", (before - F.col("first")).alias("__shift"), depth.cast("int").alias("depth"))
    sizes = materialize(sizes, "merkle-sizes")
    sizes = F.broadcast(sizes) if row_count_within(sizes, FEW_ROWS) else sizes
    met = dealt.withColumn("__r", of).join(sizes, F.col("part").eqNullSafe(F.col("__part")) & (F.col("__r") == F.col("__range")))
    return met.withColumn("at", F.col("__place") + F.col("__shift")).drop("__part", "__range", "__r", "__shift", "__place")


def _block(nodes: DataFrame) -> DataFrame:
    """``(part, at, depth, h, item)`` to one nested row a block: ``(part, block, depth, h, below)``."""
    digits = [F.shiftright("at", k).bitwiseAND(1).cast("int").alias(f"d{k}") for k in range(LEVELS)]
    rows = nodes.select("part", F.shiftright("at", LEVELS).alias("block"), "depth", *digits, "h", F.col("item").alias("below")).repartition("part", "block")
    for k in range(LEVELS):
        keys = ["part", "block", "depth", *(f"d{j}" for j in range(LEVELS - 1, k, -1))]
        kids = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), "h", "below"))).alias("kids"))
        # Beyond the depth of its part a node is alone and is the root already.
        parent = F.when(F.col("depth") > k, F.sha2(F.concat_ws("", "kids.h").cast("binary"), 256)).otherwise(F.col("kids")[0]["h"])
        rows = kids.select(*keys, parent.alias("h"), F.col("kids").alias("below"))
    return rows


def rolled(nodes: DataFrame) -> list[DataFrame]:
    """The tiers of nested blocks over ``nodes(part, at, depth, h, item)``; the last has one block a part."""
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    tiers = []
    while True:
        tiers.append(materialize(_block(nodes), "merkle-blocks"))
        if deepest <= LEVELS * len(tiers):
            return tiers
        nodes = tiers[-1].select("part", F.col("block").alias("at"), F.greatest(F.col("depth") - LEVELS, F.lit(0)).alias("depth"), "h", F.struct("block").alias("item"))


def _kids(depth: Column, level: int) -> Callable[[Column], Column]:
    """A node with its path to its children with theirs."""

    def kids(x: Column) -> Column:
        def kid(y: Column, i: Column) -> Column:
            left = F.when(i == 1, x["below"][0]["h"]).otherwise(F.lit(""))
            right = F.when(i == 0, F.coalesce(F.get(x["below"], F.lit(1))["h"], F.lit(""))).otherwise(F.lit(""))
            more = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), x["path"])
            return F.struct(y["h"].alias("h"), y["below"].alias("below"), F.when(depth > level, more).otherwise(x["path"]).alias("path"))

        return F.transform(x["below"], kid)

    return kids


def _steps(depth: Column, below: Column, path: Column) -> Column:
    """The nodes at the bottom of a nested block, each with its path: from its own siblings up to those of the root."""
    found = F.array(F.struct(F.lit("").alias("h"), below.alias("below"), path.alias("path")))
    for level in range(LEVELS - 1, -1, -1):
        found = F.flatten(F.transform(found, _kids(depth, level)))
    return found


def unrolled(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``tops(part, path, told)`` (the path above each part's root, and a struct to hand down) to the leaves' rows:
    ``(part, h, item, path, told)``."""
    above = tops.select("part", F.lit(0).cast("long").alias("block"), "path", "told")
    for tier in reversed(tiers):
        both = tier.select("part", "block", "depth", "below").unionByName(above, allowMissingColumns=True)
        met = both.groupBy("part", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("depth", "below", "path", "told")))
        nodes = met.select("part", "told", F.explode(_steps(F.col("depth"), F.col("below"), F.col("path"))).alias("x"))
        nodes = nodes.select("part", F.col("x.h").alias("h"), F.col("x.below").alias("item"), F.col("x.path").alias("path"), "told")
        if tier is not tiers[0]:
            above = nodes.select("part", F.col("item.block").alias("block"), "path", "told")
    return nodes


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, change: dict[str, Column] | None = None) -> DataFrame:
    """``docs(doc_id, source, lang, n_chars, text, ...)`` to one row for each: ``(doc_id, leaf, subroot, root, path,
    proof_sha256, folded_root, verified)``.

    A leaf is the digest of the row's five columns, null as such. Per language, leaves stand by doc_id, null first, and
    rows of one id by their digests, so repeated rows are leaves of their own. The root is over the languages' subroots,
    null first and bytewise. ``path`` has for each level what is left and right of the row's node. ``folded_root`` is
    computed from the leaf of the row with ``change`` where ``tampered`` is true, and ``verified`` says whether it is the
    root. An empty table has no rows and no root; other columns are ignored.
    """
    rows = placed(leaves(docs, F.lit(False) if tampered is None else tampered, change or {}), ["doc_id", "leaf"])
    tiers = rolled(rows.select("part", "at", "depth", F.col("leaf").alias("h"), F.struct("doc_id", "other").alias("item")))
    subroots = tiers[-1].select(F.lit(0).alias("part"), F.col("part").alias("lang"), "h")
    langs = placed(subroots, ["lang"])
    upper = rolled(langs.select("part", "at", "depth", "h", F.struct("lang").alias("item")))
    start = upper[-1].select("part", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.struct(F.col("h").alias("root")).alias("told"))
    tops = unrolled(upper, start).select(F.col("item.lang").alias("part"), "path", F.struct(F.col("h").alias("subroot"), F.col("told.root").alias("root")).alias("told"))
    found = unrolled(tiers, tops).select(F.col("item.doc_id").alias("doc_id"), F.col("h").alias("leaf"), "told.subroot", "told.root", "path", F.coalesce("item.other", "h").alias("claimed"))
    proof = F.concat_ws("", F.transform("path", lambda p: F.concat(p["left"], p["right"])))
    folded = found.withColumns({"proof_sha256": F.sha2(proof.cast("binary"), 256), "folded_root": fold(F.col("claimed"), F.col("path"))})
    return folded.drop("claimed").withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = manifest(docs, F.coalesce(tampered, F.lit(False)), {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}


def _coded(c: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


_LEAF = " || ".join(_coded(c) for c in FIELDS)
_CRC = "list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda h, k: CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END), 4294967295)"
ORACLES = {
    "op12_merkle_manifest": f"""
    WITH RECURSIVE rows_ AS (SELECT doc_id, lang, sha256({_LEAF}) AS leaf,
              CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN sha256({_LEAF.replace(_coded("n_chars"), _coded("(n_chars + 1)"))}) END AS other FROM documents),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM rows_),
    nodes(lang, lvl, pos, n, h) AS (
        SELECT lang, 0, pos, n, leaf FROM ranked
        UNION ALL
        SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
    subs AS (SELECT lang, lvl AS deep, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
    tops(lvl, pos, n, h) AS (
        SELECT 0, place, n, subroot FROM subs
        UNION ALL
        SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 2, n),
    sides AS (
        SELECT r.lang, r.pos AS row_pos, v.lvl, (r.pos >> v.lvl) % 2 AS odd, s.h
        FROM ranked r JOIN (SELECT DISTINCT lang, lvl FROM nodes WHERE n > 1) v ON r.lang IS NOT DISTINCT FROM v.lang
        LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM r.lang AND s.lvl = v.lvl AND s.pos = xor(r.pos >> v.lvl, 1)
        UNION ALL
        SELECT r.lang, r.pos, b.deep + v.lvl, (b.place >> v.lvl) % 2, s.h
        FROM ranked r JOIN subs b ON r.lang IS NOT DISTINCT FROM b.lang CROSS JOIN (SELECT DISTINCT lvl FROM tops WHERE n > 1) v
        LEFT JOIN tops s ON s.lvl = v.lvl AND s.pos = xor(b.place >> v.lvl, 1)),
    folds(lang, row_pos, lvl, h) AS (
        SELECT lang, pos, 0, coalesce(other, leaf) FROM ranked
        UNION ALL
        SELECT f.lang, f.row_pos, f.lvl + 1, sha256(CASE WHEN s.odd = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END)
        FROM folds f JOIN sides s ON f.lang IS NOT DISTINCT FROM s.lang AND f.row_pos = s.row_pos AND f.lvl = s.lvl),
    proofs AS (SELECT lang, row_pos, string_agg(h, '' ORDER BY lvl) AS proof FROM sides GROUP BY lang, row_pos),
    folded AS (SELECT lang, row_pos, max_by(h, lvl) AS folded_root FROM folds GROUP BY lang, row_pos),
    top AS (SELECT h AS root FROM tops WHERE n = 1)
    SELECT r.doc_id, r.leaf, b.subroot, t.root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.folded_root, f.folded_root = t.root AS verified
    FROM ranked r JOIN subs b ON r.lang IS NOT DISTINCT FROM b.lang CROSS JOIN top t
    LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM r.lang AND p.row_pos = r.pos
    JOIN folded f ON f.lang IS NOT DISTINCT FROM r.lang AND f.row_pos = r.pos
    """
}
