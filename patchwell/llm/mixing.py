"""Mixing sources to target weights by systematic sampling, in DataFrame operations.

Within a source every document is expected target / size copies. Documents stand in order of size,
largest first (then by md5 of the id, then id); the prefix sum of the expected copies plus one
random offset a source is cut at whole numbers, and a document is taken once for each whole number
that its own share crosses. Because the order is by size, the words taken from a source differ from
its target by no more than its largest document has.

The prefix sum is a rank times a constant, and the rank is built in four levels (size groups in a
source, 16 slices of the md5 in a size group, 256 in each of those, rows in a slice), so no task
holds all rows of a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import store

#: Words are runs of anything but these six characters.
WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Copies of a document at most; also the cap of a source's target as a multiple of its size.
MOST = 3
SEED = "mix-1"


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Each source's target: shares of the total by weight, none above `most` times its size.

    `sizes`: source, source_size. What a capped source can't take goes to the others by weight until
    none is above its cap; that is target = min(cap, level * weight) with one level for all, found by
    running sums over the sources in order of cap / weight. The table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth + 1).cast("int"))
    ranked = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The first source, in this order, whose cap is not below the level sets the level of all.
    out = ranked.withColumn("level", level).withColumn("fits", F.col("cap") >= F.col("level") * F.col("weight"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "source", "level"))).over(every)["level"]
    return out.withColumn("level", level).select(
        "source", "source_size", "weight", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target")
    )


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def offset(source: Column, seed: str) -> Column:
    """A fixed number in [0, 1) for each source."""
    h = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit(":"), source), F.lit("null")))), 1, 8)
    return F.conv(h, 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    Sizes are words (null text: 0). Null is a source of its own, the last. Sources of size 0 have
    target 0 and take nothing. Equal rows count one by one. An empty table gives no rows. The same
    table and seed give the same result at any partitioning.
    """
    base = store(
        docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("md5")),
        "sizes",
    )
    slices = store(base.groupBy("source", "size", F.substring("md5", 1, 3).alias("slice")).agg(F.count(F.lit(1)).alias("n")), "slices")
    tops = store(slices.groupBy("source", "size", F.substring("slice", 1, 1).alias("top")).agg(F.sum("n").alias("n")), "tops")
    groups = store(tops.groupBy("source", "size").agg(F.sum("n").alias("n")), "groups")
    per_source = groups.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = store(targets(per_source, weights, most), "targets")
    before = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("n").over(before(F.desc("size")).partitionBy("source")), F.lit(0))
    null_safe = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    groups = groups.withColumn("ahead", ahead).drop("n")
    groups = groups.join(goal, null_safe(groups, goal, "source")).drop(goal["source"])
    above = F.coalesce(F.sum("n").over(before("top").partitionBy("source", "size")), F.lit(0))
    tops = tops.withColumn("above", above).drop("n")
    tops = store(tops.join(groups, null_safe(tops, groups, "source", "size")).drop(groups["source"], groups["size"]), "tops")
    own = F.coalesce(F.sum("n").over(before("slice").partitionBy("source", "size", "top")), F.lit(0))
    slices = slices.withColumn("top", F.substring("slice", 1, 1)).withColumn("own", own).drop("n")
    placed = slices.join(tops, null_safe(slices, tops, "source", "size", "top")).drop(tops["source"], tops["size"], tops["top"])
    placed = store(placed.withColumn("own", F.col("own") + F.col("above")).drop("above", "top"), "placed")
    rows = base.withColumn("slice", F.substring("md5", 1, 3))
    rows = rows.join(placed, null_safe(rows, placed, "source", "size", "slice")).drop(placed["source"], placed["size"], placed["slice"])
    nth = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("md5", "doc_id"))
    rank = F.col("ahead") + F.col("own") + nth
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("rank", rank).withColumn("share", share).withColumn("offset", offset(F.col("source"), seed))
    copies = F.floor(F.col("rank") * F.col("share") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("share") + F.col("offset"))
    return rows.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


QUERY_COLUMNS = ("doc_id", "size", "source_size", "target", "taken")

ORACLE = f"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS m FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM base GROUP BY source
), w AS (
  SELECT source, source_size, CASE nth % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS cap FROM src
), lv AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), pick AS (
  SELECT level FROM lv WHERE cap >= level * weight ORDER BY cap / weight, source LIMIT 1
), goal AS (
  SELECT source, source_size, CASE WHEN (SELECT level FROM pick) IS NULL THEN cap ELSE least(cap, (SELECT level FROM pick) * weight) END AS target FROM w
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, m, doc_id) AS rnk,
         ('0x' || substr(md5('{SEED}' || coalesce(':' || source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM base
), cut AS (
  SELECT r.doc_id, r.size, g.source_size, g.target, r.rnk, r.u, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS share
  FROM ranked r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, ((floor(rnk * share + u) - floor((rnk - 1) * share + u)) * size)::BIGINT AS taken FROM cut
"""
