"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text, A-Z lower-cased, is cut into blocks of a fixed number of characters. Each distinct block
gets an integer name: its 48-bit hash bucket times 2^15 plus its rank among the distinct blocks of
the bucket in sorted order. Equal blocks have equal names and different blocks different ones,
whatever the hash does. Then adjacent pairs of names are named in the same way, level by level,
until each document has one name; with the number of blocks that is its collision-free identity.

Ranks differ from 0 only in buckets with more than one block, which are found by grouping the
distinct blocks (pre-aggregated before the shuffle, so copies cost nothing) and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import having_ids, store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 2048
RANKS = 15


def normalised(text: Column) -> Column:
    """Null as empty; only A-Z lower-cased."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike("^[\\x00-\\x7F]*$"), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def bucket_of(*block: Column) -> Column:
    return F.xxhash64(*block).bitwiseAND(F.lit((1 << 48) - 1))


def crowded(blocks: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """(keys, bucket, rank) of the distinct blocks in buckets with more than one; nearly always none.

    `bits` narrows the buckets, to test with collisions.
    """
    mask = F.lit((1 << bits) - 1)
    distinct = blocks.select(*keys, bucket_of(*keys).bitwiseAND(mask).alias("bucket")).distinct()
    n = distinct.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*keys)) - 1
    return distinct.join(n, "bucket").withColumn("rank", F.when(rank < 1 << RANKS, rank).otherwise(F.raise_error(F.lit("a bucket holds too many blocks"))).cast("long"))


def named(docs: DataFrame, items: str, keys: list[str], bits: int) -> DataFrame:
    """Replace the array `items` of structs `keys` by the array `names` of their names.

    Where buckets are crowded, rows are numbered in a stored table; only the places of items with a rank go back to them.
    """
    mask = F.lit((1 << bits) - 1)
    bucket = lambda x: bucket_of(*(x[k] for k in keys)).bitwiseAND(mask)
    odd = store(crowded(docs.select(F.explode(items).alias("x")).select(*(F.col("x")[k].alias(k) for k in keys)), keys, bits), "crowded").filter("rank > 0")
    if odd.isEmpty():
        return docs.withColumn("names", F.transform(items, lambda x: F.shiftleft(bucket(x), RANKS))).drop(items)
    docs = store(docs.withColumn("row", F.monotonically_increasing_id()), "rows")  # row numbers must stay as they are
    places = docs.select("row", F.posexplode(items).alias("pos", "x")).select("row", "pos", bucket(F.col("x")).alias("bucket"), *(F.col("x")[k].alias(k) for k in keys))
    places = having_ids(places, odd.select("bucket").distinct(), "bucket").drop("bucket")
    same = [places[k].eqNullSafe(odd[k]) for k in keys]  # the last of an odd number of names has no right one
    ranks = places.join(odd, same).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
    rank = lambda i: F.coalesce(F.try_element_at("ranks", i), F.lit(0).cast("long"))
    return docs.join(ranks, "row", "left").withColumn("names", F.transform(items, lambda x, i: F.shiftleft(bucket(x), RANKS) + rank(i))).drop(items, "row", "ranks")


def identities(docs: DataFrame, block: int = BLOCK, bits: int = 48) -> DataFrame:
    """doc_id, text_sha256, n_blocks, name: rows have equal (n_blocks, name) exactly when their normalised texts are equal."""
    text = normalised(F.col("text"))
    cut = lambda t: F.transform(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), lambda b: F.struct(b.alias("block")))
    source = docs.select("doc_id", text.alias("t"))
    level = named(source.select("doc_id", F.sha2("t", 256).alias("text_sha256"), cut(F.col("t")).alias("blocks")), "blocks", ["block"], bits)
    level = store(level.withColumn("n_blocks", F.size("names")), "names")
    longest = level.agg(F.max("n_blocks")).first()[0] or 0
    while longest > 1:
        pair = lambda a, i: F.struct(a[2 * i].alias("l"), F.try_element_at(a, 2 * i + 2).alias("r"))
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.size("names") / 2).cast("int")) - 1), lambda i: pair(F.col("names"), i))
        paired = F.when(F.size("names") > 0, pairs).otherwise(F.array().cast("array<struct<l:bigint,r:bigint>>"))
        level = store(named(level.withColumn("pairs", paired).drop("names"), "pairs", ["l", "r"], bits), "names")
        longest = (longest + 1) // 2
    return level.select("doc_id", "text_sha256", "n_blocks", F.coalesce(F.try_element_at("names", F.lit(1)), F.lit(-1)).alias("name"))


def deduplicate(docs: DataFrame, block: int = BLOCK, bits: int = 48) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (A-Z lower-cased, null as empty) the row with the largest doc_id stays. Rows that
    repeat a doc_id each get a row and count in group_size; a row with a null doc_id is never the one
    that stays unless the whole group has none, in which case keep_id is null and kept is false.
    An empty table gives no rows.
    """
    rows = store(identities(docs, block, bits), "identities")
    groups = store(rows.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return rows.join(groups, ["n_blocks", "name"]).select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


ORACLE = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT t.doc_id, g.keep_id, g.group_size, coalesce(t.doc_id = g.keep_id, false) AS kept, sha256(t.t) AS text_sha256 FROM t JOIN g ON t.t = g.t
"""
