"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors of a label are one class. Classes of a label are dealt to tiles of a bounded number
of rows, and each pair of tiles is one task. There, unit vectors x = s q + e with int8 codes q are
multiplied as whole tiles; since |x.y - s_x s_y q_x.q_y| <= (1 + |e_x|) |e_y| + |e_x|, only pairs whose upper
bound reaches the threshold are recomputed in double precision. A task reports the number of links
of each class and a spanning forest, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import store
from .components import components
from .forest import Forest

TILE, STRIP = 2048, 256
#: More than the rounding of scaled products (the products of codes themselves are exact) and double sums of unit vectors.
SLACK = 1e-6


def usable(embedding: Column) -> Column:
    """True for vectors without null or non-finite components that are not zero or empty."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(embedding.isNotNull() & ~F.exists(embedding, bad) & F.exists(embedding, lambda x: x != 0), F.lit(False))


class Tile:
    def __init__(self, table: pa.Table) -> None:
        self.ids = table.column("rep").to_numpy()
        self.copies = table.column("n").to_numpy()
        x = np.array(table.column("embedding").combine_chunks().values, np.float64).reshape(len(self.ids), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        self.x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        self.scale = np.abs(self.x).max(axis=1) / 127
        self.codes = np.rint(self.x / self.scale[:, None]).astype(np.int8)
        self.error = np.sqrt(((self.x - self.codes * self.scale[:, None]) ** 2).sum(axis=1))


def linked(a: Tile, b: Tile, threshold: float):
    """Pairs of places (in a, in b) with cosine >= threshold, strip by strip; a is b: each pair once."""
    # products of codes are whole numbers up to 127 * 127 * dimension: exact in float32 up to 2^24, beyond that in float64
    exact = np.float32 if 127 * 127 * b.codes.shape[1] <= 1 << 24 else np.float64
    codes = b.codes.astype(exact).T
    for at in range(0, len(a.ids), STRIP):
        s = slice(at, at + STRIP)
        product = (a.codes[s].astype(exact) @ codes) * (a.scale[s, None] * b.scale[None, :])
        bound = product + ((1 + a.error[s, None]) * b.error[None, :] + a.error[s, None] + SLACK)
        i, j = np.nonzero(bound >= threshold)
        i += at
        if a is b:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            near = np.einsum("ij,ij->i", a.x[p], b.x[q]) >= threshold
            yield p[near], q[near]


def tile_links(table: pa.Table, threshold: float) -> pa.Table:
    """One pair of tiles: for each class with links here rep, links (copies counted), root (its forest root's rep)."""
    left = table.filter(table.column("left"))
    right = table.filter(pc.invert(table.column("left")))
    a = Tile(left) if left.num_rows else None
    own = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    b = a if own else Tile(right) if right.num_rows else None
    if a is None or b is None:
        return pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    shift = 0 if own else len(a.ids)
    ids = a.ids if own else np.concatenate([a.ids, b.ids])
    links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
    for p, q in linked(a, b, threshold):
        np.add.at(links, p, b.copies[q])
        np.add.at(links, q + shift, a.copies[p])
        forest.link(p, q + shift)
    some = np.flatnonzero(links)
    return pa.table({"rep": ids[some], "links": links[some], "root": ids[forest.root[some]]})


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding, label).

    Vectors link when their labels are equal and not null and their cosine, in double precision, is
    at least `threshold`; vectors of different length never do, and null, zero or non-finite ones
    link with nothing and are their own component. n_links counts other rows linked directly;
    component_id is the smallest vec_id reachable; kept is vec_id = component_id. Rows that repeat a
    vec_id count as rows of their own; rows without one link with nothing and aren't kept. An empty table
    gives no rows.
    """
    v = vectors.select("vec_id", "label", "embedding", (usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).alias("ok"))
    key = F.xxhash64("label", "embedding")
    classes = v.filter("ok").withColumn("key", key).groupBy("key", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = store(classes.withColumn("dim", F.size("embedding")), "classes")
    sizes = store(classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")), "tiles")
    t = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("t", t).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("label", "dim", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), (F.col("t") <= F.col("o")).alias("left"), "rep", "n", "embedding")
    found = store(dealt.groupBy("label", "dim", "i", "j").applyInArrow(lambda table: tile_links(table, threshold), "rep bigint, links bigint, root bigint"), "found")
    counts = store(found.groupBy("rep").agg(F.sum("links").alias("links")), "counts")
    label = store(components(found.select(F.col("root").alias("u"), F.col("rep").alias("v"))), "labels")
    per_class = classes.join(counts, "rep", "left").join(label, classes["rep"] == label["node"], "left")
    per_class = store(per_class.select("key", "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "per_class")
    mine = store(v.withColumn("key", F.when(F.col("ok"), key)), "vectors")
    return mine.join(per_class, ["key", "label", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept")
    )


ORACLE = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.v FROM reach r JOIN link l ON r.other = l.u
), comp AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
cnt AS (SELECT u, count(*) AS n FROM link GROUP BY u)
SELECT e.vec_id, coalesce(cnt.n, 0)::BIGINT AS n_links, comp.component_id, e.vec_id = comp.component_id AS kept
FROM embeddings e JOIN comp ON comp.vec_id = e.vec_id LEFT JOIN cnt ON cnt.u = e.vec_id
"""
