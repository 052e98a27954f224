"""Hard negatives by inner product, with bounds from segment summaries.

A vector x is cut into segments of l components. With the mean m and the deviation d of each segment,

    q.x = sum l m_q m_x + sum (q - m_q).(x - m_x),   where the second sum is at most  sum l d_q d_x  in size,

so a few numbers a vector bound its score from both sides. The summaries are stored at two levels, few long
segments and more short ones. A tile of rows meets a block of anchors in one task: the coarse bounds
of all of them are one matrix product, the fine ones are taken of the rows that the coarse ones leave, and
only what those leave is scored exactly. What a row must reach is the best known of the scores so far and of the
lower bounds of the rows at hand.

Two passes: the first finds each anchor's positives, the second, knowing their scores, the negatives
of each. Anchors are a stated share of the rows, so all pairs of tiles and blocks are visited.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import sized, store

#: Segments of a vector at each level.
LEVELS = (4, 16)
#: Components of a tile's rows and of a block's anchors (about so many), rows handled at once in a task.
TILE, BLOCK, AT_ONCE = 1 << 19, 1 << 17, 4096
#: More than the rounding of a bound, as a part of the product of the vectors' lengths.
SLACK = 1e-11
NO_ID = (1 << 63) - 1
LEAST = -(1 << 63)

ROW = "vec_id bigint, label bigint, key bigint, dim int, codes array<double>, coarse array<double>, fine array<double>"


def lists(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def summary(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row sqrt(l) * mean of all segments, then sqrt(l) * deviation of all segments; l is a segment's length."""
    dim = x.shape[1]
    cuts = np.linspace(0, dim, min(segments, dim) + 1).astype(int)[:-1]
    size = np.diff(np.append(cuts, dim)).astype(np.float64)
    mean = np.add.reduceat(x, cuts, axis=1) / size
    rest = x - np.repeat(mean, size.astype(int), axis=1)
    return np.concatenate([mean * np.sqrt(size), np.sqrt(np.add.reduceat(rest * rest, cuts, axis=1))], axis=1)


def _summaries(batches):
    for batch in batches:
        dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            x = lists(part.column(part.schema.get_field_index("codes")))
            own = [as_lists(summary(x, n)) for n in LEVELS]
            yield pa.RecordBatch.from_arrays([*part.columns, *own], names=[*part.schema.names, "coarse", "fine"])


def as_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


def product(x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """Whole-number inner products of the rows of x with y; most: no partial sum is larger. Those beyond a long end at its limits."""
    if most < 1 << 53:
        return (x @ y).astype(np.int64)
    whole = [int(v) for v in y]
    return np.array([max(LEAST + 1, min(NO_ID, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in x], np.int64)


class Side:
    """Rows or anchors of a task as matrices."""

    def __init__(self, table: pa.Table) -> None:
        self.ids = table.column("vec_id").fill_null(NO_ID).to_numpy()
        self.labels = table.column("label").to_numpy()
        self.codes, self.coarse, self.fine = (lists(table.column(c)) for c in ("codes", "coarse", "fine"))
        self.largest = np.abs(self.codes).max(axis=1, initial=0)
        self.length = np.sqrt((self.codes * self.codes).sum(axis=1))


class Best:
    """The k best (score, id) of one search: higher scores first, then smaller ids; within limits of the score."""

    def __init__(self, k: int, low: int = LEAST, high: int = NO_ID) -> None:
        self.k, self.low, self.high = k, low, high
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def floor(self) -> int:
        return max(self.low, int(self.scores[-1])) if len(self.scores) == self.k else self.low

    def raised(self, lower: np.ndarray, upper: np.ndarray) -> float:
        """What a score must reach, given bounds of the rows at hand: k of them that lie within the limits reach it."""
        sure = lower[(lower >= self.low) & (upper <= self.high)]
        return max(self.floor, np.partition(sure, -self.k)[-self.k]) if len(sure) >= self.k else self.floor

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        fits = (scores >= self.floor) & (scores <= self.high)
        ids, scores = np.concatenate([self.ids, ids[fits]]), np.concatenate([self.scores, scores[fits]])
        first = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[first], scores[first]


def search(anchors: Side, rows: Side, wanted: list[list[Best]], same: bool) -> None:
    """Give each search of each anchor the rows that belong to it; rows of the anchor's label if `same`, else of the others."""
    half, fine_half = anchors.coarse.shape[1] // 2, anchors.fine.shape[1] // 2
    for at in range(0, len(rows.ids), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        ids, labels, coarse, fine, codes = rows.ids[part], rows.labels[part], rows.coarse[part], rows.fine[part], rows.codes[part]
        longest, largest = rows.length[part].max(), rows.largest[part].max()
        for block in range(0, len(anchors.ids), 512):
            own = slice(block, block + 512)
            means = anchors.coarse[own, :half] @ coarse[:, :half].T
            spread = anchors.coarse[own, half:] @ coarse[:, half:].T
            for i, (mean, more) in enumerate(zip(means, spread, strict=True), block):
                if not wanted[i]:
                    continue
                slack = SLACK * anchors.length[i] * longest
                here = np.flatnonzero(((labels == anchors.labels[i]) == same) & (ids != anchors.ids[i]))
                here = _left(here, mean[here], more[here] + slack, wanted[i])
                if len(here):
                    f = fine[here]
                    mean, more = f[:, :fine_half] @ anchors.fine[i, :fine_half], f[:, fine_half:] @ anchors.fine[i, fine_half:]
                    here = _left(here, mean, more + slack, wanted[i])
                if len(here):
                    scores = product(codes[here], anchors.codes[i], float(anchors.largest[i]) * float(largest) * codes.shape[1])
                    for best in wanted[i]:
                        best.add(ids[here], scores)


def _left(here: np.ndarray, mean: np.ndarray, more: np.ndarray, wanted: list[Best]) -> np.ndarray:
    lower, upper = np.clip(mean - more, LEAST, NO_ID), np.clip(mean + more, LEAST, NO_ID)
    keep = np.zeros(len(here), bool)
    for best in wanted:
        keep |= (upper >= best.raised(lower, upper)) & (lower <= best.high)
    return here[keep]


def _task(table: pa.Table, wanted: Callable[[pa.Table], list[list[Best]]], same: bool) -> pa.Table:
    """One block of anchors against one tile of rows: the best rows of each search, as anchor_id, key, nth, id, score."""
    of_anchors = table.filter(table.column("anchor"))
    rows = table.filter(pc.invert(table.column("anchor")))
    found: list[tuple] = []
    if of_anchors.num_rows and rows.num_rows:
        searches = wanted(of_anchors)
        search(Side(of_anchors), Side(rows), searches, same)
        keys, ids = of_anchors.column("key").to_pylist(), of_anchors.column("vec_id").to_pylist()
        found = [(ids[i], keys[i], nth, int(j), int(s)) for i, own in enumerate(searches) for nth, best in enumerate(own) for j, s in zip(best.ids, best.scores, strict=True)]
    return pa.table({name: pa.array([x[n] for x in found], kind) for n, (name, kind) in enumerate((("anchor_id", pa.int64()), ("key", pa.int64()), ("nth", pa.int32()), ("id", pa.int64()), ("score", pa.int64())))})


def shares(score: np.ndarray, part: int) -> np.ndarray:
    """part * score / 100 rounded down, in longs that don't overflow."""
    return score // 100 * part + score % 100 * part // 100


def codes_of(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as doubles that hold whole numbers."""
    return F.transform(embedding, lambda x: _floor(x.cast("double") * float(scale)))


def _floor(x: Column) -> Column:
    # doubles of 2^53 and more are whole numbers, and floor would make longs of them
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hardest negatives of each anchor and positive.

    `vectors`: vec_id, embedding, label; `anchors`: a condition on its columns. Components become
    floor(scale * x), scores are inner products of these. An anchor's positives are its `positives` best other rows of
    its label. The negatives of a positive are the `negatives` best rows of other labels whose score is at least
    `least` and at most `most` percent of the positive's. Better: higher score, then smaller vec_id.

    Rows with a null label or vector, an empty vector, or a null or non-finite component take no part. Vectors of
    different lengths have no score. Rows that repeat id, label and vector count once; a row with the anchor's own id is no
    partner of it. Rows without an id come last among equal scores. Scores beyond a long end at its limits. Fewer rows
    than asked for give fewer; an empty table gives none. Other columns don't matter.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad)
    v = vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), codes_of(F.col("embedding"), scale).alias("codes"), F.coalesce(anchors, F.lit(False)).alias("asks")).distinct()
    key = F.xxhash64("vec_id", "label", "codes").alias("key")
    v = v.select("vec_id", "label", key, F.size("codes").alias("dim"), "codes", "asks").mapInArrow(_summaries, ROW.replace("codes array<double>,", "codes array<double>, asks boolean,"))
    v = store(v, "vectors")
    count = F.count(F.lit(1))
    dims = store(v.groupBy("dim").agg(F.ceil(count * F.col("dim") / TILE).cast("int").alias("tiles"), F.ceil(F.count_if("asks") * F.col("dim") / BLOCK).cast("int").alias("blocks")).filter("blocks > 0"), "dims")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["dim", "block", "tile", "anchor", "vec_id", "label", "key", "codes", "coarse", "fine"]
    rows = v.join(sized(dims), "dim").withColumn("tile", F.pmod("key", "tiles").cast("int")).withColumn("block", every("blocks")).withColumn("anchor", F.lit(False)).select(*columns)
    askers = v.filter("asks").join(sized(dims), "dim").withColumn("block", F.pmod("key", "blocks").cast("int")).withColumn("tile", every("tiles")).withColumn("anchor", F.lit(True))
    found = "anchor_id bigint, key bigint, nth int, id bigint, score bigint"

    def first(df: DataFrame, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("anchor_id", "key", "nth").orderBy(F.desc("score"), "id"))
        return df.withColumn("rank", place).filter(F.col("rank") <= k)

    def any_positive(table: pa.Table) -> list[list[Best]]:
        return [[Best(positives)] for _ in range(table.num_rows)]

    def below(table: pa.Table) -> list[list[Best]]:
        scores = [np.array(s, np.int64) for s in table.column("scores").to_pylist()]
        return [[Best(negatives, int(-shares(-x, least)), int(shares(x, most))) for x in s] for s in scores]

    near = rows.unionByName(askers.select(*columns)).groupBy("dim", "block", "tile").applyInArrow(lambda t: _task(t, any_positive, True), found)
    near = store(first(near, positives), "positives")
    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])
    known = near.groupBy(F.col("anchor_id").alias("vec_id"), "key").agg(scores.alias("scores"))
    asking = askers.join(known, ["vec_id", "key"]).select(*columns, "scores")
    none = F.lit(None).cast("array<bigint>").alias("scores")
    far = rows.select(*columns, none).unionByName(asking).groupBy("dim", "block", "tile").applyInArrow(lambda t: _task(t, below, False), found)
    far = first(far, negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    near = near.select("anchor_id", "key", (F.col("rank") - 1).alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    known_id = lambda c: F.nullif(c, F.lit(NO_ID)).alias(c)
    return far.join(near, ["anchor_id", "key", "nth"]).select("anchor_id", known_id("positive_id"), F.col("rank").cast("int").alias("rank"), known_id("negative_id"), "positive_score", "negative_score")


def contract(vectors: DataFrame) -> DataFrame:
    """The registered query: ids divisible by 50 ask; where the id is divisible by 7 the label is the next of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.c, b.c)::BIGINT AS score
  FROM v a JOIN v b ON len(a.c) = len(b.c) AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 3
"""
