"""SimHash fingerprints of word shingles, linked by a binary trie self-join.

Equal fingerprints are one node. Fingerprints within `budget` bits agree on at least two of six
blocks of bits, so Spark deals each distinct fingerprint to the 15 subtries given by two blocks
(turned to the front). In a subtrie, node pairs are traversed together from the root: differing
bits add up, and a pair of nodes is pruned as soon as it exceeds the budget; small pairs are
compared outright. A task reports a spanning forest of what it links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, portions, store
from .components import components
from .forest import Forest

U = np.uint64
BLOCKS, EQUAL = 6, 2
#: Pairs compared outright below this number; pairs of places held at once.
SMALL, MANY = 32, 1 << 20
#: Fingerprints of a subtrie that one task joins.
MOST = 20_000
#: Shares of a turn at least, so that small data use several tasks as well.
LEAST_SHARES = 8


def fingerprint(text: bytes, width: int = 4) -> int:
    """64-bit SimHash of a text: bits set in over half the XXH64 (seed 42) of its shingles, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-width] + 1].tolist()
    hashes = np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], U, len(starts))
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        votes += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((U(1) << np.flatnonzero(2 * votes > len(hashes)).astype(U)).sum(dtype=U))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a signed long) of each row; a text without words has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            prints = np.array([fingerprint(t, width) for t in as_bytes(batch.column(1))], U)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def turns() -> list[list[tuple[int, int]]]:
    """For each choice of pivot blocks, all blocks (first bit, bits) in order, the pivot ones first."""
    sizes = [64 // BLOCKS + (i < 64 % BLOCKS) for i in range(BLOCKS)]
    blocks = [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]
    return [[blocks[i] for i in (*pick, *(i for i in range(BLOCKS) if i not in pick))] for pick in combinations(range(BLOCKS), EQUAL)]


def turned(x: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out, at = np.zeros(len(x), U), 64
    for first, n in order:
        at -= n
        out |= ((x >> U(first)) & U((1 << n) - 1)) << U(at)
    return out


def self_join(keys: np.ndarray, pivot: int, budget: int, forest: Forest, place: np.ndarray) -> None:
    """Link the sorted distinct keys that agree on their first `pivot` bits and differ in at most `budget`."""

    def compared(a, b, c, d):
        """All pairs of the ranges a..b and c..d (the same range: each pair once)."""
        n = (b - a) * (d - c)
        for part in np.array_split(np.arange(len(n)), 1 + int(n.sum()) // MANY):
            k = n[part]
            nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            wide = np.repeat((d - c)[part], k)
            x, y = np.repeat(a[part], k) + nth // wide, np.repeat(c[part], k) + nth % wide
            ok = (np.bitwise_count(keys[x] ^ keys[y]) <= budget) & (x != y)
            forest.link(place[x[ok]], place[y[ok]])

    top = keys >> U(64 - pivot)
    at = np.flatnonzero(np.r_[True, top[1:] != top[:-1]][: len(keys)])
    a, b = at, np.r_[at[1:], len(keys)][: len(at)]
    a, b = a[b - a > 1], b[b - a > 1]
    c, d, off = a, b, np.zeros(len(a), np.int64)
    for depth in range(pivot, 64):
        small = (b - a) * (d - c) <= SMALL
        compared(a[small], b[small], c[small], d[small])
        a, b, c, d, off = (v[~small] for v in (a, b, c, d, off))
        if not len(a):
            return
        ones = np.r_[0, np.cumsum((keys >> U(63 - depth)) & U(1), dtype=np.int64)]
        ab, cd = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        same = a == c
        child = [(a, ab, c, cd, off), (ab, b, cd, d, off), (a, ab, cd, d, off + 1), *((v[~same] for v in (ab, b, c, cd, off + 1)),)]
        a, b, c, d, off = (np.concatenate(v) for v in zip(*(tuple(x) for x in child), strict=True))
        live = (a < b) & (c < d) & (off <= budget) & ~((a == c) & (b - a < 2))
        a, b, c, d, off = (v[live] for v in (a, b, c, d, off))
    compared(a, b, c, d)


def linked(distinct: DataFrame, budget: int, most: int = MOST) -> DataFrame:
    """(u, v): links between distinct fingerprints that span the components of the budget graph.

    Subtries are dealt to shares of about `most` fingerprints, so a share is as large at any size of the
    data; a subtrie of more is cut into slots, and each pair of slots is a task.
    """
    order = turns()
    pivot = [sum(n for _, n in o[:EQUAL]) for o in order]
    share = max(LEAST_SHARES, -(-distinct.count() // most))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(U)
            for t, o in enumerate(order):
                top = turned(x, o) >> U(64 - pivot[t])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(top.astype(np.int32)), pa.array(x.view(np.int64))], ["t", "top", "fp"])

    def join(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        t = table.column("t")[0].as_py()
        x = table.column("fp").to_numpy().view(U)
        key = turned(x, order[t])
        place = np.argsort(key)
        forest = Forest(len(x))
        self_join(key[place], pivot[t], budget, forest, place)
        up = np.flatnonzero(forest.root != np.arange(len(x)))
        fp = x.view(np.int64)
        return pa.table({"u": fp[forest.root[up]], "v": fp[up]})

    rows = distinct.select("fp").mapInArrow(deal, "t int, top int, fp bigint")
    large = store(rows.groupBy("t", "top").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("t", "top", F.ceil(F.col("n") / most).cast("int").alias("slots")), "large")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("top"), F.lit(share)))
    if large.isEmpty():
        dealt = rows.select("t", "part", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    else:
        small = rows.join(large, ["t", "top"], "left_anti").select("t", "part", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
        slot = F.pmod(F.xxhash64("fp"), F.col("slots")).cast("int")
        cut = rows.join(large, ["t", "top"]).withColumn("a", slot).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).filter("a <> b")
        dealt = small.unionByName(cut.select("t", (F.lit(share) + F.col("top")).alias("part"), F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "fp"))
    return dealt.groupBy("t", "part", "i", "j").applyInArrow(join, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, budget: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of at most `budget` differing bits.

    Null and wordless texts share fingerprint 0. Texts of fewer words than `width` are one shingle.
    Rows that repeat a doc_id each get a row; a missing doc_id is never a component_id unless its component
    has no other (then null); an empty table gives none; other columns are ignored.
    """
    prints = store(fingerprints(docs, width), "prints")
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct")
    label = store(components(linked(distinct, budget)), "labels").withColumnRenamed("node", "fp")
    rooted = store(distinct.join(label, "fp", "left").select("fp", "doc", F.coalesce("component", "fp").alias("root")), "rooted")
    least = store(rooted.groupBy("root").agg(F.min("doc").alias("component_id")), "least")
    known = store(rooted.join(least, "root").select("fp", "component_id"), "known")
    return prints.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
