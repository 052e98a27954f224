"""Word-level removal of long repeats: Rabin-Karp hashes of windows of words, counted in Spark.

Workers hash the words of a chunk of documents and roll a Rabin-Karp hash over every window of
`length` words. Windows that share their smallest 8-gram stand in runs (see `repeats`), and Spark
counts rows (bucket, name of the run, chunk, document): a run that a smaller document has is repeated
whole; where a bucket has one run only there is nothing else to find; else its windows are counted
one by one, by 128 bits of their hashes. Repeated windows merge into maximal intervals that are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import store
from .repeats import Chunk, Plan, Runs, among, id_column, id_shift, pack

U = np.uint64
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
#: Bytes that the words whose hashes a worker remembers may take; what one takes besides its letters.
REMEMBER, BESIDE = 64 << 20, 200
ROWS = "bucket bigint, name bigint, chunk bigint, doc bigint"
#: What a chunk is told of a run or window: an earlier document has it, or its windows are counted one by one.
MARK, REFINE, MARK_WINDOW = range(3)


class Names(dict):
    """Word to its 64-bit hash."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        if self.held >= REMEMBER:
            self.clear()
            self.held = 0
        self[word] = h = xxhash.xxh64_intdigest(word)
        self.held += BESIDE + len(word)
        return h


NAMES = Names()


def word_tokens(body: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """bytes.split() splits at exactly 0x20 and 0x09-0x0D."""
    counts, hashes, a = [], [], 0
    for b in ends.tolist():
        words = body[a:b].split()
        hashes.append(np.fromiter(map(NAMES.__getitem__, words), np.uint64, len(words)))
        counts.append(len(words))
        a = b
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.cumsum(counts, dtype=np.int64)


def rows_of(chunk: int, entries: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    bucket, name, doc = entries
    return pa.table({"bucket": bucket.view(np.int64), "name": name.view(np.int64), "chunk": np.full(len(bucket), chunk, np.int64), "doc": doc})


def counted(entries: DataFrame, of_windows: bool) -> DataFrame:
    """(chunk, kind, bucket, name) of entries that a smaller document has, and of first holders in buckets with other runs.

    Counts are pre-aggregated, so a run in every chunk, or a bucket of very many runs, is no large group.
    """
    named = store(entries.groupBy("bucket", "name").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")), "named")
    if of_windows:
        return entries.join(named.filter("n > 1"), ["bucket", "name"]).filter("doc > first").select("chunk", F.lit(MARK_WINDOW).alias("kind"), "bucket", "name")
    crowded = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("runs")).filter("runs > 1").select("bucket")
    known = named.join(crowded.withColumn("crowded", F.lit(True)), "bucket", "left").filter("n > 1 OR crowded")
    kind = F.when(F.col("doc") > F.col("first"), MARK).when(F.col("crowded"), REFINE)
    return entries.join(known, ["bucket", "name"]).select("chunk", kind.alias("kind"), "bucket", "name").filter("kind IS NOT NULL")


def told(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    mine = table.filter(pa.array(table.column("kind").to_numpy() == kind))
    return tuple(mine.column(c).to_numpy().astype(np.int64).view(U) for c in ("bucket", "name"))


def remove_repeated_windows(docs: DataFrame, length: int = 50, q: int = 8, with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of `length` words that also starts in a document with a smaller doc_id.

    One row per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space),
    and, with `with_text`, kept. Null texts have no words; shorter texts keep everything; rows that
    repeat a doc_id count as one document and each gets a row, rows without one as a document after all
    others; other columns are ignored; an empty table gives no rows.
    """
    plan, shift = Plan(length, min(q, length), word_tokens), id_shift(docs)
    chunks = pack(docs, shift)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1).to_pylist()[0]
                c = Chunk(plan, row)
                yield from rows_of(row["chunk"], c.entries(c.runs())).to_batches()

    def asked(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return rows_of(0, (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)))
        row = left.to_pylist()[0]
        c = Chunk(plan, row)
        runs = c.runs(keep_windows=True)
        return rows_of(row["chunk"], c.entries(refined(c, runs, c.later(runs), right)))

    def refined(c: Chunk, runs: Runs, later: np.ndarray, right: pa.Table) -> Runs:
        return c.windows(runs, among(runs, *told(right, REFINE)) & ~later)

    def finished(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(plan, left.to_pylist()[0])
        runs = c.runs(keep_windows=True)
        later = c.later(runs)
        w = refined(c, runs, later, right)
        one = w.start[c.later(w) | among(w, *told(right, MARK_WINDOW))]
        return pa.Table.from_batches([cleaned(c, c.covered(runs, later | among(runs, *told(right, MARK)), one))])

    def cleaned(c: Chunk, covered: np.ndarray) -> pa.RecordBatch:
        rows, a, s = [], 0, 0
        for doc, b, e in zip(c.doc_ids.tolist(), c.byte_ends.tolist(), c.ends.tolist(), strict=True):
            words, gone = c.body[a:b].split(), covered[s:e]
            n = int(np.count_nonzero(gone))
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if n else words)
            rows.append((doc, e - s, n, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            a, s = b, e
        cols = list(zip(*rows, strict=True))
        types = [pa.int64()] * 2 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([id_column(cols[0], shift), *(pa.array(x, t) for x, t in zip(cols[1:], types, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    runs = store(counted(store(chunks.mapInArrow(emit, ROWS), "runs"), False), "told")
    asks = runs.filter(F.col("kind") == REFINE)
    windows = store(chunks.groupBy("chunk").cogroup(asks.groupBy("chunk")).applyInArrow(asked, ROWS), "windows")
    every = runs.unionByName(store(counted(windows, True), "told"))
    out = chunks.groupBy("chunk").cogroup(every.groupBy("chunk")).applyInArrow(finished, SCHEMA)
    return out if with_text else out.drop("kept")
