"""Windows of a fixed number of tokens, in packed chunks of documents and in runs.

What the byte-level (`suffix_dedup`) and the word-level (`substring_dedup`) operators share. A
window's bucket is the smallest identifier of the q-grams inside it, so equal windows share a bucket,
and neighbouring windows mostly do as well: those form a run, named by (bucket, identifier of its
tokens). Documents travel in packed chunks of a few MB, and a chunk reports each of its distinct runs
once, so a passage that a third of all documents share costs one entry a chunk, not one a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, mix64, portions, store

U = np.uint64
BASE, BASE2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: Bytes of text in a chunk (a longer document is a chunk of its own, or one for each segment), window starts handled at once.
CHUNK, STEP = 4 << 20, 1 << 18
#: Stands for a missing doc_id inside: after all others.
NO_ID = (1 << 63) - 1

#: Bytes of a bucket that are kept; with the 8 of a name, 120 bits tell runs apart.
KEY = 7
KEY_MASK = U((1 << 64) - (1 << 8 * (8 - KEY)))

#: text_no, nth and own are null but in a segment: the chunk of its text's first one, its place, and its bytes without those it shares with the next.
CHUNKS = "chunk bigint, doc_ids binary, ends binary, body binary, n_bytes bigint, text_no bigint, nth int, own bigint"
CHUNK_TYPES = [pa.int64(), *[pa.binary()] * 3, pa.int64(), pa.int64(), pa.int32(), pa.int64()]


@dataclass(frozen=True)
class Plan:
    """Window length and q in tokens, and how a chunk's bytes become token identifiers."""

    window: int
    q: int
    tokens: Callable[[bytes, np.ndarray], tuple[np.ndarray, np.ndarray]]


def id_shift(docs: DataFrame) -> int:
    """What to take from all ids inside, so that none is NO_ID. Only in a table that has both the least and the largest long, rows without an id count as those of the largest."""
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return int(most == NO_ID and least > -NO_ID - 1)


def pack(docs: DataFrame, shift: int = 0, overlap: int | None = None) -> DataFrame:
    """Rows (doc_id, text) as packed, compressed chunks, stored.

    With `overlap`, a text longer than a chunk is cut into segments of a chunk's size, each a chunk
    of its own that also holds the next `overlap` bytes: windows of one byte more each start in exactly one segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, texts, held = TaskContext.get().partitionId() << 32, 0, [], [], 0
        size = CHUNK if overlap is None else max(CHUNK, 2 * overlap + 2)

        def row(ids: list[int], texts: list[bytes], *segment: int | None) -> pa.RecordBatch:
            body = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            values = (part + seq, np.array(ids, np.int64).tobytes(), ends.tobytes(), pa.compress(body, "zstd", asbytes=True), len(body), *(segment or [None] * 3))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, CHUNK_TYPES, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])

        for batch in portions(batches, 1):
            for i, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if ids and held + len(text) > CHUNK:
                    yield row(ids, texts)
                    seq, ids, texts, held = seq + 1, [], [], 0
                i = NO_ID if i is None else i - shift  # noqa: PLW2901
                if overlap is not None and len(text) > size:
                    if ids:
                        yield row(ids, texts)
                        seq, ids, texts, held = seq + 1, [], [], 0
                    text_no = part + seq
                    for nth, at in enumerate(range(0, len(text), size)):
                        yield row([i], [text[at : at + size + overlap]], text_no, nth, min(size, len(text) - at))
                        seq += 1
                    continue
                ids.append(i)
                texts.append(text)
                held += len(text)
        if ids:
            yield row(ids, texts)

    return store(docs.select("doc_id", "text").mapInArrow(run, CHUNKS), "chunks")


def rolled(x: np.ndarray, base: np.uint64, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Rabin-Karp identifiers of every run of `width` tokens, for each width."""
    power, blocks, n = base, [(x, base)], 2
    with np.errstate(over="ignore"):
        while n <= max(widths):
            y, half = blocks[-1][0], n // 2
            blocks.append((y[:-half] * power + y[half:], power := power * power))
            n *= 2
        out = []
        for width in widths:
            acc, at = None, 0
            for bit in range(width.bit_length() - 1, -1, -1):
                if width >> bit & 1:
                    y, p = blocks[bit]
                    acc = y if acc is None else acc[: len(x) - at - (1 << bit) + 1] * p + y[at : at + len(x) - at - (1 << bit) + 1]
                    at += 1 << bit
            out.append(acc[: len(x) - width + 1])
    return out


def slid_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    n, y = 1, x
    while n * 2 <= width:
        y = np.minimum(y[:-n], y[n:])
        n *= 2
    return y if n == width else np.minimum(y[: len(x) - width + 1], y[width - n :])


@dataclass
class Runs:
    """Runs of one chunk: bucket, name, first window, number of windows, document's place in the chunk."""

    bucket: np.ndarray
    name: np.ndarray
    start: np.ndarray
    n: np.ndarray
    doc: np.ndarray


class Chunk:
    def __init__(self, plan: Plan, row: dict) -> None:
        self.plan = plan
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.byte_ends = np.frombuffer(row["ends"], np.int64)
        self.body = pa.decompress(row["body"], row["n_bytes"], "zstd", asbytes=True)
        self.tokens, self.ends = plan.tokens(self.body, self.byte_ends)

    def _valid(self) -> np.ndarray:
        w, starts = self.plan.window, np.r_[0, self.ends[:-1]]
        some = self.ends > starts
        cut = np.zeros(len(self.tokens) + 1, np.int32)
        np.add.at(cut, np.maximum(self.ends[some] - w + 1, starts[some]), 1)
        np.add.at(cut, self.ends[some], -1)
        return np.cumsum(cut[:-1]) == 0

    def _steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first window, buckets, identifiers of whole windows) of stretches of windows; those across documents included."""
        w, q = self.plan.window, self.plan.q
        for s in range(0, len(self.tokens) - w + 1, STEP):
            x = self.tokens[s : s + STEP + w - 1]
            grams = mix64(rolled(x, BASE, (q,))[0])
            yield s, slid_min(grams, w - q + 1), rolled(x, BASE2, (w,))[0]

    def runs(self, keep_windows: bool = False) -> Runs:
        w, valid, parts, kept = self.plan.window, self._valid(), [], []
        for s, low, whole in self._steps():
            ok = valid[s : s + len(low)]
            change = np.r_[True, low[1:] != low[:-1]]
            change[1:] |= ok[1:] != ok[:-1]
            at = np.flatnonzero(change)
            n = np.diff(np.r_[at, len(low)])
            at, n = at[ok[at]], n[ok[at]]
            if len(n) and n.max() > w:  # longer runs (periodic text) in pieces that two windows cover
                pieces = -(-n // w)
                nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                whole_n, at = np.repeat(n, pieces), np.repeat(at, pieces) + nth * w
                n = np.minimum(w, whole_n - nth * w)
            with np.errstate(over="ignore"):
                name = mix64(whole[at] * U(3) + mix64(whole[at + n - 1] + n.astype(U)))
            parts.append((mix64(low[at] + U(1)) & KEY_MASK, np.maximum(name, U(1)), at + s, n))
            if keep_windows:
                kept.append(whole)
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.whole = np.concatenate(kept) if kept else np.zeros(0, U)
        return Runs(*cols, np.searchsorted(self.ends, cols[2], "right"))

    def windows(self, runs: Runs, chosen: np.ndarray) -> Runs:
        """Single windows of the chosen runs, each in a bucket of its own name, so that none is crowded."""
        n = runs.n[chosen]
        start = np.repeat(runs.start[chosen], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        name = mix64(self.whole[start])
        return Runs(mix64(np.repeat(runs.bucket[chosen], n) ^ name) & KEY_MASK, np.maximum(mix64(name), U(1)), start, np.ones(len(start), np.int64), np.repeat(runs.doc[chosen], n))

    def first(self, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
        """Order that puts equal runs together, earliest document first, and where each group of them starts."""
        order = np.lexsort((self.doc_ids[runs.doc], runs.name, runs.bucket))
        b, m = runs.bucket[order], runs.name[order]
        return order, np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (m[1:] != m[:-1])][: len(b)])

    def later(self, runs: Runs) -> np.ndarray:
        """Whether an equal run is in an earlier document of this chunk."""
        order, at = self.first(runs)
        ids = self.doc_ids[runs.doc[order]]
        out = np.zeros(len(order), bool)
        out[order] = ids > np.repeat(ids[at], np.diff(np.r_[at, len(ids)]))
        return out

    def entries(self, runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order, at = self.first(runs)
        top = order[at]
        return runs.bucket[top], runs.name[top], self.doc_ids[runs.doc[top]]

    def covered(self, runs: Runs, marked: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """For each token, whether a window of the marked runs or one that starts at one of `windows` covers it."""
        cut = np.zeros(len(self.tokens) + 1, np.int32)
        np.add.at(cut, np.r_[runs.start[marked], windows], 1)
        np.add.at(cut, np.r_[runs.start[marked] + runs.n[marked], windows + 1] + self.plan.window - 1, -1)
        return np.cumsum(cut[:-1]) > 0


def id_column(ids: tuple[int, ...], shift: int = 0) -> pa.Array:
    return pa.array([None if i == NO_ID else i + shift for i in ids], pa.int64())


def places(runs: Runs, bucket: np.ndarray, name: np.ndarray) -> np.ndarray:
    """For each run the place of its (bucket, name) in the given list, or -1."""
    if not len(bucket) or not len(runs.bucket):
        return np.full(len(runs.bucket), -1)
    with np.errstate(over="ignore"):
        z, x = bucket * U(5) + name, runs.bucket * U(5) + runs.name
    order = np.argsort(z)
    at = order[np.minimum(np.searchsorted(z[order], x), len(z) - 1)]
    return np.where((bucket[at] == runs.bucket) & (name[at] == runs.name), at, -1)


def among(runs: Runs, bucket: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Which runs are in the given set of (bucket, name)."""
    return places(runs, bucket, name) >= 0
