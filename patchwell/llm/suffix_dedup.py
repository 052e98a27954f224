"""Byte-level removal of long repeats by bucket-pointer refinement.

Window starts are dealt to buckets by a q-gram of theirs, the one with the smallest identifier among
those in the window; neighbours that share it form a run (see `repeats`). Spark groups the distinct
runs of all chunks by bucket:

1. a run equal to one of an earlier document is repeated whole and leaves;
2. a bucket without different runs needs nothing more; of the others, the first holder of each run
   sends its text, and there bucket pointers are refined: every offset starts in the bucket of its
   first 8 bytes, a bucket of m bytes is split by sorting on (its number, the number of the bucket at
   the offset m further on), for m = 8, 16, 32, up to the window's length, each level built on the
   numbers of the one before. Offsets that are alone in their bucket leave the next level;
3. a bucket with very many runs isn't refined in one place: its windows are dealt one by one, by an
   identifier of all their bytes.

Refinement compares bytes; steps 1 and 3 compare 120 bits of identifiers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix64, portions, store
from .repeats import KEY, Chunk, Plan, Runs, among, id_column, id_shift, pack, places

U = np.uint64
BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
SEGMENTS = "text_no bigint, nth int, doc_id bigint, own binary, n_bytes bigint, gone binary, carry int"
ENTRIES = "share bigint, chunk bigint, kind int, entries binary"
MESSAGES = "chunk bigint, kind int, entries binary"
#: Kinds of messages to chunks: runs that an earlier document has; first holders that send texts, or windows; then windows, and bits of runs, that an earlier document has.
MARK, REFINE, SPLIT, MARK_WINDOW, BITS = range(5)
#: Kinds of entries: runs or windows, and texts of runs.
NAMED, TEXTS = range(2)
#: Bytes of text for each share of the bucket space.
SHARE = 8 << 20
#: Runs of a bucket from which it is dealt window by window: in one chunk (which then sends one entry, WIDE, for all), and in all.
WIDE_RUNS, MOST_RUNS, WIDE = 256, 4096, U(0)
#: Bytes by which offsets are bucketed at first.
FIRST = 8


def byte_tokens(body: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTES[np.frombuffer(body, np.uint8)], ends


def packed(key: np.ndarray, *rest: np.ndarray) -> bytes:
    """Buckets without their low bytes (0), then 8-byte columns."""
    a = np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)
    return b"".join([a[:, 8 - KEY :].tobytes(), *(x.tobytes() for x in rest)])


def unpacked(blob: bytes, columns: int, n: int | None = None) -> tuple[np.ndarray, ...]:
    n = len(blob) // (KEY + 8 * columns) if n is None else n
    a = np.zeros((n, 8), np.uint8)
    a[:, 8 - KEY :] = np.frombuffer(blob, np.uint8, n * KEY).reshape(n, KEY)
    return a.view(U).ravel(), *(np.frombuffer(blob, U, n, n * (KEY + 8 * k)) for k in range(columns))


def joined(parts: list[tuple[np.ndarray, ...]], columns: int) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, U) for _ in range(columns))


def pieces(share: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Stretches of equal values in a sorted array."""
    at = np.flatnonzero(np.r_[True, share[1:] != share[:-1]][: len(share)])
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(share)], strict=False):
        yield int(share[a]), slice(a, b)


def share_of(key: np.ndarray, shares: int) -> np.ndarray:
    return ((key >> U(32)) * U(shares)) >> U(32)


def batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.binary()], strict=True)], ["share", "chunk", "kind", "entries"])


def dealt(chunk: int, entries: tuple[np.ndarray, np.ndarray, np.ndarray], shares: int) -> list[tuple[int, int, int, bytes]]:
    """A chunk's entries, sorted by bucket, as one packed row for each share of the bucket space."""
    key, name, doc = entries
    return [(share, chunk, NAMED, packed(key[s], name[s], doc[s])) for share, s in pieces(share_of(key, shares))]


def narrowed(key: np.ndarray, name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a chunk, sorted by bucket, with one WIDE entry for each bucket of very many runs."""
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    n = np.diff(np.r_[at, len(key)])
    wide = np.repeat(n > WIDE_RUNS, n)
    if not wide.any():
        return key, name, doc
    first = np.zeros(len(key), bool)
    first[at] = True
    keep = ~wide | first
    return key[keep], np.where(wide, WIDE, name)[keep], doc[keep]


def matched(parts: list[tuple[int, bytes]], windows: bool) -> list[tuple[int, int, bytes]]:
    """One share of the buckets: tell each chunk which of its runs (or windows) an earlier document has, and which first holders to refine or split."""
    blobs = [unpacked(blob, 2) for _, blob in parts]
    chunk = np.repeat(np.array([c for c, _ in parts], np.int64), [len(b[0]) for b in blobs])
    key, name, doc = joined(blobs, 3)
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    sub = order[np.r_[False, same] | np.r_[same, False] | (name[order] == WIDE)] if len(k) else order
    key, name, doc, chunk = key[sub], name[sub], doc[sub].view(np.int64), chunk[sub]
    order = np.lexsort((doc, name, key))
    key, name, doc, chunk = key[order], name[order], doc[order], chunk[order]
    new_key = np.r_[True, key[1:] != key[:-1]][: len(key)]
    new = new_key | np.r_[True, name[1:] != name[:-1]][: len(key)]
    at, key_at = np.flatnonzero(new), np.flatnonzero(new_key)
    earlier = (doc > np.repeat(doc[at], np.diff(np.r_[at, len(key)]))) & (name != WIDE)
    kind = np.where(earlier, MARK_WINDOW if windows else MARK, -1)
    if not windows and len(key):
        n = np.diff(np.r_[key_at, len(key)])
        names = np.repeat(np.add.reduceat(new.astype(np.int64), key_at), n)
        split = np.repeat(np.add.reduceat((name == WIDE).astype(np.int64), key_at), n) > 0
        kind[~earlier & (names > 1)] = REFINE
        kind[~earlier & (split | (names > MOST_RUNS))] = SPLIT
    keep = np.flatnonzero(kind >= 0)
    keep = keep[np.lexsort((kind[keep], chunk[keep]))]
    key, name, chunk, kind = key[keep], name[keep], chunk[keep], kind[keep]
    return [(int(chunk[s.start]), int(kind[s.start]), packed(key[s], name[s])) for _, s in pieces(chunk * 8 + kind)]


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers from 1, in sorted order of `values`, and how many share each."""
    order = np.argsort(values)
    v = values[order]
    new = np.r_[True, v[1:] != v[:-1]][: len(v)]
    number = np.empty(len(v), np.int64)
    number[order] = np.cumsum(new)
    return number, np.diff(np.r_[np.flatnonzero(new), len(v)])


def refined(text: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Bucket numbers at `window` bytes of each offset of the texts up to `ends`; 0 where the offset is alone or has fewer bytes.

    Two offsets have equal numbers exactly when the strings of `window` bytes there are equal.
    """
    left = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(len(text))  # bytes to the end of the own text
    x, m = text.astype(U), 1
    while m < FIRST:
        x = (x[:-m] << U(8 * m)) | x[m:] if len(x) > m else x[:0]
        m *= 2
    number = np.zeros(len(text) + window, np.int64)
    alive = np.flatnonzero(left >= m)
    values, size = x[alive], 0
    while True:
        found, sizes = numbered(values)
        many = sizes[found - 1] > 1
        number[:] = 0
        alive = alive[many]
        number[alive] = found[many]
        if m == window or not len(alive):
            return number[: len(text)]
        step = min(m, window - m)  # the last level overlaps
        m += step
        size = U(len(sizes) + 1)
        alive = alive[(left[alive] >= m) & (number[np.minimum(alive + step, len(text))] > 0)]
        values = number[alive].astype(U) * size + number[alive + step].astype(U)


def settled(parts: list[tuple[int, bytes]], window: int) -> list[tuple[int, int, bytes]]:
    """Texts of one share's runs: tell each chunk, as bits, which windows of a run an earlier document has."""
    cols, texts = [], []
    for _, blob in parts:
        n = int.from_bytes(blob[:8], "little")
        cols.append(unpacked(blob[8:], 3, n))
        texts.append(blob[8 + n * (KEY + 24) :])
    chunk = np.repeat(np.array([c for c, _ in parts], np.int64), [len(c[0]) for c in cols])
    key, name, doc, n = joined(cols, 4)
    doc, n = doc.view(np.int64), n.astype(np.int64)
    sizes = n + window - 1
    ends = np.cumsum(sizes)
    number = refined(np.frombuffer(b"".join(texts), np.uint8), ends, window)
    run = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    number = number[(ends - sizes)[run] + nth]
    some = np.flatnonzero(number)
    run, nth, number = run[some], nth[some], number[some]
    first = np.full(number.max(initial=0) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, number, doc[run])
    late = doc[run] > first[number]
    bits = np.zeros(len(n), U)
    np.bitwise_or.at(bits, run[late], U(1) << nth[late].astype(U))
    keep = np.flatnonzero(bits)
    keep = keep[np.argsort(chunk[keep], kind="stable")]
    return [(c, BITS, packed(key[keep[s]], name[keep[s]], bits[keep[s]])) for c, s in pieces(chunk[keep])]


class Joined:
    """One text, from its segments in order."""

    def __init__(self, text_no: int, doc_id: int, with_text: bool) -> None:
        self.text_no, self.doc_id, self.kept = text_no, doc_id, [] if with_text else None
        self.digest, self.n_bytes, self.n_removed, self.n_spans = hashlib.sha256(), 0, 0, 0
        self.carry, self.last = 0, False

    def add(self, row: dict) -> None:
        body = np.frombuffer(pa.decompress(row["own"], row["n_bytes"], "zstd", asbytes=True), np.uint8)
        gone = np.unpackbits(np.frombuffer(row["gone"], np.uint8), count=len(body)).astype(bool)
        gone[: self.carry] = True
        kept = body[~gone].tobytes()
        self.digest.update(kept)
        if self.kept is not None:
            self.kept.append(kept)
        self.n_bytes += len(body)
        self.n_removed += len(body) - len(kept)
        self.n_spans += int(np.count_nonzero(gone & ~np.r_[self.last, gone[:-1]]))
        self.carry, self.last = row["carry"], gone[-1]

    def result(self) -> tuple:
        return self.doc_id, self.n_bytes, self.n_removed, self.n_spans, self.digest.hexdigest(), None if self.kept is None else b"".join(self.kept)


def told(table: pa.Table, kind: int, columns: int = 1) -> tuple[np.ndarray, ...]:
    return joined([unpacked(e, columns) for k, e in zip(table.column("kind").to_pylist(), table.column("entries").to_pylist(), strict=True) if k == kind], columns + 1)


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.table({name: pa.array(c, t) for name, c, t in zip(("chunk", "kind", "entries"), cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)})


def to_split(runs: Runs, right: pa.Table) -> np.ndarray:
    """Runs to deal window by window: those told, and all of the buckets that the chunk has sent as WIDE."""
    key, name = told(right, SPLIT)
    return among(runs, key, name) | np.isin(runs.bucket, key[name == WIDE])


def remove_repeats(docs: DataFrame, length: int = 50, q: int = 20, with_text: bool = False) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts in a document with a smaller doc_id.

    One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256,
    and, with `with_text`, kept (the remaining bytes). `length` is 16 to 64. Null texts count as empty;
    texts shorter than `length` keep everything; rows that repeat a doc_id count as one document and
    each gets a row; rows without a doc_id count as one document after all others; other columns are
    ignored; an empty table gives no rows. Matches never cross documents. Texts longer than a chunk are handled
    in segments that share `length` - 1 bytes; what a segment's windows cover of the next one is handed on.
    """
    if not 2 * FIRST <= length <= 64:
        raise ValueError("length is 16 to 64")
    plan, shift = Plan(length, min(q, length), byte_tokens), id_shift(docs)
    chunks = pack(docs, shift, length - 1)
    shares = 1 + (chunks.agg(F.sum("n_bytes")).first()[0] or 0) // SHARE

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1).to_pylist()[0]
                c = Chunk(plan, row)
                yield batch(dealt(row["chunk"], narrowed(*c.entries(c.runs())), shares))

    def grouped(table: pa.Table, first: bool) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "chunk", "entries")), strict=True))
        named, texts = ([r[1:] for r in rows if r[0] == kind] for kind in (NAMED, TEXTS))
        return messages((matched(named, not first) if named else []) + (settled(texts, length) if texts else []))

    def asked(left: pa.Table, right: pa.Table) -> pa.Table:
        """What a chunk sends of the runs it is asked for: texts, or windows one by one."""
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([batch([])])
        row = left.to_pylist()[0]
        c = Chunk(plan, row)
        runs = c.runs(keep_windows=True)
        alone = ~c.later(runs)
        out = dealt(row["chunk"], c.entries(c.windows(runs, to_split(runs, right) & alone)), shares)
        order, at = c.first(runs)
        mine = order[at]
        mine = mine[(among(runs, *told(right, REFINE)) & alone)[mine]]
        key, name, start, n, doc = runs.bucket[mine], runs.name[mine], runs.start[mine], runs.n[mine], c.doc_ids[runs.doc[mine]]
        body = np.frombuffer(c.body, np.uint8)
        for share, s in pieces(share_of(key, shares)):
            size = n[s] + length - 1
            at = np.repeat(start[s] - np.cumsum(size) + size, size) + np.arange(size.sum())
            out.append((share, row["chunk"], TEXTS, len(size).to_bytes(8, "little") + packed(key[s], name[s], doc[s], n[s]) + body[at].tobytes()))
        return pa.Table.from_batches([batch(out)])

    def removed(c: Chunk, right: pa.Table) -> np.ndarray:
        """For each byte of a chunk, whether it goes."""
        runs = c.runs(keep_windows=True)
        later = c.later(runs)
        w = c.windows(runs, to_split(runs, right) & ~later)
        one = w.start[c.later(w) | among(w, *told(right, MARK_WINDOW))]
        key, name, bits = told(right, BITS, 2)
        at = places(runs, key, name)
        had = np.flatnonzero(~later & (at >= 0))
        n = runs.n[had]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = (np.repeat(bits[at[had]], n) >> nth.astype(U)) & U(1) == 1
        windows = np.r_[one, (np.repeat(runs.start[had], n) + nth)[hit]]
        return c.covered(runs, later | among(runs, *told(right, MARK)), windows)

    def finished(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # messages to a segment
            return cleaned_table([])
        c = Chunk(plan, left.to_pylist()[0])
        return cleaned(c, removed(c, right))

    def segment(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # messages to a chunk of whole texts
            values = [[]] * 7
        else:
            row = left.to_pylist()[0]
            c, own = Chunk(plan, row), row["own"]
            gone = removed(c, right)
            values = [[v] for v in (row["text_no"], row["nth"], int(c.doc_ids[0]), pa.compress(c.body[:own], "zstd", asbytes=True), own, np.packbits(gone[:own]).tobytes(), int(np.count_nonzero(gone[own:])))]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32()]
        return pa.table({name.split()[0]: pa.array(v, t) for name, v, t in zip(SEGMENTS.split(", "), values, types, strict=True)})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts from their segments, which come in order: one segment is held at a time."""
        text = None
        for rows in portions(batches, 3):
            for row in rows.to_pylist():
                if text is None or text.text_no != row["text_no"]:
                    if text is not None:
                        yield from cleaned_table([text.result()]).to_batches()
                    text = Joined(row["text_no"], row["doc_id"], with_text)
                text.add(row)
        if text is not None:
            yield from cleaned_table([text.result()]).to_batches()


    def cleaned(c: Chunk, covered: np.ndarray) -> pa.Table:
        body, rows, a = np.frombuffer(c.body, np.uint8), [], 0
        for doc, b in zip(c.doc_ids.tolist(), c.byte_ends.tolist(), strict=True):
            gone = covered[a:b]
            n = int(np.count_nonzero(gone))
            kept = body[a:b][~gone].tobytes() if n else c.body[a:b]
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]) if n else 0
            rows.append((doc, b - a, n, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            a = b
        return cleaned_table(rows)

    def cleaned_table(rows: list[tuple]) -> pa.Table:
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        return pa.table([id_column(cols[0], shift), *(pa.array(x, t) for x, t in zip(cols[1:], types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    heads = store(chunks.mapInArrow(emit, ENTRIES).groupBy("share").applyInArrow(lambda t: grouped(t, True), MESSAGES), "messages")
    asks = heads.filter(F.col("kind").isin(REFINE, SPLIT))
    tails = store(chunks.groupBy("chunk").cogroup(asks.groupBy("chunk")).applyInArrow(asked, ENTRIES).groupBy("share").applyInArrow(lambda t: grouped(t, False), MESSAGES), "windows")
    said = heads.filter(F.col("kind") != REFINE).unionByName(tails)
    out = chunks.filter("text_no IS NULL").groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(finished, SCHEMA)
    segments = chunks.filter("text_no IS NOT NULL")
    if not segments.isEmpty():
        parts = segments.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(segment, SEGMENTS)
        out = out.unionByName(parts.repartition("text_no").sortWithinPartitions("text_no", "nth").mapInArrow(whole, SCHEMA))
    return out if with_text else out.drop("kept")
