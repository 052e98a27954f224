"""SentencePiece encoding and decoding of merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by score (then leftmost first) and
merges until no pair is a piece. Texts fall apart into units that no piece can span (a unit ends
where a space mark follows another character, at line feeds when no piece holds one, and between a
letter and a sign that no piece has side by side; that no piece holds such an end is checked over the
vocabulary). Units are encoded once and remembered. Every unit that is met anew is checked, a batch
of units at a time, against the sentencepiece library's encode and decode; a text with a unit that
differs is left to the library as a whole.

The decoder takes the ids of whole documents, a batch at a time: each id gives the bytes of its
piece, a byte piece its byte, and the leading space that encoding adds goes.
"""

from __future__ import annotations

import gc
import hashlib
import re
import string
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import portions

MARK = "▁"
#: Type of an id in memory.
IDS = np.uint16
#: As isalnum, without decimal digits: also superscripts and fractions, which isalpha leaves out.
LETTER = "[^\\W\\d_]"
#: Bytes that a worker's remembered units may take, twice over; what one takes besides its characters and ids.
REMEMBER, BESIDE = 40 << 20, 220


class Pieces:
    """Byte strings by id, laid end to end, to put together those of many ids at once."""

    def __init__(self, of_id: list[bytes]) -> None:
        self.body = np.frombuffer(b"".join(of_id), np.uint8)
        self.size = np.array([len(b) for b in of_id], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings of `ids` end to end, and where each ends."""
        n = self.size[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.start[ids] - ends + n, n)
        at += np.arange(len(at))
        return self.body[at].tobytes(), ends


class Codec:
    """Pieces of one merge-type model."""

    def __init__(self, model: bytes) -> None:
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(lib.get_piece_size())
        plain = [i for i in ids if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        order = {x: r for r, x in enumerate(sorted({-lib.get_score(i) for i in plain}))}
        self.rank = {lib.id_to_piece(i): order[-lib.get_score(i)] for i in plain}
        beside = {ab for p in self.ids for ab in zip(p, p[1:], strict=False)}
        self.byte = {int(lib.id_to_piece(i)[3:5], 16): i for i in ids if lib.is_byte(i)}
        self.end = lib.eos_id()
        of_byte, known = {i: bytes([b]) for b, i in self.byte.items()}, set(plain)
        self.bytes_of = Pieces([of_byte[i] if i in of_byte else lib.id_to_piece(i).replace(MARK, " ").encode() if i in known else b"" for i in ids])
        self.digits_of = Pieces([f"{i} ".encode() for i in ids])
        if len(ids) > np.iinfo(IDS).max:
            raise ValueError("the vocabulary has too many pieces")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces with inner space marks are not supported")
        self.feeds = not any("\n" in p for p in self.ids)
        joins = {(a, b) for a, b in beside if re.match(LETTER, a) and b in string.punctuation}
        signs = [c for c in string.punctuation if not any(a.isalpha() for a, b in joins if b == c)]
        apart, odd = ("".join(map(re.escape, x)) for x in (signs, sorted({a for a, b in joins if b in signs})))  # odd: superscripts and the like
        word = f"{MARK}*{LETTER}+(?=[{apart}])" + (f"(?<![{odd}])|" if odd else "|") if self.feeds and apart else ""  # letters, then a sign that no piece has after the last
        self.units = re.compile(word + (f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if self.feeds else f"{MARK}*[^{MARK}]+|{MARK}+")).findall
        if cut := [p for p in self.ids if len(self.units(p)) != 1]:
            raise ValueError(f"units end inside the pieces {cut[:9]}")
        self.young: dict[str, bytes | None] = {}  # ids of units, or None where the library's differ
        self.old: dict[str, bytes | None] = {}
        self.held, self.most = 0, REMEMBER
        self.line = self.encoded(MARK) + self.encoded("\n")

    def merged(self, unit: str) -> list[str]:
        """Symbols of a unit after all merges. The agenda holds rank * length + place of the left symbol; an entry is alive while it is the one now at its place."""
        symbols, rank, n = list(unit), self.rank.get, len(unit)
        keys = [-1 if (r := rank(a + b)) is None else r * n + i for i, (a, b) in enumerate(zip(symbols, unit[1:]))]  # noqa: B905
        agenda = [k for k in keys if k >= 0]
        if not agenda:
            return symbols
        heapify(agenda)
        keys.append(-1)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            key = heappop(agenda)
            i = key % n
            if keys[i] != key:
                continue
            j = right[i]
            symbols[i] = pair = symbols[i] + symbols[j]
            symbols[j], keys[j], keys[i] = None, -1, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                r = rank(pair + symbols[k])
                if r is not None:
                    keys[i] = new = r * n + i
                    heappush(agenda, new)
            h = left[i]
            if h >= 0:
                r = rank(symbols[h] + pair)
                if r is None:
                    keys[h] = -1
                else:
                    keys[h] = new = r * n + h
                    heappush(agenda, new)
        return [s for s in symbols if s is not None]

    def encoded(self, unit: str) -> list[int]:
        symbols = self.merged(unit)
        try:
            return [self.ids[s] for s in symbols]
        except KeyError:
            return [i for s in symbols for i in ([self.ids[s]] if s in self.ids else [self.byte[b] for b in s.encode()])]

    def learn(self, units: set[str]) -> None:
        """Encode units, compare them with the library's encode and decode, a batch at once, and remember their ids."""
        marked = [u for u in units if u[0] == MARK]
        inner = [u for u in units if u[0] != MARK]
        both = marked + inner
        own = [self.encoded(u) for u in both]
        plain = [u[1:].replace(MARK, " ") for u in marked]
        theirs = [x or self.encoded(MARK) for x in self.lib.encode(plain, num_threads=1)]  # the library drops a lone mark
        if self.feeds:
            start = len(self.line)
            theirs += [x[start:] if x[:start] == self.line else None for x in self.lib.encode(["\n" + u for u in inner], num_threads=1)]
        else:
            theirs += own[len(marked) :]
        said = self.lib.decode(own, num_threads=1)
        cuts = [0, *accumulate(map(len, own))]
        flat = np.fromiter(chain.from_iterable(own), IDS, cuts[-1])
        spelled = self.decoded(flat, np.array(cuts[1:]))
        width = flat.itemsize
        raw = flat.tobytes()
        found = [raw[a * width : b * width] for a, b in pairwise(cuts)]
        if own != theirs or said != plain + inner or b"".join(spelled) != "".join([" " + x for x in plain] + inner).encode():
            for k, (x, ids, text, other, want) in enumerate(zip(theirs, own, said, spelled, plain + inner, strict=True)):
                if x != ids or text != want or other.decode("utf-8", "replace") != (" " + want if k < len(marked) else want):
                    found[k] = None
        self.young.update(zip(both, found, strict=True))
        self.held += BESIDE * len(both) + sum(map(len, both)) + len(raw)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, without an end id, and where each text's end."""
        split = [self.units(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if self.held > self.most:
            self.young, self.old, self.held = {}, self.young, 0
        young, old = self.young, self.old
        missing = set()
        for units in split:
            missing.update(units)
        missing.difference_update(young)
        again = missing.intersection(old)
        for u in again:
            young[u] = old[u]
            self.held += BESIDE + len(u)
        missing -= again
        if missing:
            self.learn(missing)
        whole = [None] * len(texts)
        for k, units in enumerate(split):
            try:
                whole[k] = b"".join([young[u] for u in units])
            except TypeError:  # a unit that the library encodes otherwise
                whole[k] = np.array(self.lib.encode(texts[k]), IDS).tobytes()
        return np.frombuffer(b"".join(whole), IDS), np.cumsum([len(x) // IDS().itemsize for x in whole])

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 of the ids up to each end; space marks are spaces."""
        body, at = self.bytes_of.joined(ids)
        cuts = np.r_[0, at][np.r_[0, ends]].tolist()
        return [body[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of documents: without the space that encoding puts first."""
        return [x.removeprefix(b" ").decode("utf-8", "replace") for x in self.decoded(ids, ends)]

    def decimals(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Decimal ids up to each end, each with a space after it."""
        body, at = self.digits_of.joined(ids)
        cuts = np.r_[0, at][np.r_[0, ends]].tolist()
        return [body[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


CODECS: dict[int, Codec] = {}


def encode_decode(docs: DataFrame, model_path: str, outputs: bool = True, remember: int = REMEMBER) -> DataFrame:
    """Encode each text with an end id only, decode the ids again.

    Returns doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256, and with
    `outputs` also ids (array of int) and decoded. Null counts as the empty text, whose only id is
    the end id; rows are independent, so repeated rows give equal results; an empty table gives none.
    The model file is read on the driver (under 16 MB) and sent to the executors. `remember` bounds the bytes
    of a worker's remembered units (kept twice over); it changes times, not results.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    if len(model) > 16 << 20:
        raise ValueError("the model is too large to broadcast")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = hash(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = CODECS.get(key) or CODECS.setdefault(key, Codec(sent.value))
        codec.most = remember
        gc.disable()  # remembered units hold no cycles; looking for some takes a tenth of the time
        try:
            yield from encoded(codec, batches)
        finally:
            gc.enable()

    def encoded(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = str(codec.end).encode()
        for batch in portions(batches, 1):
            ids, ends = codec.encode(["" if t is None else t for t in batch.column(1).to_pylist()])
            id_sha = [hashlib.sha256(x + end).hexdigest() for x in codec.decimals(ids, ends)]
            texts = codec.decode(ids, ends)
            text_sha = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            cols = [batch.column(0).cast(pa.int64()), pa.array(np.diff(np.r_[0, ends]) + 1, pa.int64()), pa.array(id_sha), pa.array(text_sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if outputs:
                marked = np.insert(ids.astype(np.int32), ends, codec.end)  # the end id after each text
                cols += [pa.ListArray.from_arrays(pa.array(np.r_[0, ends + np.arange(1, len(ends) + 1)], pa.int32()), pa.array(marked)), pa.array(texts)]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if outputs else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
