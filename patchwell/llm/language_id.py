"""Language identification by rank-order n-gram profiles.

A text, lower-cased, is read as words of letters with a space mark around each; its 1- to 3-grams
are counted and ranked by frequency (ties by code). A language's profile is the same ranking over
all its training texts, counted in Spark. A document gets the language with the smallest
out-of-place distance: for each of its most frequent n-grams the difference of the two ranks, or
the profile length where the language's profile lacks it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import held_out, portions, store

U = np.uint64
#: N-grams in a profile, of a language and of a document.
TOP = 300
#: Languages of one model; profiles (TOP rows a language) are read by the driver and sent to all tasks, so many models at once.
MOST_LANGUAGES = 2000
#: A filter takes a language as told from this score on; text in no learned language stays far below.
LEAST = 0.4
UNDETERMINED = "und"
#: Counted n-grams of a task before it reports them.
HELD = 400_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point: is it a letter."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """Codes of all 1- to 3-grams of letters with a mark (1) at each word edge; 21 bits a character."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[np.minimum(c, 0x10FFFF)]
    c = np.where(is_letter, c, 1).astype(U)
    c = np.r_[U(1), c[is_letter | np.r_[False, is_letter[:-1]]], U(1)]
    edge = c == 1
    two = (c[:-1] << U(21)) | c[1:]
    three = (two[:-1] << U(21)) | c[2:]
    return np.concatenate([c[~edge], two[~(edge[:-1] & edge[1:])], three[~edge[1:-1]]])


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, in order; ties by code."""
    return codes[np.lexsort((codes, -counts))[:top]]


def learn(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Profiles (lang, gram, rank from 0) of the rows of (text, lang); null texts and languages teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def report(lang: str) -> pa.RecordBatch:
            g, n = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        def add(lang: str, parts: list[np.ndarray]) -> None:
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            if lang in held:
                g0, n0 = held[lang]
                both, at = np.unique(np.concatenate([g0, g]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n0, n]), len(both)).astype(np.int64)
                g = both
            held[lang] = (g, n)

        for batch in portions(batches, 0, 8 << 20):
            parts: dict[str, list[np.ndarray]] = {}
            size: dict[str, int] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(lang, []).append(x := grams(text))
                size[lang] = size.get(lang, 0) + len(x)
                if size[lang] > 1 << 21:
                    add(lang, parts.pop(lang))
                    size[lang] = 0
            for lang, p in parts.items():
                add(lang, p)
            for lang in [x for x, (g, _) in held.items() if len(g) > HELD or len(held) > 200]:
                yield report(lang)
        for lang in list(held):
            yield report(lang)

    counts = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, gram bigint, n bigint")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return total.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


class Model:
    def __init__(self, rows: list[tuple[str, int, int]], top: int) -> None:
        self.top = top
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], np.int64).view(U)) if rows else np.zeros(0, U)
        self.rank = np.full((len(self.langs), len(self.codes) + 1), -1, np.int32)
        for lang, gram, rank in rows:
            self.rank[self.langs.index(lang), np.searchsorted(self.codes, np.array(gram, np.int64).view(U))] = rank

    def nearest(self, text: str | None) -> tuple[float, str]:
        """The smallest distance, as a share of the largest there can be, and its language; `und` is farther than any."""
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return 2.0, UNDETERMINED
        g, n = np.unique(grams(text), return_counts=True)
        own = ranked(g, n, self.top)
        if not len(own):
            return 2.0, UNDETERMINED
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        theirs = self.rank[:, np.where(self.codes[at] == own, at, len(self.codes))]
        far = np.where(theirs < 0, self.top, np.abs(theirs - np.arange(len(own), dtype=np.int32))).sum(axis=1)
        best = int(np.argmin(far))
        return float(far[best] / (self.top * len(own))), self.langs[best]


def predictor(profiles: DataFrame, top: int = TOP, most: int = MOST_LANGUAGES) -> Callable[[Column], Column]:
    """A function from a text column to struct(lang_pred, score). More than `most` languages are compared model by model."""
    langs = sorted(r["lang"] for r in profiles.select("lang").distinct().collect())
    far = [distance(profiles.filter(F.col("lang").isin(langs[i : i + most])), top) for i in range(0, max(1, len(langs)), most)]

    def predicted(text: Column) -> Column:
        found = [f(text) for f in far]
        best = F.least(*found) if len(found) > 1 else found[0]
        return F.struct(best["lang_pred"].alias("lang_pred"), F.when(best["lang_pred"] == UNDETERMINED, F.lit(0.0)).otherwise(1 - best["distance"]).alias("score"))

    return predicted


def distance(profiles: DataFrame, top: int) -> Callable[[Column], Column]:
    """A function from a text column to struct(distance, lang_pred): the nearest profile of one model."""
    rows = [(r["lang"], r["gram"], r["rank"]) for r in profiles.collect()]
    sent = profiles.sparkSession.sparkContext.broadcast(Model(rows, top))

    @F.arrow_udf("distance double, lang_pred string")
    def nearest(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = [sent.value.nearest(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.string())], ["distance", "lang_pred"])

    return nearest


def predict(docs: DataFrame, profiles: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, lang_pred, score for each row of (doc_id, text).

    `und` and 0 for null texts, texts without a letter, or without any profile. Ties go to the first
    language by name. Repeated rows are predicted alike; an empty table gives no rows.
    """
    return docs.select("doc_id", predictor(profiles, top)(F.col("text")).alias("p")).select("doc_id", "p.lang_pred", "p.score")


def profiles_of(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Stored profiles learned from the rows that are not held out."""
    return store(learn(docs.filter(~F.coalesce(held_out(), F.lit(False))), top), "profiles")


def reject(docs: DataFrame, wanted: list[str] | None = None, least: float = LEAST, top: int = TOP) -> DataFrame:
    """The rows of `docs`, all columns, whose predicted language is wanted (None: any learned one) with a score of `least` or more.

    Null texts and texts without a letter go. Where no language was learned none can be told, and
    texts with a letter stay. Repeated rows stay or go together; an empty table gives no rows.
    """
    profiles = profiles_of(docs, top)
    if profiles.isEmpty():
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    told = predictor(profiles, top)(F.col("text"))
    keep = (told["lang_pred"] != UNDETERMINED) & (told["score"] >= least)
    return docs.filter(keep if wanted is None else keep & told["lang_pred"].isin(wanted))


def identify(docs: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out, predicted for all."""
    return predict(docs, profiles_of(docs, top), top).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
