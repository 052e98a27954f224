"""Ranked lexical search with hashed max-sketches.

A document's impact for a term is what one occurrence of the term in a query adds to its score. Impacts of
a document fold into a sketch: a few hundred slots, each the maximum over the terms hashed to it. The
sketches of a portion of documents are a matrix, the queries another (how often their terms fall in each
slot), and their product bounds every score from above. Then, query by query, documents are scored exactly in
descending order of bound until no bound reaches the tenth best score so far.

Documents are read once for each batch of queries, as term counts of the batch's vocabulary; a query batch is
bounded in bytes, so that its vocabulary fits each worker. A task returns the best of its documents
for each query, and the best of those are picked in two steps, so no task sees all of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import as_bytes, mix64, portions, store

#: Slots of a sketch, postings of the documents whose sketches are held at once, documents scored between two looks at the bounds.
SLOTS, POSTINGS, STEP = 1024, 1 << 18, 64
#: Bytes of distinct query texts in a batch, about.
BATCH = 4 << 20
#: Bytes of a text that are split into terms at once.
SLICE = 1 << 20
#: Runs of ASCII letters and digits and of anything beyond ASCII, in UTF-8.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Saturation and length weight of an impact.
SCALE, LENGTH = 1_000_000_000, 75
NO_ID = (1 << 63) - 1

COUNTS = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, A-Z lower-cased, in lists for slices of a bounded length that end between terms."""
    at = 0
    while at < len(text):
        end = BREAK.search(text, at + SLICE)
        to = end.start() if end else len(text)
        yield TERM.findall(text[at:to].lower())
        at = to


def counted(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, and the numbers and counts of the vocabulary's terms, of each document with a term."""
    for batch in portions(batches, 1):
        out: list[tuple] = []
        for i, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            n, tf = 0, Counter()
            for terms in terms_of(text):
                n += len(terms)
                tf.update(map(vocabulary.get, terms))
            del tf[None]
            if n:
                out.append((i, n, list(tf), list(tf.values())))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))], names=["doc_id", "n", "terms", "tfs"])


class Queries:
    """A batch of queries over one vocabulary: each query's distinct terms with how often it has them."""

    def __init__(self, texts: list[bytes]) -> None:
        counts = [Counter(t for terms in terms_of(text) for t in terms) for text in texts]
        self.vocabulary: dict[bytes, int] = {}
        for c in counts:
            for t in c:
                self.vocabulary.setdefault(t, len(self.vocabulary))
        self.terms = [np.fromiter((self.vocabulary[t] for t in c), np.int64, len(c)) for c in counts]
        self.times = [np.fromiter(c.values(), np.int64, len(c)) for c in counts]
        self.weight = np.zeros(len(self.vocabulary), np.int64)
        self.slot = (mix64(np.arange(len(self.vocabulary), dtype=np.uint64)) % np.uint64(SLOTS)).astype(np.int64)

    def lookups(self) -> np.ndarray:
        """queries x slots: how often each query looks a slot up."""
        out = np.zeros((len(self.terms), SLOTS))
        for row, terms, times in zip(out, self.terms, self.times, strict=True):
            np.add.at(row, self.slot[terms], times)
        return out


class Portion:
    """Documents with their impacts, postings in the order of the documents."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, queries: Queries, docs: int, total: int) -> None:
        self.ids, self.starts, self.terms = ids, np.concatenate([[0], ends[:-1]]), terms
        self.sizes = ends - self.starts
        self.doc = np.repeat(np.arange(len(ids)), self.sizes)
        m = np.array([100 - LENGTH + LENGTH * int(k) * docs // total for k in n], np.int64)
        self.impacts = queries.weight[terms] * (SCALE * tfs // (1000 * tfs + 8 * m[self.doc]))

    def sketches(self, slot: np.ndarray) -> np.ndarray:
        """slots x documents: the largest impact of the terms of a slot."""
        out = np.zeros((SLOTS, len(self.ids)))
        np.maximum.at(out, (slot[self.terms], self.doc), self.impacts)
        return out

    def scores(self, which: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Exact scores of these documents; times: of each term in the query."""
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[which] - (ends - sizes), sizes)
        total = np.concatenate([[0], np.cumsum(times[self.terms[at]] * self.impacts[at])])
        return total[ends] - total[ends - sizes]


class Top:
    """The best documents of one query so far: higher scores first, then smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        some = scores >= self.least
        ids, scores = np.concatenate([self.ids, ids[some]]), np.concatenate([self.scores, scores[some]])
        first = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[first], scores[first]


def rescored(portion: Portion, bounds: np.ndarray, times: np.ndarray, top: Top) -> None:
    """Documents in descending order of bound, scored until no bound reaches the worst of the best."""
    left = np.flatnonzero(bounds >= top.least)
    left = left[np.argsort(-bounds[left], kind="stable")]
    for at in range(0, len(left), STEP):
        if bounds[left[at]] < top.least:
            return
        which = left[at : at + STEP]
        top.add(portion.ids[which], portion.scores(which, times))


def cut(batches: Iterator[pa.RecordBatch], queries: Queries, docs: int, total: int) -> Iterator[Portion]:
    """The documents in portions of at most POSTINGS postings, or of one document; those without a term of the batch score nothing."""
    for batch in batches:
        ids, n, terms, tfs = (batch.column(k) for k in range(4))
        sizes = pc.list_value_length(terms).to_numpy()
        some = np.flatnonzero(sizes)
        ids, n = ids.fill_null(NO_ID).to_numpy()[some], n.to_numpy()[some]
        terms, tfs = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()
        ends, at = np.cumsum(sizes[some]), 0
        while at < len(some):
            begin = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, begin + POSTINGS, "right")))
            own = slice(begin, ends[to - 1])
            yield Portion(ids[at:to], n[at:to], ends[at:to] - begin, terms[own], tfs[own], queries, docs, total)
            at = to


def best_of_task(batches: Iterator[pa.RecordBatch], queries: Queries, docs: int, total: int, k: int) -> Iterator[pa.RecordBatch]:
    tops = [Top(k) for _ in queries.terms]
    lookups, times = queries.lookups(), np.zeros(len(queries.vocabulary), np.int64)
    for portion in cut(batches, queries, docs, total):
        bounds = lookups @ portion.sketches(queries.slot)
        for own, terms, count, top in zip(bounds, queries.terms, queries.times, tops, strict=True):
            times[terms] = count
            rescored(portion, own, times, top)
            times[terms] = 0
    for at, top in enumerate(tops):
        if len(top.ids):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.ids), at)), pa.array(top.ids), pa.array(top.scores)], names=["nth", "doc_id", "score"])


def first(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each nth with their rank, in two steps: of shares of the documents, then of all."""
    share = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))
    some = found.withColumn("share", share).withColumn("rank", place("nth", "share")).filter(F.col("rank") <= k)
    return some.withColumn("rank", place("nth")).filter(F.col("rank") <= k).drop("share")


def search_batch(docs: DataFrame, texts: list[tuple[str, str]], k: int) -> DataFrame:
    """key, rank, doc_id, score: the best documents of one batch of (key, text)."""
    spark = docs.sparkSession
    queries = Queries([text.encode() for _, text in texts])
    sent = spark.sparkContext.broadcast(queries.vocabulary)
    counts = store(docs.select("doc_id", "text").mapInArrow(lambda b: counted(b, sent.value), COUNTS), "term_counts")
    n, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    for term, df in counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        queries.weight[term] = int(np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))))
    known = spark.sparkContext.broadcast(queries)
    found = counts.mapInArrow(lambda b: best_of_task(b, known.value, n, total, k), "nth bigint, doc_id bigint, score bigint")
    keys = spark.createDataFrame([(at, key) for at, (key, _) in enumerate(texts)], "nth bigint, key string")
    out = first(found, k).join(F.broadcast(keys), "nth")
    return store(out.select("key", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score"), "ranked")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, those with a score above 0.

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Of N documents
    with a term, with L terms in all, one with n terms has m = 25 + 75 n N div L, and a term of weight
    w = floor(1000 ln((2N + 2) / (2 df + 1))) that it holds tf times adds w (10^9 tf div (1000 tf + 8 m)) for each of its
    occurrences in the item. Equal scores are in order of doc_id.

    A null or empty text has no term: such documents count nowhere, such items find nothing. Rows
    that repeat an id are documents, or items, of their own; a document without an id comes last among equal
    scores. Long texts are split piece by piece. Empty tables give no rows; other columns don't matter.
    """
    asked = store(items.filter("octet_length(text) > 0").select("item_id", F.sha2("text", 256).alias("key"), "text"), "items")
    texts = store(asked.groupBy("key").agg(F.first("text").alias("text")), "texts")
    batches = -(-(texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // BATCH)
    out = docs.sparkSession.createDataFrame([], "key string, rank int, doc_id bigint, score bigint")
    for b in range(batches):
        own = texts.filter(F.pmod(F.xxhash64("key"), F.lit(batches)) == b).orderBy("key").collect()
        if own:
            out = out.unionByName(search_batch(docs, [tuple(r) for r in own], k))
    return asked.select("item_id", "key").join(out, "key").drop("key")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY doc_id, term),
len AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM len),
m AS (SELECT doc_id, 25 + (75 * n * docs) // total AS m FROM len, whole),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark) GROUP BY item_id, term),
s AS (
  SELECT q.item_id, tf.doc_id, sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY q.item_id, tf.doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
