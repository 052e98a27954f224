"""The registered queries and the pipeline on the smallest tables, against SQL or plain versions."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[1]))
import brute
from conftest import DATA, same

from patchwell.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, DATA), duck, queries.ORACLE_SQL[name])


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())


@pytest.mark.parametrize(("name", "plain"), [("op4_suffix_dedup", brute.suffix), ("op6_substring_dedup", brute.substring), ("op10_simhash_dedup", brute.near)])
def test_plain(spark, texts, name, plain):
    assert sorted(map(tuple, queries.QUERIES[name](spark, DATA).collect())) == plain(texts)


def test_language_plain(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in queries.QUERIES["op3_language_id"](spark, DATA).collect())
    assert got == [(*x[:3], round(x[3], 9)) for x in brute.languages(rows)]


def test_sentencepiece_library(spark, texts):
    import sentencepiece

    from patchwell.llm.common import tokenizer_path

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = []
    for i, t in texts:
        ids = lib.encode(t or "", add_bos=False, add_eos=True)
        want.append((i, len(ids), brute.sha(" ".join(map(str, ids)).encode()), brute.sha(lib.decode(ids).encode())))
    assert sorted(tuple(r)[:4] for r in queries.QUERIES["op7_sentencepiece"](spark, DATA).collect()) == want


def test_html_plain(spark):
    """Every page of the given tables, by host, against html.parser and counts in Python."""
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()]
    sites = {}
    for i, url, html in rows:
        sites.setdefault(url.split("//")[1].split("/")[0].lower(), {})[i] = html
    low = {i: weak for pages in sites.values() for weak in [brute.weak_places(pages)] for i in pages}
    want = {i: brute.main_text(html, low[i]) for i, _, html in rows}
    got = {r["page_id"]: r for r in queries.QUERIES["op9_html_extract"](spark, DATA).collect()}
    assert {i: r["text"] for i, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_language(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = [r for r in queries.QUERIES["op3_language_id"](spark, DATA).collect() if r["held_out"] and lang[r["doc_id"]]]
    assert rows and sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_quality(spark):
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op5_quality"](spark, "/root/testdata/sf0.01").collect() if r["held_out"] and known.get(r["doc_id"]) is not None]
    assert rows and sum(r["predicted"] == known[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_quality_plain(spark, texts):
    """Scores of every document against a plain fit on the same pairs."""
    labels = [tuple(r) for r in spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality").collect()]
    want = {i: rest for i, *rest in brute.qualities(texts, labels)}
    got = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in queries.QUERIES["op5_quality"](spark, DATA).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == h and abs(got[i][1] - s) < 1e-4 and (got[i][2] == p or abs(s - 0.7) < 1e-4) for i, (h, s, p) in want.items())


def test_pipeline(spark, texts):
    import sentencepiece

    import corpus_pipeline
    from patchwell.llm.common import tokenizer_path

    full = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    told = {i for i, _, lang, score in brute.languages(full) if lang != "und" and score >= 0.4}
    rows = [(i, t) for i, t in texts if i in told]
    keep = {r[0] for r in brute.exact(rows) if r[3]}
    rows = [r for r in rows if r[0] in keep]
    keep = {r[0] for r in brute.near(rows) if r[0] == r[2]}
    text = {i: t for i, t in rows if i in keep}
    got = sorted((r["doc_id"], r["n_tokens"], list(r["ids"])) for r in corpus_pipeline.run(spark, DATA).collect())
    copies = {}
    for i, _, _ in got:
        copies[i] = copies.get(i, 0) + 1
    assert set(copies) <= set(text) and max(copies.values()) <= 3
    sizes, taken, largest = {}, {}, {}
    for i, t in text.items():
        s, n = source[i], brute.size_of(t)
        sizes[s] = sizes.get(s, 0) + n
        taken[s] = taken.get(s, 0) + n * copies.get(i, 0)
        largest[s] = max(largest.get(s, 0), n)
    assert all(abs(taken[s] - goal) <= largest[s] + 1e-6 for s, goal in brute.targets(sizes).items())
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    assert all(ids == lib.encode(text[i], add_eos=True) and n == len(ids) for i, n, ids in got)


def test_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_stages_on_awkward_rows(spark):
    """Null and empty texts, repeated ids and rows, missing ids, columns with the stages' own names."""
    import corpus_pipeline

    base = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 60").orderBy("doc_id")
    odd = spark.createDataFrame([(1000, None, "en", "a", 0), (1001, "", None, None, 0), (1002, "123 ?", "en", "a", 5), (None, "the and of that", "en", "a", 3), (3, "other text of an id that repeats", "en", "a", 3)], base.schema)
    docs = base.unionByName(odd).unionByName(base.filter("doc_id IN (5, 6)"))
    for c in ("key", "row", "copies", "copy", "taken_id", "n", "size", "text_sha256", "bucket", "fp", "lang_pred", "score", "col"):
        docs = docs.withColumn(c, docs["doc_id"])
    stages = dict(corpus_pipeline.STAGES)
    kept = {name: stages[name](spark, docs, DATA) for name in list(stages)[:-1]}
    assert all(df.columns == docs.columns for df in kept.values())
    n = lambda df: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in df.select("doc_id").collect())
    every = n(docs)
    assert n(kept["language_id"]) == [i for i in every if i not in (1000, 1001, 1002)]
    exact = n(kept["exact_dedup"])
    assert exact.count(5) <= 1 and exact.count(3) == 2 and 1001 in exact and 1000 not in exact and exact.count(-1) == 1
    copies = kept["mixing"].groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in copies} <= {*every, None} and max(r["count"] for r in copies if r["doc_id"] not in (3, 5, 6)) <= 3
    assert stages["sentencepiece"](spark, docs, DATA).count() == len(every)
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs.limit(0), DATA).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert n(corpus_pipeline.language(spark, unlabelled, DATA)) == n(kept["language_id"])


def test_exact_selects_rows_not_ids(spark):
    """Rows that share an id stay or go each with its text; rows without an id stay where no other has their text, once."""
    import corpus_pipeline

    data = [(3, "X"), (3, "Y"), (9, "Y"), (9, "y"), (None, "Z"), (None, "Z"), (None, "x"), (4, "X"), (4, "X"), (None, None), (5, "W")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], (r["text"] or "").lower()) for r in corpus_pipeline.exact(spark, docs, DATA).collect()]
    assert sorted(got, key=repr) == sorted([(4, "x"), (9, "y"), (None, "z"), (None, ""), (5, "w")], key=repr)
    pair = docs.filter("doc_id IN (3, 9) AND text <> 'y'")
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.exact(spark, pair, DATA).collect()) == [(3, "X"), (9, "Y")]


def test_near_selects_rows_not_ids(spark):
    """Of rows that share an id, one with the smallest id of its group stays, and those of other groups go with them."""
    import corpus_pipeline

    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    data = [(3, a), (3, b), (1, b), (5, a), (3, a), (3, a.upper()), (7, None), (9, ""), (None, "x y z w v")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"], (r["text"] or "").lower()) for r in corpus_pipeline.near(spark, docs, DATA).collect())
    assert got == [(1, b), (3, a), (7, "")]
