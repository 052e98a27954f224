"""Operators against plain versions, on awkward rows: null, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import sys
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from patchwell.llm import components, embedding_dedup, exact_dedup, html_extract, language_id, mixing, quality, repeats, sentencepiece_codec, simhash_dedup, substring_dedup, suffix_dedup
from patchwell.llm.common import tokenizer_path

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


PASSAGE, LONG = prose(80), prose(6000)
TEXTS = [
    None, "", " \t\n", "one", "One", "ONE", "ÉONE", "éone", "a b c", prose(40), PASSAGE, "x " + PASSAGE + " y", PASSAGE.upper(), prose(30) + " " + PASSAGE + "\n" + prose(30), LONG, LONG, LONG[:-1] + "~",
    LONG.replace(WORDS[3], WORDS[4], 2), "ab" * 400, "ab" * 300 + "c", "z" * 49, "z" * 50, "z" * 51, "q " * 60, "q " * 55 + "r", "\x1c".join(WORDS[:70]), " ".join(WORDS[:60]), "🙂" * 30, prose(50)[:120], "A" * 3000 + prose(900), "a" * 3000 + prose(10),
]
ROWS = list(enumerate(TEXTS, 10))
random.Random(1).shuffle(ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names operators use themselves."""
    rows = [(i, t, "x", 1, 2, 3.0, "s", "en") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, chunk int, size int, score double, source string, lang string").repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_exact(docs, none, spark):
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows(exact_dedup.deduplicate(docs), *cols) == brute.exact(ROWS)
    assert rows(exact_dedup.deduplicate(docs, block=7), *cols) == brute.exact(ROWS)
    assert rows(exact_dedup.deduplicate(docs, block=5, bits=6), *cols) == brute.exact(ROWS)  # names collide all the time
    assert exact_dedup.deduplicate(none).count() == 0
    twice = docs.filter("doc_id = 13").unionByName(docs.filter("doc_id = 13"))
    assert rows(exact_dedup.deduplicate(twice), "doc_id", "group_size", "kept") == [(13, 2, True)] * 2


def test_exact_with_colliding_blocks(docs, spark, monkeypatch):
    """At the production width: two texts of one 48-bit bucket, then few buckets for all blocks and pairs."""
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    data = [(1, "10538120"), (2, "16106211"), (3, "16106211"), (4, None), (5, "10538120" + "x" * 3000), (6, "16106211" + "x" * 3000)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert df.filter("doc_id < 3").select(exact_dedup.bucket_of(F.col("text"))).distinct().count() == 1
    assert rows(exact_dedup.deduplicate(df), *cols) == brute.exact(data)
    assert rows(exact_dedup.deduplicate(df, block=8), *cols) == brute.exact(data)
    monkeypatch.setattr(exact_dedup, "bucket_of", lambda *block: F.xxhash64(*block).bitwiseAND(F.lit(3)))
    assert rows(exact_dedup.deduplicate(docs), *cols) == brute.exact(ROWS)
    twice = docs.unionByName(docs.filter("doc_id = 25"))
    assert rows(exact_dedup.deduplicate(twice), *cols) == brute.exact([*ROWS, *(r for r in ROWS if r[0] == 25)])


@pytest.mark.parametrize("chunk", [8 << 20, 3000])
def test_suffix(docs, none, chunk, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    out = suffix_dedup.remove_repeats(docs)
    assert rows(out, *out.columns) == brute.suffix(ROWS)
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("chunk", [1, 140])
def test_suffix_of_long_texts(docs, spark, chunk, monkeypatch):
    """Texts of many segments: passages across their borders, last segments of any length, repeated ids, kept bytes in order."""
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    out = suffix_dedup.remove_repeats(docs)
    assert rows(out, *out.columns) == brute.suffix(ROWS)
    r = random.Random(5)
    passage = "".join(r.choices("abcdefghij ", k=400))
    cut = lambda: passage[(a := r.randrange(400)) : a + r.randrange(30, 200)]
    data = [(i, "".join(cut() if r.random() < 0.5 else "".join(r.choices("klmnop\u00e9", k=r.randrange(1, 120))) for _ in range(r.randrange(0, 9)))) for i in range(60)]
    data += [(100 + k, "ab" * k) for k in range(40, 80, 3)] + [(62, passage[:100]), (63, passage[:149]), (64, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(df, with_text=True)
    assert rows(got.drop("kept"), *out.columns) == brute.suffix(data)
    assert all(hashlib.sha256(x["kept"]).hexdigest() == x["kept_sha256"] and len(x["kept"]) == x["n_bytes"] - x["n_removed"] for x in got.collect())
    same = spark.createDataFrame([(1, passage), (1, passage), (2, passage)], "doc_id long, text string")
    assert rows(suffix_dedup.remove_repeats(same), "doc_id", "n_removed", "n_spans") == [(1, 0, 0), (1, 0, 0), (2, 400, 1)]


def test_suffix_texts(docs):
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(docs, with_text=True).collect()}
    assert kept[25] == b"" and kept[24] == LONG.encode()


@pytest.mark.parametrize("chunk", [8 << 20, 3000])
def test_substring(docs, none, chunk, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    out = substring_dedup.remove_repeated_windows(docs)
    assert rows(out, *out.columns) == brute.substring(ROWS)
    assert substring_dedup.remove_repeated_windows(none).count() == 0
    texts = {r["doc_id"]: r["kept"] for r in substring_dedup.remove_repeated_windows(docs, with_text=True).collect()}
    assert texts[21] == "x y"


def test_repeats_in_steps(docs, monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 64)
    out = suffix_dedup.remove_repeats(docs.limit(100))
    assert rows(out, *out.columns) == brute.suffix(ROWS)


@pytest.mark.parametrize(("wide", "most", "share"), [(1, 1, 2000), (3, 1 << 30, 5000), (1 << 30, 2, 300), (1 << 30, 1 << 30, 1000)])
def test_suffix_with_crowded_buckets(docs, monkeypatch, wide, most, share):
    """Buckets that a chunk, or all, deal window by window, and many shares."""
    for name, value in (("WIDE_RUNS", wide), ("MOST_RUNS", most), ("SHARE", share)):
        monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setattr(repeats, "CHUNK", 3000)
    out = suffix_dedup.remove_repeats(docs)
    assert rows(out, *out.columns) == brute.suffix(ROWS)


def test_bucket_pointers():
    """Refined buckets are those of equal strings; offsets alone in theirs, and near an end, have none."""
    r = random.Random(6)
    for window in (16, 17, 33, 50, 64):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randint(window, 140))) for _ in range(30)] + [b"ab" * 70, b"a" * 120]
        texts += [t[5:] for t in texts[:9]]
        text, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
        number = suffix_dedup.refined(np.frombuffer(text, np.uint8), ends, window)
        string = {i: text[i : i + window] for t, e in zip(texts, ends.tolist(), strict=True) for i in range(e - len(t), e - window + 1)}
        groups = defaultdict(list)
        for i, x in string.items():
            groups[x].append(i)
        assert {i for i in range(len(text)) if number[i]} == {i for g in groups.values() if len(g) > 1 for i in g}
        assert sorted(sorted(g) for g in groups.values() if len(g) > 1) == sorted(np.flatnonzero(number == k).tolist() for k in np.unique(number) if k)


def test_largest_id_is_not_a_missing_one(spark):
    top = (1 << 63) - 1
    df = spark.createDataFrame([(top, PASSAGE), (None, PASSAGE), (None, PASSAGE)], "doc_id long, text string")
    n = len(PASSAGE.encode())
    assert sorted(((r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(df).collect()), key=repr) == [(top, 0), (None, n), (None, n)]
    assert sorted(((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeated_windows(df).collect()), key=repr) == [(top, 0), (None, 80), (None, 80)]


def test_repeated_rows_are_one_document(spark):
    df = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, PASSAGE)], "doc_id long, text string")
    assert rows(suffix_dedup.remove_repeats(df), "doc_id", "n_removed") == [(1, 0), (1, 0), (2, len(PASSAGE.encode()))]
    assert rows(substring_dedup.remove_repeated_windows(df), "doc_id", "n_removed") == [(1, 0), (1, 0), (2, 80)]


def test_simhash(docs, none):
    out = simhash_dedup.near_duplicates(docs)
    assert rows(out, *out.columns) == brute.near(ROWS)
    assert simhash_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("most", [simhash_dedup.MOST, 9])
def test_trie_join_links_everything(spark, most):
    """Random centres with many neighbours, through the join alone."""
    r = np.random.default_rng(3)
    centre = r.integers(0, 1 << 63, 20, dtype=np.uint64)
    x = {int(c) ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 5), replace=False)) for c in centre for _ in range(60)}
    fps = np.array(sorted(x), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    got = {r["node"]: r["component"] for r in components.components(simhash_dedup.linked(df, 4, most)).collect()}
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    ids = fps.view(np.int64).tolist()
    want = brute.components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(close, 1)), strict=True)])
    assert {i: got.get(i, i) for i in ids} == want


def test_components(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(500, 100 + i) for i in range(50)]
    links = [*path, *star, (7, 7), (1000, 999), (999, 1000)]
    df = spark.createDataFrame(links, "u long, v long")
    nodes = {x for link in links for x in link} - {500}
    want = brute.components(nodes | {500}, links)
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == want
    assert components.components(df.limit(0)).count() == 0


VECTORS = [
    (1, [1.0, 0.0, 0.0], 1), (2, [0.99, 0.05, 0.0], 1), (3, [0.9, 0.4, 0.0], 1), (4, [0.99, 0.05, 0.0], 2), (5, [1.0, 0.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [float("nan"), 1.0, 1.0], 1),
    (9, [1.0, None, 1.0], 1), (10, [1.0, 0.0], 1), (11, [2.0, 0.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [], 1), (14, [1e30, 1e30, 0.0], 2), (15, [1e-30, 1e-30, 0.0], 2), (16, [float("inf"), 0.0, 0.0], 1), (17, [-1.0, 0.0, 0.0], 1),
]


@pytest.mark.parametrize("tile", [2048, 3])
def test_embeddings(spark, tile):
    r = np.random.default_rng(1)
    base = r.normal(size=(30, 16))
    many = [(100 + i, [float(np.float32(x)) for x in base[i % 30] + r.normal(size=16) * r.choice([0.05, 0.2, 0.35])], int(i % 3)) for i in range(200)]
    data = VECTORS + many
    df = spark.createDataFrame([(*v, "x") for v in data], "vec_id long, embedding array<float>, label int, rep string")
    data = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], lab) for i, e, lab in data]
    want = brute.cosines(data)
    got = rows(embedding_dedup.near_duplicates(df, tile=tile), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted((i, n, c, i == c) for i, (n, c) in want.items())
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_bounds_are_rigorous():
    import pyarrow as pa

    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8)) * r.choice([1e-3, 1, 1e4], size=(300, 1))
    t = embedding_dedup.Tile(pa.table({"rep": np.arange(300), "n": np.ones(300, int), "embedding": pa.array(x.tolist())}))
    true = t.x @ t.x.T
    guess = (t.codes.astype(np.float32) @ t.codes.astype(np.float32).T) * np.outer(t.scale, t.scale)
    assert (np.abs(true - guess) <= (1 + t.error[:, None]) * t.error[None, :] + t.error[:, None] + embedding_dedup.SLACK).all()


def test_sentencepiece(docs, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    got = {r["doc_id"]: r for r in sentencepiece_codec.encode_decode(docs, tokenizer_path()).collect()}
    for i, t in ROWS:
        ids = lib.encode(t or "", add_bos=False, add_eos=True)
        r = got[i]
        assert list(r["ids"]) == ids and r["decoded"] == lib.decode(ids) and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == brute.sha(" ".join(map(str, ids)).encode()) and r["decoded_sha256"] == brute.sha(lib.decode(ids).encode())
    assert sentencepiece_codec.encode_decode(none, tokenizer_path()).count() == 0


def test_sentencepiece_odd_texts():
    with open(tokenizer_path(), "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    r = random.Random(8)
    alphabet = " ▁  \n\t.,;'\"()<>aeinrstHTé½世界🙂​　 _-0123 the "
    for _ in range(400):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        ids, ends = codec.encode([text])
        assert ids.tolist() == codec.lib.encode(text), text
        assert codec.decode(ids, ends) == [text.replace("▁", " ")] == [codec.lib.decode(ids.tolist())]


def test_sentencepiece_falls_back_and_forgets(monkeypatch):
    """A text with a unit that the library encodes otherwise is left to it; few remembered units give the same ids."""
    with open(tokenizer_path(), "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    texts = [t or "" for t in TEXTS[:16]] + ["hello world", "", "world hello 🙂"]
    own = codec.encoded
    monkeypatch.setattr(codec, "encoded", lambda unit: own("x") if "hello" in unit else own(unit))
    codec.most = 1000
    for _ in range(2):
        ids, ends = codec.encode(texts)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == codec.lib.encode(texts)
        assert codec.decode(ids, ends) == codec.lib.decode(codec.lib.encode(texts)) == texts
    assert None in {*codec.young.values(), *codec.old.values()}


def test_sentencepiece_units_end_in_no_piece():
    """Superscripts and fractions before signs, and every piece after a letter and before a sign."""
    with open(tokenizer_path(), "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    texts = ["km².", "5 km².", "km².\nm²", "x²) y³, ½. ²..", "².", "ªº.", "Ⅳ.", "m².m².", "٣.", "Ⓐ'"]
    texts += ["km" + p.replace("▁", " ") + "." for p in codec.ids]
    texts += [a + b for a in map(chr, range(0x21, 0x3000)) if a.isalnum() for b in "².'\""]
    ids, ends = codec.encode(texts)
    for text, got, want in zip(texts, np.split(ids, ends[:-1]), codec.lib.encode(texts), strict=True):
        assert got.tolist() == want, text


def test_mixing(spark):
    r = random.Random(4)
    data = [(i, None if r.random() < 0.05 else " ".join(["w"] * int(r.paretovariate(1.2) * 5)), r.choice(["a", "b", "b", "b", "b", "b", "b", "c", None, "Z", "d"])) for i in range(4000)]
    data += [(9000, "", "empty"), (9001, None, "empty"), (5, "w w", "a")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix(df).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, brute.size_of(t)) for i, t, _ in data)
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += brute.size_of(t)
    goal = brute.targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and abs(x["target"] - goal[x["source"]]) < 1e-6 * max(1, goal[x["source"]])
        assert 0 <= x["copies"] <= 3 and x["taken"] == x["copies"] * x["size"]
        taken[x["source"]] += x["taken"]
        largest[x["source"]] = max(largest[x["source"]], x["size"])
    assert all(abs(taken[s] - goal[s]) <= largest[s] + 1e-6 for s in sizes)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect()), key=repr)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_without_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert rows(mixing.mix(df), "doc_id", "target", "taken") == [(1, 0.0, 0), (2, 0.0, 0)]


def test_language(spark):
    r = random.Random(2)
    make = lambda words: " ".join(r.choice(words) for _ in range(r.randint(3, 60)))
    sets = {"en": ["the", "and", "with", "that", "thing", "over", "which"], "de": ["der", "und", "nicht", "über", "schön", "für", "straße"], "ru": ["это", "что", "как", "дом", "мир"]}
    data = [(i, make(sets[lang]), lang) for i, lang in enumerate(["en", "de", "ru"] * 150)]
    data += [(1000, None, "en"), (1001, "123 !?", "en"), (1002, "", "de"), (1003, "the and", None), (1004, "der und " * 20000, None)]
    df = spark.createDataFrame([(*x, 0.5, "y") for x in data], "doc_id long, text string, lang string, score double, lang_pred string")
    got = {x["doc_id"]: x for x in language_id.identify(df).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in data[:450])
    assert [got[i]["lang_pred"] for i in range(1000, 1005)] == ["und", "und", "und", "en", "de"]
    few = df.select("doc_id", language_id.predictor(language_id.profiles_of(df), most=2)(F.col("text")).alias("p")).collect()
    assert {x["doc_id"]: (x["p"]["lang_pred"], x["p"]["score"]) for x in few} == {i: (x["lang_pred"], x["score"]) for i, x in got.items()}  # two models at once
    assert rows(language_id.reject(df, wanted=["de"]), "doc_id")[-1] == (1004,) and language_id.reject(df, wanted=["de"]).count() == 151
    assert language_id.reject(df, least=1.1).count() == 0
    kept = language_id.reject(df)
    assert kept.columns == df.columns and rows(kept, "doc_id")[-2:] == [(1003,), (1004,)] and kept.count() == 452
    assert language_id.identify(df.limit(0)).count() == 0
    assert {x["lang_pred"] for x in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_ignores_its_answers(spark):
    """Held-out rows teach nothing."""
    df = spark.createDataFrame([(i, "the and" if i % 2 else "der und", "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    held = language_id.held_out()
    a = language_id.learn(df.filter(~held))
    b = language_id.learn(df.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).filter(~held))
    assert rows(a, *a.columns) == rows(b, *b.columns)


def test_quality(spark):
    data, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        data.append((i, prose(20).upper().replace(" ", "!! ") if bad else prose(20).capitalize() + "."))
        labels.append((i, int(not bad)))
    data += [(900, None), (901, ""), (902, "!" * 5000)]
    labels += [(900, None), (5000, 1)]
    df = spark.createDataFrame([(*x, 1.0, 7) for x in data], "doc_id long, text string, score double, quality int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.rate(df, lab).collect()}
    assert len(got) == 603 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    held = [i for i in range(600) if got[i]["held_out"]]
    assert held and sum(got[i]["predicted"] == int(i % 4 != 0) for i in held) >= 0.95 * len(held)
    assert got[902]["predicted"] == 0
    assert quality.rate(df.limit(0), lab).count() == 0
    both = lab.unionByName(lab.withColumn("quality", 1 - F.col("quality")))
    assert all(r["score"] == pytest.approx(0.7) for r in quality.rate(df, both).collect())  # ids with both labels teach nothing
    model = quality.fit(df.unionByName(df), lab, sample=50)
    assert np.array_equal(model.weights, quality.fit(df.unionByName(df).repartition(7), lab, sample=50).weights)
    assert all(r["score"] == pytest.approx(0.7) for r in quality.rate(df, lab.limit(0)).collect())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head><body class="page">
<header><a href=/>Site</a></header><nav><ul><li>Menu</li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use</div><div class="Ad top">Buy</div>
<main><article><header><h1>The &amp; Title&nbsp;x</h1></header><p>One <b>bold</b>
 text<br>next <a href="x">link</a>.<p>Two &lt;tag&gt; &#233;<aside>See also</aside><ul><li>i<li>j</ul><form><input value=no><label>L</label></form>
<table><tr><td>c1<td>c2</table><div id="comments"><p>nice</p></div></article></main><div role="complementary">side</div><footer>&copy; f</footer></body></html>"""


def test_html():
    assert html_extract.main_text(PAGE) == "The & Title x One bold text next link. Two <tag> é i j c1 c2"
    assert html_extract.main_text("") == html_extract.main_text(None) == ""
    assert html_extract.main_text("just text & more") == "just text & more"
    assert html_extract.main_text("<article><p>a<p>b <i>c") == "a b c"
    assert html_extract.main_text("<p>" * 5000 + "deep" + "</div>" * 10) == "deep"
    assert html_extract.main_text("<div>" * 30000 + "deep") == "deep"
    assert html_extract.main_text('<p title="a>b">x</p><p hidden>y</p><nav>z') == "x"
    assert html_extract.main_text("<nav><p>m</nav><p>body</p><article>A</article><article>B</article>") == "A B"
    assert html_extract.main_text("a < b <c") == "a < b <c"
    assert html_extract.main_text("<main><h1>T</h1><article>A</article><p>B</main><p>c") == "T A B"
    assert html_extract.main_text('<div class="menu"><p>all there is</p></div>') == "all there is"


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ('<section id="comments"><article class="comment"><p>reader says</p></article></section>', ""), ('<div><div><article class="comment">reader says</article></div></div>', ""), ('<div class="reader-comments"><p>reader says</div>', ""),
        ('<div id="user_comments">c</div>', ""), ('<ol class="commentlist"><li>c</ol>', ""), ('<div class="ad-slot-300x250">buy</div>', ""), ('<div class="sponsored-post">buy</div>', ""),
        ('<pre><span class="token comment"># code</span> x = 1</pre>', "# code x = 1"), ('<div class="discussion">We find y.</div>', "We find y."), ('<div class="footnotes">1. See z.</div>', "1. See z."), ('<div class="related content">Others did w.</div>', "Others did w."),
        ('<div class="social">Society matters.</div>', "Society matters."), ('<p>Open <span class="menu">File</span> now.', "Open File now."), ("<p>Press <button>OK</button> twice, then the <label>Name</label> box.", "Press OK twice, then the Name box."),
        ("<div><button>Share</button></div><ul><li><button>Like</button></ul>", ""), ("<form><p>Your <label>name</label></p></form>", ""), ('<p hidden>x</p><p data-hidden="1">y</p>', "y"),
    ],
)
def test_html_of_articles(inside, text):
    """What is no article goes at any depth, and what only sounds like it stays."""
    assert html_extract.main_text(f"<html><body><article><h1>T</h1><p>Body.</p>{inside}</article></body></html>") == f"T Body. {text}".strip()


@pytest.mark.parametrize("page", ["<" + "a" * 1_000_000, "<b c " * 200_000, '<b c="x' * 150_000, "<b c='x\">" * 120_000, "<a " + "b" * 1_000_000 + ">", "<a " + "b " * 500_000 + ">", "<!-- " * 200_000, '<i "><i \'>' * 110_000, "<script>" * 125_000, "<a b=" * 200_000 + ">"])
def test_html_time_is_linear(page):
    """A MB of broken markup takes seconds, whatever the kind."""
    start = time.time()
    html_extract.main_text(page)
    assert time.time() - start < 4


def test_html_broken_quotes():
    assert html_extract.main_text('<p>a<b title="x>y</b> z') == "ay z"
    assert html_extract.main_text('<p>a <i title="1 > 0">b</i> c < d <e') == "a b c < d <e"
    assert html_extract.main_text("<p>it<b don't>s</b> x") == "its x"


def test_html_keeps_titled_parts():
    """Ids of headings and sections, classes that name a neighbour, and formulas are no adverts."""
    text = '<h2 id="related-work">Related work</h2><section id="discussion">We discuss <math><mi>x</mi></math></section><h3 id=social-impact>Impact</h3>'
    assert html_extract.main_text(f"<article>{text}</article>") == "Related work We discuss x Impact"
    assert html_extract.main_text('<div class="content has-sidebar no-comments"><p>text</p></div><div class="sidebar">s</div>') == "text"
    assert html_extract.main_text('<section class="comments">c</section><h2 class="related">r</h2><p>t') == "t"
    assert html_extract.main_text('<div class="related-work">w</div><div class="notice-of-meeting">m</div><div class="cookie-bar">c</div><div id="sidebarLeft">s</div>') == "w m"


def test_html_by_site(spark):
    """Without article or main, what repeats over a host's pages goes."""
    page = lambda i: f"<body><div class=bar><p>Same bar</p></div><div class=text><p>{prose(12)} {i}</p><p>{prose(9)} {i}</p></div><div class=tail>Always</div></body>"
    html = [page(i) for i in range(12)]
    data = [(i, f"http://a.example/{i}", h) for i, h in enumerate(html)] + [(50, None, None), (51, "http://b.example/", "<p>Same bar</p><p>alone</p>"), (52, "http://a.example/x", "")]
    df = spark.createDataFrame([(*x, "q") for x in data], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert all("Same bar" not in got[i]["text"] and "Always" not in got[i]["text"] and got[i]["text"].count(f" {i}") >= 2 for i in range(12))
    assert got[51]["text"] == "Same bar alone" and got[50]["text"] == got[52]["text"] == "" and got[51]["n_chars"] == 14
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_by_site_inside_articles(spark):
    """A terms box in every article goes, the same passage in a few paragraphs stays; the tree switched off keeps both. Plain counts agree."""
    page = lambda i: f"<html><body><article><h1>{prose(4)} {i}</h1><p>{prose(12)} {i}</p><div class=terms><p>Our terms.</p><p>They hold.</p></div><p>{'Said before.' if i % 3 == 0 else prose(8)}</p></article><article><p>{prose(5)} {i}</p></article></body></html>"
    html = {i: page(i) for i in range(14)}
    same = "<html><body><article><h1>One</h1><p>text of all pages</p></article></body></html>"
    data = [(i, f"http://A.example/{i}", h) for i, h in html.items()] + [(100 + i, f"http://copies.example/{i}", same) for i in range(6)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    off = {r["page_id"]: r["text"] for r in html_extract.extract(df, least_pages=1 << 30).collect()}
    assert all("terms" not in got[i] and "Our terms. They hold." in off[i] for i in html)
    assert all("Said before." in got[i] for i in html if i % 3 == 0)
    assert all(got[100 + i] == off[100 + i] == "One text of all pages" for i in range(6))
    low = brute.weak_places(html)
    assert low and {i: brute.main_text(h, low) for i, h in html.items()} == {i: got[i] for i in html}


def test_html_deep_and_large(spark):
    """Time in proportion to the page, and hosts joined in salted parts."""
    deep = "<div>" * 30000 + "deep" + "</p>" * 30000
    data = [(i, "http://a.example/", deep) for i in range(2)] + [(9, "http://a.example/9", "x" * 2_000_000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in html_extract.extract(df).collect()) == [4, 4, 2_000_000]
    start = time.time()
    assert len(html_extract.places(deep)) > 30000 and time.time() - start < 5


def test_html_salted(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "BROADCAST_IDS", 0)
    test_html_by_site(spark)


def test_html_by_site_keeps_what_differs(spark):
    """A constant layout of many blocks around differing texts stays; one page alone with many equal cells, too."""
    body = lambda i: "<div class=wrap>" + "".join(f"<p>{prose(6)} {i} {k}</p>" for k in range(12)) + "</div>"
    table = lambda i: "<table>" + "".join(f"<tr><td>value {i} {k}</td></tr>" for k in range(10)) + "</table>"
    page = lambda i: f"<body><div class=bar><ul>{'<li>Same bar</li>' * 9}</ul></div>{body(i)}{table(i)}</body>"
    data = [(i, f"http://a.example/{i}", page(i)) for i in range(9)]
    cells = "".join(f"<td>{'yes' if k % 2 else 'no'}</td>" for k in range(100))
    data += [(50, "http://b.example/", f"<table><tr>{cells}</tr></table>")] * 5
    got = html_extract.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    for i in range(9):
        assert all(f" {i} {k}" in texts[i] and f"value {i} {k}" in texts[i] for k in range(10)) and "Same bar" not in texts[i]
    assert len(got) == 14 and texts[50].split() == ["no", "yes"] * 50


def test_missing_ids(spark):
    df = spark.createDataFrame([(None, PASSAGE, "a", "en"), (1, PASSAGE, "a", "en"), (None, "x y z", None, None)], "doc_id long, text string, source string, lang string")
    removed = len(PASSAGE.encode())
    by = lambda out, c: sorted(((r["doc_id"], r[c]) for r in out.collect()), key=repr)
    assert by(suffix_dedup.remove_repeats(df), "n_removed") == [(1, 0), (None, 0), (None, removed)]
    assert by(substring_dedup.remove_repeated_windows(df), "n_removed") == [(1, 0), (None, 0), (None, 80)]
    assert by(exact_dedup.deduplicate(df), "kept") == [(1, True), (None, False), (None, False)]
    assert by(simhash_dedup.near_duplicates(df), "component_id") == [(1, 1), (None, 1), (None, None)]
    assert len(by(mixing.mix(df), "taken")) == len(by(language_id.identify(df), "lang_pred")) == len(by(sentencepiece_codec.encode_decode(df, tokenizer_path()), "n_tokens")) == 3
    assert len(by(quality.rate(df, df.select("doc_id", F.lit(1).alias("quality"))), "predicted")) == 3
    v = spark.createDataFrame([(None, [1.0], 1), (3, [1.0], 1), (4, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(v).collect()), key=repr) == [(3, 1, 3, True), (4, 1, 3, False), (None, 0, None, False)]
    pages = spark.createDataFrame([(None, None, "<p>a")], "page_id long, url string, html string")
    assert [tuple(r) for r in html_extract.extract(pages).collect()] == [(None, None, "a", 1)]
