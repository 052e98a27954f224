"""Hard negatives, lexical search and URL filters against plain versions, on awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchwell.llm import hard_negatives, lexical_search, url_filter

r = random.Random(11)


def plain_negatives(rows, asks, positives=5, negatives=3):
    """rows: distinct (id, label, vector)."""
    ok = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, lab, v in rows if lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda s, j: (-s, j is None, j)
    out = []
    for i, lab, q in ok:
        if i is None or not asks(i):
            continue
        scored = [(max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, x)))), j, other) for j, other, x in ok if j != i and len(x) == len(q)]
        best = sorted(((s, j) for s, j, other in scored if other == lab), key=lambda x: order(*x))[:positives]
        for s, j in best:
            far = sorted(((t, k) for t, k, other in scored if other != lab and 50 * s <= 100 * t <= 95 * s), key=lambda x: order(*x))[:negatives]
            out += [(i, j, n, k, s, t) for n, (t, k) in enumerate(far, 1)]
    return Counter(out)


def vectors():
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    rows = []
    for i in range(180):
        c = r.choice(centres)
        rows.append((i, r.randint(0, 3), [x + r.gauss(0, 0.4) for x in c]))
    rows += [(200 + k, 1, rows[6][2]) for k in range(30)]  # copies: ties by id
    rows += [(300, None, [1.0] * 12), (301, 1, None), (302, 1, []), (303, 1, [1.0, None]), (304, 2, [float("nan")] * 12), (305, 2, [float("inf")] + [0.0] * 11), (306, 0, [0.0] * 12)]
    rows += [(310, 0, [1.0, 2.0]), (311, 0, [1.0, 2.5]), (312, 1, [1.0, 1.0]), (315, 1, [2.0]), (None, 1, rows[6][2]), (None, 2, rows[9][2])]
    rows += [(320, 3, [3e35, -2e30] + [0.0] * 10), (325, 3, [3e35, 1.0] + [0.0] * 10), (330, 2, [2.5e35] + [0.0] * 11)]
    return rows


@pytest.fixture(scope="module")
def embeddings(spark):
    rows = vectors()
    return rows, spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("key", F.lit(1)).withColumn("tile", F.lit("x")).withColumn("score", F.lit(2.0)).repartition(4)


@pytest.mark.parametrize(("tile", "block", "at_once"), [(1 << 19, 1 << 17, 4096), (300, 200, 7)])
def test_hard_negatives(embeddings, monkeypatch, tile, block, at_once):
    rows, df = embeddings
    for name, value in (("TILE", tile), ("BLOCK", block), ("AT_ONCE", at_once)):
        monkeypatch.setattr(hard_negatives, name, value)
    want = plain_negatives(rows, lambda i: i % 5 == 0)
    got = Counter(tuple(x) for x in hard_negatives.mine(df, F.col("vec_id") % 5 == 0).collect())
    assert got == want and len(want) > 100 and any(k[0] >= 310 for k in want)
    twice = hard_negatives.mine(df.unionByName(df.filter("vec_id < 40")), F.col("vec_id") % 5 == 0)
    assert Counter(tuple(x) for x in twice.collect()) == want


def test_hard_negatives_of_nothing(embeddings):
    _, df = embeddings
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0
    assert hard_negatives.contract(df.filter("vec_id = 50")).count() == 0


def test_bounds_hold():
    """Segment summaries bound every product, at both levels and at any length of a vector."""
    g = np.random.default_rng(3)
    for dim in (1, 3, 4, 15, 16, 17, 64, 100):
        x, y = np.floor(g.normal(0, 60, (40, dim))), np.floor(g.normal(5, 90, (40, dim)))
        for n in hard_negatives.LEVELS:
            a, b = hard_negatives.summary(x, n), hard_negatives.summary(y, n)
            half = a.shape[1] // 2
            mean, more = a[:, :half] @ b[:, :half].T, a[:, half:] @ b[:, half:].T
            assert (np.abs(x @ y.T - mean) <= more + 1e-6).all()


def test_bounds_prune():
    """On clustered vectors most rows are never scored exactly."""
    g = np.random.default_rng(4)
    centres = g.normal(0, 1, (8, 16)).repeat(4, axis=1)
    which = g.integers(0, 8, 4000)
    x = np.floor(256 * (centres[which] + g.normal(0, 0.05, (4000, 64))))
    side = hard_negatives.Side.__new__(hard_negatives.Side)
    side.ids, side.labels, side.codes = np.arange(4000), which % 2, x
    side.coarse, side.fine = (hard_negatives.summary(x, n) for n in hard_negatives.LEVELS)
    side.largest, side.length = np.abs(x).max(axis=1), np.sqrt((x * x).sum(axis=1))
    scored, product = [], hard_negatives.product
    hard_negatives.product = lambda a, b, most: scored.append(len(a)) or product(a, b, most)
    try:
        hard_negatives.search(side, side, [[hard_negatives.Best(5)] if i < 50 else [] for i in range(4000)], True)
    finally:
        hard_negatives.product = product
    assert sum(scored) < 0.5 * 50 * 2000


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_search(docs, items, k=10):
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    tfs = [(i, c) for i, c in tfs if c]
    n, total = len(tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in tfs:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((s, i))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out += [(item, rank, i, s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return Counter(out)


WORDS = ["".join(r.choice("abcdé9") for _ in range(r.randint(1, 4))) for _ in range(150)]
DOCS = [(i, " ".join(r.choice(WORDS) for _ in range(r.choice([1, 5, 40, 200])))) for i in range(120)]
DOCS += [(200 + i, DOCS[3][1]) for i in range(25)] + [(300, None), (301, ""), (302, "-- !?"), (303, "ABC_Éab\x1cc"), (None, DOCS[5][1]), (7, "other text of a repeated id"), (304, " ".join(WORDS) * 60), (305, "x" * 5000)]
ITEMS = [(i, " ".join(r.choice(WORDS) for _ in range(12))) for i in range(15)] + [(20, DOCS[3][1]), (21, None), (22, ""), (23, "nowhere"), (24, (WORDS[0] + ", ") * 9), (None, DOCS[8][1]), (25, DOCS[8][1]), (25, "x" * 5000), (26, "abc éab É")]


@pytest.mark.parametrize(("batch", "postings", "step", "slots", "piece"), [(4 << 20, 1 << 18, 64, 1024, 1 << 20), (300, 40, 3, 8, 30)])
def test_lexical_search(spark, monkeypatch, batch, postings, step, slots, piece):
    for name, value in (("BATCH", batch), ("POSTINGS", postings), ("STEP", step), ("SLOTS", slots), ("SLICE", piece)):
        monkeypatch.setattr(lexical_search, name, value)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS], "doc_id long, text string, n int, nth string").repartition(4)
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, rank int, key string")
    assert Counter(tuple(x) for x in lexical_search.search(docs, items).collect()) == plain_search(DOCS, ITEMS)
    assert lexical_search.search(docs.limit(0), items).count() == 0 == lexical_search.search(docs, items.limit(0)).count()
    twice = lexical_search.search(docs, items.unionByName(items), k=3)
    assert Counter(tuple(x) for x in twice.collect()) == plain_search(DOCS, ITEMS * 2, 3)


def test_bounds_spare_documents():
    """Documents whose sketch can't reach the tenth best are not scored."""
    queries = lexical_search.Queries([b"rare common common"])
    queries.weight[:] = [9000, 700]
    n, docs = np.full(500, 50), 500
    counts = [(1, 1) if i % 20 == 0 else (0, 1 + i % 3) for i in range(500)]
    terms_, tfs, ends = [], [], []
    for rare, common in counts:
        terms_ += [0] * (rare > 0) + [1]
        tfs += [rare] * (rare > 0) + [common]
        ends.append(len(terms_))
    portion = lexical_search.Portion(np.arange(500), n, np.array(ends), np.array(terms_), np.array(tfs, np.int64), queries, docs, 500 * 50)
    scored, scores = [], portion.scores
    portion.scores = lambda which, times: scored.append(len(which)) or scores(which, times)
    top, times = lexical_search.Top(10), np.zeros(2, np.int64)
    times[queries.terms[0]] = queries.times[0]
    lexical_search.rescored(portion, (queries.lookups() @ portion.sketches(queries.slot))[0], times, top)
    assert sum(scored) < 100 and set(top.ids) <= set(range(0, 500, 20))


def plain_host(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")


def plain_rule(host, path, rules):
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def plain_domain(host):
    name = re.sub(r"\.?(:[0-9]*)?$", "", re.sub(r"^.*@", "", host, flags=re.S))
    if re.search(r"^[0-9.]+$|[\[\]:]", name):
        return name, ""
    parts = name.split(".")
    n = 2 if len(parts) > 1 and parts[-2] in url_filter.SECOND and re.fullmatch("[a-z][a-z]", parts[-1]) else 1
    return ".".join(parts[-n - 1 :]), ".".join(parts[-n:])


def plain_low(outcomes):
    """Lower bounds by host, level by level."""
    hosts = defaultdict(lambda: [0, 0])
    for h, n, bad in outcomes:
        hosts[h or ""][0] += n
        hosts[h or ""][1] += bad
    domains, suffixes = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for h, x in hosts.items():
        d, s = plain_domain(h)
        for k in (0, 1):
            domains[d, s][k] += x[k]
            suffixes[s][k] += x[k]
    every = (sum(x[1] for x in hosts.values()) + 1) / (sum(x[0] for x in hosts.values()) + 2)

    def level(counts, prior):
        rows = [(n, bad, prior(k)) for k, (n, bad) in counts.items() if n]
        extra, free = sum(n * (bad / n - m) ** 2 - m * (1 - m) for n, bad, m in rows), sum(m * (1 - m) * (n - 1) for n, _, m in rows)
        rho = extra / free if free > 0 else 0
        c = max(1 / rho - 1, url_filter.LEAST) if rho > 1 / (url_filter.MOST + 1) else url_filter.MOST
        return {k: ((bad + c * prior(k)) / (n + c), n + c) for k, (n, bad) in counts.items()}

    s = level(suffixes, lambda k: every)
    d = level(domains, lambda k: s[k[1]][0])
    return {h: m - 3 * math.sqrt(m * (1 - m) / (w + 1)) for h, (m, w) in level(hosts, lambda k: d[plain_domain(k)][0]).items()}


URLS = [
    None, "", "no scheme/en/", "://x.net/es/", "http://", "http:///p", "HTTP://WWW.Example.COM/en/1", "http://example.com/en/", "http://example.com/EN/", "http://a.www.example.com/en/x?y=/fr/", "https://xexample.com/en/", "http://com/en", "http://a.net/es/#/fr/", "http://a.net/es",
    "http://a.net?x://b.com/", "http://u:p@good.co.uk:80/a", "http://GOOD.co.uk./a", "http://10.0.0.1/a", "http://[::1]:8/a", "http://é.ÉX.org/a\nb", "x" * 9000 + "://spam.org/" + "y" * 9000, "http://" + "a." * 300 + "bad.org/",
]


def test_url_filter(spark):
    rules = [*url_filter.RULES, ("bad.org", "/fine", "allow"), ("bad.org", "/fine", "block"), ("x.net", "", "block")]
    urls = URLS + [f"http://{h}/{i}" for h in ("m.bad.org", "www.bad.org", "bad.org", "new.bad.org", "fine.org", "m.fine.org", "co.uk", "b.co.uk") for i in ("1", "fine")] + ["http://hot.org/1"] * 400
    outcomes = [("m.bad.org", 30, 29), ("www.bad.org", 25, 25), ("bad.org", 10, 10), ("bad.org", 3, 3), ("fine.org", 40, 1), ("m.fine.org", 50, 3), ("hot.org", 100, 2), (None, 1, 0), ("good.co.uk:80", 5, 0), ("b.co.uk", 3, 3), ("a.com", 60, 4), ("b.com", 60, 5), ("empty.org", 0, 0)]
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(urls)] + [(None, "http://bad.org/", 1, "x")], "page_id long, url string, n int, host string").repartition(3)
    known = spark.createDataFrame(outcomes, "host string, n long, bad long")
    low = plain_low(outcomes + [(plain_host(u)[0], 0, 0) for u in [*urls, "http://bad.org/"]])
    want = []
    for i, u in [*enumerate(urls), (None, "http://bad.org/")]:
        host, path = plain_host(u)
        rule, verdict = plain_rule(host, path, rules)
        want.append((i, host, path, rule, verdict or ("block" if low[host] > 0.5 else "allow"), round(low[host], 9)))
    got = [(*tuple(x)[:5], round(x["low"], 9)) for x in url_filter.judge(pages, known, rules).collect()]
    assert Counter(got) == Counter(want)
    by_host = {x[1]: x[4] for x in want if x[3] is None}
    assert by_host["new.bad.org"] == by_host["m.bad.org"] == "block" and by_host["m.fine.org"] == by_host["hot.org"] == "allow"
    assert url_filter.judge(pages.limit(0), known, rules).count() == 0
    assert {x["verdict"] for x in url_filter.judge(pages, known.limit(0)).collect()} == {"allow"}


def test_labelled_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/en/5?x"), (2, "http://a.org/5.html"), (3, "http://A.org/6/"), (4, "http://a.org/7#top"), (5, "http://a.org/x"), (6, None), (7, "http://b.org/8"), (8, "http://b.org/" + "9" * 30), (9, "http://b.org/9")], "page_id long, url string")
    labels = spark.createDataFrame([(5, 0, 0), (6, 1, 1), (7, 1, 0), (8, 1, 0), (8, 0, 0), (9, None, None), (None, 0, 0), (5, 0, None)], "doc_id long, quality int, toxic int")
    assert sorted(tuple(x) for x in url_filter.labelled(pages, labels).collect()) == [("a.org", 4, 3)]
    assert url_filter.labelled(pages, labels.limit(0)).count() == 0
