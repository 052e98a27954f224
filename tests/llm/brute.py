"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import xxhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def cosines(rows, threshold=0.93):
    """rows of (vec_id, embedding, label): vec_id -> (n_links, component)."""
    ok = [(i, np.array(e, float), lab) for i, e, lab in rows if lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = [(a, b) for k, (a, x, p) in enumerate(ok) for b, y, q in ok[k + 1 :] if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold]
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = components([r[0] for r in rows], links)
    return {i: (n[i], comp[i]) for i in comp}


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UPPER)].append(i)
    return sorted((i, max(g), len(g), i == max(g), sha(t.encode())) for t, g in groups.items() for i in g)


def removed(tokens, length=50):
    """tokens: doc_id -> sequence; doc_id -> which tokens go."""
    first = {}
    for d in sorted(tokens):
        for i in range(len(tokens[d]) - length + 1):
            first.setdefault(tuple(tokens[d][i : i + length]), d)
    out = {}
    for d, t in tokens.items():
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if first[tuple(t[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out[d] = gone
    return out


def suffix(rows):
    tokens = {i: (t or "").encode() for i, t in rows}
    out = []
    for d, gone in removed(tokens).items():
        kept = bytes(x for x, g in zip(tokens[d], gone, strict=True) if not g)
        out.append((d, len(gone), sum(gone), len(re.findall("1+", "".join("01"[g] for g in gone))), sha(kept)))
    return sorted(out)


def substring(rows):
    tokens = {i: (t or "").encode().split() for i, t in rows}
    return sorted((d, len(g), sum(g), sha(b" ".join(x for x, y in zip(tokens[d], g, strict=True) if not y))) for d, g in removed(tokens).items())


def simhash(text, width=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + width]), 42) for k in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(rows, budget=4):
    prints = {i: simhash(t) for i, t in rows}
    ids = sorted(prints)
    x = np.array([prints[i] for i in ids], np.uint64)
    close = np.bitwise_count(x[:, None] ^ x[None, :]) <= budget
    comp = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(close, 1)), strict=True)])
    return sorted((i, f"{prints[i]:016x}", comp[i]) for i in ids)


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(5, 2, 1), most=3):
    """source -> size: source -> target, sharing again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, left, rest = {}, set(names), float(sum(sizes.values()))
    while left:
        level = rest / sum(w[s] for s in left)
        over = {s for s in left if level * w[s] > most * sizes[s]}
        if not over:
            return goal | {s: level * w[s] for s in left}
        for s in over:
            goal[s] = float(most * sizes[s])
            rest -= goal[s]
        left -= over
    return goal


class Tree(HTMLParser):
    """Pages of few elements as nested lists: [name, classes, children]; a block ends open inline elements and a paragraph."""

    def __init__(self, html):
        super().__init__()
        self.top = self.here = ["", "", []]
        self.path = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        while tag not in INLINE and self.here[0] in INLINE | {"p"}:
            self.here = self.path.pop()
        e = [tag, " ".join(sorted((dict(attrs).get("class") or "").split())), []]
        self.here[2].append(e)
        if tag not in ("meta", "br", "link"):
            self.path.append(self.here)
            self.here = e

    def handle_endtag(self, tag):
        if tag in [e[0] for e in [*self.path, self.here]]:
            while self.here[0] != tag:
                self.here = self.path.pop()
            self.here = self.path.pop()

    def handle_data(self, data):
        self.here[2].append(data)


INLINE, GONE, GONE_CLASSES = {"a", "b", "i", "em", "span", "br"}, {"head", "nav", "footer", "header", "aside", "script", "style", "form"}, {"ad", "comments", "sidebar"}


def _gone(e):
    return e[0] in GONE or bool(GONE_CLASSES & set(e[1].split()))


def _text(e, low, path=()):
    """Block texts under e."""
    out, now = [], ""
    path = (*path, (e[0], e[1]))
    for c in e[2]:
        if isinstance(c, str):
            now += c
        elif c[0] == "br":
            now += "\n"
        elif not _gone(c) and (*path, (c[0], c[1])) not in low:
            inner = _text(c, low, path)
            if c[0] in INLINE:
                now += inner[0] if inner else ""
            else:
                out += [now, *inner]
                now = ""
    return [t for t in (" ".join(x.split()) for x in [*out, now]) if t] if e[0] not in INLINE else [now]


def _counted(e, path, around, found):
    path = (*path, (e[0], e[1]))
    block = e[0] not in INLINE | {"", "html", "body"}
    own, inner = "", []
    for c in e[2]:
        if isinstance(c, str):
            own += c
        elif not _gone(c) and c[0] != "br":
            got = _counted(c, path, path if block else around, found)
            inner += got[1]
            own += got[0] if c[0] in INLINE else " "
        else:
            own += " "
    own = " ".join(own.split())
    if not block:
        return own, inner
    if own or inner:
        found.append((path, around, tuple(inner), own))
        return own, [e[0]]
    return own, []


def weak_places(pages, low=0.4, least=4):
    """Of one site's pages {page: html}: paths to drop. Copies of a page count once."""
    pages = {html: html for html in pages.values()}
    at = defaultdict(lambda: defaultdict(set))
    for page, html in pages.items():
        found = []
        _counted(Tree(html).top, (), None, found)
        for path, around, inner, own in found:
            at[path]["pages"].add(page)
            at[path]["layouts"].add((page, inner))
            at[path]["around"] = around
            if own:
                at[path]["texts"].add((page, own))
    value, strong, weak = {}, set(), set()
    for path in sorted(at, key=len, reverse=True):
        x, m = at[path], len(at[path]["pages"])
        count = lambda pairs: Counter(v for _, v in pairs)
        one = lambda f: 1.0 if m < 2 else f / math.log(m)
        content = None
        if x["texts"]:
            n = count(x["texts"]).values()
            content = 1.0 if m < 2 else 1 - sum(map(math.log, n)) / len(n) / math.log(m)
        n = count(x["layouts"])
        every = sum(n.values())
        layout = min(1.0, one(math.log(every) - sum(v * math.log(v) for v in n.values()) / every)) if m > 1 else 1.0
        below = [value[p] for p in at if at[p]["around"] == path and p != path]
        v = content or 0.0
        if below:
            decay = 0.9 ** (sum(len(layout) for _, layout in x["layouts"]) / every)
            v = (1 - decay) * layout + decay * (sum(below) + v) / (len(below) + (content is not None))
        value[path] = v if m > 1 else 1.0
        if value[path] >= low or (content or 0.0) >= low or path in strong:
            strong.add(x["around"])
        elif m >= least:
            weak.add(path)
    return weak


def main_text(html, low=frozenset()):
    top, found = Tree(html).top, []

    def find(e, path):
        path = (*path, (e[0], e[1]))
        for c in e[2]:
            if not isinstance(c, str) and not _gone(c):
                if c[0] == "article":
                    found.append((c, path))
                else:
                    find(c, path)

    find(top, ())
    text = lambda low: " ".join(t for e, p in found or [(top, ())] for t in _text(e, low, p))
    got, whole = text(low), text(frozenset())
    return got or whole


def _grams(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        w = f" {word} "
        out.update(c for c in word)
        out.update(w[i : i + 2] for i in range(len(w) - 1))
        out.update(w[i : i + 3] for i in range(len(w) - 2))
    return out


def _ranked(counts, top):
    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return {g: r for r, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:top])}


def languages(rows, top=300):
    """rows of (doc_id, text, lang): (doc_id, held_out, lang_pred, score)."""
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if not held[i] and text is not None and lang is not None:
            counts[lang] += _grams(text)
    profiles = {lang: _ranked(c, top) for lang, c in counts.items()}
    out = []
    for i, text, _ in rows:
        own = _ranked(_grams(text or ""), top)
        far = {lang: sum(abs(p[g] - r) if g in p else top for g, r in own.items()) for lang, p in profiles.items()} if own else {}
        best = min(far, key=lambda lang: (far[lang], lang), default="und")
        out.append((i, held[i], best, 1 - far[best] / (top * len(own)) if far else 0.0))
    return sorted(out)


def _share(n, of):
    return n / of if of else 0.0


def quality_features(text):
    """Of a text's bytes: shares of classes and symbols, word lengths, repetition, one by one."""
    symbols = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    t = (text or "").encode()
    if not t:
        return [0.0] * (len(symbols) + 15)
    n, words = len(t), t.split()
    m = max(1, len(words))
    count = lambda low, high: sum(low <= b <= high for b in t)
    upper, lower = count(65, 90), count(97, 122)
    half, rest = set(words[: m // 2]), set(words[m // 2 :])
    return [
        _share(upper, max(1, upper + lower)), lower / n, count(48, 57) / n, count(128, 255) / n, math.log(1 + m), math.log(1 + n) / 10, (n - m + 1) / m / 10, len(set(words)) / m, max((words.count(w) for w in set(words)), default=0) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m, sum(w[-1] < 48 or 58 <= w[-1] <= 64 for w in words) / m, sum(65 <= w[0] <= 90 for w in words) / m, t.count(b"\n") / n * 10, len(half & rest) / max(1, len(half)) if m >= 8 else 0.0, float(m < 5),
        *[math.log(1 + 100 * t.count(bytes([c])) / n) for c in symbols],
    ]


def qualities(docs, labels):
    """(doc_id, held out, score, predicted): Bradley-Terry on the same drawn pairs, by reweighted least squares."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    told = defaultdict(set)
    for i, q in labels:
        if q in (0, 1) and i is not None and not held(i):
            told[i].add(q)
    rows = sorted((i, quality_features(t), q) for i, t in docs for q in told.get(i, ()) if len(told[i]) == 1)
    x, good = np.array([r[1] for r in rows]), np.array([r[2] == 1 for r in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    rng = np.random.default_rng(7)
    d = z[rng.choice(np.flatnonzero(good), 100_000)] - z[rng.choice(np.flatnonzero(~good), 100_000)]
    w, n = np.zeros(d.shape[1]), len(d)
    for _ in range(60):
        p = 1 / (1 + np.exp(-d @ w))
        v = p * (1 - p)
        target = d @ w + (1 - p) / np.maximum(v, 1e-13)  # the working response of a logistic fit whose outcomes are all 1
        new = np.linalg.solve((d * v[:, None]).T @ d + 1e-3 * n * np.eye(len(w)), (d * v[:, None]).T @ target)
        w, moved = new, np.abs(new - w).max()
        if moved < 1e-9:
            break
    ranked = sorted(z @ w)
    at = (1 - good.mean()) * (len(ranked) - 1)
    cut = ranked[int(at)] + (at - int(at)) * (ranked[min(int(at) + 1, len(ranked) - 1)] - ranked[int(at)])
    score = lambda t: 1 / (1 + math.exp(-max(-30.0, min(30.0, float((np.array(quality_features(t)) - mean) / scale @ w) - cut + math.log(0.7 / 0.3)))))
    return [(i, held(i), s, int(s >= 0.7)) for i, t in docs for s in [score(t)]]
