"""Main text of web pages by site style trees.

Every page is read into elements. Pages of one host are merged: an element's place in the merged
tree is its path of tags and classes, kept as a 64-bit hash. Spark counts, for each place, the pages
that have it, the different layouts of its blocks (presentation) and the different texts outside
them (content). From the leaves up, the importance of a place is 1 less the mean entropy of its texts
(a text on every page counts 1, a text on one page 0); where it has blocks, the mean of that and of
their importance, mixed by their number with the entropy of its layouts to the base of its pages.
Branches of low importance are removed from each page, inside articles too, but for those with an
important place in them. What no count can tell is told by the page itself: elements that say what
they are (nav, footer, forms, ...) and class names made of nothing but such words (advert, cookie-bar)
go, whatever the counts say, since an advert may differ on every page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import BROADCAST_IDS, portions, store

#: Places below this importance go, if at least so many pages of the host have them.
LOW, PAGES = 0.4, 4
#: Decay of a place's own presentation against its content, by children.
GAMMA = 0.9
#: Copies of a large table of places, so that a host with many pages is joined in as many parts.
SALTS = 32

# Element names and class words.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "label", "fieldset", "dialog", "menu", "svg", "canvas", "audio", "video", "object", "map", "datalist"} | RAW
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "button", "label"}
MAIN = {"article", "main"}
TITLED = {"section", "h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu", "menubar", "status"}
UNWANTED = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "paywall", "popup", "promo", "promoted", "promotion", "related", "replies", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets"}
COMMENTS = {"comment", "comments", "commentlist", "replies", "respond", "disqus"}
# Unwanted outside an article; inside it they may name a part of it.
OUTSIDE = {"related", "social"}
# What may stand beside an unwanted word in a class or id that still says nothing else.
AROUND = {"area", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "desktop", "form", "global", "group", "header", "holder", "id", "inner", "item", "items", "left", "links", "list", "main", "mobile", "outer", "page", "panel", "policy", "primary", "rail", "right", "row", "secondary", "section", "site", "slot", "sticky", "top", "unit", "wrap", "wrapper", "zone", "post", "posts", "story", "stories", "card", "cards", "frame", "placeholder", "leaderboard", "rectangle", "native", "google", "reader", "readers", "user", "users", "visitor", "visitors", "guest", "thread", "threads", "count", "author", "body", "text", "meta", "x"}
# Classes that tell what an element has beside it, not what it is.
STATE = re.compile(r"(?:has|no|with|without)[-_]", re.I)
# An open element of the first kind ends where one of its set begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

TOKENS = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)|[^<]+|<", re.S)
# The rest of a tag, by the quotes that count: both, one kind, none.
RESTS = {quotes: re.compile("(?:[^>" + quotes + "]++" + "".join(f"|{q}[^{q}]*+{q}" for q in quotes) + ")*+") for quotes in ("\"'", '"', "'", "")}
ATTRIBUTE = re.compile(r"([^\s=\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}
HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


class Element:
    __slots__ = ("children", "drop", "name", "parent", "place")

    def __init__(self, name: str, parent: Element | None, place: int, drop: int) -> None:
        self.name, self.parent, self.place, self.drop = name, parent, place, drop
        self.children: list = []


#: Why an element is dropped: its name, role or state; or its class words.
BY_NAME, BY_CLASS = 2, 1


def unwanted(token: str, names: set[str]) -> bool:
    """A class name or id of unwanted words and those that may stand around them: cookie-bar, but not related-work."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if w]
    return not names.isdisjoint(words) and all(w in UNWANTED or w in COMMENTS or w in AROUND for w in words)


def in_sentence(parent: Element) -> bool:
    """What comes next follows words of the same block."""
    while True:
        if any(isinstance(c, str) and c.strip() for c in parent.children):
            return True
        if parent.name not in INLINE or parent.parent is None:
            return False
        parent = parent.parent


def opened(name: str, attributes: str, parent: Element, in_main: bool) -> Element:
    said, mark, hidden = False, "", False
    if attributes:
        names = set() if name in INLINE or name in ("body", "html") else COMMENTS if name in MAIN else UNWANTED | COMMENTS if not in_main else (UNWANTED - OUTSIDE) | COMMENTS
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                mine = names & COMMENTS if key == "id" and name in TITLED else names  # an id of a heading or section is its title
                said |= any(unwanted(v, mine) for v in value.split() if not STATE.match(v))
                if key == "class":
                    mark = "." + " ".join(sorted(value.split()))
            elif key == "role" and value.lower() in ROLES:
                hidden = True
            hidden |= key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value, re.I) is not None) or (key == "aria-hidden" and value == "true")
    by_name = name in DROPPED and not (name in ("button", "label") and in_sentence(parent))
    drop = BY_NAME if by_name or hidden or (name == "header" and not in_main) else BY_CLASS if said else 0
    return Element(name, parent, xxhash.xxh64_intdigest(name + mark, parent.place), drop)


def parsed(html: str) -> Element:
    """The page's tree. Unclosed elements end with their parent; stray end tags are ignored.

    A tag without its > is text. Where a quote in a tag isn't closed, or a > is only in quotes, that kind of quote means
    nothing from there on, so each kind is looked for in vain once, and the time is in proportion to the page.
    """
    top = here = Element("", None, 0, 0)
    mains, at = 0, 0
    inside: dict[str, int] = {}  # open elements by name, so that a stray end tag costs nothing
    find, closing, quotes = TOKENS.match, html.rfind(">"), "\"'"
    while (m := find(html, at)) is not None:
        at = m.end()
        name = m[2]
        if name is None or at > closing:
            t = m[0]
            if name is not None or t[:2] not in ("<!", "<?"):
                here.children.append(t)
            continue
        end = RESTS[quotes].match(html, at).end()
        while html[end : end + 1] != ">":
            stuck = html[end : end + 1]
            quotes = quotes.replace(stuck, "") if stuck else ""
            end = RESTS[quotes].match(html, at).end()
        attributes, at = html[at:end], end + 1
        name = name.lower()
        if m[1]:
            if inside.get(name):
                while True:
                    closed, here = here, here.parent
                    inside[closed.name] -= 1
                    mains -= closed.name in MAIN
                    if closed.name == name:
                        break
            continue
        if name == "body":
            while here.name in ("head", "meta", "link"):
                inside[here.name] -= 1
                here = here.parent
        e = here
        if name not in INLINE and name not in VOID:
            while e is not top and e.name in INLINE:
                e = e.parent
            last = e if e.name == "p" or name in ENDS.get(e.name, ()) else None
            if last is not None and name == "tr" and e.name in ("td", "th") and e.parent.name == "tr":
                last = e.parent
            while last is not None and here is not last.parent:
                inside[here.name] -= 1
                here = here.parent
        new = opened(name, attributes, here, mains > 0)
        here.children.append(new)
        if name in RAW:
            end = RAW_END[name].search(html, at)
            at = end.end() if end else len(html)
        elif name not in VOID and not attributes.endswith("/"):
            here = new
            inside[name] = inside.get(name, 0) + 1
            mains += name in MAIN
    return top


def blocks(e: Element, low: frozenset[int], drop: int, out: list[list[str]]) -> None:
    """Texts of the blocks under `e`, in page order, without low branches and those dropped for reasons from `drop` up."""
    work = [(e, 0)]
    while work:
        node, i = work.pop()
        if i == 0 and node.name not in INLINE:
            out.append([])
        children = node.children
        while i < len(children):
            c = children[i]
            i += 1
            if isinstance(c, str):
                out[-1].append(c)
            elif c.name == "br":
                out[-1].append("\n")
            elif c.drop < drop and c.place not in low:
                work.append((node, i))
                work.append((c, 0))
                break
        else:
            if node.name not in INLINE:
                out.append([])


def joined(parts: list[Element], low: frozenset[int] = frozenset(), drop: int = BY_CLASS) -> str:
    out: list[list[str]] = []
    for e in parts:
        out.append([])
        blocks(e, low, drop, out)
    texts = (" ".join(unescape("".join(b)).split()) for b in out if b)
    return " ".join(t for t in texts if t)


def bodies(top: Element) -> list[Element]:
    """The page's main elements that hold text, else its outermost articles, else none."""
    mains, articles = [], []
    work = [(top, False, False)]
    while work:
        e, in_main, in_article = work.pop()
        if e.name == "main" and not in_main:
            mains.append(e)
        if e.name == "article" and not in_article:
            articles.append(e)
        in_main, in_article = in_main or e.name == "main", in_article or e.name == "article"
        work.extend((c, in_main, in_article) for c in reversed(e.children) if isinstance(c, Element) and not c.drop)
    mains = [e for e in mains if joined([e])]
    return mains or articles


def main_text(html: str | None, low: frozenset[int] = frozenset()) -> str:
    """Main text of one page; `low`: places of low importance on its host.

    Where nothing would be left the tree, then the class words don't count.
    """
    if not html:
        return ""
    top = parsed(html)
    found = bodies(top)
    return joined(found or [top], low) or joined(found or [top]) or joined(found or [top], drop=BY_NAME)


def own_text(e: Element) -> str:
    """Text of `e` outside its blocks: its own and that of its inline elements."""
    out, work = [], list(reversed(e.children))
    while work:
        c = work.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.name in INLINE and not c.drop:
            work.extend(reversed(c.children))
        else:
            out.append(" ")
    return " ".join("".join(out).split())


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def places(html: str | None) -> set[tuple[int, int, bool, int, int]]:
    """(place, parent place, is text, layout or text hash, blocks) of the block elements that hold text and aren't dropped already; each element is looked at once."""
    if not html:
        return set()
    found: list[tuple[Element, int, list[str], str]] = []  # element, index of the block around it, its blocks with text, own text
    work = [(parsed(html), -1)]
    while work:
        e, around = work.pop()
        if e.parent is not None and e.name not in ("html", "body") and e.name not in INLINE:
            found.append((e, around, [], own_text(e)))
            around = len(found) - 1
        work.extend((c, around) for c in e.children if isinstance(c, Element) and not c.drop and c.name not in VOID)
    out = set()
    for e, around, inner, text in reversed(found):  # blocks before what is around them
        if not (text or inner):
            continue
        parent = 0
        if around >= 0:
            parent = found[around][0].place
            found[around][2].append(e.name)
        place, parent = signed(e.place), signed(parent)
        out.add((place, parent, False, xxhash.xxh64_intdigest(" ".join(inner)) >> 1, len(inner)))
        if text:
            out.add((place, parent, True, xxhash.xxh64_intdigest(text) >> 1, 0))
    return out


def composite(group: pa.Table, low: float, least_pages: int) -> list[int]:
    """Places of one host's tree to drop: on enough pages, of low importance, and with nothing important in them."""
    rows, below, waits = {}, {}, {}  # below: sum and number of the importances of a place's blocks; waits: blocks to come
    for r in group.to_pylist():
        if r["place"] is not None:
            rows[r["place"]] = r
            waits[r["parent"]] = waits.get(r["parent"], 0) + 1
        else:
            below[r["parent"]] = [float(r["n"]), r["n"]]
    holds, weak = set(below), []
    ready = [place for place in rows if place not in waits]
    while ready:
        place = ready.pop()
        r = rows[place]
        content, (total, n) = r["content"], below.get(place, (0.0, 0))
        value = content or 0.0
        if n:
            decay = GAMMA ** r["blocks"]
            value = (1 - decay) * r["layout"] + decay * (total + value) / (n + (content is not None))
        if value >= low or (content or 0.0) >= low or place in holds:
            holds.add(r["parent"])
        elif r["pages"] >= least_pages:
            weak.append(place)
        around = below.setdefault(r["parent"], [0.0, 0])
        around[0] += value
        around[1] += 1
        waits[r["parent"]] -= 1
        if not waits[r["parent"]] and r["parent"] in rows:
            ready.append(r["parent"])
    return sorted(weak)


def site(url: Column) -> Column:
    """Hash of the host, lower-cased."""
    return F.xxhash64(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)))


def merged(pages: DataFrame) -> DataFrame:
    """(site, place, parent, pages, blocks, layout, content) of every place of the merged trees; pages of one html count once, as what repeats in copies of a page is the page itself. site is the host's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2, 8 << 20):
            rows = [(h, page, *p) for h, page, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for p in places(html)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["site", "page", "place", "parent", "is_text", "value", "blocks"])

    seen = pages.select(site(F.col("url")).alias("site"), F.xxhash64("html").alias("page"), "html").mapInArrow(run, "site bigint, page bigint, place bigint, parent bigint, is_text boolean, value bigint, blocks bigint").distinct()
    # one row a place and page, to count pages, beside those of layouts and texts
    kinds = F.array(F.struct(F.when(F.col("is_text"), 1).otherwise(0).alias("kind"), "value"), F.struct(F.lit(2).alias("kind"), F.col("page").alias("value")))
    counts = seen.withColumn("f", F.explode(kinds)).groupBy("site", "place", "parent", "f").agg(F.count(F.lit(1)).alias("n"), F.sum("blocks").alias("blocks"))
    of = lambda kind, x: F.when(F.col("f.kind") == kind, x)
    stats = counts.groupBy("site", "place", "parent").agg(
        F.count(of(2, F.lit(1))).alias("pages"), F.avg(of(1, F.log("n"))).alias("repeat"),
        F.sum(of(0, F.col("n"))).alias("all"), F.sum(of(0, F.col("n") * F.log("n"))).alias("layouts"), F.sum(of(0, F.col("blocks"))).alias("blocks"),
    )
    m = F.log(F.col("pages").cast("double"))
    content = F.when(F.col("repeat").isNotNull(), F.when(F.col("pages") < 2, F.lit(1.0)).otherwise(1 - F.col("repeat") / m))
    layout = F.when(F.col("pages") < 2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), (F.log("all") - F.col("layouts") / F.col("all")) / m))
    return stats.select("site", "place", "parent", "pages", (F.col("blocks") / F.col("all")).alias("blocks"), layout.alias("layout"), content.alias("content"))


def unimportant(pages: DataFrame, low: float, least_pages: int) -> DataFrame:
    """(site, low): places to drop. A host's tree comes to one task as one row a place, without what hangs below places of a single page."""
    found = store(merged(pages), "places")
    common = found.filter("pages > 1").withColumn("n", F.lit(1).cast("long"))
    lone = found.filter("pages < 2").groupBy("site", "parent").agg(F.count(F.lit(1)).alias("n"))
    lone = lone.join(common.select("site", F.col("place").alias("parent")).distinct(), ["site", "parent"], "left_semi")
    schema = "site bigint, low array<bigint>"

    def run(group: pa.Table) -> pa.Table:
        weak = composite(group, low, least_pages)
        return pa.table({"site": pa.array([group.column("site")[0].as_py()] if weak else [], pa.int64()), "low": pa.array([weak] if weak else [], pa.list_(pa.int64()))})

    return common.unionByName(lone, allowMissingColumns=True).groupBy("site").applyInArrow(run, schema)


def extract(pages: DataFrame, low: float = LOW, least_pages: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars for each row of (page_id, url, html).

    Null or empty html gives the empty text; a null url belongs to the host ''. Rows that repeat a
    page_id each get a row; pages of the same html count once in the tree; other columns are ignored; an empty table gives none. Nothing of a kept
    branch is shortened. `least_pages` beyond all pages switches the tree off.
    """
    weak = store(unimportant(pages, low, least_pages), "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2, 8 << 20):
            texts = [main_text(html, frozenset(x % (1 << 64) for x in places or ())) for html, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html", site(F.col("url")).alias("site"))
    few = weak.select("site", F.explode("low")).limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    if few:
        rows = rows.join(F.broadcast(weak), "site", "left")
    else:
        salted = weak.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["site", "salt"], "left")
    return rows.select("page_id", "url", "html", "low").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
