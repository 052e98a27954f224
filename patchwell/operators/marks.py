"""Marks of generated files: by name, by banner, by the look of translation catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import files, text as t
from .diff import in_block, once, sections, told_files

VERSION = r"([0-9](?:[0-9A-Za-z.-]*[0-9A-Za-z])?)"

# Banners (generator, family, pattern) in order; a first group captures the version.
BANNERS = [
    ("autoconf", "autotools", f"Generated by GNU Autoconf(?: {VERSION})?"),
    ("automake", "autotools", f"generated by automake {VERSION}"),
    ("automake", "autotools", f"generated automatically by automake {VERSION}"),
    ("aclocal", "autotools", f"generated automatically by aclocal {VERSION}"),
    ("autoheader", "autotools", "Generated from [^ ]+ by autoheader"),
    ("libtool", "autotools", rf"ltmain\.sh \(GNU libtool\)(?: {VERSION})?"),
    ("libtool", "autotools", "This file is part of GNU Libtool"),
    ("libtool", "autotools", r"libtool\.m4 - Configure libtool for the (?:target|host) system"),
    ("@generated", "marker", r"@generated\b"),
]
CANDIDATES = ["DO NOT EDIT", "[Dd]o not edit this file", "[Aa]utomatically generated"]
TIMESTAMP_NAMES, TIMESTAMP = ["config.guess", "config.sub"], "timestamp='([0-9]{4}-[0-9]{2}-[0-9]{2})'"
TS_DOCTYPE, TS_ROOT = "<!DOCTYPE TS>", r"^[+\- ]?\s*<TS(?:\s[^>]*)?>\s*$"
TS_ELEMENTS = ["<message[ >]", "<source>", "<translation[ >]"]
PO_MSGID, PO_MSGSTR, PO_HEADER = r'^[+\- ]?msgid "', r'^[+\- ]?msgstr(?:\[[0-9]+\])? "', '"Project-Id-Version:'


#: Words without which a section has no banner, or none of the lines below; sections with one are taken apart.
BANNER_WORDS = ["enerated", "ibtool"]


def _within(pattern: str) -> str:
    """A pattern of lines as one of whole texts: what it repeats ends with the line, and it captures nothing."""
    return pattern.replace("[^ ]", r"[^ \n]").replace("[^>]", r"[^>\n]").replace(r"\s", r"[\s&&[^\n]]").replace(VERSION, f"(?:{VERSION[1:-1]})")


def _first_banner(section: Column) -> Column:
    """The first banner of a section: among added lines, then context, then removed ones. The line is looked up in the whole text; of several banners in it, the first listed counts."""
    some = "(?:" + "|".join(_within(pattern) for _, _, pattern in BANNERS) + ")"
    line = lambda begin: F.nullif(F.regexp_extract(section, rf"(?dm)^{begin}[^\n]*?{some}[^\n]*$", 0), F.lit(""))
    return F.when(t.any_of([section.contains(w) for w in BANNER_WORDS]), F.coalesce(line(r"(?=\+)"), line("(?![+-])"), line("(?=-)")))


def _of_banner(line: Column) -> Column:
    """Generator, family and version of a line with a banner; null without one."""
    out = F.when(line.isNull(), F.lit(None))
    for generator, family, pattern in BANNERS:
        version = F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")) if VERSION in pattern else F.lit(None).cast("string")
        out = out.when(line.rlike(pattern), F.struct(F.lit(generator).alias("generator"), F.lit(family).alias("family"), version.alias("version")))
    return out


def _some_line(section: Column, pattern: str, word: str) -> Column:
    """Some line matches the pattern, which needs the word."""
    return section.contains(word) & section.rlike("(?dm)" + _within(pattern))


def _some(*texts: Column) -> Column:
    """Those of the distinct texts that aren't null; no lambda, which would be interpreted with all that is in it."""
    return F.array_except(F.array(*texts), F.array(F.lit(None).cast("string")))


def file_marks(file_rows: DataFrame, key: str = "patch_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each file of a diff: path, added, removed, family (null: no mark), signals, generator, version, candidate.

    A banner counts among added lines first, then context, then removed ones. `candidate` is the
    first line with a do-not-edit phrase; it is measured and never marks. Nothing is shuffled. What a file shows is worked out once, and a
    filter on the result doesn't reach below it: else the scan of the lines would run again for each use of it in the condition.
    """
    section = F.col("section")
    rows = file_rows.select(key, "file_no", "path", "ext", "added", "removed", "section", "trimmed", *keep)
    rows = once(once(rows, "line", _first_banner(section)), "banner", _of_banner(F.col("line")))
    word = "|".join(CANDIDATES)
    phrase = t.any_of([section.contains(w) for w in ("DO NOT EDIT", "o not edit this file", "utomatically generated")])
    rows = rows.select(
        key, "file_no", "path", "ext", "added", "removed", "banner", F.when(section.contains("timestamp="), F.nullif(F.regexp_extract(section, TIMESTAMP, 1), F.lit(""))).alias("stamp"),
        section.contains(TS_DOCTYPE).alias("doctype"), _some_line(section, TS_ROOT, "<TS").alias("root"), sum((section.contains(p[: p.find("[")] if "[" in p else p) & section.rlike(p)).cast("int") for p in TS_ELEMENTS).alias("elements"),
        _some_line(section, PO_MSGID, "msgid").alias("msgid"), _some_line(section, PO_MSGSTR, "msgstr").alias("msgstr"), section.contains(PO_HEADER).alias("po_header"),
        F.when(phrase & section.rlike(word), F.regexp_extract("trimmed", f"(?dm)^[^\\n]*(?:{word})[^\\n]*$", 0)).alias("candidate"), *keep,
    )
    rows = once(once(rows, "base", t.strip_backup(t.basename(F.col("path")))), "suffix", F.lower(F.regexp_extract("base", r"^.+(\.[^.]*)$", 1)))
    base, banner = F.col("base"), F.col("banner").isNotNull()
    named = F.when(~base.isin(files.NEEDS_BANNER) | banner, files.name_family(F.col("path")))
    is_ts, is_po = F.col("suffix") == ".ts", F.col("suffix").isin(".po", ".pot")
    looks = _some(
        F.when(is_po & F.col("po_header"), "po-header"), F.when(is_po & F.col("msgid") & F.col("msgstr"), "po-msgid-msgstr"),
        F.when(is_ts & (F.col("doctype") | F.col("root")), "ts-doctype"), F.when(is_ts & (F.col("elements") >= 2), "ts-elements"),
    )
    shown = F.struct(named.alias("named"), looks.alias("looks"), F.when(is_ts, "qt-linguist").when(is_po, "gettext").alias("tool"))
    rows = once(rows, "shown", shown).select("*", "shown.*")
    translated = F.size("looks") > 0
    family = F.coalesce("named", F.when(translated, F.lit("translations")), F.col("banner.family"))
    signals = F.sort_array(F.concat(_some(F.when(banner, "banner"), F.when(F.col("named").isNotNull(), "name")), F.col("looks")))
    return once(rows, "mark", F.struct(family.alias("family"), signals.alias("signals"))).select(
        key, "file_no", "path", "added", "removed", "mark.family", "mark.signals",
        F.coalesce(F.col("banner.generator"), F.when(translated, F.col("tool"))).alias("generator"),
        F.coalesce(F.col("banner.version"), F.when(base.isin(TIMESTAMP_NAMES) & ~banner, F.col("stamp"))).alias("version"), "candidate", *keep,
    )


def coverage(marks: DataFrame, key: str = "patch_id", entries: bool = False) -> DataFrame:
    """generated, residue, total changed lines, coverage, dominant family, detail (family/percent, half to even); with `entries` the marked files in order, too."""
    changed, marked = F.col("added") + F.col("removed"), F.col("family").isNotNull()
    one = F.struct("file_no", F.struct("added", "family", "generator", "path", "removed", "signals", "version").alias("e"))
    lists = [F.collect_list(F.when(marked, one)).alias("f")] if entries else []
    by_family = marks.groupBy(key, "family").agg(F.sum(changed).alias("n"), F.count(F.lit(1)).alias("files"), *lists)
    own = lambda c, other: F.sum(F.when(marked, F.col(c)).otherwise(other))
    rows = by_family.groupBy(key).agg(
        own("n", 0).alias("generated"), F.sum(F.when(marked, F.lit(0)).otherwise(F.col("n"))).alias("residue"), F.sum("n").alias("total"), own("files", 0).alias("n_marked"),
        F.min_by("family", F.when(marked, F.struct(-F.col("n"), F.col("family")))).alias("dominant"), *([F.array_sort(F.flatten(F.collect_list("f"))).alias("f")] if entries else []),
    )
    rows = rows.withColumn("coverage", F.when(F.col("total") > 0, F.col("generated") / F.col("total")).otherwise(0.0))
    return rows.withColumn("detail", F.when(F.col("n_marked") > 0, F.concat("dominant", F.lit("/"), F.bround(F.col("coverage") * 100).cast("int").cast("string"))))


def evidence(marks: DataFrame, key: str = "patch_id") -> DataFrame:
    """(key, detail, evidence): canonical JSON of the marked files of each marked patch, in one pass over the marks."""
    rows = coverage(marks, key, entries=True).filter("n_marked > 0")
    doc = F.struct("coverage", F.transform("f", lambda x: x["e"]).alias("files"), F.col("generated").alias("generated_lines"), F.col("residue").alias("residue_lines"))
    return rows.select(key, "detail", F.to_json(doc, {"ignoreNullFields": "false"}).alias("evidence"))


def _note() -> Column:
    """What stands for a marked file."""
    return F.concat(F.lit("[generated file "), "path", F.lit(" omitted: "), F.col("added").cast("string"), F.lit(" added, "), F.col("removed").cast("string"), F.lit(" removed]"))


def projection(lines: DataFrame, marks: DataFrame, patches: DataFrame, key: str = "patch_id") -> DataFrame:
    """(key, projected): each patch's text with its unmarked files verbatim and a note for each marked one.

    Patches without a mark keep their text byte by byte. A file starts at its `--- ` line or the
    decoration before it.
    """
    lead_in = F.col("kind").isin("meta", "from")
    ahead = F.min(F.when(~lead_in, F.struct("line_no", "kind"))).over(in_block(key).rowsBetween(0, Window.unboundedFollowing))
    nxt = F.coalesce(ahead["kind"] == "to", F.col("carry.follow"), F.lit(False))
    owner = F.col("file_no") + (lead_in & nxt).cast("int")
    rows = lines.withColumn("owner", owner)
    segment = rows.groupBy(key, "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    m = marks.filter("family IS NOT NULL").select(key, F.col("file_no").alias("owner"), _note().alias("note"))
    shown = segment.join(m, [key, "owner"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("owner", F.coalesce("note", "text").alias("x")))), lambda x: x["x"]), "\n")
    changed = shown.groupBy(key).agg(text.alias("projected"), F.count("note").alias("notes")).filter("notes > 0")
    return patches.select(key, "body").join(changed, key, "left").select(key, F.coalesce("projected", "body").alias("projected"))


def projected(patches: DataFrame, key: str = "patch_id") -> DataFrame:
    """`projection` of whole patches (key, body): files keep their text from the lines that lead in to them on, so no line is taken apart, and the table is read once."""
    cut = sections(patches.select(key, "body"), key, ("body",), all_patches=True, numbered=False, leads=True)
    cut = cut.withColumn("body", F.when(F.coalesce("file_no", F.lit(1)) == 1, F.col("body")))  # one copy a patch
    rows = file_marks(told_files(cut, key), key, ("own", "ahead", "body"))
    text = F.when(F.col("family").isNotNull(), _note()).otherwise(F.col("own"))
    shown = F.array_sort(F.collect_list(F.when(F.col("file_no").isNotNull(), F.struct("file_no", text.alias("x")))))
    out = rows.groupBy(key).agg(shown.alias("shown"), F.count("family").alias("notes"), F.first("ahead").alias("ahead"), F.max("body").alias("body"))
    whole = F.array_join(F.concat(F.when(F.col("ahead") != "", F.array("ahead")).otherwise(F.array().cast("array<string>")), F.transform("shown", lambda f: f["x"])), "\n")
    return out.select(key, F.when(F.col("notes") > 0, whole).otherwise(F.col("body")).alias("projected"))


def construct_tally(marks: DataFrame, key: str = "patch_id") -> DataFrame:
    """Construct hits in all, in marked files and in the residue; distinct residue hits as path:detail in first-hit order, that of files, lines and patterns.

    `marks` keep the constructs of their files. A mark stands for its path: it holds for all files of a diff that share the path, so `marks` are
    those of every file of code, with a hit or not. One pass and no join; lists hold a detail of a file once.
    """
    n, marked = F.size("constructs"), F.col("family").isNotNull()
    names = F.transform(F.array_distinct("constructs"), lambda d: F.concat("path", F.lit(":"), d))
    of_file = F.when(n > 0, F.struct("file_no", names.alias("names")))
    paths = marks.filter(marked | (n > 0)).groupBy(key, "path").agg(F.sum(n).alias("n"), F.bool_or(marked).alias("marked"), F.collect_list(of_file).alias("files"))
    of = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    residue = F.array_sort(F.flatten(F.collect_list(F.when(~F.col("marked"), F.col("files")))))
    return paths.groupBy(key).agg(
        F.sum("n").alias("hits"), of(F.col("marked")).alias("in_marked"), of(~F.col("marked")).alias("in_residue"),
        F.array_join(F.array_distinct(F.flatten(residue["names"])), ", ").alias("residue_hits"),
    ).filter("hits > 0")


def report(marks: DataFrame, key: str = "patch_id") -> DataFrame:
    """Measurement of the scan by base name: files, marked, with a banner, with a candidate phrase only."""
    banner = F.array_contains("signals", "banner")
    return marks.groupBy(t.basename(F.col("path")).alias("name")).agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("family").isNotNull()).alias("n_marked"), F.count_if(banner).alias("n_banner"),
        F.count_if(F.col("family").isNull() & F.col("candidate").isNotNull()).alias("n_gap"),
    )


def coverage_buckets(cover: DataFrame) -> DataFrame:
    """Marked patches by coverage in tenths (1.0 in the last)."""
    bucket = F.least(F.floor(F.col("coverage") * 10), F.lit(9)).cast("int")
    return cover.filter("n_marked > 0").groupBy(bucket.alias("tenth")).agg(F.count(F.lit(1)).alias("n"))
