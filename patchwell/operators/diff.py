"""Diff analysis: normalisation and file sections without a shuffle, and line tables in blocks of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import files, text as t
from ..schemas import FILE_TYPES
from .rules import construct_details, may_hold

#: Normalisation variants: (strip_path, drop_context).
VARIANTS = {"default": (True, False), "keep_path": (False, False), "drop_context": (True, True), "keep_path_drop_context": (False, True)}


def _from_start(feeds: Column) -> Column:
    return F.regexp_extract(feeds, r"(?dms)^(?:diff --git |@@ |--- [^\n]*\n\+\+\+ ).*\z", 0)


def diff_text(body: Column) -> Column:
    """Text from the first line of the diff on, each line with a line feed; empty if there is none."""
    return _from_start(t.with_feeds(body))


#: Patterns over whole texts, whose lines end in line feeds (?d), one for each step of the normalisation.
TRAILING, DECORATED = r"(?dmU)[\s&&[^\n]]++$", r"(?dm)^" + t.either(t.DECORATION) + r"[^\n]*\n"
HUNK, CONTEXT, ANY_HEADER = r"(?dm)^@@[^\n]*$", r"(?dm)^ [^\n]*\n", r"(?dm)^(---|\+\+\+) [^\n]*$"
#: The path of a header line: up to a tab, else to two spaces; then without white space around it and a/ or b/; then without the space if it is empty.
PATH = [
    (r"(?dm)^(---|\+\+\+) (?:([^\n\t]*)\t[^\n]*|((?:(?!  )[^\n\t])*+)(?:  [^\n\t]*)?)$", "$1 $2$3"),
    (r"(?dmU)^(---|\+\+\+) [\s&&[^\n]]*+(?:[ab]/)?([^\n]*?)[\s&&[^\n]]*$", "$1 $2"),
    (r"(?dm)^(---|\+\+\+) $", "$1"),
]


def trimmed_lines(text: Column) -> Column:
    """Without white space at the right of its lines, which end in line feeds; the pattern runs only where there may be some."""
    some = ~t.is_ascii(text) | text.contains(" \n") | text.contains("\t\n") | text.endswith(" ") | text.endswith("\t")
    return F.when(some, F.regexp_replace(text, TRAILING, "")).otherwise(text)


def plain(body: Column) -> Column:
    """The diff without trailing white space, decoration lines and positions: what all normalisations start from."""
    out = trimmed_lines(diff_text(body))
    return F.regexp_replace(F.regexp_replace(out, DECORATED, ""), HUNK, "@@")


def normalised_plain(text: Column, strip_path: bool = True, drop_context: bool = False) -> Column:
    """Canonical text from that of `plain`: optionally without paths and without context."""
    if strip_path:
        text = F.regexp_replace(text, ANY_HEADER, "$1")
    else:
        for pattern, to in PATH:
            text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, CONTEXT, "") if drop_context else text


def normalised(body: Column, strip_path: bool = True, drop_context: bool = False) -> Column:
    """Canonical text of a diff: no decoration, no positions, optionally no paths and no context."""
    return normalised_plain(plain(body), strip_path, drop_context)


def fingerprint(body: Column, strip_path: bool = True, drop_context: bool = False, version: int = 1) -> Column:
    if version != 1:
        raise ValueError(f"unsupported normalisation version: {version}")
    return F.sha2(normalised(body, strip_path, drop_context), 256)


def with_fingerprints(bodies: DataFrame) -> DataFrame:
    """Adds the fingerprint and its three variants; the steps they share run once, in a column of their own."""
    rows = bodies.withColumn("_plain", plain(F.col("body")))
    names = {k: "fingerprint" if k == "default" else f"fingerprint_{k}" for k in VARIANTS}
    return rows.select(*bodies.columns, *[F.sha2(normalised_plain(F.col("_plain"), *v), 256).alias(names[k]) for k, v in VARIANTS.items()])


def diff_body(body: Column, most: int | None = None) -> Column:
    """Text from the diff's start; beyond `most` characters cut with a note that tells the whole length."""
    out = F.regexp_replace(diff_text(body), r"(?d)\n\z", "")
    if most is None:
        return out
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most), F.lit("\n[diff truncated: "), F.length(out).cast("string"), F.lit(" characters in all]"))).otherwise(out)


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once: it stands behind a generator, through which nothing is inlined again. The generator gets the
    value ready made, from a projection: what a generator works out itself is interpreted node by node, not compiled."""
    return rows.select("*", value.alias("_value")).select(*rows.columns, F.explode(F.array("_value")).alias(name))


#: Lines of a block. Longer diffs are cut, so that no window or sort covers a whole diff.
BLOCK = 4096


def _from(raw: Column) -> Column:
    return raw.startswith("--- ")


def _to(raw: Column) -> Column:
    return raw.startswith("+++ ")


def kind_of(raw: Column) -> Column:
    """meta, from, to, hunk, add, del or ctx, of a line without white space at the right."""
    return (
        F.when(t.starts_with(raw, t.DECORATION), "meta").when(_from(raw), "from").when(_to(raw), "to")
        .when(raw.startswith("@@"), "hunk").when(raw.startswith("+"), "add").when(raw.startswith("-"), "del").otherwise("ctx")
    )


#: All before a diff, and the words that it begins with.
UPTO_DIFF = r"(?dms)\A.*?^(?:diff --git |@@ |--- (?=[^\n]*\n\+\+\+ ))"


def with_diff(patches: DataFrame, key: str = "patch_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep, _feeds (the body, each line with a line feed), _diff (from the first line of the diff on)."""
    rows = once(patches.select(key, "body", *keep), "_feeds", t.with_feeds(F.col("body")))
    # What is before the diff is short: it is matched, with the words that the diff begins with, and the rest is taken as it is.
    rows = once(rows, "_upto", F.regexp_extract("_feeds", UPTO_DIFF, 0))
    upto = F.col("_upto")
    begin = F.octet_length(upto) - F.when(upto.endswith("diff --git "), 11).when(upto.endswith("@@ "), 3).otherwise(4) + 1
    return once(rows, "_diff", F.when(upto == "", "").otherwise(t.bytes_of(F.col("_feeds"), begin, F.lit(1 << 30)))).select(key, *keep, "_feeds", "_diff")


def _offset() -> Column:
    """Lines of the body before the diff."""
    head = F.left("_feeds", F.length("_feeds") - F.length("_diff"))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def diff_lines(patches: DataFrame, key: str = "patch_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, offset, ls, keep: the lines of each diff, and how many lines of the body are before it."""
    rows = once(with_diff(patches, key, keep), "ls", t.fed_lines(F.col("_diff")))
    return rows.select(key, _offset().alias("offset"), "ls", *keep)


def blocks(patches: DataFrame, key: str = "patch_id", size: int | None = None) -> DataFrame:
    """A row for each block of lines: key, first (line number), block, chunk (its lines), before, after, carry.

    before and after are the lines next to the block. carry is what the blocks before add up to: file_no,
    hunk_no and open_no so far, the last header line, and whether the first line behind the block that isn't part of a
    lead-in opens a file. Blocks are summed up in their row, then the sums of the blocks before each are added: there is one row
    of sums a block, and none for a diff of one block.
    """
    size = size or BLOCK
    rows = diff_lines(patches, key)
    ls, n = F.col("ls"), F.size("ls")
    raw = t.rtrim
    part = lambda b: F.slice(ls, b * size + 1, F.lit(size))
    count = lambda xs, f: F.size(F.filter(xs, f))
    lead_in = lambda x: kind_of(raw(x)).isin("meta", "from")

    def summed(b: Column) -> Column:
        chunk = part(b)
        opens = count(chunk, lambda x, i: x.startswith("--- ") & F.coalesce(F.get(ls, b * size + i + 1).startswith("+++ "), F.lit(False)))
        header = F.try_element_at(F.filter(chunk, lambda x: _from(raw(x)) | _to(raw(x))), F.lit(-1))
        follow = _to(raw(F.try_element_at(F.filter(chunk, lambda x: ~lead_in(x)), F.lit(1))))
        return F.struct(count(chunk, lambda x: _to(raw(x))).alias("files"), count(chunk, lambda x: raw(x).startswith("@@")).alias("hunks"), opens.alias("opens"), raw(header).alias("header"), follow.alias("follow"))

    several = F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))
    rows = once(rows, "sums", F.when(n > size, F.transform(several, summed)))
    sums = F.col("sums")
    total = lambda xs, f: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x[f])
    known = lambda xs, f: F.filter(F.transform(xs, lambda x: x[f]), lambda v: v.isNotNull())

    def carry(b: Column) -> Column:
        upto, rest = F.slice(sums, F.lit(1), b), F.slice(sums, b + 2, F.size(sums))
        return F.struct(total(upto, "files").alias("file_no"), total(upto, "hunks").alias("hunk_no"), total(upto, "opens").alias("open_no"), F.try_element_at(known(upto, "header"), F.lit(-1)).alias("header"), F.try_element_at(known(rest, "follow"), F.lit(1)).alias("follow"))

    def block(b: Column, chunk: Column, before: Column, after: Column, carried: Column) -> Column:
        return F.struct(b.alias("block"), chunk.alias("chunk"), before.alias("before"), after.alias("after"), carried.alias("carry"))

    text, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    nothing = F.struct(F.lit(0).alias("file_no"), F.lit(0).alias("hunk_no"), F.lit(0).alias("open_no"), text.alias("header"), flag.alias("follow"))
    whole = F.array(block(F.lit(0), ls, text, text, nothing))
    cut = F.transform(several, lambda b: block(b, part(b), F.get(ls, b * size - 1), F.get(ls, (b + 1) * size), carry(b)))
    return rows.filter(n > 0).select(key, "offset", F.inline(F.when(n > size, cut).otherwise(whole))).select(key, (F.col("offset") + F.col("block") * size).alias("first"), "block", "chunk", "before", "after", "carry")


def in_block(key: str = "patch_id"):
    """Window over a block's lines in order."""
    return Window.partitionBy(key, "block").orderBy("line_no")


def line_table(patches: DataFrame, key: str = "patch_id", size: int | None = None) -> DataFrame:
    """A row for each line of each diff: key, line_no, line, raw, kind, file_no, hunk_no, source, run_start; block, before, after, carry of its block.

    kind: meta, from, to, hunk, add, del, ctx. file_no counts the `+++ ` lines so far (0: before
    the first); source is the path of the `--- ` line that a `+++ ` line follows, with no other `+++ ` line between. All windows
    are within a block of lines, share one order, and go on from what the blocks before carry: one shuffle, on (key, block).
    """
    w = in_block(key)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    lines = blocks(patches, key, size).select(key, "block", "first", "before", "after", "carry", F.posexplode("chunk").alias("at", "line"))
    raw, kind = F.col("raw"), F.col("kind")
    rows = lines.withColumn("line_no", F.col("first") + F.col("at")).withColumn("raw", t.rtrim(F.col("line"))).withColumn("kind", kind_of(raw))
    header = F.coalesce(F.last(F.when(kind.isin("from", "to"), raw), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("carry.header"))
    number = lambda k, carried: (F.sum((kind == k).cast("int")).over(so_far) + F.col(f"carry.{carried}")).alias(carried)
    previous = F.coalesce(F.lag("kind").over(w), kind_of(t.rtrim(F.col("before"))))
    rows = rows.select(key, "block", "line_no", "line", "raw", "kind", "before", "after", "carry", number("to", "file_no"), number("hunk", "hunk_no"), header.alias("header"), previous.alias("previous"))
    changed = kind.isin("add", "del")
    return rows.select(
        key, "line_no", "line", "raw", "kind", "file_no", "hunk_no", F.when((kind == "to") & _from(F.col("header")), t.header_path(F.col("header"))).alias("source"),
        (changed & ~F.coalesce(F.col("previous").isin("add", "del"), F.lit(False))).alias("run_start"), "block", "before", "after", "carry",
    )


def line_kinds(patches: DataFrame, key: str = "patch_id", size: int | None = None) -> DataFrame:
    """A row for each line of each diff, its kind and whether it starts a run of changed lines: key, kind, run_start. The line before is looked up in the block; nothing is shuffled or sorted."""
    pair = F.transform("chunk", lambda x, i: F.struct(x.alias("line"), F.coalesce(F.get("chunk", i - 1), F.col("before")).alias("previous")))
    rows = blocks(patches, key, size).select(key, F.inline(pair)).select(key, kind_of(t.rtrim(F.col("line"))).alias("kind"), "previous")
    changed = lambda raw: (raw.startswith("+") & ~_to(raw)) | (raw.startswith("-") & ~_from(raw))
    return rows.select(key, "kind", (F.col("kind").isin("add", "del") & ~F.coalesce(changed(t.rtrim(F.col("previous"))), F.lit(False))).alias("run_start"))


def hunk_lines(patches: DataFrame, key: str = "patch_id", size: int | None = None) -> DataFrame:
    """The hunk lines of `line_table` (key, raw, kind, file_no, hunk_no): only these and the lines that open files are numbered."""
    w, line, hunk = in_block(key).rowsBetween(Window.unboundedPreceding, 0), F.col("line"), F.col("hunk")
    lines = blocks(patches, key, size).select(key, "block", F.col("carry.file_no").alias("files"), F.col("carry.hunk_no").alias("hunks"), F.posexplode("chunk").alias("line_no", "line"))
    rows = lines.filter(line.startswith("@@") | (line.startswith("+++ ") & _to(t.rtrim(line)))).withColumn("hunk", line.startswith("@@"))
    number = lambda which, before: F.sum(which.cast("int")).over(w) + F.col(before)
    rows = rows.select(key, "line", "hunk", number(~hunk, "files").alias("file_no"), number(hunk, "hunks").alias("hunk_no")).filter("hunk")
    return rows.select(key, t.rtrim(line).alias("raw"), F.lit("hunk").alias("kind"), "file_no", "hunk_no")


#: Where a file starts: a `+++ ` line with a path. Cutting there takes no line apart.
FILE = r"(?dmU)^(?=\+\+\+ [^\n]*[^\s])"
#: The last `--- ` line with a path, and lines that lead in to a file, in a text whose lines end in line feeds.
LAST_FROM = r"(?dmsU)\A.*^(--- [^\n]*[^\s][^\n]*)"
LEAD_IN = r"(?:(?:--- |diff --git |index )[^\n]*[^\s]|" + t.either([p for p in t.DECORATION if not p.endswith(" ")]) + ")"
UPTO_LEAD_IN = r"(?dmsU)\A(.*^(?!" + LEAD_IN + r")[^\n]*\n)"


#: A line break that no text of `with_diff` has left.
CUT = "\x1e"


def _parts(diffs: Column) -> Column:
    """The diff cut before each `+++ ` line with a path. Only where such a line may have none is it told by a pattern; to split by one would compile it for each diff."""
    odd = ~t.is_ascii(diffs) | t.any_of([diffs.contains("+++ " + c) for c in (" ", "\t", "\n")])
    marked = F.when(odd, F.regexp_replace(diffs, FILE, CUT)).otherwise(F.replace(diffs, F.lit("\n+++ "), F.lit("\n" + CUT + "+++ ")))
    return F.split(marked, CUT, -1)


def _last_from(before: Column) -> Column:
    """The last `--- ` line with a path; empty if there is none. Mostly it is the last line."""
    last = F.substring_index(before, "\n", -2)
    path = F.substring(last, 5, 1)
    return F.when(last.startswith("--- ") & (path > " ") & (path <= "~"), F.substring_index(last, "\n", 1)).when(before.contains("--- "), F.regexp_extract(before, LAST_FROM, 1)).otherwise("")


def cut_files(rows: DataFrame, key: str, keep: tuple[str, ...] = (), all_patches: bool = False, numbered: bool = True, leads: bool = False) -> DataFrame:
    """`sections` of the rows of `with_diff`."""
    if numbered:
        opens = lambda x: x.startswith("+++ ") & _to(t.rtrim(x))
        rows = once(rows, "ls", t.fed_lines(F.col("_diff")))
        rows = once(rows, "ats", F.filter(F.transform("ls", lambda x, i: F.when(opens(x), i)), lambda i: i.isNotNull()))
    rows = once(rows, "parts", _parts(F.col("_diff")))
    parts, n = F.col("parts"), F.size("parts")
    # The generator deals out texts that there are; what is told of them is worked out in its rows.
    files = F.arrays_zip(F.slice(parts, F.lit(1), n - 1).alias("before"), F.slice(parts, F.lit(2), n - 1).alias("part"), *([F.col("ats").alias("at")] if numbered else []))
    ahead = [F.regexp_extract(F.get(parts, F.lit(0)), UPTO_LEAD_IN, 1).alias("ahead")] if leads else []
    offset = [_offset().alias("offset")] if numbered else []
    rows = rows.select(key, *offset, *ahead, *keep, n.alias("n"), files.alias("files"))
    rows = rows.select(key, *(["offset"] if numbered else []), *(["ahead"] if leads else []), *keep, "n", (F.posexplode_outer if all_patches else F.posexplode)("files").alias("i", "file"))
    rows = once(rows, "from", _last_from(F.col("file.before")))
    before, part, i = F.col("file.before"), F.col("file.part"), F.col("i")
    unended = lambda c: t.bytes_of(c, F.lit(1), F.octet_length(c) - 1)
    own = []
    if leads:
        lead = F.right(before, F.length(before) - F.length(F.regexp_extract(before, UPTO_LEAD_IN, 1)))
        own = [unended(F.concat(lead, F.when(i + 2 == F.col("n"), part).otherwise(F.regexp_extract(part, UPTO_LEAD_IN, 1)))).alias("own"), unended(F.col("ahead")).alias("ahead")]
    return rows.select(
        key, (i + 1).alias("file_no"), *([(F.col("offset") + F.col("file.at")).alias("start")] if numbered else []), t.header_path(F.nullif("from", F.lit(""))).alias("source"),
        t.header_path(t.rtrim(F.substring_index(part, "\n", 1))).alias("target"), unended(part).alias("section"), *own, *keep,
    )


def sections(patches: DataFrame, key: str = "patch_id", keep: tuple[str, ...] = (), all_patches: bool = False, numbered: bool = True, leads: bool = False) -> DataFrame:
    """A row for each file of a diff: key, file_no, start (line number of its `+++ ` line), source, target, section (its text, from that line on), keep.

    Cut in the row of the diff: nothing is shuffled. With `all_patches` a patch without a file has one row, whose file_no is null.
    Without `numbered` there is no start, and no line is taken apart. `leads` adds own, the file's text from the lines that lead in to it up to those of
    the next file, and ahead, what the patch has before its first file.
    """
    return cut_files(with_diff(patches, key, keep), key, keep, all_patches, numbered, leads)


ADDED, REMOVED = r"^\+(?!\+\+ )", r"^-(?!-- )"


def changed_lines(text: Column, mark: str) -> Column:
    """Texts of the added or removed lines of a trimmed section, in order."""
    return F.regexp_extract_all(text, F.lit(f"(?dm){mark}([^\\n]*)$"), F.lit(1))


def file_table(patches: DataFrame, key: str = "patch_id", keep: tuple[str, ...] = (), all_patches: bool = False, numbered: bool = True, leads: bool = False) -> DataFrame:
    """A row for each file of a diff: key, file_no, start, path, type, ext, hunks, added, removed, the traits of its changed lines, section, trimmed.

    Patterns over the section's text tell all of it; only added lines of code that hold a word of some construct are taken apart.
    `keep`, `all_patches`, `numbered` and `leads` as of `sections`.
    """
    return told_files(sections(patches, key, keep, all_patches, numbered, leads), key)


def told_files(cut: DataFrame, key: str = "patch_id") -> DataFrame:
    """`file_table` of the rows of `sections`; what else they hold is kept."""
    keep = [c for c in cut.columns if c not in (key, "file_no", "start", "source", "target", "section")]
    start = ["start"] if "start" in cut.columns else []
    path = F.when((F.col("target") == "/dev/null") & F.col("source").isNotNull() & (F.col("source") != "/dev/null"), F.col("source")).otherwise(F.col("target"))
    rows = once(once(cut, "path", path), "trimmed", trimmed_lines(F.col("section")))
    rows = rows.withColumn("about", F.struct(t.extension(F.col("path")).alias("ext"), files.file_type(F.col("path")).alias("type")))
    text, ext = F.col("trimmed"), F.col("about.ext")
    code = (F.col("about.type") == "code") & may_hold(text, ext)
    details = F.flatten(F.transform(changed_lines(text, ADDED), lambda x: construct_details(x, ext)))
    # A section's first line is its header.
    return rows.select(
        key, "file_no", *start, "path", "about.ext", "about.type", t.occurrences(text, "\n@@").alias("hunks"),
        (t.occurrences(text, "\n+") - t.occurrences(text, "\n+++ ")).alias("added"), (t.occurrences(text, "\n-") - t.occurrences(text, "\n--- ")).alias("removed"),
        files.only_comments(text, ext).alias("comments"), files.only_patterns(text, F.col("path")).alias("patterns"),
        F.when(code, details).otherwise(F.array().cast("array<string>")).alias("constructs"), "section", "trimmed", *keep,
    )


#: One letter for each line that counts, in order: a space for a file's first line, + and - for changed lines, @ for hunks. White space at the right of a line changes none of them.
MARKED = r"(?dmU)^(?:\+\+\+( )(?=[^\n]*[^\s])|--- (?=[^\n]*[^\s])|([-+])|(@)@|)[^\n]*\n"


def line_marks(diffs: Column) -> Column:
    """What the lines of a diff are, as a text of a letter each: they are counted there, and the diff is gone through once."""
    return F.regexp_replace(diffs, MARKED, "$1$2$3")


def with_spaced(rows: DataFrame) -> DataFrame:
    """Adds _spaced to rows of _diff and _marks: the added lines of a diff's files are their removed ones but for white space, in some order, and not the same as they are."""
    lead = F.substring_index("_marks", " ", 1)
    count = lambda mark: t.occurrences(F.col("_marks"), mark) - t.occurrences(lead, mark)
    # The lines are taken out only where there are as many of both, and once.
    text = trimmed_lines(F.regexp_extract("_diff", r"(?dmsU)^\+\+\+ [^\n]*[^\s].*\z", 0))
    both = F.struct(changed_lines(text, ADDED).alias("added"), changed_lines(text, REMOVED).alias("removed"))
    rows = once(rows, "_both", F.when((count("+") == count("-")) & (count("+") > 0), both))
    added, removed = F.col("_both.added"), F.col("_both.removed")
    plain_space = lambda xs: F.array_sort(F.transform(xs, lambda x: F.regexp_replace(t.strip(x), r"(?U)\s+", " ")))
    same = F.when(F.col("_both").isNotNull(), (plain_space(added) == plain_space(removed)) & (F.array_sort(added) != F.array_sort(removed))).otherwise(F.lit(False))
    return rows.withColumn("_spaced", same).drop("_both")


#: A line that isn't decoration: with one, something is left of the diff once it is normalised.
LEFT = r"(?dmU)^(?!(?:diff --git |index )[^\n]*[^\s]|" + t.either([p for p in t.DECORATION if not p.endswith(" ")]) + r")[^\n]*\n"


def profiled_files(rows: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
    """A row for each file of the rows of `with_diff` with _marks, one whose file_no is null for a patch without: key, file_no, path, type, hunks, added, removed, the traits of its changed lines, keep.

    As `told_files`, but counts come from the marks, and no text is trimmed or copied but where a trait needs it.
    """
    rows = once(rows.select(key, *keep, "_marks", _parts(F.col("_diff")).alias("_parts")), "parts", F.col("_parts"))
    parts, n = F.col("parts"), F.size("parts")
    behind = lambda xs: F.slice(xs, F.lit(2), n - 1)
    files_ = F.arrays_zip(F.slice(parts, F.lit(1), n - 1).alias("before"), behind(parts).alias("part"), behind(F.split("_marks", " ", -1)).alias("marks"))
    rows = rows.select(key, *keep, F.posexplode_outer(files_).alias("i", "file"))
    rows = once(rows, "target", t.header_path(t.rtrim(F.substring_index("file.part", "\n", 1))))
    # Only a file that is gone is named by its old path.
    rows = once(rows, "from", F.when(F.col("target") == "/dev/null", _last_from(F.col("file.before"))).otherwise(""))
    rows = once(rows, "path", F.when(F.col("from") == "", F.col("target")).otherwise(t.header_path(F.col("from"))))
    path, part, ext, mark = F.col("path"), F.col("file.part"), F.col("ext"), F.col("file.marks")
    rows = rows.withColumn("ext", t.extension(path))
    rows = rows.select("*", files.file_type(path, ext).alias("type"))
    details = F.flatten(F.transform(changed_lines(trimmed_lines(part), ADDED), lambda x: construct_details(x, ext)))
    return rows.select(
        key, (F.col("i") + 1).alias("file_no"), "path", "type", t.occurrences(mark, "@").alias("hunks"), t.occurrences(mark, "+").alias("added"), t.occurrences(mark, "-").alias("removed"),
        files.only_comments(part, ext).alias("comments"), files.only_patterns(part, path).alias("patterns"), files.benign_data(path).alias("benign"),
        F.when((F.col("type") == "code") & may_hold(part, ext), details).otherwise(F.array().cast("array<string>")).alias("constructs"), *keep,
    )


def profile(patches: DataFrame, key: str = "patch_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each patch: files, counts in all and by type, types (their names, joined), touches_code, the trivial flags, construct hits, and the columns `keep` of `patches`.

    `patches`: key, one row each, and `body`. Patches without a diff get zero counts and is_empty. The table is read
    once; what is shuffled is a row for each file without its text. Only files and constructs are collected: without them the
    rows of a patch go into counts and flags, which compiled code adds up.
    """
    every = ("_empty", "_spaced", *keep)
    rows = once(with_diff(patches, key, keep), "_marks", line_marks(F.col("_diff"))).withColumn("_empty", ~F.col("_diff").rlike(LEFT))
    file_rows = profiled_files(with_spaced(rows), key, every)
    has = F.col("file_no").isNotNull()
    changes = F.col("added") + F.col("removed") > 0
    kinds = sorted(FILE_TYPES)
    of = lambda kind: has & (F.col("type") == kind)
    per = {"file_types": lambda k: F.count_if(of(k)), "added_by_type": lambda k: F.sum(F.when(of(k), F.col("added"))), "removed_by_type": lambda k: F.sum(F.when(of(k), F.col("removed")))}
    per_patch = file_rows.groupBy(key).agg(
        F.collect_list(F.when(has, F.struct("file_no", "path", "type"))).alias("files"), F.count("file_no").alias("n_files"), *[n(k).alias(f"{name}_{k}") for name, n in per.items() for k in kinds],
        F.sum("added").alias("added_lines"), F.sum("removed").alias("removed_lines"), F.sum("hunks").alias("hunks"), F.bool_and(~changes | F.col("comments")).alias("comments"), F.bool_and("patterns").alias("patterns"),
        F.bool_and("benign").alias("benign"), F.collect_list(F.when(F.size("constructs") > 0, F.col("constructs"))).alias("constructs"), *[F.first(c).alias(c) for c in every],
    )
    some = F.coalesce(F.col("added_lines") + F.col("removed_lines"), F.lit(0)) > 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    flag = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    there = lambda k: F.col(f"file_types_{k}") > 0
    # One struct a type that the patch has: null counts of the other types drop out.
    by_type = lambda name: F.when(F.col("n_files") > 0, F.map_from_entries(F.array_compact(F.array(*[F.when(there(k), F.struct(F.lit(k).alias("key"), F.col(f"{name}_{k}").alias("value"))) for k in kinds])))).alias(name)
    constructs = F.flatten("constructs")
    return per_patch.select(
        key, F.when(F.size("files") > 0, F.array_sort("files")).alias("files"), "n_files", F.when(F.col("n_files") > 0, F.concat_ws(",", *[F.when(there(k), F.lit(k)) for k in kinds])).alias("types"), *map(by_type, per),
        zero("added_lines"), zero("removed_lines"), zero("hunks"), there("code").alias("touches_code"), F.col("_empty").alias("is_empty"), flag(F.col("_spaced"), "whitespace_only"),
        flag(some & F.col("comments"), "comment_only"), flag(some & F.col("patterns"), "ignore_file_only"), flag(F.col("benign"), "benign_data_only"),
        F.size(constructs).cast("long").alias("flag_count"), F.array_join(F.array_sort(F.array_distinct(constructs)), ", ").alias("flag_details"), *keep,
    )


def code_added_lines(file_rows: DataFrame, key: str = "patch_id") -> DataFrame:
    """Added lines of the code files in which some construct may be: key, file_no, path, ext, line_no, text."""
    code = file_rows.filter((F.col("type") == "code") & may_hold(F.col("trimmed"), F.col("ext")))
    lines = code.select(key, "file_no", "path", "ext", "start", F.posexplode(F.split("trimmed", "\n")).alias("at", "raw"))
    return lines.filter(kind_of(F.col("raw")) == "add").select(key, "file_no", "path", "ext", (F.col("start") + F.col("at")).alias("line_no"), F.substring("raw", 2, 1 << 30).alias("text"))


def adjacent_files(lines: DataFrame, key: str = "patch_id") -> DataFrame:
    """Stricter segmentation: a file opens only where a `--- ` line is directly followed by a `+++ ` line."""
    w, line = in_block(key), F.col("line")
    opens = line.startswith("--- ") & F.coalesce(F.coalesce(F.lead("line").over(w), F.col("after")).startswith("+++ "), F.lit(False))
    opened = line.startswith("+++ ") & F.coalesce(F.coalesce(F.lag("line").over(w), F.col("before")).startswith("--- "), F.lit(False))
    rows = lines.withColumn("opens", opens).withColumn("header", opens | opened)
    number = F.sum(F.col("opens").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("carry.open_no")
    rows = rows.withColumn("file_no", number).filter("file_no > 0")
    first = lambda prefix: F.min_by(F.when(F.col("header") & line.startswith(prefix), t.header_path(line)), F.when(F.col("header") & line.startswith(prefix), F.col("line_no")))
    out = rows.groupBy(key, "file_no").agg(first("--- ").alias("a"), first("+++ ").alias("b"), F.count_if(~F.col("header") & line.startswith("+")).alias("added"), F.count_if(~F.col("header") & line.startswith("-")).alias("removed"))
    return out.select(key, "file_no", F.when(F.col("b") == "/dev/null", F.col("a")).otherwise(F.col("b")).alias("path"), "added", "removed")


def hunks(lines: DataFrame, key: str = "patch_id") -> DataFrame:
    """A row for each hunk: key, file_no, hunk_no, old_start, old_count, new_start, new_count (0 where malformed; a missing count is 1)."""
    pattern = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    raw = F.col("raw")
    part = lambda i, d: F.when(raw.rlike(pattern), F.coalesce(F.nullif(F.regexp_extract(raw, pattern, i), F.lit("")).cast("bigint"), F.lit(d))).otherwise(F.lit(0)).cast("long")
    return lines.filter("kind = 'hunk'").select(key, "file_no", "hunk_no", part(1, 0).alias("old_start"), part(2, 1).alias("old_count"), part(3, 0).alias("new_start"), part(4, 1).alias("new_count"))


def churn_order(file_rows: DataFrame, key: str = "patch_id") -> DataFrame:
    """Files of a patch by changed lines, largest first, then path; file_no keeps the diff's order."""
    w = Window.partitionBy(key).orderBy(F.desc(F.col("added") + F.col("removed")), "path", "file_no")
    return file_rows.select(key, "file_no", "path", "added", "removed", F.row_number().over(w).alias("rank"))


def display_chunks(file_rows: DataFrame, marked: DataFrame, key: str = "patch_id") -> DataFrame:
    """Files in display chunks: neighbours without a mark share one, a marked file (key, file_no) is one of its own."""
    rows = file_rows.select(key, "file_no", "path").join(marked.select(key, "file_no", F.lit(True).alias("marked")), [key, "file_no"], "left")
    return chunked(rows.withColumn("marked", F.coalesce("marked", F.lit(False))), key)


def chunked(rows: DataFrame, key: str = "patch_id") -> DataFrame:
    """Display chunks of files that say whether they are marked: key, file_no, path, marked."""
    w = Window.partitionBy(key).orderBy("file_no")
    starts = F.col("marked") | F.coalesce(F.lag("marked").over(w), F.lit(True))
    rows = rows.select(key, "file_no", "path", "marked", starts.alias("starts")).withColumn("chunk", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "chunk", "marked").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_no", "path"))), lambda x: x["path"]), ",").alias("paths"))
