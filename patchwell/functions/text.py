"""Line, path and header expressions. Patterns use (?U) where white space is meant in Unicode's sense."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

#: Every line boundary that counts, and the lines' right trim.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
ODD_BREAK = "\\r\\n|[\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
#: Any break but a line feed.
ODD = "[\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
#: Those of ASCII.
ODD_ASCII = "[\\r\\x0b\\x0c\\x1c\\x1d\\x1e]"
RIGHT = "(?U)\\s++$"
EDGES = "(?U)^\\s+|\\s+$"

# Prefixes of a diff's decoration lines, and of lines that end a header.
DECORATION = ["diff --git ", "index ", "new file mode", "deleted file mode", "old mode", "new mode", "similarity index", "dissimilarity index", "rename from", "rename to", "copy from", "copy to"]
DIFF_MARKERS = ["--- ", "+++ ", "diff ", "Index:", "@@ ", "rename ", "GIT binary patch"]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def starts_with(x: Column, prefixes: list[str]) -> Column:
    return any_of([x.startswith(p) for p in prefixes])


def contains_any(x: Column, words: list[str]) -> Column:
    return x.rlike(either(words))


def rtrim(x: Column) -> Column:
    """Without white space at the right; the pattern runs only where the last character may be some."""
    last = F.substring(x, -1, 1)
    return F.when((x != "") & ((last <= " ") | (last > "~")), F.regexp_replace(x, RIGHT, "")).otherwise(x)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, EDGES, "")


def lines(text: Column) -> Column:
    """Lines of a text without their ends; no empty last line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def is_ascii(x: Column) -> Column:
    return F.octet_length(x) == F.length(x)


def bytes_of(x: Column, begin: Column, n: Column) -> Column:
    """Part of a text that begins and ends between characters, by its bytes: characters aren't counted to find it."""
    return F.substring(x.cast("binary"), begin, n).cast("string")


def occurrences(x: Column, word: str) -> Column:
    """How often an ASCII word, which can't overlap itself, is in the text."""
    return ((F.octet_length(x) - F.octet_length(F.replace(x, F.lit(word), F.lit("")))) / len(word)).cast("long")


def with_feeds(text: Column) -> Column:
    """Text whose lines all end in one line feed, the last one too; null as empty."""
    x = F.coalesce(text, F.lit(""))
    odd = x.rlike(ODD_ASCII) | (~is_ascii(x) & x.rlike(ODD))
    ended = (x == "") | x.endswith("\n") | F.substring(x, -1, 1).rlike(ODD)
    return F.concat(F.when(odd, F.regexp_replace(x, ODD_BREAK, "\n")).otherwise(x), F.when(ended, "").otherwise("\n"))


def fed_lines(text: Column) -> Column:
    """Lines of such a text."""
    parts = F.split(text, "\n")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def either(prefixes: list[str]) -> str:
    """Pattern of any of the given texts."""
    return "(?:" + "|".join(re.escape(p) for p in prefixes) + ")"


def header_path(line: Column) -> Column:
    """Path of a `--- ` or `+++ ` line: up to a tab, else to two spaces, without a leading a/ or b/."""
    rest = F.substring(line, 5, 1 << 30)
    cut = F.when(rest.contains("\t"), F.substring_index(rest, "\t", 1)).otherwise(F.substring_index(rest, "  ", 1))
    seen = lambda c: (c > " ") & (c <= "~")
    bare = F.when(starts_with(cut, ["a/", "b/"]), F.substring(cut, 3, 1 << 30)).otherwise(cut)
    # The pattern runs only where there may be white space at an end.
    return F.when(seen(F.substring(cut, 1, 1)) & seen(F.substring(cut, -1, 1)), bare).otherwise(F.regexp_extract(cut, r"(?sU)^\s*+(?:[ab]/)?+(.*?)\s*$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased, with the dot; empty for dotfiles."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def folders(path: Column) -> Column:
    """Lower-cased components above the last."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda c: c != "")
    return F.when(F.size(parts) > 0, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def source_tree_path(path: Column) -> Column:
    """Path without a tarball root: a first component that ends in a version or .orig."""
    return F.regexp_replace(path, r"^[^/]+(?:-\d[^/]*|\.orig)/(?=.)", "")


def strip_backup(name: Column) -> Column:
    """Name without any run of backup suffixes, but never empty."""
    some = any_of([name.endswith(e) for e in ("~", ".ori", ".orig", ".bak", ".rej", "\n", "\r")])
    return F.when(some, F.regexp_replace(name, r"(?<=.)(?:~|\.ori|\.orig|\.bak|\.rej)+$", "")).otherwise(name)


def family_of(detail: Column) -> Column:
    return F.split_part(detail, F.lit("/"), F.lit(1))


def region_of(detail: Column) -> Column:
    return F.split_part(detail, F.lit("/"), F.lit(2))


def bug_link(ref: Column, tracker: Column) -> Column:
    """URL of a bug reference: itself, or the tracker's page for #n."""
    number = F.regexp_extract(ref, r"^#?(\d+)$", 1)
    return F.when(ref.rlike("^https?://"), ref).when((tracker == "debian") & (number != ""), F.concat(F.lit("https://bugs.debian.org/"), number)).otherwise(ref)


def bug_number(ref: Column) -> Column:
    """First run of three or more digits."""
    return F.regexp_extract(ref, r"(\d{3,})", 1).try_cast("bigint")


def visible(x: Column) -> Column:
    """Text with line feeds, tabs and the scanned invisible characters spelled out."""
    out = F.replace(F.replace(x, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    for code in [0x200B, 0x200C, 0x2060, 0xFEFF, *range(0x202A, 0x202F), *range(0x2066, 0x206A)]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"<U+{code:04X}>"))
    return out


def changelog_date(text: Column) -> Column:
    """ISO date of the first ` -- name  date` trailer."""
    found = F.regexp_extract(text, r"(?m)^ -- .*  [A-Za-z]{3}, +(\d{1,2} [A-Za-z]{3} \d{4})", 1)
    return F.date_format(F.try_to_timestamp(found, F.lit("d MMM yyyy")), "yyyy-MM-dd")


def binary_names(folded: Column) -> Column:
    """Names of a comma list that may be folded over lines."""
    return F.filter(F.transform(F.split(F.regexp_replace(folded, r"\n", " "), ","), lambda x: F.trim(x)), lambda x: x != "")
