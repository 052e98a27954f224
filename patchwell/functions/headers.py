"""Patch headers: fields, forwarding, bug references, claims."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import text as t

# Words and prefixes of each claimed category, in order of precedence.
KEYWORDS = {
    "security": ["security", "vulnerab", "overflow", "exploit", "cve", "denial of service", "injection", "use-after-free", "heap corruption", "privilege escalation", "remote code execution", "arbitrary code", "out-of-bounds"],
    "packaging": ["packaging", "quilt", ".pc", "debian/", "build system", "makefile", "autotools", "reproducib", "debhelper", "dpkg", "dh_"],
    "documentation": ["typo", "spelling", "man page", "manpage", "documentation", "docstring", "comment", "readme"],
    "feature": ["add support", "feature", "implement", "new option", "enable", "add a"],
    "bugfix": ["fix", "crash", "segfault", "error", "bug", "incorrect", "regression", "workaround"],
}
NAME_PREFIXES = ["deb-", "debian-"]
FOLDERS = {"packaging": ["debian/"], "documentation": ["doc/", "docs/", "documentation/"]}


#: From the first line that ends a header on; the second pattern ends at a blank line too. Lines end in line feeds (?d).
ENDS = r"(?dmsU)^(?:[\s&&[^\n]]*---[\s&&[^\n]]*$|" + t.either(t.DIFF_MARKERS) + r").*\z"
FIELD_ENDS = r"(?dmsU)^[\s&&[^\n]]*\n.*\z"


def header(body: Column) -> Column:
    """Text before the diff, cut once from the body: all below work on it."""
    return F.regexp_replace(t.with_feeds(body), ENDS, "")


def fields(header: Column) -> Column:
    """Fields of a header up to a blank line: lower-cased names, continuation lines folded; the last of a name stands."""
    upto = F.filter(F.split(F.regexp_replace(header, FIELD_ENDS, ""), "\n"), lambda x: x != "")
    empty = F.create_map().cast("map<string,string>")
    start = F.struct(empty.alias("m"), F.lit(None).cast("string").alias("k"))

    def put(m: Column, k: Column, v: Column) -> Column:
        return F.map_concat(F.map_filter(m, lambda a, _: a != k), F.create_map(k, v))

    def step(acc: Column, line: Column) -> Column:
        folded = line.rlike("^[ \t]") & acc["k"].isNotNull()
        name = F.lower(t.strip(F.substring_index(line, ":", 1)))
        value = t.strip(F.regexp_replace(line, "^[^:]*:", ""))
        return (
            F.when(folded, F.struct(put(acc["m"], acc["k"], t.strip(F.concat_ws(" ", acc["m"][acc["k"]], t.strip(line)))).alias("m"), acc["k"].alias("k")))
            .when(line.contains(":"), F.struct(put(acc["m"], name, value).alias("m"), name.alias("k")))
            .otherwise(F.struct(acc["m"].alias("m"), F.lit(None).cast("string").alias("k")))
        )

    return F.aggregate(upto, start, step, lambda acc: acc["m"])


def bug_references(h: Column) -> Column:
    """Array of (tracker, ref) of the fields Bug and Bug-<tracker>."""
    named = F.filter(F.map_entries(h), lambda e: (e["key"] == "bug") | e["key"].startswith("bug-"))
    return F.transform(named, lambda e: F.struct(F.when(e["key"] == "bug", F.lit("upstream")).otherwise(F.substring(e["key"], 5, 1 << 30)).alias("tracker"), e["value"].alias("ref")))


def forwarding(header: Column, name: Column, h: Column) -> Column:
    """forwarded, debian-only or unknown: declared fields first, then naming habits."""
    origin = F.lower(t.strip(F.substring_index(F.coalesce(h["origin"], F.lit("")), ",", 1)))
    marked = header.rlike(r"(?idm)^[\s&&[^\n]]*#+[\s&&[^\n]]*DP:")
    return (
        F.when(F.map_contains_key(h, "applied-upstream"), "forwarded")
        .when(h["forwarded"].isNotNull(), F.when(F.lower(t.strip(h["forwarded"])).startswith("no"), "debian-only").otherwise("forwarded"))
        .when(origin.isin("upstream", "backport"), "forwarded")
        .when(origin == "vendor", "debian-only")
        .when(F.size(bug_references(h)) > 0, "forwarded")
        .when(marked | t.starts_with(t.basename(name), NAME_PREFIXES), "debian-only")
        .otherwise("unknown")
    )


def cves(header: Column) -> Column:
    """CVE ids of a header, upper-cased, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(header, F.lit(r"(?i)CVE-\d{4}-\d{4,}"), F.lit(0)), lambda x: F.upper(x)))


def description(h: Column) -> Column:
    return F.coalesce(F.nullif(h["description"], F.lit("")), F.nullif(h["subject"], F.lit("")))


def claim_date(h: Column) -> Column:
    return F.coalesce(F.nullif(h["last-update"], F.lit("")), F.nullif(h["date"], F.lit("")))


def claimed_category(description: Column, name: Column, cves: Column) -> Column:
    base, folder = F.lower(t.basename(name)), F.when(name.contains("/"), F.lower(F.regexp_replace(name, "[^/]*$", ""))).otherwise("")
    said = F.concat(F.lower(F.coalesce(description, F.lit(""))), F.lit(" "), base, F.lit(" "), folder)
    out = F.when(F.size(cves) > 0, "security")
    for category, words in KEYWORDS.items():
        hit = t.contains_any(said, words)
        if category in FOLDERS:
            hit = hit | t.contains_any(folder, FOLDERS[category])
        if category == "packaging":
            hit = hit | t.starts_with(base, NAME_PREFIXES)
        out = out.when(hit, category)
    return out.otherwise("unknown")
