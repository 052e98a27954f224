"""Package versions: validity, parts, and a key whose natural order is the version order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

VALID = r"^(?:\d+:)?\d[A-Za-z0-9.+:~-]*$"
#: Characters in version order: the tilde first, then the end, letters, and the rest.
FROM, TO = "~+-.:", "\x01{|}\x7f"


def valid(version: Column) -> Column:
    return F.coalesce(version.rlike(VALID), F.lit(False))


def epoch(version: Column) -> Column:
    return F.when(version.contains(":"), F.substring_index(version, ":", 1)).otherwise(F.lit("0")).cast("decimal(38,0)")


def upstream(version: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(version, r"^\d+:", ""), r"-[^-]*$", "")


def revision(version: Column) -> Column:
    rest = F.regexp_replace(version, r"^\d+:", "")
    return F.when(rest.contains("-"), F.substring_index(rest, "-", -1)).otherwise(F.lit("0"))


def part_key(part: Column) -> Column:
    """Alternating non-digit and digit runs, closed by an end mark that only a tilde sorts below."""
    pairs = F.filter(F.regexp_extract_all(part, F.lit(r"([^0-9]*)([0-9]*)"), F.lit(0)), lambda x: x != "")
    one = lambda x: F.struct(
        F.concat(F.translate(F.regexp_extract(x, r"^([^0-9]*)", 1), FROM, TO), F.lit("\x02")).alias("n"),
        F.coalesce(F.nullif(F.regexp_extract(x, r"([0-9]*)$", 1), F.lit("")).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("d"),
    )
    return F.concat(F.transform(pairs, one), F.array(F.struct(F.lit("\x02").alias("n"), F.lit(0).cast("decimal(38,0)").alias("d"))))


def key(version: Column) -> Column:
    """Comparable struct of a valid version, null for an invalid one."""
    return F.when(valid(version), F.struct(epoch(version).alias("epoch"), part_key(upstream(version)).alias("upstream"), part_key(revision(version)).alias("revision")))


def upstream_key(version: Column) -> Column:
    return F.when(valid(version), part_key(upstream(version)))


def candidates(version: Column) -> Column:
    """The version as recorded, then without its epoch."""
    return F.array_distinct(F.array(version, F.regexp_replace(version, r"^\d+:", "")))
