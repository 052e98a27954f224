"""Drift of installed packages: version lag, carried patches, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import versions

# Upstream statuses that don't count.
UNUSABLE = ["ignored", "incorrect", "untrusted", "noscheme"]
BEHIND, DEBIAN_ONLY, UNKNOWN = 2, 3, 1


def one_per_source(inventory: DataFrame) -> DataFrame:
    """The first version seen of each source, in input order `ord`."""
    return inventory.groupBy("source").agg(F.min_by("source_version", "ord").alias("version"), F.min("ord").alias("ord"))


def usable(entries: DataFrame) -> DataFrame:
    return entries.filter((F.col("version") != "") & ~F.coalesce(F.col("status").isin(UNUSABLE), F.lit(False)) & versions.valid(F.col("version")))


def newest_upstream(entries: DataFrame) -> DataFrame:
    """(name, newest): the largest version among those with status newest, else among all usable; ties by text. Keys are made once for each distinct version of a name."""
    once = usable(entries).groupBy("name", "version").agg(F.bool_or(F.coalesce(F.col("status") == "newest", F.lit(False))).alias("first"))
    key = F.struct("first", versions.key(F.col("version")), F.col("version"))
    return once.groupBy("name").agg(F.max_by("version", key).alias("newest"))


def newest_archive(sources: DataFrame) -> DataFrame:
    """The largest version of each source in an archive (source, version, format, ord); ties keep the first."""
    r = F.max_by(F.struct("version", "format"), F.struct(versions.key(F.col("version")), -F.col("ord")))
    return sources.groupBy("source").agg(r.alias("r")).select("source", "r.*")


def staleness_state(installed: Column, newest: Column) -> Column:
    """behind, current or unknown; only upstream parts are compared."""
    a, b = versions.upstream_key(installed), versions.upstream_key(newest)
    return F.when(a.isNull() | b.isNull(), "unknown").when(a < b, "behind").otherwise("current")


def staleness(installed: DataFrame, newest: DataFrame) -> DataFrame:
    rows = installed.join(newest.withColumnRenamed("name", "source"), "source", "left")
    return rows.select("source", "version", "newest", staleness_state(F.col("version"), F.col("newest")).alias("staleness"))


def divergence(installed: DataFrame, bundle: DataFrame, known: list[str]) -> DataFrame:
    """Bundle entry (state, total) of the exact source and version; states that aren't known count as a miss."""
    rows = installed.join(bundle.filter(F.col("state").isin(known)), ["source", "version"], "left")
    return rows.select("source", "version", F.coalesce("state", F.lit("unknown")).alias("state"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def with_fallback(wanted: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The first tier's row of each key, else the second's, with the tier."""
    cols = [c for c in first.columns if c != key]
    a = first.select(key, F.struct(*cols).alias("a"))
    b = second.select(key, F.struct(*cols).alias("b"))
    rows = wanted.join(a, key, "left").join(b, key, "left")
    return rows.withColumn("r", F.coalesce("a", "b")).withColumn("tier", F.when(F.col("a").isNotNull(), 1).when(F.col("b").isNotNull(), 2)).select(*wanted.columns, "r.*", "tier")


def candidate_match(wanted: DataFrame, recorded: DataFrame) -> DataFrame:
    """Wanted (source, version) rows with the recorded row of the version as it is, else without its epoch."""
    tries = wanted.select("source", "version", F.posexplode(versions.candidates(F.col("version"))).alias("pos", "candidate"))
    rest = [c for c in recorded.columns if c not in ("source", "version")]
    r = recorded.select("source", F.col("version").alias("candidate"), *rest)
    hit = tries.join(r, ["source", "candidate"])
    return hit.groupBy("source", "version").agg(F.min_by(F.struct("candidate", *rest), "pos").alias("r")).select("source", "version", "r.*")


def combine(stale: DataFrame, diverged: DataFrame) -> DataFrame:
    """Drift of each source: 2 if behind, plus its carried patches."""
    rows = stale.join(diverged, ["source", "version"])
    return rows.withColumn("score", (F.when(F.col("staleness") == "behind", BEHIND).otherwise(0) + F.col("total")).cast("long"))


def drift_summary(drift: DataFrame) -> DataFrame:
    behind, carrying = F.col("staleness") == "behind", F.col("total") > 0
    return drift.agg(
        F.count_if(behind).alias("behind"), F.count_if(carrying).alias("carrying"), F.count_if(behind & carrying).alias("both"), F.count(F.lit(1)).alias("sources"),
        F.count_if(F.col("staleness") == "unknown").alias("staleness_unknown"), F.count_if(F.col("state") == "unknown").alias("divergence_unknown"),
        F.sum("total").alias("patches"), F.count_if(F.col("state") == "patched").alias("patched"), F.sum("score").alias("score"),
    )


def report(drift: DataFrame, view: str, show_all: bool = False) -> DataFrame:
    """Rows of a report in its order: staleness (behind only), divergence (with patches), score (above 0)."""
    if view == "staleness":
        order = F.when(F.col("staleness") == "behind", 0).when(F.col("staleness") == "unknown", 1).otherwise(2)
        return (drift if show_all else drift.filter("staleness = 'behind'")).orderBy(order, "source").select("source", "version", "newest", "staleness")
    if view == "divergence":
        return (drift if show_all else drift.filter("total > 0")).orderBy(F.desc("total"), "source").select("source", "version", "state", "total")
    return (drift if show_all else drift.filter("score > 0")).orderBy(F.desc("score"), F.desc("total"), "source").select("source", "version", "staleness", "state", "total", "score")


def class_counts(patches: DataFrame) -> DataFrame:
    """debian_only, forwarded and unknown patches of each source."""
    n = lambda v: F.count_if(F.col("forwarding") == v)
    return patches.groupBy("source").agg(n("debian-only").alias("debian_only"), n("forwarded").alias("forwarded"), n("unknown").alias("unclassified"), F.count(F.lit(1)).alias("total"))


def classified_scores(stale: DataFrame, counts: DataFrame, show_all: bool = False) -> DataFrame:
    """2 if behind, 3 for each debian-only patch, 1 for each unknown one; highest first."""
    rows = stale.join(counts, "source", "left").fillna(0, ["debian_only", "forwarded", "unclassified", "total"])
    score = F.when(F.col("staleness") == "behind", BEHIND).otherwise(0) + DEBIAN_ONLY * F.col("debian_only") + UNKNOWN * F.col("unclassified")
    rows = rows.withColumn("score", score.cast("long"))
    return (rows if show_all else rows.filter("score > 0")).orderBy(F.desc("score"), F.desc("debian_only"), "source")


def category_breakdown(patches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Categories of a source's patches that have a verdict, most first."""
    return patches.join(verdicts.select("fingerprint", "category"), "fingerprint").groupBy("source", "category").agg(F.count(F.lit(1)).alias("n")).orderBy("source", F.desc("n"), "category")


def resolve_names(inventory: DataFrame, names: DataFrame) -> DataFrame:
    """name, source and source_version of each name: of the binary of that name, else of the first row of the source; null where there is neither."""
    row = F.struct("source", "source_version")
    first = lambda column, name: inventory.groupBy(F.col(column).alias("name")).agg(F.min_by(row, "ord").alias(name))
    rows = names.select("name").join(first("binary", "b"), "name", "left").join(first("source", "s"), "name", "left")
    return rows.withColumn("r", F.coalesce("b", "s")).select("name", "r.source", "r.source_version")


def fresh(generated_at: Column, now: Column, days: int = 7) -> Column:
    """Whether a bundle's time stamp, which must carry a zone, is at most so many days old."""
    at = F.when(generated_at.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(generated_at))
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(at) <= days * 86400, F.lit(False))


def age_days(generated_at: Column, now: Column) -> Column:
    """Whole days since a time stamp; null if it can't be read."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(generated_at))) / 86400).cast("int")


def spot_check(bundle: DataFrame, independent: DataFrame, n: int, seed: int) -> DataFrame:
    """n sampled bundle rows against an independent source: match, mismatch or inconclusive, by verdict."""
    sample = bundle.orderBy(F.xxhash64("source", "version", F.lit(seed)), "source").limit(n)
    o = independent.select("source", "version", F.col("state").alias("own_state"), F.col("total").alias("own_total"))
    rows = sample.join(o, ["source", "version"], "left")
    blind = F.col("own_state").isNull() | (F.col("own_state") == "unknown") | (F.col("state") == "unknown")
    verdict = F.when(blind, "inconclusive").when((F.col("state") != F.col("own_state")) | (F.col("total") != F.col("own_total")), "mismatch").otherwise("match")
    return rows.withColumn("verdict", verdict)
