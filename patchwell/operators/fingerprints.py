"""Fingerprint groups and dedup measures over patch provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .diff import VARIANTS, with_fingerprints

# Buckets of the multiplicity histogram.
BUCKETS = [("1", 1, 1), ("2", 2, 2), ("3-5", 3, 5), ("6-10", 6, 10), ("11-50", 11, 50), ("51+", 51, 1 << 40)]


def fingerprint_bodies(bodies: DataFrame) -> DataFrame:
    """(sha, body) to sha, fingerprint and the three other variants: each distinct body once."""
    return with_fingerprints(bodies).drop("body")


def last_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in append order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def index(provenance: DataFrame, bodies: DataFrame) -> DataFrame:
    """A row for each provenance row with its body's fingerprint."""
    return provenance.join(fingerprint_bodies(bodies), provenance["raw_sha256"] == F.col("sha")).drop("sha")


def groups(index: DataFrame) -> DataFrame:
    """fingerprint, n_occurrences, n_packages, the first row in (source_package, version, patch_name, raw_sha256) order and the smallest sha."""
    row = F.struct("source_package", "version", "patch_name", "raw_sha256")
    g = index.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_occurrences"), F.count_distinct("source_package").alias("n_packages"), F.min(row).alias("r"), F.min("raw_sha256").alias("min_sha"))
    return g.select("fingerprint", "n_occurrences", "n_packages", "r.*", "min_sha")


def sensitivity(index: DataFrame) -> DataFrame:
    """variant, n_rows, distinct bodies and fingerprints, ratio, for each of the four variants."""
    pairs = [F.struct(F.lit(k).alias("variant"), F.col("fingerprint" if k == "default" else f"fingerprint_{k}").alias("fp")) for k in VARIANTS]
    rows = index.select("raw_sha256", F.explode(F.array(*pairs)).alias("v")).select("raw_sha256", "v.*")
    out = rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("raw_sha256").alias("n_bodies"), F.count_distinct("fp").alias("n_fingerprints"))
    return out.withColumn("ratio", F.col("n_rows") / F.col("n_fingerprints"))


def histogram(counts: DataFrame, column: str = "n_packages") -> DataFrame:
    """bucket, position and how many rows of `counts` fall in it, empty buckets as 0."""
    buckets = counts.sparkSession.createDataFrame([(i, *b) for i, b in enumerate(BUCKETS)], "position int, bucket string, low bigint, high bigint")
    of = F.when(F.lit(False), "")
    for name, low, high in BUCKETS:
        of = of.when(F.col(column).between(low, high), name)
    n = counts.select(of.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return buckets.join(n, "bucket", "left").select("position", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top_recurring(groups: DataFrame, n: int) -> DataFrame:
    return groups.orderBy(F.desc("n_packages"), F.desc("n_occurrences"), F.desc("fingerprint")).limit(n)


def repeats_inside(index: DataFrame) -> DataFrame:
    """Packages with fewer distinct fingerprints than patches."""
    g = index.groupBy("source_package").agg(F.count(F.lit(1)).alias("n_patches"), F.count_distinct("fingerprint").alias("n_fingerprints"))
    return g.filter("n_patches <> n_fingerprints")


def outcomes(packages: DataFrame) -> DataFrame:
    """state, n, fetch_failures, non_quilt of package outcome rows."""
    return packages.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("error").startswith("fetch-"), F.lit(False))).alias("fetch_failures"), F.count_if(F.coalesce(F.col("error") == "non-quilt-format", F.lit(False))).alias("non_quilt"))


def package_facts(packages: DataFrame) -> DataFrame:
    """Latest changelog date and the synopsis of the newest row that has one, for each source package."""
    return packages.groupBy("source_package").agg(F.max("changelog_date").alias("changelog_date"), F.max_by("description", F.when(F.col("description").isNotNull(), F.struct(F.coalesce("changelog_date", F.lit("")), "version"))).alias("description"))


def for_package(index: DataFrame, query: str) -> DataFrame:
    """Fingerprints carried by packages whose name holds `query`, whatever its case."""
    return index.filter(F.contains(F.lower("source_package"), F.lit(query.lower()))).select("fingerprint").distinct()
