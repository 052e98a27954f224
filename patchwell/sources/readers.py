"""Readers of text tables, feeds, snapshots and exports. Schemas are fixed; what doesn't fit is dropped as documented."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import text as t
from . import commits

# Statuses of a tracker, best first.
STATUS_ORDER = ["resolved", "open", "undetermined"]


def inventory(lines: DataFrame) -> DataFrame:
    """Installed packages of tab-separated lines `value` (status, package, version, source, source version, architecture).

    Only rows of six fields whose status has i in its second place; an empty source name or version is the binary's.
    """
    f = F.split("value", "\t", -1)
    rows = lines.withColumn("f", f).filter((F.size("f") == 6) & (F.substring(t.strip(F.col("f")[0]), 2, 1) == "i"))
    own = lambda i, j: F.coalesce(F.nullif(F.col("f")[i], F.lit("")), F.col("f")[j])
    return rows.select(F.col("f")[1].alias("binary"), F.col("f")[2].alias("version"), own(3, 1).alias("source"), own(4, 2).alias("source_version"), F.col("f")[5].alias("arch"))


def stanzas(spark: SparkSession, path: str) -> DataFrame:
    """Blank-line-separated stanzas as `value`."""
    return spark.read.option("lineSep", "\n\n").text(path)


def source_index(stanza: DataFrame) -> DataFrame:
    """source, version, format, binaries of index stanzas; those without name or version are dropped."""
    field = lambda n: F.nullif(t.strip(F.regexp_extract("value", rf"(?m)^{n}: *(.*)$", 1)), F.lit(""))
    folded = F.regexp_extract("value", r"(?m)^Binary: *(.*(?:\n[ \t].*)*)", 1)
    return stanza.select(field("Package").alias("source"), field("Version").alias("version"), field("Format").alias("format"), t.binary_names(folded).alias("binaries")).filter("source IS NOT NULL AND version IS NOT NULL")


def upstream_feed(pages: DataFrame, repo: str) -> DataFrame:
    """Entries (project, name, version, status) of JSON pages `value`; name is the entry's source name in `repo`, with all entries of its project."""
    rows = pages.select(F.explode(F.from_json("value", schemas.FEED)).alias("project", "entries")).filter("entries IS NOT NULL")
    names = F.array_distinct(F.transform(F.filter("entries", lambda e: (e["repo"] == repo) & e["srcname"].isNotNull()), lambda e: e["srcname"]))
    return rows.withColumn("name", F.explode(names)).select("project", "name", F.explode("entries").alias("e")).select("project", "name", "e.version", "e.status")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with an ordinal `ord` in file order."""
    return spark.read.schema(schema).json(path).withColumn("ord", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))


def series(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Patch names of series files (source, series) in order; names without a file (source, name) are dropped."""
    x = rows.select("source", F.posexplode(t.lines(F.col("series"))).alias("position", "line")).withColumn("line", t.strip(F.col("line")))
    names = x.filter((F.col("line") != "") & ~F.col("line").startswith("#")).select("source", "position", F.split("line", r"\s+")[0].alias("name"))
    return names.join(files.select("source", "name").distinct(), ["source", "name"])


def control_synopsis(controls: DataFrame) -> DataFrame:
    """Synopsis of each source (source, control): of the stanza named like it, else of the first with a description."""
    s = controls.select("source", F.posexplode(F.split("control", r"\n\s*\n")).alias("pos", "stanza"))
    s = s.withColumn("name", F.regexp_extract("stanza", r"(?m)^Package: *(\S+)", 1)).withColumn("synopsis", F.nullif(t.strip(F.regexp_extract("stanza", r"(?m)^Description: *(.*)$", 1)), F.lit("")))
    return s.filter("synopsis IS NOT NULL").groupBy("source").agg(F.min_by("synopsis", F.struct(F.col("name") != F.col("source"), F.col("pos"))).alias("synopsis"))


def patch_api(rows: DataFrame) -> DataFrame:
    """State and total of API answers (source, version, format, names array, count): the count stands where it isn't below the names listed."""
    listed = F.coalesce(F.size(F.filter("names", lambda x: x.isNotNull())), F.lit(0))
    listed = F.when(F.col("names").isNull(), 0).otherwise(listed)
    total = F.when(F.col("count") >= listed, F.col("count")).otherwise(listed)
    f = F.lower("format")
    state = F.when(F.col("format").isNull() & F.col("names").isNull(), "unknown").when(f.contains("native"), "native").when(total > 0, "patched").when(f.contains("quilt"), "clean").otherwise("unknown")
    return rows.select("source", "version", state.alias("state"), F.when(state == "patched", total).otherwise(0).cast("long").alias("total"))


def source_outcome(rows: DataFrame) -> DataFrame:
    """State and error of fetched sources (source, version, format, texts map or null)."""
    n = F.when(F.col("texts").isNotNull(), F.size("texts"))
    f = F.lower("format")
    state = F.when(f.contains("native"), "native").when(n.isNull(), "unknown").when(~f.contains("quilt"), "unknown").when(n == 0, "clean").otherwise("patched")
    error = F.when(f.contains("native"), None).when(n.isNull(), "fetch-failed").when(~f.contains("quilt"), "non-quilt-format")
    return rows.select("source", "version", state.alias("state"), error.alias("error"))


def install_counts(lines: DataFrame) -> DataFrame:
    """(binary, inst, vote) of a white-space table; comments, rules, short rows, the total and non-numbers are dropped."""
    rows = lines.withColumn("f", F.split(F.trim("value"), r"\s+")).filter(~F.col("value").rlike("^[#-]") & (F.size("f") >= 7))
    rows = rows.select(F.col("f")[1].alias("binary"), F.col("f")[2].try_cast("bigint").alias("inst"), F.col("f")[3].try_cast("bigint").alias("vote"))
    return rows.filter("binary <> 'Total' AND inst IS NOT NULL AND vote IS NOT NULL")


def tracker(documents: DataFrame, release: str) -> DataFrame:
    """(source, cve, status, fixed_version) of JSON documents `value`: the release's entry, else the best status, with a fixed version if any."""
    rows = documents.select(F.explode(F.from_json("value", schemas.TRACKER)).alias("source", "cves")).select("source", F.explode("cves").alias("cve", "entry"))
    rows = rows.filter(F.upper("cve").startswith("CVE-")).withColumn("rel", F.col("entry.releases")).filter("rel IS NOT NULL AND size(rel) > 0")
    rank = lambda x: F.when(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), x["status"]) > 0, F.array_position(F.array(*map(F.lit, STATUS_ORDER)), x["status"])).otherwise(9)
    ordered = F.array_sort(F.transform(F.map_values("rel"), lambda x: F.struct(rank(x).alias("r"), x["fixed_version"].isNull().alias("n"), x["status"].alias("status"), x["fixed_version"].alias("fixed_version"))))
    own = F.col("rel")[release]
    best = F.element_at(ordered, 1)
    return rows.select("source", F.upper("cve").alias("cve"), F.coalesce(own["status"], best["status"], F.lit("undetermined")).alias("status"), F.when(own.isNotNull(), own["fixed_version"]).otherwise(best["fixed_version"]).alias("fixed_version"))


def bug_index(lines: DataFrame) -> DataFrame:
    """(bug, source, status) of tab- or space-separated lines; rows whose bug isn't a number are dropped."""
    f = F.split(F.trim("value"), r"\t|\s+")
    rows = lines.select(f[0].try_cast("bigint").alias("bug"), F.get(f, 1).alias("source"), F.lower(F.get(f, 2)).alias("status"))
    return rows.filter("bug IS NOT NULL AND source IS NOT NULL")


def bug_tables(open_bugs: DataFrame, archived: DataFrame, least: int) -> DataFrame:
    """Both tables, one after the other; an error where fewer rows than `least` come together."""
    rows = open_bugs.unionByName(archived)
    if rows.limit(least).count() < least:
        raise ValueError("too few bugs")
    return rows


def bundle(spark: SparkSession, path: str, release: str) -> tuple[DataFrame, DataFrame]:
    """(staleness, divergence) tables of a published bundle; another schema version or release is an error."""
    doc = schemas.expect_version(spark.read.schema(schemas.BUNDLE).json(path), "schema", schemas.BUNDLE_VERSION)
    doc = doc.filter(F.when(F.col("release") == release, F.lit(True)).otherwise(F.raise_error(F.lit("bundle of another release")).cast("boolean")))
    d = doc.select(F.explode("divergence").alias("source", "e")).select("source", "e.*")
    return doc.select(F.explode("staleness").alias("source", "newest")), d


def _committed(spark: SparkSession, path: str) -> tuple[str, dict]:
    entry = commits.latest(spark, path)
    if entry is None:
        raise FileNotFoundError(f"nothing is committed in {path}")
    return f"{path}/{entry['folder']}", entry


def verdict_bundle(spark: SparkSession, path: str, release: str) -> DataFrame:
    """(fingerprint, category, kind, ...) of a verdict bundle; another schema version or release is an error."""
    doc = schemas.expect_version(spark.read.schema(schemas.VERDICT_BUNDLE).json(path), "schema", schemas.BUNDLE_VERSION)
    doc = doc.filter(F.when(F.col("release") == release, F.lit(True)).otherwise(F.raise_error(F.lit("bundle of another release")).cast("boolean")))
    return doc.select(F.explode("verdicts").alias("fingerprint", "e")).select("fingerprint", "e.*")


def export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the last export that publish.write_export has committed; columns that were null are null again."""
    folder, entry = _committed(spark, path)
    if entry["version"] != schemas.EXPORT_VERSION:
        raise ValueError(f"unknown export version: {entry['version']}")
    return spark.read.schema(schema + ", month string").json(folder).drop("month")


def export_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(month, n, version) of the last committed export."""
    _, entry = _committed(spark, path)
    return spark.createDataFrame([(m, n, entry["version"]) for m, n in sorted(entry["months"].items())], "month string, n bigint, version int")


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last committed snapshot."""
    return spark.read.parquet(_committed(spark, path)[0])


def known_index(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Fingerprints of an index of publish.write_index that may start with a prefix: of one folder, if it has two characters or more."""
    rows = spark.read.schema("fingerprint string, prefix string").parquet(_committed(spark, path)[0])
    return (rows.filter(F.col("prefix") == prefix[:2]) if len(prefix) >= 2 else rows).select("fingerprint")


def _steps(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """One table of all committed steps of a corpus build; empty before the first."""
    folders = [f"{path}/{commits.read(spark, path, n)['folder']}/{name}" for n in commits.numbers(spark, path)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def corpus_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Outcome rows of a corpus build; a package that was tried again has several, of which the last without a failed fetch counts."""
    return _steps(spark, path, "packages", "source_package string, version string, state string, source_format string, n_patches int, error string")


def corpus_patches(spark: SparkSession, path: str) -> DataFrame:
    """Patch rows of a corpus build."""
    return _steps(spark, path, "patches", schemas.PROVENANCE_ROWS)


def corpus_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(sha, body, prefix) of all bodies stored, those of a step that was stopped included."""
    schema = "sha string, body string, prefix string"
    try:
        return spark.read.schema(schema).parquet(f"{path}/bodies")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
