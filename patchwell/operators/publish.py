"""Bundles and exports: what the library hands to others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..sources import commits, readers


def _map(df: DataFrame, key: str, value: Column) -> DataFrame:
    """One row: the map of all keys, in order."""
    return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))))).alias("m"))


def bundle(staleness: DataFrame, divergence: DataFrame, release: str, generated_at: str) -> DataFrame:
    """The published bundle as one row of compact JSON. A bundle is one document by its format (a row a source, under 1 MB an archive)."""
    s = _map(staleness, "source", F.col("newest")).withColumnRenamed("m", "staleness")
    d = _map(divergence, "source", F.struct("version", "state", "total")).withColumnRenamed("m", "divergence")
    return s.join(F.broadcast(d)).select(F.to_json(F.struct(F.lit(schemas.BUNDLE_VERSION).alias("schema"), F.lit(release).alias("release"), F.lit(generated_at).alias("generated_at"), "staleness", "divergence")).alias("value"))


def write_bundle(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("overwrite").option("compression", "gzip").text(path)


def reason(kind: Column, decided_by: Column) -> Column:
    return F.when(kind == "human", "confirmed by a reviewer").when(kind == "llm", "drafted and verified by a model").otherwise(F.concat(F.lit("settled by rule "), decided_by))


def verdict_rows(verdicts: DataFrame, risk: DataFrame, reach: DataFrame, size: DataFrame) -> DataFrame:
    """A verdict with its axes for each fingerprint; an axis without a value stays null, which JSON leaves out."""
    rows = verdicts
    for name, axis in (("risk", risk), ("reach", reach), ("reviewability", size)):
        rows = rows.join(axis.withColumnRenamed("level", name), "fingerprint", "left")
    return rows.select("fingerprint", "category", "kind", "confidence", reason(F.col("kind"), F.col("decided_by")).alias("reason"), "risk", "reach", "reviewability")


def verdict_note() -> Column:
    """Over the columns of `verdict_rows`, one line: category, reason and the axes there are."""
    axes = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c} "), F.col(c))) for c in ("risk", "reach", "reviewability")]))
    return F.concat_ws("; ", F.concat("category", F.lit(" ("), "reason", F.lit(")")), F.nullif(F.array_join(axes, ", "), F.lit("")))


def verdict_lines(rows: DataFrame) -> DataFrame:
    """(fingerprint, value): lean JSON of each row."""
    return rows.select("fingerprint", F.to_json(F.struct("category", "confidence", "kind", "reach", "reason", "reviewability", "risk")).alias("value"))


def verdict_document(rows: DataFrame, release: str, generated_at: str) -> DataFrame:
    """The verdict bundle of `verdict_rows` as one row of compact JSON; one document by its format, as `bundle`."""
    entry = F.struct("category", "kind", "confidence", "reason", "risk", "reach", "reviewability")
    whole = _map(rows, "fingerprint", entry).withColumnRenamed("m", "verdicts")
    return whole.select(F.to_json(F.struct(F.lit(schemas.BUNDLE_VERSION).alias("schema"), F.lit(release).alias("release"), F.lit(generated_at).alias("generated_at"), "verdicts")).alias("value"))


def write_index(known: DataFrame, path: str) -> None:
    """Known fingerprints in folders by their first two characters, sorted in each: a prefix reads one folder of it."""
    spark, folder = known.sparkSession, commits.new_folder()
    rows = known.select("fingerprint").distinct().withColumn("prefix", F.substring("fingerprint", 1, 2))
    rows.repartitionByRange("fingerprint").sortWithinPartitions("fingerprint").write.partitionBy("prefix").parquet(f"{path}/{folder}")
    commits.commit(spark, path, {"folder": folder})
    commits.keep_last(spark, path)


def patch_verdicts(patches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Patches with their verdict, where there is one."""
    return patches.join(verdicts, "fingerprint", "left")


def month(at: Column) -> Column:
    return F.when(at.rlike(r"^\d{4}-\d{2}"), F.substring(at, 1, 7)).otherwise("undated")


def shards(rows: DataFrame, at: str) -> DataFrame:
    """Rows with their month, for writing."""
    return rows.withColumn("month", month(F.col(at)))


def write_export(rows: DataFrame, at: str, path: str) -> DataFrame:
    """JSON lines in one folder a month, in id order, null columns left out; returns the manifest (month, n, version) that is committed with them.

    Rows are dealt by ranges of (month, id): a large month, or all rows without a date, is many files in order of id.
    The manifest counts what the files hold, and is written last: until then, and after a failure, readers see the export before.
    """
    spark, folder = rows.sparkSession, commits.new_folder()
    shards(rows, at).repartitionByRange("month", "id").sortWithinPartitions("month", "id").write.partitionBy("month").json(f"{path}/{folder}")
    written = spark.read.schema("id bigint, month string").json(f"{path}/{folder}").groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    months = {r["month"]: r["n"] for r in written.collect()}  # a row a month
    commits.commit(spark, path, {"folder": folder, "version": schemas.EXPORT_VERSION, "rows": sum(months.values()), "months": months})
    commits.keep_last(spark, path)
    return readers.export_manifest(spark, path)


def work_list_rows(bundle_rows: DataFrame) -> DataFrame:
    return bundle_rows.filter("state = 'patched'").select("source", "version")


def acquisition(work: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Work (source, version) without a terminal outcome; failed fetches are tried again."""
    done = outcomes.filter(~F.coalesce(F.col("error").startswith("fetch-"), F.lit(False))).select(F.col("source_package").alias("source"), "version")
    return work.join(done, ["source", "version"], "left_anti")


def new_bodies(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct bodies (sha, body) that aren't stored yet."""
    rows = fetched.select(F.sha2("body", 256).alias("sha"), "body")
    return rows.groupBy("sha").agg(F.first("body").alias("body")).join(stored.select("sha"), "sha", "left_anti")


def write_snapshot(rows: DataFrame, path: str, anchor: str | None = None) -> None:
    """Replace a snapshot; an empty one, or one whose anchor column has no positive value, is refused.

    The rows are worked out once, into a folder of their own, and judged there; readers see the snapshot before until the new one is
    committed.
    """
    spark, folder = rows.sparkSession, commits.new_folder()
    rows.write.parquet(f"{path}/{folder}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/{folder}")
    n, most = written.agg(F.count(F.lit(1)), F.max(anchor) if anchor else F.lit(1)).first()
    if not n or not (most or 0) > 0:
        commits.drop(spark, f"{path}/{folder}")
        raise ValueError("refusing to replace a snapshot by an empty one")
    commits.commit(spark, path, {"folder": folder, "rows": n})
    commits.keep_last(spark, path)


def build_corpus(work: DataFrame, fetch: Callable[[DataFrame], DataFrame], path: str, steps: int = 16) -> None:
    """Acquire the work (source, version) that has no terminal outcome yet, in steps that are each committed; failed fetches are tried again.

    `fetch` gives (source, version, format, texts: patch name to body, or null) for each row of work. A step fetches its share
    once, adds the bodies that aren't stored, by their digest and in folders by its first characters, and commits its outcome and
    patch rows last. A build that is stopped goes on where it was: bodies without a commit are found again, and no outcome is without its bodies.
    """
    spark = work.sparkSession
    share = F.pmod(F.xxhash64("source", "version"), F.lit(steps))
    for step in range(steps):
        todo = acquisition(work.filter(share == step).select("source", "version").distinct(), readers.corpus_outcomes(spark, path))
        if todo.isEmpty():
            continue
        folder = commits.new_folder()
        fetch(todo).select("source", "version", "format", "texts").write.parquet(f"{path}/{folder}/fetched")
        fetched = spark.read.parquet(f"{path}/{folder}/fetched")
        patches = fetched.select("source", "version", F.explode("texts").alias("patch_name", "body"))
        prefix = F.substring("sha", 1, 2)
        new = new_bodies(patches, readers.corpus_bodies(spark, path)).withColumn("prefix", prefix)
        new.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(f"{path}/bodies")
        patches.select(F.col("source").alias("source_package"), "version", "patch_name", F.sha2("body", 256).alias("raw_sha256")).write.parquet(f"{path}/{folder}/patches")
        outcome = readers.source_outcome(fetched).join(fetched.select("source", "version", F.col("format").alias("source_format"), F.coalesce(F.size("texts"), F.lit(0)).alias("n")), ["source", "version"])
        outcome.select(F.col("source").alias("source_package"), "version", "state", "source_format", F.greatest("n", F.lit(0)).alias("n_patches"), "error").write.parquet(f"{path}/{folder}/packages")
        commits.commit(spark, path, {"folder": folder})
        commits.drop(spark, f"{path}/{folder}/fetched")


def classification_rows(classified: DataFrame) -> DataFrame:
    """The classification table: counts of an occurrence's profile, verdicts, and its lists as text, details by comma, signals and rules by bar."""
    texts = {"flag_details": ", ", "signals": "|", "rule_ids": "|"}
    return classified.select(*[F.array_join(c, texts[c]).alias(c) if c in texts and dict(classified.dtypes)[c].startswith("array") else c for c in classified.columns])


def package_lines(carriers: DataFrame, most: int = 8) -> DataFrame:
    """The first carriers of each fingerprint by name, then how many more."""
    names = F.array_sort(F.collect_set("source_package"))
    rows = carriers.groupBy("fingerprint").agg(names.alias("names"))
    more = F.size("names") - most
    return rows.select("fingerprint", F.concat(F.array_join(F.slice("names", 1, most), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise("")).alias("packages"))
