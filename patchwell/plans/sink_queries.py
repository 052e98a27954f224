"""Queries that write and read back: exports, snapshots, bundles, a corpus build, indexes and JSON lines, each under the application's shared folder."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as t
from ..operators import diff, fingerprints, ledger, publish, verdict
from ..session import shared_dir
from ..sources import readers
from . import derive, ledger_queries, patch_queries, source_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return add


def place(spark, name: str) -> str:
    """A folder of this run."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


BASE, DL = ledger_queries.BASE, patch_queries.DL
DECISION = "id bigint, fingerprint string, category string, confidence string, decided_by string, rule_version int, kind string, decided_at string"


@query(BASE + "SELECT id, fingerprint, category, confidence, decided_by, rule_version, kind, decided_at FROM decision")
def export_round_trip(spark, d):
    """An export, a second one that fails in the middle, and what readers see then."""
    rows, path = ledger_queries.tables(spark, d)[0].select(*[c.split()[0] for c in DECISION.split(", ")]), place(spark, "export")
    publish.write_export(rows, "decided_at", path)
    broken = rows.withColumn("category", F.when(F.col("id") % 1000 == 7, F.raise_error(F.lit("a row fails")).cast("string")).otherwise("none"))
    with contextlib.suppress(PySparkException):
        publish.write_export(broken, "decided_at", path)
    return readers.export(spark, path, DECISION)


@query(BASE + "SELECT CASE WHEN regexp_matches(decided_at, '^\\d{4}-\\d{2}') THEN substr(decided_at, 1, 7) ELSE 'undated' END AS month, count(*) AS n, 2 AS version FROM decision GROUP BY 1")
def export_written(spark, d):
    """The manifest that is committed with an export: counts of its files."""
    path = place(spark, "export")
    publish.write_export(ledger_queries.tables(spark, d)[0], "decided_at", path)
    return readers.export_manifest(spark, path)


@query(f"WITH {derive.ctes('install')} SELECT * FROM install")
def snapshot_round_trip(spark, d):
    """A snapshot, an empty one that is refused, and what readers see."""
    rows, path = derive.table(spark, d, "install"), place(spark, "snapshot")
    publish.write_snapshot(rows, path, "inst")
    with contextlib.suppress(ValueError):
        publish.write_snapshot(rows.withColumn("inst", F.lit(0).cast("bigint")), path, "inst")
    return readers.snapshot(spark, path)


@query(f"WITH {derive.ctes('bundle_row')}, r AS (SELECT source, min(version) AS version, min(state) AS state, min(total)::BIGINT AS total FROM bundle_row GROUP BY 1) SELECT source, version, state, total, source || '-new' AS newest FROM r")
def bundle_round_trip(spark, d):
    """The published bundle of all sources, written and read behind its version gate."""
    rows = derive.table(spark, d, "bundle_row").groupBy("source").agg(F.min("version").alias("version"), F.min("state").alias("state"), F.min("total").cast("bigint").alias("total"))
    path = place(spark, "bundle")
    newest = rows.select("source", F.concat("source", F.lit("-new")).alias("newest"))
    publish.write_bundle(publish.bundle(newest, rows, "r1", "2024-06-01T00:00:00Z"), path)
    staleness, divergence = readers.bundle(spark, path, "r1")
    return divergence.join(staleness, "source")


@query(ledger_queries.ORACLE_SQL["verdict_bundle"])
def verdict_bundle_round_trip(spark, d):
    """The verdict bundle of all fingerprints, written and read behind its version gate."""
    path = place(spark, "verdicts")
    publish.write_bundle(publish.verdict_document(ledger_queries.verdict_bundle(spark, d), "r1", "2024-06-01T00:00:00Z"), path)
    return readers.verdict_bundle(spark, path, "r1")


@query(DL + ", b AS (SELECT sha256(body) AS s FROM patch GROUP BY 1) SELECT source_package, version, count(DISTINCT patch_name) AS n_patches, count(DISTINCT sha256(body)) AS n_bodies, 'patched' AS state FROM patch GROUP BY 1, 2")
def corpus_build(spark, d):
    """All patches acquired in steps: a build that stops in its second step, then one that goes on."""
    patches = patch_queries.patches(spark, d).select("source_package", "version", "patch_name", "body")
    path, calls = place(spark, "corpus"), []
    deal = lambda source: F.pmod(F.xxhash64(source, "version"), F.lit(3))
    patches.withColumn("folder", deal("source_package")).write.partitionBy("folder").parquet(f"{path}-given")
    given = spark.read.parquet(f"{path}-given")
    texts = F.map_from_entries(F.collect_list(F.struct("patch_name", "body")))
    held = given.withColumnRenamed("source_package", "source")

    def fetch(work):
        calls.append(1)
        if len(calls) == 2:
            raise ConnectionError("the second step's fetch fails")
        # only folders with what a step asks for are read: all bodies are shuffled once in all steps, not once in each
        wanted = [r[0] for r in work.select(deal("source")).distinct().collect()]
        return held.filter(F.col("folder").isin(wanted)).join(work, ["source", "version"], "left_semi").groupBy("source", "version").agg(texts.alias("texts")).withColumn("format", F.lit("3.0 (quilt)"))

    work = given.select(F.col("source_package").alias("source"), "version").distinct()
    with contextlib.suppress(ConnectionError):
        publish.build_corpus(work, fetch, path, steps=3)
    publish.build_corpus(work, fetch, path, steps=3)
    bodies = readers.corpus_bodies(spark, path).select(F.col("sha").alias("raw_sha256"))
    rows = readers.corpus_patches(spark, path).join(bodies, "raw_sha256")  # a body stored twice would count twice
    per = rows.groupBy("source_package", "version").agg(F.count(F.lit(1)).alias("n_patches"), F.count_distinct("raw_sha256").alias("n_bodies"))
    return per.join(readers.corpus_outcomes(spark, path).select("source_package", "version", "state"), ["source_package", "version"])


@query(BASE + "SELECT fingerprint, category, decided_by, rule_version, kind, confidence, decided_at, id AS decision_id FROM cv")
def maintained_verdict(spark, d):
    """The verdict table kept up over three batches of decisions, each with the stamps known by then."""
    decision, _, _, log = ledger_queries.tables(spark, d)
    table, path = None, place(spark, "verdict")
    for batch in range(3):
        upto, own = decision.filter(F.col("id") % 3 <= batch), decision.filter(F.col("id") % 3 == batch)
        stamps = log.filter(F.col("id") % 3 <= batch)
        fresh = stamps.filter((F.col("id") % 3 == batch) | (F.col("id") % 2 == batch % 2))
        verdict.maintained(table, ledger.live(own, stamps, "decision"), fresh, ledger.live(upto, stamps, "decision")).write.parquet(f"{path}/{batch}")
        table = spark.read.parquet(f"{path}/{batch}")
    return verdict.verdicts(table).drop("evidence")


@query(ledger_queries.ORACLE_SQL["prefix_candidates"].replace("'f1'", "'f12'"))
def indexed_prefix(spark, d):
    """Prefix lookup in an index that is stored by prefix."""
    path = place(spark, "index")
    publish.write_index(ledger_queries.known_fingerprints(spark, d), path)
    return verdict.resolve_prefix(readers.known_index(spark, path, "f12"), "f12")


def _lines(spark, rows, order, name):
    """Rows as JSON lines in files in this order; the files' names are in order too."""
    path = place(spark, name)
    rows.repartitionByRange(4, order).sortWithinPartitions(order).drop(order).write.json(path)
    return path


@query("SELECT concat('s', o_custkey) AS source_package, '1' AS version, concat('p', o_orderkey % 5) AS patch_name, arg_max(md5(o_orderkey::VARCHAR), o_orderkey) AS raw_sha256 FROM orders GROUP BY 1, 2, 3")
def provenance_scan(spark, d):
    """Provenance lines read from files: of rows with one key, the last line stands."""
    o = source_queries.rows(spark, d, "orders")
    rows = o.select("o_orderkey", F.concat(F.lit("s"), "o_custkey").alias("source_package"), F.lit("1").alias("version"), F.concat(F.lit("p"), F.col("o_orderkey") % 5).alias("patch_name"), F.md5(F.col("o_orderkey").cast("string")).alias("raw_sha256"))
    lines = readers.json_lines(spark, _lines(spark, rows, "o_orderkey", "provenance"), schemas.PROVENANCE_ROWS)
    return fingerprints.last_rows(lines, ["source_package", "version", "patch_name"], "ord").drop("ord")


@query(source_queries.ORACLE_SQL["outcome_accounting"])
def outcome_scan(spark, d):
    """Outcome lines read from files, the last of each package, counted."""
    path = _lines(spark, source_queries.outcome_rows(spark, d), "o_orderkey", "outcomes")
    lines = readers.json_lines(spark, path, schemas.PACKAGE_ROWS)
    return fingerprints.outcomes(fingerprints.last_rows(lines, ["source_package", "version"], "ord"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(x) - (x[-1] = '')::INT END AS n_lines FROM (SELECT doc_id, text, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS x FROM documents) y")
def document_lines(spark, d):
    """Lines of each document, at every boundary that counts."""
    docs = source_queries.rows(spark, d, "documents")
    return docs.select("doc_id", F.coalesce(F.size(t.lines(F.col("text"))), F.lit(0)).alias("n_lines"))


@query(DL + """, t AS (SELECT patch_id, file_no, path, regexp_extract(path, '[^/]*$') AS base FROM fl)
SELECT patch_id, file_no, path, base, lower(CASE WHEN base ~ '.+\\.[^.]*' THEN regexp_extract(base, '(\\.[^.]*)$', 1) ELSE '' END) AS ext, lower(rtrim(substr(path, 1, length(path) - length(base)), '/')) AS folders, path AS inside, CASE WHEN base LIKE '%.orig' THEN regexp_replace(base, '\\.orig$', '') ELSE base END AS name FROM t""")
def path_parts(spark, d):
    """Paths of header lines, their parts, the path within a source tree, the name without a backup suffix."""
    path = F.col("target")
    rooted = F.concat(F.lit("pkg-1.2.orig/"), path)
    rows = diff.sections(patch_queries.patches(spark, d))
    return rows.select("patch_id", "file_no", path.alias("path"), t.basename(path).alias("base"), t.extension(path).alias("ext"), F.array_join(t.folders(path), "/").alias("folders"), t.source_tree_path(rooted).alias("inside"), t.strip_backup(t.basename(path)).alias("name"))
