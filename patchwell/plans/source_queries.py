"""Queries over readers: their text inputs are built from the tables, so that their work grows with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import fingerprints, publish
from ..sources import readers
from . import derive

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return add


def rows(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("""SELECT concat('p', p_partkey) AS "binary", concat(p_size, '.1') AS version, CASE WHEN p_partkey % 4 = 0 THEN concat('s', p_partkey % 50) ELSE concat('p', p_partkey) END AS source,
CASE WHEN p_partkey % 6 = 0 THEN '9.9' ELSE concat(p_size, '.1') END AS source_version, 'amd64' AS arch FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0""")
def inventory_scan(spark, d):
    k = F.col("p_partkey")
    status = F.when(k % 5 == 0, "rc ").when(k % 3 == 0, "hi ").otherwise("ii ")
    line = F.concat_ws("\t", status, F.concat(F.lit("p"), k), F.concat("p_size", F.lit(".1")), F.when(k % 4 == 0, F.concat(F.lit("s"), k % 50)).otherwise(""), F.when(k % 6 == 0, "9.9").otherwise(""), F.lit("amd64"))
    return readers.inventory(rows(spark, d, "part").select(F.when(k % 7 == 0, "garbage\tline").otherwise(line).alias("value")))


@query("""SELECT concat('src', s_suppkey) AS source, concat('1.', s_nationkey) AS version, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '3.0 (quilt)' END AS format, CASE WHEN s_suppkey % 2 = 0 THEN 'a,b' ELSE 'a' END AS binaries FROM supplier WHERE s_suppkey % 8 <> 0""")
def source_index_scan(spark, d):
    k = F.col("s_suppkey")
    stanza = F.concat(F.lit("Package: src"), k, F.when(k % 3 == 0, "").otherwise("\nFormat: 3.0 (quilt)"), F.when(k % 2 == 0, "\nBinary: a,\n b").otherwise("\nBinary: a"), F.when(k % 8 == 0, "").otherwise(F.concat(F.lit("\nVersion: 1."), "s_nationkey")))
    return readers.source_index(rows(spark, d, "supplier").select(stanza.alias("value"))).withColumn("binaries", F.array_join("binaries", ","))


@query("""WITH e AS (SELECT l_partkey AS p, CASE WHEN l_suppkey % 2 = 0 THEN 'deb' ELSE 'other' END AS repo, l_quantity::BIGINT AS v FROM lineitem), n AS (SELECT DISTINCT p FROM e WHERE repo = 'deb')
SELECT concat('proj', e.p) AS project, concat('n', e.p) AS name, concat('1.', v) AS version, 'newest' AS status, count(*) AS copies FROM e JOIN n ON n.p = e.p GROUP BY ALL""")
def upstream_feed_scan(spark, d):
    entry = F.struct(F.when(F.col("l_suppkey") % 2 == 0, "deb").otherwise("other").alias("repo"), F.concat(F.lit("n"), "l_partkey").alias("srcname"), F.concat(F.lit("1."), F.col("l_quantity").cast("long")).alias("version"), F.lit("newest").alias("status"))
    pages = rows(spark, d, "lineitem").groupBy("l_partkey").agg(F.collect_list(entry).alias("e")).select(F.to_json(F.create_map(F.concat(F.lit("proj"), "l_partkey"), F.col("e"))).alias("value"))
    return readers.upstream_feed(pages, "deb").groupBy("project", "name", "version", "status").agg(F.count(F.lit(1)).alias("copies"))


@query("""SELECT concat('b', l_suppkey) AS "binary", count(*) AS inst, count(*) FILTER (WHERE l_returnflag = 'R') AS vote FROM lineitem WHERE l_suppkey % 9 <> 0 GROUP BY 1""")
def install_count_scan(spark, d):
    g = rows(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("v"))
    k = F.col("l_suppkey")
    line = F.concat_ws(" ", k, F.concat(F.lit("b"), k), "n", "v", F.lit(0), F.lit(0), F.lit(0), F.lit("(x)"))
    bad = F.when(k % 27 == 0, "# comment").when(k % 18 == 0, F.concat_ws(" ", k, F.lit("Total"), "n", "v", F.lit("0 0 0"))).otherwise(F.concat_ws(" ", k, F.lit("short")))
    return readers.install_counts(g.select(F.when(k % 9 == 0, bad).otherwise(line).alias("value")))


@query(f"""WITH {derive.ctes("tracker")}, r AS (SELECT source, cve, max(CASE WHEN status = 'open' THEN 1 ELSE 0 END) AS o FROM tracker GROUP BY 1, 2)
SELECT source, cve, CASE WHEN substr(cve, 12)::INT % 3 = 0 THEN 'open' ELSE 'resolved' END AS status, CASE WHEN substr(cve, 12)::INT % 3 <> 0 THEN '1.2' END AS fixed_version FROM r""")
def tracker_scan(spark, d):
    """Entries have an own release with a third of the CVEs; the others fall back to the best status."""
    x = derive.table(spark, d, "tracker").select("source", "cve").distinct()
    n = F.substring("cve", 12, 9).cast("int")
    release = lambda status, fixed: F.struct(F.lit(status).alias("status"), F.lit(fixed).cast("string").alias("fixed_version"))
    releases = F.when(n % 3 == 0, F.map_from_arrays(F.array(F.lit("own"), F.lit("old")), F.array(release("open", None), release("resolved", "1.0")))).otherwise(F.map_from_arrays(F.array(F.lit("x"), F.lit("y")), F.array(release("open", None), release("resolved", "1.2"))))
    entry = F.struct(F.lower("cve").alias("k"), F.struct(releases.alias("releases")).alias("v"))
    docs = x.groupBy("source").agg(F.map_from_entries(F.collect_list(entry)).alias("m")).select(F.to_json(F.create_map("source", "m")).alias("value"))
    return readers.tracker(docs, "own")


@query("SELECT o_orderkey AS bug, concat('s', o_custkey) AS source, lower(o_orderstatus) AS status FROM orders WHERE o_orderkey % 13 <> 0")
def bug_index_scan(spark, d):
    k = F.col("o_orderkey")
    o = rows(spark, d, "orders").select(F.concat_ws("\t", F.when(k % 13 == 0, "x").otherwise(k.cast("string")), F.concat(F.lit("s"), "o_custkey"), "o_orderstatus").alias("value"))
    return readers.bug_tables(readers.bug_index(o.filter("value not like '1%'")), readers.bug_index(o.filter("value like '1%'")), 1)


@query("""SELECT concat('s', o_custkey) AS source, concat('p', o_orderkey, '.patch') AS name, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY ALL""")
def series_scan(spark, d):
    o = rows(spark, d, "orders").select(F.concat(F.lit("s"), "o_custkey").alias("source"), F.concat(F.lit("p"), "o_orderkey", F.lit(".patch")).alias("name"), "o_orderkey")
    text = o.groupBy("source").agg(F.concat(F.lit("# series\n\n"), F.array_join(F.collect_list(F.concat(F.lit(" "), "name", F.lit(" -p1"))), "\n")).alias("series"))
    return readers.series(text, o.filter("o_orderkey % 4 <> 0")).groupBy("source", "name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat('s', c_custkey) AS source, CASE WHEN c_custkey % 2 = 0 THEN 'own' ELSE 'lib' END AS synopsis FROM customer")
def synopsis_pick(spark, d):
    k = F.col("c_custkey")
    control = F.concat(F.lit("Package: lib\nDescription: lib\n more\n\nPackage: "), F.when(k % 2 == 0, F.concat(F.lit("s"), k)).otherwise("x"), F.lit("\nDescription: own\n"))
    return readers.control_synopsis(rows(spark, d, "customer").select(F.concat(F.lit("s"), k).alias("source"), control.alias("control")))


@query("""SELECT concat('s', p_partkey) AS source, CASE p_partkey % 5 WHEN 0 THEN 'native' WHEN 1 THEN 'patched' WHEN 2 THEN 'clean' WHEN 3 THEN 'unknown' ELSE 'patched' END AS state, (CASE p_partkey % 5 WHEN 1 THEN 99 WHEN 4 THEN 2 ELSE 0 END)::BIGINT AS total FROM part""")
def patch_api_states(spark, d):
    k = F.col("p_partkey") % 5
    two, none = F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>")
    x = rows(spark, d, "part").select(
        F.concat(F.lit("s"), "p_partkey").alias("source"), F.lit("1").alias("version"), F.when(k == 0, "3.0 (native)").when(k == 3, None).otherwise("3.0 (quilt)").alias("format"),
        F.when(k.isin(1, 4), two).when(k == 3, None).otherwise(none).alias("names"), F.when(k == 1, 99).when(k == 4, 1).cast("long").alias("count"),
    )
    return readers.patch_api(x).drop("version")


@query("""SELECT concat('s', p_partkey) AS source, CASE p_partkey % 5 WHEN 0 THEN 'native' WHEN 1 THEN 'unknown' WHEN 2 THEN 'unknown' WHEN 3 THEN 'clean' ELSE 'patched' END AS state, CASE p_partkey % 5 WHEN 1 THEN 'fetch-failed' WHEN 2 THEN 'non-quilt-format' END AS error FROM part""")
def source_outcomes(spark, d):
    k = F.col("p_partkey") % 5
    empty = F.create_map().cast("map<string,string>")
    texts = F.when(k == 1, None).when(k == 3, empty).otherwise(F.create_map(F.lit("a.patch"), F.lit("x")))
    x = rows(spark, d, "part").select(F.concat(F.lit("s"), "p_partkey").alias("source"), F.lit("1").alias("version"), F.when(k == 0, "3.0 (native)").when(k == 2, "1.0").otherwise("3.0 (quilt)").alias("format"), texts.alias("texts"))
    return readers.source_outcome(x).drop("version")


OUT = "CASE o_orderkey % 4 WHEN 0 THEN 'patched' WHEN 1 THEN 'clean' ELSE 'unknown' END AS state, CASE o_orderkey % 4 WHEN 2 THEN 'fetch-failed' WHEN 3 THEN 'non-quilt-format' END AS error"


def outcome_rows(spark, d):
    o = rows(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    return o.select(F.concat(F.lit("s"), "o_custkey").alias("source_package"), F.lit("1").alias("version"), "o_orderkey", F.when(k == 0, "patched").when(k == 1, "clean").otherwise("unknown").alias("state"), F.when(k == 2, "fetch-failed").when(k == 3, "non-quilt-format").alias("error"))


@query(f"WITH o AS (SELECT o_custkey, o_orderkey, {OUT} FROM orders), l AS (SELECT o_custkey, max(o_orderkey) AS m FROM o GROUP BY 1) SELECT state, count(*) AS n, count(*) FILTER (WHERE error = 'fetch-failed') AS fetch_failures, count(*) FILTER (WHERE error = 'non-quilt-format') AS non_quilt FROM o JOIN l ON l.m = o.o_orderkey GROUP BY 1")
def outcome_accounting(spark, d):
    return fingerprints.outcomes(fingerprints.last_rows(outcome_rows(spark, d), ["source_package", "version"], "o_orderkey"))


@query(f"WITH o AS (SELECT o_custkey, o_orderkey, {OUT} FROM orders), l AS (SELECT o_custkey, max(o_orderkey) AS m FROM o GROUP BY 1) SELECT concat('s', c_custkey) AS source, '1' AS version FROM customer WHERE c_custkey NOT IN (SELECT o.o_custkey FROM o JOIN l ON l.m = o.o_orderkey WHERE error IS NULL OR error <> 'fetch-failed')")
def acquisition_list(spark, d):
    last = fingerprints.last_rows(outcome_rows(spark, d), ["source_package", "version"], "o_orderkey")
    return publish.acquisition(rows(spark, d, "customer").select(F.concat(F.lit("s"), "c_custkey").alias("source"), F.lit("1").alias("version")), last)


@query("SELECT concat('s', o_custkey) AS source_package, max(strftime(o_orderdate, '%Y-%m-%d')) AS changelog_date FROM orders GROUP BY 1")
def changelog_dates(spark, d):
    o = rows(spark, d, "orders")
    entry = F.concat(F.lit("x (1) y\n\n  * z\n\n -- A B <a@b>  "), F.date_format("o_orderdate", "EEE, d MMM yyyy"), F.lit(" 10:00:00 +0000\n"))
    x = o.select(F.concat(F.lit("s"), "o_custkey").alias("source_package"), F.lit("1").alias("version"), t.changelog_date(entry).alias("changelog_date"), F.lit(None).cast("string").alias("description"))
    return fingerprints.package_facts(x).drop("description")


@query("SELECT sha256(text) AS sha, min(length(text)) AS n FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) GROUP BY 1")
def new_bodies(spark, d):
    docs = rows(spark, d, "documents").filter("text IS NOT NULL")
    stored = docs.filter("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha")).distinct()
    return publish.new_bodies(docs.select(F.col("text").alias("body")), stored).select("sha", F.length("body").cast("long").alias("n"))
