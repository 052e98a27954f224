"""Queries over versions, installed packages, bundles and reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import versions
from ..operators import axes, drift, publish
from . import derive

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2024-06-01T00:00:00Z"


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return add


BASE = f"""WITH {derive.ctes("version_case", "installed", "bundle_row")},
nw AS (SELECT name, coalesce(max(row(k1, k2, k3, k4, k5, version)) FILTER (WHERE status = 'newest'), max(row(k1, k2, k3, k4, k5, version))) AS r FROM version_case WHERE status <> 'ignored' GROUP BY 1),
newest AS (SELECT name, v.version AS newest, v.k1, v.k2, v.k3, v.k4 FROM nw JOIN (SELECT DISTINCT * EXCLUDE (status) FROM version_case) v USING (name) WHERE row(v.k1, v.k2, v.k3, v.k4, v.k5, v.version) = nw.r),
one AS (SELECT source, arg_min(source_version, ord) AS version, arg_min(k1, ord) AS k1, arg_min(k2, ord) AS k2 FROM installed GROUP BY 1),
st AS (SELECT one.source, one.version, newest, CASE WHEN newest IS NULL THEN 'unknown' WHEN row(one.k1, one.k2, 0, 0) < row(newest.k1, newest.k2, newest.k3, newest.k4) THEN 'behind' ELSE 'current' END AS staleness FROM one LEFT JOIN newest ON newest.name = one.source),
dv AS (SELECT one.source, one.version, coalesce(b.state, 'unknown') AS state, coalesce(b.total, 0)::BIGINT AS total FROM one LEFT JOIN bundle_row b ON b.source = one.source AND b.version = one.version AND b.state IN ('patched', 'clean', 'native', 'unknown')),
df AS (SELECT st.source, st.version, newest, staleness, state, total, (CASE WHEN staleness = 'behind' THEN 2 ELSE 0 END + total)::BIGINT AS score FROM st JOIN dv ON dv.source = st.source)
"""


def parts(spark, d):
    entries, installed, bundle = (derive.table(spark, d, n) for n in ("version_case", "installed", "bundle_row"))
    newest = drift.newest_upstream(entries.select("name", "version", "status"))
    one = drift.one_per_source(installed)
    stale = drift.staleness(one, newest)
    return one, newest, stale, drift.divergence(one, bundle, ["patched", "clean", "native", "unknown"]), bundle


def scored(spark, d):
    _, _, stale, diverged, _ = parts(spark, d)
    return drift.combine(stale, diverged)


@query(BASE + "SELECT name, newest FROM newest")
def newest_upstream(spark, d):
    return parts(spark, d)[1]


@query(BASE + "SELECT DISTINCT name, version, 0::BIGINT AS epoch, k1 || '.' || k2 || CASE k3 WHEN -1 THEN '~rc' || k4 WHEN 1 THEN '+b' || k4 ELSE '' END AS upstream, k5::VARCHAR AS revision FROM version_case")
def version_parts(spark, d):
    v = derive.table(spark, d, "version_case").select("name", "version").distinct()
    x = F.col("version")
    return v.select("name", "version", versions.epoch(x).cast("long").alias("epoch"), versions.upstream(x).alias("upstream"), versions.revision(x).alias("revision"))


@query(BASE + "SELECT name, version, row_number() OVER (PARTITION BY name ORDER BY k1, k2, k3, k4, k5) AS place FROM (SELECT DISTINCT name, version, k1, k2, k3, k4, k5 FROM version_case) x")
def version_order(spark, d):
    from pyspark.sql import Window

    v = derive.table(spark, d, "version_case").select("name", "version").distinct()
    return v.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(versions.key(F.col("version")))))


@query(BASE + ", r AS (SELECT name AS source, max(row(k1, k2, k3, k4, k5)) AS r FROM version_case GROUP BY 1) SELECT DISTINCT r.source, version FROM r JOIN version_case v ON v.name = r.source AND row(v.k1, v.k2, v.k3, v.k4, v.k5) = r.r")
def newest_in_archive(spark, d):
    v = derive.table(spark, d, "version_case").select(F.col("name").alias("source"), "version", F.lit("3.0").alias("format"), F.lit(0).alias("ord"))
    return drift.newest_archive(v).select("source", "version")


@query(BASE + "SELECT * FROM one")
def one_per_source(spark, d):
    one = parts(spark, d)[0]
    k = F.split(versions.upstream(F.col("version")), r"\.")
    return one.select("source", "version", k[0].cast("long").alias("k1"), k[1].cast("long").alias("k2"))


@query(BASE + "SELECT * FROM st")
def staleness(spark, d):
    return parts(spark, d)[2]


@query(BASE + "SELECT staleness, count(*) AS n FROM st GROUP BY 1")
def staleness_counts(spark, d):
    return parts(spark, d)[2].groupBy("staleness").agg(F.count(F.lit(1)).alias("n"))


@query(BASE + "SELECT * FROM dv")
def divergence(spark, d):
    return parts(spark, d)[3]


@query(BASE + ", t2 AS (SELECT source, max(version) AS version, 'clean' AS state FROM bundle_row GROUP BY 1) SELECT one.source, coalesce(dv.state, t2.state) AS state, CASE WHEN dv.source IS NOT NULL THEN 1 WHEN t2.source IS NOT NULL THEN 2 END AS tier FROM one LEFT JOIN (SELECT * FROM dv WHERE state <> 'unknown') dv ON dv.source = one.source LEFT JOIN t2 ON t2.source = one.source")
def fallback(spark, d):
    one, _, _, diverged, bundle = parts(spark, d)
    second = bundle.groupBy("source").agg(F.lit("clean").alias("state"))
    return drift.with_fallback(one.select("source"), diverged.filter("state <> 'unknown'").select("source", "state"), second, "source")


@query(BASE + "SELECT DISTINCT one.source, '1:' || one.version AS version, b.version AS candidate, b.total FROM one JOIN bundle_row b ON b.source = one.source AND b.version = one.version")
def candidate_versions(spark, d):
    one, _, _, _, bundle = parts(spark, d)
    return drift.candidate_match(one.select("source", F.concat(F.lit("1:"), "version").alias("version")), bundle.select("source", "version", "total"))


@query(BASE + "SELECT source, version, staleness, state, total, score FROM df WHERE score > 0")
def drift_report(spark, d):
    return drift.report(scored(spark, d), "score")


@query(BASE + "SELECT source, version, newest, staleness FROM df WHERE staleness = 'behind'")
def staleness_report(spark, d):
    return drift.report(scored(spark, d), "staleness")


@query(BASE + "SELECT source, version, state, total FROM df WHERE total > 0")
def divergence_report(spark, d):
    return drift.report(scored(spark, d), "divergence")


@query(BASE + "SELECT count(*) FILTER (WHERE staleness = 'behind') AS behind, count(*) FILTER (WHERE total > 0) AS carrying, count(*) FILTER (WHERE staleness = 'behind' AND total > 0) AS both, count(*) AS sources, count(*) FILTER (WHERE staleness = 'unknown') AS staleness_unknown, count(*) FILTER (WHERE state = 'unknown') AS divergence_unknown, sum(total)::BIGINT AS patches, count(*) FILTER (WHERE state = 'patched') AS patched, sum(score)::BIGINT AS score FROM df")
def drift_summary(spark, d):
    return drift.drift_summary(scored(spark, d))


@query(BASE + "SELECT source, version FROM bundle_row WHERE state = 'patched'")
def patched_work_list(spark, d):
    return publish.work_list_rows(derive.table(spark, d, "bundle_row"))


@query(BASE + "SELECT b.source, b.version, b.state, b.total, CASE WHEN v.source IS NULL OR b.state = 'unknown' OR v.state = 'unknown' THEN 'inconclusive' WHEN v.state <> b.state OR v.total <> b.total THEN 'mismatch' ELSE 'match' END AS verdict FROM bundle_row b LEFT JOIN dv v ON v.source = b.source AND v.version = b.version")
def verification(spark, d):
    """Every bundle row against the divergence table (the sample covers all)."""
    _, _, _, diverged, bundle = parts(spark, d)
    return drift.spot_check(bundle, diverged, 1 << 30, 3).select("source", "version", "state", "total", "verdict")


@query(BASE + "SELECT source, strftime(max(ts), '%Y-%m-%d') AS generated_at, max(ts) >= TIMESTAMP '2024-05-25' AS fresh, date_diff('day', date_trunc('day', max(ts)), TIMESTAMP '2024-06-01')::INT AS age FROM (SELECT concat('s', user_id) AS source, ts FROM events) x GROUP BY 1")
def bundle_ages(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").groupBy(F.concat(F.lit("s"), "user_id").alias("source")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("generated_at"))
    stamp, now = F.concat("generated_at", F.lit("T00:00:00Z")), F.lit(NOW).cast("timestamp")
    return e.select("source", "generated_at", drift.fresh(stamp, now).alias("fresh"), drift.age_days(stamp, now).alias("age"))


REACH = f"""WITH {derive.ctes("carrier", "install", "source_binary")}, an AS (SELECT max(inst) AS anchor FROM install),
sb AS (SELECT source, sb."binary", coalesce(i.inst, 0) AS inst FROM (SELECT DISTINCT source, "binary" FROM source_binary) sb LEFT JOIN install i ON i."binary" = sb."binary"),
r AS (SELECT DISTINCT c.fingerprint, sb."binary", sb.inst FROM carrier c LEFT JOIN sb ON sb.source = c.source),
m AS (SELECT fingerprint, max(inst) AS inst FROM r GROUP BY 1)
SELECT m.fingerprint, CASE WHEN m.inst IS NULL THEN 'unknown' WHEN m.inst / anchor >= 0.5 THEN 'XL' WHEN m.inst / anchor >= 0.1 THEN 'L' WHEN m.inst / anchor >= 0.01 THEN 'M' WHEN m.inst / anchor >= 0.001 THEN 'S' ELSE 'XS' END AS level,
 min(r."binary") AS "binary", m.inst, anchor FROM m LEFT JOIN r ON r.fingerprint = m.fingerprint AND r.inst = m.inst CROSS JOIN an GROUP BY ALL"""


@query(REACH)
def reach_levels(spark, d):
    carriers, installs, binaries = (derive.table(spark, d, n) for n in ("carrier", "install", "source_binary"))
    return axes.reach(carriers.select("fingerprint", "source"), binaries.groupBy("source").agg(F.collect_list("binary").alias("binaries")), installs)


@query(REACH.replace("SELECT m.fingerprint, CASE", ", z AS (SELECT m.fingerprint, CASE", 1) + ") SELECT fingerprint, level AS bucket, \"binary\", inst, round_even(inst / anchor, 4) AS fraction, '2024-06-01' AS snapshot_date FROM z WHERE level <> 'unknown'")
def reach_evidence(spark, d):
    """What the evidence of each known reach says."""
    rows = reach_levels(spark, d).filter("level <> 'unknown'").select("fingerprint", axes.reach_evidence("2024-06-01").alias("evidence"))
    e = F.from_json("evidence", "bucket string, binary string, inst bigint, fraction double, snapshot_date string")
    return rows.select("fingerprint", e.alias("e")).select("fingerprint", "e.*")


CLAIMED = f"""WITH {derive.ctes("cve_claim", "tracker")}, c AS (SELECT fingerprint, source, unnest(CASE WHEN m = 0 THEN []::VARCHAR[] WHEN m = 1 THEN [c1] ELSE [c1, c2] END) AS cve, unnest(CASE WHEN m = 0 THEN []::INT[] WHEN m = 1 THEN [0] ELSE [0, 1] END) AS pos FROM cve_claim),
j AS (SELECT c.*, EXISTS (SELECT 1 FROM tracker t WHERE t.cve = c.cve AND t.source = c.source) AS own, EXISTS (SELECT 1 FROM tracker t WHERE t.cve = c.cve) AS known FROM c),
g AS (SELECT fingerprint, arg_min(cve, pos) FILTER (WHERE own) AS hit, arg_min(cve, pos) FILTER (WHERE known) AS els, arg_min(cve, pos) AS first FROM j GROUP BY 1)
SELECT q.fingerprint, q.source, CASE WHEN g.fingerprint IS NULL THEN 'unknown' WHEN hit IS NOT NULL THEN 'confirmed' WHEN els IS NOT NULL THEN 'wrong-source' ELSE 'not-found' END AS outcome, coalesce(hit, els, first) AS cve FROM cve_claim q LEFT JOIN g ON g.fingerprint = q.fingerprint"""


@query(CLAIMED)
def cve_corroboration(spark, d):
    c = derive.table(spark, d, "cve_claim")
    cves = F.when(F.col("m") == 0, F.array().cast("array<string>")).when(F.col("m") == 1, F.array("c1")).otherwise(F.array("c1", "c2"))
    return axes.verify_cves(c.select("fingerprint", "source", cves.alias("cves")), derive.table(spark, d, "tracker")).select("fingerprint", "source", "outcome", "cve")


@query("""WITH c AS (SELECT concat('f', o_orderkey) AS fingerprint, concat('s', o_custkey % 20) AS source, CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE 1000 + o_custkey % 400 END AS bug FROM orders),
b AS (SELECT DISTINCT 1000 + l_partkey % 300 AS bug, concat('s', (l_partkey % 300 + l_suppkey % 3) % 20) AS source FROM lineitem)
SELECT c.fingerprint, c.source, CASE WHEN c.bug IS NULL THEN 'unknown' WHEN EXISTS (SELECT 1 FROM b WHERE b.bug = c.bug AND b.source = c.source) THEN 'confirmed' WHEN EXISTS (SELECT 1 FROM b WHERE b.bug = c.bug) THEN 'wrong-source' ELSE 'not-found' END AS outcome, c.bug FROM c""")
def bug_corroboration(spark, d):
    o, li = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("orders", "lineitem"))
    ref = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.struct(F.lit("upstream").alias("tracker"), F.lit("#12").alias("ref")))).otherwise(F.array(F.struct(F.lit("debian").alias("tracker"), F.concat(F.lit("#"), (1000 + F.col("o_custkey") % 400).cast("string")).alias("ref"))))
    claims = o.select(F.concat(F.lit("f"), "o_orderkey").alias("fingerprint"), F.concat(F.lit("s"), F.col("o_custkey") % 20).alias("source"), ref.alias("bugs"))
    bugs = li.select((1000 + F.col("l_partkey") % 300).alias("bug"), F.concat(F.lit("s"), (F.col("l_partkey") % 300 + F.col("l_suppkey") % 3) % 20).alias("source"))
    return axes.verify_bugs(claims, bugs)


@query("""WITH c AS (SELECT concat('src-', p_partkey % 250) AS source, CASE p_partkey % 3 WHEN 0 THEN 'debian-only' WHEN 1 THEN 'forwarded' ELSE 'unknown' END AS f FROM part), """ + BASE[5:] + """
, k AS (SELECT source, count(*) FILTER (WHERE f = 'debian-only') AS debian_only, count(*) FILTER (WHERE f = 'forwarded') AS forwarded, count(*) FILTER (WHERE f = 'unknown') AS unclassified, count(*) AS total FROM c GROUP BY 1)
SELECT * FROM (SELECT st.source, staleness, debian_only, forwarded, unclassified, total, (CASE WHEN staleness = 'behind' THEN 2 ELSE 0 END + 3 * debian_only + unclassified)::BIGINT AS score FROM st JOIN k ON k.source = st.source) x WHERE score > 0""")
def classified_scores(spark, d):
    forwarding = F.when(F.col("p_partkey") % 3 == 0, "debian-only").when(F.col("p_partkey") % 3 == 1, "forwarded").otherwise("unknown")
    p = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("src-"), F.col("p_partkey") % 250).alias("source"), forwarding.alias("forwarding"))
    return drift.classified_scores(parts(spark, d)[2].select("source", "staleness"), drift.class_counts(p))
