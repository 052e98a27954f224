"""Queries over what is recorded: existence checks, records of triage, risk and review, notes, context, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as t
from ..operators import axes, drift, ledger, publish, review, triage, verdict
from . import derive
from .ledger_queries import BASE, ORACLE_SQL as LEDGER_SQL, RESPONSES, items, tables, verdict_bundle

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return add


@query(BASE + "SELECT DISTINCT d.fingerprint, d.decided_by, d.rule_version FROM decision d JOIN ld ON ld.fingerprint = d.fingerprint AND ld.decided_by = d.decided_by AND ld.rule_version = d.rule_version")
def decided_before(spark, d):
    """Every (fingerprint, rule, version) ever decided that has a live decision."""
    decision, live, _, _ = tables(spark, d)
    return ledger.exists(decision.select("fingerprint", "decided_by", "rule_version").distinct(), live)


@query(BASE + "SELECT DISTINCT fingerprint, observed_by, rule_version, detail, evidence FROM observation o WHERE NOT EXISTS (SELECT 1 FROM lo WHERE lo.fingerprint = o.fingerprint AND lo.observed_by = o.observed_by AND lo.rule_version = o.rule_version AND lo.detail IS NOT DISTINCT FROM o.detail AND lo.evidence IS NOT DISTINCT FROM o.evidence)")
def missing_observations(spark, d):
    """Every observation ever made that no live one repeats."""
    wanted = derive.table(spark, d, "observation").select("fingerprint", "observed_by", "rule_version", "detail", "evidence").distinct()
    return ledger.missing_observations(wanted, tables(spark, d)[2].filter("superseded_at IS NULL"))


@query(f"""WITH {derive.ctes("installed")}, n AS (SELECT "binary" AS name FROM installed UNION SELECT source FROM installed UNION SELECT concat('x-', s_suppkey) FROM supplier),
b AS (SELECT "binary" AS name, arg_min(source, ord) AS source, arg_min(source_version, ord) AS v FROM installed GROUP BY 1), s AS (SELECT source AS name, arg_min(source_version, ord) AS v FROM installed GROUP BY 1)
SELECT n.name, CASE WHEN b.name IS NOT NULL THEN b.source WHEN s.name IS NOT NULL THEN s.name END AS source, coalesce(b.v, s.v) AS source_version FROM n LEFT JOIN b ON b.name = n.name LEFT JOIN s ON s.name = n.name""")
def resolved_names(spark, d):
    """Binaries, sources and unknown names resolved over the inventory."""
    inventory = derive.table(spark, d, "installed")
    name = lambda df, c: df.select(F.col(c).alias("name"))
    supplier = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("x-"), "s_suppkey").alias("name"))
    return drift.resolve_names(inventory, name(inventory, "binary").unionByName(name(inventory, "source")).unionByName(supplier).distinct())


@query(BASE + "SELECT id, strftime(CAST(substr(decided_at, 1, 10) AS DATE) + 30, '%Y-%m-%d') AS fresh_until, '2024-02-15' >= strftime(CAST(substr(decided_at, 1, 10) AS DATE) + 30, '%Y-%m-%d') AS stale FROM decision WHERE decided_at IS NOT NULL")
def freshness(spark, d):
    """Until when each dated decision's snapshot is fresh, and whether it is stale in the middle of February."""
    rows = tables(spark, d)[0].filter("decided_at IS NOT NULL").select("id", axes.fresh_until(F.substring("decided_at", 1, 10)).alias("fresh_until"))
    return rows.withColumn("stale", axes.is_stale(F.col("fresh_until"), F.lit("2024-02-15")))


CARRIED = BASE.replace("WITH ", f"WITH {derive.ctes('carrier')},\n", 1)


@query(CARRIED + "SELECT ord, carrier.fingerprint, source, cv.category, cv.kind FROM carrier LEFT JOIN cv ON cv.fingerprint = carrier.fingerprint")
def patch_verdicts(spark, d):
    verdicts = verdict.current(tables(spark, d)[1]).select("fingerprint", "category", "kind")
    return publish.patch_verdicts(derive.table(spark, d, "carrier"), verdicts)


@query(CARRIED + "SELECT source, category, count(*) AS n FROM carrier JOIN cv ON cv.fingerprint = carrier.fingerprint GROUP BY 1, 2")
def category_breakdown(spark, d):
    return drift.category_breakdown(derive.table(spark, d, "carrier"), verdict.current(tables(spark, d)[1]))


@query("SELECT concat('f', conv_id) AS fingerprint, count(*) AS n_notes FROM conversations GROUP BY 1")
def note_counts(spark, d):
    """Turns of conversations as notes."""
    return ledger.note_counts(spark.read.parquet(f"{d}/conversations.parquet").select(F.concat(F.lit("f"), "conv_id").alias("fingerprint")))


def routed(spark, d):
    """Results of a run: drafts and verifications of all responses, routed; a response without any text in braces counts as an error."""
    drafts = triage.parse_drafts(derive.table(spark, d, "response")).withColumnRenamed("confidence", "draft_confidence")
    rows = triage.parse_verifications(drafts).withColumnRenamed("confidence", "verify_confidence")
    rows = rows.withColumn("claim_category", F.when(F.col("turn") % 2 == 1, "feature").otherwise("unknown")).withColumn("dangerous", F.lit(0))
    return triage.routed(rows).withColumn("error", F.when(~F.col("text").contains("{"), "no answer"))


ROUTED = "(" + LEDGER_SQL["triage_routing"].replace("SELECT conv_id, turn, category, CASE WHEN why", "SELECT conv_id, turn, k, category, CASE WHEN why") + ") x"


@query(f"SELECT category, count(*) AS n, count(*) FILTER (WHERE routing = 'verified') AS verified, count(*) FILTER (WHERE routing = 'needs_human') AS needs_human, count(*) FILTER (WHERE reason LIKE '%mismatch%') AS mismatches FROM {ROUTED} GROUP BY 1")  # noqa: S608
def run_statistics(spark, d):
    return triage.run_statistics(routed(spark, d))


TRIAGED = BASE + f""", r AS (SELECT concat('f', conv_id * 100 + turn) AS fingerprint, k = 4 AS failed, CASE WHEN k = 4 THEN 'unknown' ELSE category END AS category, CASE WHEN k = 0 THEN 'high' WHEN k = 1 THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN k = 4 THEN 'needs_human' ELSE routing END AS routing, CASE WHEN k = 4 THEN 'no answer' ELSE reason END AS reason, k FROM {ROUTED}),
p AS (SELECT fingerprint FROM q WHERE reviewed_at IS NULL), done AS (SELECT fingerprint FROM ld WHERE decided_by = 'llm:m1' AND rule_version = 1)
"""  # noqa: S608


def triaged(spark, d):
    rows = routed(spark, d)
    return triage.triage_records(rows, tables(spark, d)[1], items(spark, d).filter("reviewed_at IS NULL"), "m1", 1, "2024-05-01")


@query(TRIAGED + "SELECT fingerprint, category, confidence, routing = 'verified' AS verified, 'llm:m1' AS decided_by, CASE WHEN failed THEN reason END AS error, CASE WHEN NOT failed THEN routing END AS routing FROM r WHERE fingerprint NOT IN (SELECT fingerprint FROM done)")
def triage_decisions(spark, d):
    """Decisions of a run over all responses, with what their evidence says."""
    rows = triaged(spark, d)[0]
    field = lambda path: F.get_json_object("evidence", path)
    return rows.select("fingerprint", "category", "confidence", "verified", "decided_by", field("$.triage_error").alias("error"), field("$.routing").alias("routing"))


@query(TRIAGED + "SELECT fingerprint, reason, category AS draft_category, confidence AS draft_confidence FROM r WHERE routing = 'needs_human' AND fingerprint NOT IN (SELECT fingerprint FROM p)")
def triage_items(spark, d):
    """Queue items of the same run."""
    return triaged(spark, d)[1].drop("enqueued_at")


@query(RESPONSES + "SELECT conv_id, turn, coalesce(regexp_extract(text, '\"reasoning\":\"([^\"]*)\"', 1), '') AS reasoning, concat('p', conv_id % 7) AS package FROM m")
def evidence_fields(spark, d):
    """Fields read back from the evidence of drafts and reviews."""
    rows = routed(spark, d).withColumn("evidence", triage.draft_evidence()).withColumn("reviewed", F.to_json(F.struct(F.concat(F.lit("p"), F.col("conv_id") % 7).alias("package"))))
    return rows.select("conv_id", "turn", review.draft_reasoning(F.col("evidence")).alias("reasoning"), review.reviewed_package(F.col("reviewed")).alias("package"))


def scores(spark, d):
    """Risk scores of all responses: those of one model culled as benign, long ones rated on a cut text, some of these on a projection."""
    rows = triage.parse_risks(derive.table(spark, d, "response"))
    cut = F.col("input_tokens") > 200
    return rows.withColumn("culled", F.col("model") == "m0").withColumn("truncated", cut).withColumn("projected", cut & (F.col("output_tokens") % 2 == 0))


RISKS = BASE.replace("WITH ", f"WITH {derive.ctes('response')},\n", 1) + ", s AS (SELECT *, CASE (conv_id + turn) % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 5 THEN 'none' ELSE 'elevated' END AS risk, model = 'm0' AS culled, input_tokens > 200 AS truncated FROM response) "


@query(RISKS + "SELECT risk, count(*) AS n, count(*) FILTER (WHERE culled) AS culled, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE truncated AND output_tokens % 2 = 0) AS projected FROM s GROUP BY 1")
def risk_statistics(spark, d):
    return review.risk_statistics(scores(spark, d))


@query(RISKS + "SELECT 'append' AS what, fingerprint, risk AS detail, CASE WHEN truncated THEN 'true' ELSE 'false' END AS truncated, NULL::BIGINT AS id FROM s UNION ALL SELECT 'stamp', NULL, NULL, NULL, id FROM lo WHERE kind = 'security-risk' AND fingerprint IN (SELECT fingerprint FROM s)")
def risk_records(spark, d):
    """What a risk run over all responses appends and stamps."""
    append, stamps = review.risk_records(scores(spark, d), tables(spark, d)[2].filter("superseded_at IS NULL"), "2024-05-01")
    a = append.select(F.lit("append").alias("what"), "fingerprint", "detail", F.get_json_object("evidence", "$.truncated").alias("truncated"))
    return a.unionByName(stamps.select(F.lit("stamp").alias("what"), "id"), allowMissingColumns=True)


@query(BASE + "SELECT fingerprint, CASE id % 3 WHEN 0 THEN draft_category ELSE 'bugfix' END AS category, CASE id % 3 WHEN 0 THEN 'accept' ELSE 'override' END AS choice, id AS item_id FROM q WHERE reviewed_at IS NULL AND id % 3 <> 2")
def human_verdicts(spark, d):
    """Reviewers' choices on all items, reviewed ones too: a third accepts, a third overrides, a third defers."""
    queue = items(spark, d)
    kind = F.col("id") % 3
    choices = queue.select(F.col("id").alias("item_id"), F.when(kind == 0, "accept").when(kind == 1, "override").otherwise("defer").alias("choice"), F.lit("bugfix").alias("category"), F.lit("ann").alias("signed_by"), F.concat(F.lit("s"), "id").alias("signature"))
    decisions, events = ledger.human_verdicts(choices, queue, "2024-05-01")
    rows = decisions.filter("verified AND decided_by = 'human:ann'").select("fingerprint", "category", F.get_json_object("evidence", "$.choice").alias("choice"), F.substring("signature", 2, 20).cast("bigint").alias("item_id"))
    return rows.join(events.select("item_id"), "item_id")


@query(BASE + "SELECT DISTINCT decided_by AS rule_id, rule_version AS version, kind, CASE WHEN kind = 'heuristic' THEN 'pure' ELSE 'external' END AS purity FROM decision WHERE kind <> 'human' AND rule_version <> 1")
def rules_to_register(spark, d):
    """Rules seen in decisions whose first versions are registered."""
    used = tables(spark, d)[0].filter("kind <> 'human'").select(F.col("decided_by").alias("rule_id"), F.col("rule_version").alias("version"), "kind", F.when(F.col("kind") == "heuristic", "pure").otherwise("external").alias("purity"))
    return ledger.register_rules(used, used.filter("version = 1").select("rule_id", "version").distinct())


@query(BASE + """, f AS (SELECT fingerprint, max(id) * 100 AS n FROM decision GROUP BY 1), o AS (SELECT DISTINCT fingerprint FROM lo WHERE kind = 'reviewability' AND detail = 'oversized'), u AS (SELECT fingerprint FROM gm WHERE (e::JSON->>'$.residue_lines')::BIGINT <= 5000)
SELECT fingerprint, CASE WHEN fingerprint IN (SELECT fingerprint FROM inj) THEN 'injection-suspect' WHEN fingerprint IN (SELECT fingerprint FROM o) AND fingerprint NOT IN (SELECT fingerprint FROM u) THEN 'oversized' WHEN n > 400000 THEN 'too-long' END AS skip FROM f""")
def skip_reasons(spark, d):
    """Why each fingerprint isn't sent to the model; a text's length is a hundred times its newest id."""
    decision, _, obs, _ = tables(spark, d)
    flag = lambda df, name: df.select("fingerprint", F.lit(True).alias(name))
    rows = decision.groupBy("fingerprint").agg((F.max("id") * 100).alias("n"))
    for side in (flag(axes.suspects(obs), "injection"), flag(axes.live_fingerprints(obs, schemas.REVIEWABILITY, "oversized"), "oversized"), flag(axes.residue_unlocked(obs), "unlocked")):
        rows = rows.join(side, "fingerprint", "left")
    known = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("fingerprint", triage.skip_reason(known("injection"), known("oversized"), known("unlocked"), F.col("n")).alias("skip"))


@query(f"SELECT fingerprint, category || ' (' || reason || ')' || coalesce('; ' || nullif(concat_ws(', ', 'risk ' || risk, 'reach ' || reach, 'reviewability ' || reviewability), ''), '') AS note FROM ({LEDGER_SQL['verdict_bundle']}) x")  # noqa: S608
def verdict_notes(spark, d):
    return verdict_bundle(spark, d).select("fingerprint", publish.verdict_note().alias("note"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'https://bugs.debian.org/' || o_custkey WHEN 1 THEN 'https://bugs.debian.org/' || o_custkey WHEN 2 THEN 'https://example.org/' || o_custkey ELSE '#' || o_custkey END AS link FROM orders")
def bug_links(spark, d):
    """Links of bug references: numbers of two trackers, with and without a sign, and addresses."""
    kind, n = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    ref = F.when(kind == 0, n).when(kind == 2, F.concat(F.lit("https://example.org/"), n)).otherwise(F.concat(F.lit("#"), n))
    tracker = F.when(kind < 3, "debian").otherwise("upstream")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), t.bug_link(ref, tracker).alias("link"))


@query(CARRIED + """, w AS (SELECT DISTINCT fingerprint FROM q WHERE reviewed_at IS NULL), g AS (SELECT fingerprint, count(*) AS n_occurrences, min(source) AS source_package FROM carrier GROUP BY 1),
dr AS (SELECT fingerprint, arg_max(category, id) AS draft FROM ld WHERE kind = 'llm' GROUP BY 1), c AS (SELECT fingerprint, string_agg(DISTINCT source, ', ' ORDER BY source) AS packages FROM carrier GROUP BY 1),
cl AS (SELECT concat('f', o_custkey) AS fingerprint, max(o_orderpriority) AS claim FROM orders GROUP BY 1), fa AS (SELECT concat('s', o_orderkey % 40) AS source_package, max(strftime(o_orderdate, '%Y-%m-%d')) AS changelog_date FROM orders GROUP BY 1),
ma AS (SELECT fingerprint, arg_max(detail, id) AS mark FROM lo WHERE kind = 'generated-content' AND evidence <> 'not json' GROUP BY 1)
SELECT w.fingerprint, n_occurrences, g.source_package, claim, draft, CASE WHEN len(string_split(packages, ', ')) <= 8 THEN packages ELSE array_to_string(string_split(packages, ', ')[1:8], ', ') || ' (+' || (len(string_split(packages, ', ')) - 8) || ' more)' END AS packages, changelog_date, mark
FROM w LEFT JOIN g ON g.fingerprint = w.fingerprint LEFT JOIN dr ON dr.fingerprint = w.fingerprint LEFT JOIN c ON c.fingerprint = w.fingerprint LEFT JOIN cl ON cl.fingerprint = w.fingerprint LEFT JOIN fa ON fa.source_package = g.source_package LEFT JOIN ma ON ma.fingerprint = w.fingerprint""")
def review_context(spark, d):
    """What a reviewer sees of each fingerprint with a pending item."""
    _, live, obs, _ = tables(spark, d)
    carrier, orders = derive.table(spark, d, "carrier").withColumnRenamed("source", "source_package"), spark.read.parquet(f"{d}/orders.parquet")
    groups = carrier.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_occurrences"), F.min("source_package").alias("source_package"))
    claims = orders.groupBy(F.concat(F.lit("f"), "o_custkey").alias("fingerprint")).agg(F.max("o_orderpriority").alias("claim"))
    drafts = verdict.latest(live, F.col("kind") == "llm", ["fingerprint"]).select("fingerprint", F.col("category").alias("draft"))
    facts = orders.groupBy(F.concat(F.lit("s"), F.col("o_orderkey") % 40).alias("source_package")).agg(F.max(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("changelog_date"))
    marks = axes.generated_marks(obs).select("fingerprint", F.col("detail").alias("mark"))
    wanted = items(spark, d).filter("reviewed_at IS NULL").select("fingerprint").distinct()
    rows = review.context(wanted, groups, claims, drafts, publish.package_lines(carrier), facts, marks)
    return rows.select("fingerprint", "n_occurrences", "source_package", "claim", "draft", "packages", "changelog_date", "mark")
