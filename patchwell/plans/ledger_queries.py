"""Queries over the decision ledger: verdicts, queue, axes, triage, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..operators import axes, ledger, publish, review, triage, verdict
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


RANK = "row(CASE WHEN kind = 'human' THEN 3 WHEN kind = 'llm' AND verified THEN 2 WHEN kind = 'heuristic' THEN 1 ELSE 0 END, coalesce(decided_at, ''), CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END, id)"
BASE = f"""WITH {derive.ctes("decision", "observation", "supersession", "queue_item", "queue_event")},
stamp AS (SELECT "table" AS t, id, min(superseded_at) AS superseded_at FROM supersession GROUP BY 1, 2),
ld AS (SELECT * FROM decision WHERE id NOT IN (SELECT id FROM stamp WHERE t = 'decision')), lo AS (SELECT * FROM observation WHERE id NOT IN (SELECT id FROM stamp WHERE t = 'observation')),
win AS (SELECT fingerprint, max({RANK}) AS r FROM ld GROUP BY 1), cv AS (SELECT ld.* FROM ld JOIN win ON win.fingerprint = ld.fingerprint AND {RANK.replace("kind", "ld.kind").replace("id)", "ld.id)")} = win.r),
risk AS (SELECT fingerprint, arg_max(detail, id) AS level FROM lo WHERE kind = 'security-risk' AND detail IN ('none', 'low', 'elevated', 'high') GROUP BY 1),
reach AS (SELECT fingerprint, arg_max(detail, id) AS level FROM lo WHERE kind = 'reach' AND detail IN ('XS', 'S', 'M', 'L', 'XL') GROUP BY 1),
size AS (SELECT fingerprint, arg_max(detail, id) AS level FROM lo WHERE kind = 'reviewability' AND detail IN ('normal', 'large', 'oversized') GROUP BY 1),
inj AS (SELECT DISTINCT fingerprint FROM lo WHERE kind = 'llm-injection-suspect' AND detail LIKE '%/diff'), dan AS (SELECT DISTINCT fingerprint FROM lo WHERE kind = 'dangerous-construct'),
gm AS (SELECT fingerprint, arg_max(evidence, id) AS e FROM lo WHERE kind = 'generated-content' AND evidence <> 'not json' GROUP BY 1),
ev AS (SELECT item_id, max(row("at", event)) FILTER (WHERE event IN ('reviewed', 'reopened')) AS r, max(priority) FILTER (WHERE event = 'reprioritised') AS p FROM queue_event GROUP BY 1),
q AS (SELECT id, fingerprint, draft_category, coalesce(ev.p, priority) AS priority, CASE WHEN struct_extract(ev.r, 2) = 'reviewed' THEN struct_extract(ev.r, 1) END AS reviewed_at FROM queue_item LEFT JOIN ev ON ev.item_id = queue_item.id),
un AS (SELECT fingerprint FROM cv WHERE category = 'unknown' UNION SELECT fingerprint FROM decision WHERE fingerprint NOT IN (SELECT fingerprint FROM ld)),
wl AS (SELECT un.fingerprint, coalesce(CASE risk.level WHEN 'high' THEN 3 WHEN 'elevated' THEN 2 WHEN 'low' THEN 1 ELSE 0 END, 0)::INT AS risk_rank, CASE reach.level WHEN 'XL' THEN 4 WHEN 'L' THEN 3 WHEN 'M' THEN 2 WHEN 'S' THEN 1 ELSE 0 END::INT AS reach_rank,
 (inj.fingerprint IS NOT NULL)::INT AS injection, (dan.fingerprint IS NOT NULL)::INT AS dangerous, 0 AS unconfirmed, g.n_occurrences, g.n_packages FROM un JOIN (SELECT fingerprint, count(*) AS n_occurrences, count(DISTINCT rule_version) AS n_packages FROM decision GROUP BY 1) g ON g.fingerprint = un.fingerprint
 LEFT JOIN risk ON risk.fingerprint = un.fingerprint LEFT JOIN reach ON reach.fingerprint = un.fingerprint LEFT JOIN inj ON inj.fingerprint = un.fingerprint LEFT JOIN dan ON dan.fingerprint = un.fingerprint)
"""  # noqa: S608


def tables(spark, d):
    decision, observation, log = (derive.table(spark, d, n) for n in ("decision", "observation", "supersession"))
    return decision, ledger.live(decision, log, "decision"), ledger.with_stamps(observation, log, "observation"), log


def items(spark, d):
    return ledger.queue_state(derive.table(spark, d, "queue_item").withColumn("reviewed_at", F.lit(None).cast("string")), derive.table(spark, d, "queue_event"))


@query(BASE + "SELECT fingerprint, category, decided_by, rule_version, kind, confidence, decided_at, id AS decision_id FROM cv")
def current_verdict(spark, d):
    return verdict.current(tables(spark, d)[1]).drop("evidence")


@query(BASE + "SELECT fingerprint FROM un")
def residue_queue(spark, d):
    decision, live, _, _ = tables(spark, d)
    return verdict.residue(decision, live)


@query(BASE + "SELECT decision.id, fingerprint, stamp.superseded_at FROM decision LEFT JOIN stamp ON stamp.id = decision.id AND stamp.t = 'decision'")
def superseded_decisions(spark, d):
    decision, _, _, log = tables(spark, d)
    return ledger.with_stamps(decision, log, "decision").select("id", "fingerprint", "superseded_at")


@query(BASE + """SELECT 'category' AS section, category AS item, count(*) AS n FROM cv GROUP BY 2 UNION ALL SELECT 'rule', decided_by || '@' || rule_version, count(*) FROM cv GROUP BY 2
UNION ALL SELECT 'observation', kind || '/' || coalesce(detail, ''), count(*) FROM lo GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM decision GROUP BY 2 UNION ALL SELECT 'superseded', 'decisions', count(*) FROM decision WHERE id NOT IN (SELECT id FROM ld) GROUP BY 2""")
def ledger_summary(spark, d):
    decision, live, obs, _ = tables(spark, d)
    return verdict.summary(decision, live, obs.filter("superseded_at IS NULL"))


@query(BASE + "SELECT kind, decided_by, category, fingerprint FROM cv ORDER BY kind, decided_by, category, fingerprint LIMIT 500")
def audit_page(spark, d):
    return verdict.audit(verdict.current(tables(spark, d)[1])).select("kind", "decided_by", "category", "fingerprint")


@query(BASE + "SELECT id, fingerprint, category FROM decision WHERE kind = 'human' ORDER BY id DESC LIMIT 20")
def human_history(spark, d):
    return ledger.history(tables(spark, d)[0], 20).select("id", "fingerprint", "category")


@query(BASE + "SELECT fingerprint, arg_max(category, id) AS category, max(id) AS id FROM ld WHERE kind = 'llm' GROUP BY 1")
def latest_drafts(spark, d):
    return verdict.latest(tables(spark, d)[1], F.col("kind") == "llm", ["fingerprint"]).select("fingerprint", "category", "id")


@query(BASE + "SELECT fingerprint FROM decision UNION SELECT fingerprint FROM queue_item")
def known_fingerprints(spark, d):
    return verdict.known_fingerprints(tables(spark, d)[0], derive.table(spark, d, "queue_item"))


@query(BASE + "SELECT fingerprint FROM (SELECT fingerprint FROM decision UNION SELECT fingerprint FROM queue_item) x WHERE starts_with(fingerprint, 'f1') ORDER BY 1 LIMIT 11")
def prefix_candidates(spark, d):
    return verdict.resolve_prefix(known_fingerprints(spark, d), "f1")


@query(BASE + ", c(position, category) AS (VALUES (0, 'packaging'), (1, 'documentation'), (2, 'bugfix'), (3, 'security'), (4, 'feature'), (5, 'unknown'), (6, 'test')) SELECT position, c.category, count(cv.id) AS n FROM c LEFT JOIN cv ON cv.category = c.category GROUP BY 1, 2")
def category_facets(spark, d):
    return verdict.facets(verdict.current(tables(spark, d)[1]), "category", schemas.ASSIGNABLE_CATEGORIES)


@query(BASE + "SELECT id, fingerprint, draft_category, priority FROM q WHERE reviewed_at IS NULL")
def pending_queue(spark, d):
    return ledger.pending(items(spark, d)).select("id", "fingerprint", "draft_category", "priority")


@query(BASE + "SELECT id AS item_id FROM q WHERE reviewed_at IS NULL AND fingerprint IN (SELECT fingerprint FROM cv WHERE kind = 'heuristic' AND category <> 'unknown')")
def resolvable_items(spark, d):
    return ledger.resolved_items(items(spark, d), verdict.current(tables(spark, d)[1]), "2024-05-01").select("item_id")


@query(BASE + ", want AS (SELECT fingerprint FROM cv WHERE category = 'security') SELECT 'stamp' AS what, id, NULL AS fingerprint FROM ld WHERE kind = 'human' AND fingerprint IN (SELECT fingerprint FROM want) UNION ALL SELECT 'reopen', max(id), NULL FROM q WHERE fingerprint IN (SELECT fingerprint FROM want) GROUP BY q.fingerprint HAVING arg_max(coalesce(reviewed_at, ''), id) <> '' UNION ALL SELECT 'new', NULL, fingerprint FROM want WHERE fingerprint NOT IN (SELECT fingerprint FROM q)")
def requeued(spark, d):
    live = tables(spark, d)[1]
    want = verdict.current(live).filter("category = 'security'").select("fingerprint")
    stamps, events, new = ledger.requeue(want, live, items(spark, d), "2024-05-01")
    none = F.lit(None).cast("string").alias("fingerprint")
    return stamps.select(F.lit("stamp").alias("what"), "id", none).unionByName(events.select(F.lit("reopen").alias("what"), F.col("item_id").alias("id"), none)).unionByName(new.select(F.lit("new").alias("what"), F.lit(None).cast("bigint").alias("id"), "fingerprint"))


@query(BASE + "SELECT cv.fingerprint, category, kind, confidence, CASE kind WHEN 'human' THEN 'confirmed by a reviewer' WHEN 'llm' THEN 'drafted and verified by a model' ELSE 'settled by rule ' || decided_by END AS reason, risk.level AS risk, reach.level AS reach, size.level AS reviewability FROM cv LEFT JOIN risk ON risk.fingerprint = cv.fingerprint LEFT JOIN reach ON reach.fingerprint = cv.fingerprint LEFT JOIN size ON size.fingerprint = cv.fingerprint")
def verdict_bundle(spark, d):
    _, live, obs, _ = tables(spark, d)
    level = lambda kind, domain: axes.level_per_fingerprint(obs, kind, domain)
    return publish.verdict_rows(verdict.current(live), level(schemas.RISK, schemas.RISK_LEVELS), level(schemas.REACH, schemas.REACH_LEVELS), level(schemas.REVIEWABILITY, schemas.SIZE_LEVELS))


@query(BASE + "SELECT fingerprint, string_agg(DISTINCT split_part(detail, '/', 1), ', ' ORDER BY split_part(detail, '/', 1)) AS families FROM lo WHERE kind = 'llm-injection-suspect' GROUP BY 1")
def injection_families(spark, d):
    return axes.injection_families(tables(spark, d)[2])


@query(BASE + "SELECT fingerprint, (e::JSON->>'$.residue_lines')::BIGINT AS residue_lines FROM gm")
def generated_marks(spark, d):
    return axes.generated_marks(tables(spark, d)[2]).select("fingerprint", "residue_lines")


@query(BASE + "SELECT DISTINCT o.fingerprint FROM lo o JOIN gm ON gm.fingerprint = o.fingerprint WHERE o.kind = 'reviewability' AND o.detail = 'oversized' AND (e::JSON->>'$.residue_lines')::BIGINT <= 5000")
def residue_unlocked(spark, d):
    return axes.residue_unlocked(tables(spark, d)[2])


@query(BASE + "SELECT DISTINCT o.fingerprint FROM lo o WHERE o.kind = 'reviewability' AND o.detail = 'oversized' AND NOT EXISTS (SELECT 1 FROM gm WHERE gm.fingerprint = o.fingerprint AND (e::JSON->>'$.residue_lines')::BIGINT <= 5000)")
def locked(spark, d):
    return triage.locked(tables(spark, d)[2])


@query(BASE + "SELECT DISTINCT o.fingerprint FROM lo o WHERE kind = 'security-risk' AND evidence = '{\"truncated\":true}' AND fingerprint IN (SELECT fingerprint FROM lo WHERE kind = 'generated-content')")
def rescore_candidates(spark, d):
    return axes.rescore_candidates(tables(spark, d)[2])


def work(spark, d):
    decision, live, obs, _ = tables(spark, d)
    groups = decision.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_occurrences"), F.count_distinct("rule_version").alias("n_packages"))
    return triage.work_list(verdict.residue(decision, live), groups, obs)


@query(BASE + "SELECT *, risk_rank::BIGINT * 1000000000 + injection * 500000000 + unconfirmed * 100000000 + reach_rank * 1000000 + least(n_occurrences, 999999) AS stored_priority FROM wl")
def work_list(spark, d):
    return work(spark, d).withColumn("stored_priority", triage.stored_priority())


@query(BASE + "SELECT fingerprint FROM wl WHERE fingerprint NOT IN (SELECT fingerprint FROM ld WHERE decided_by = 'llm:m1') ORDER BY risk_rank DESC, injection DESC, dangerous DESC, unconfirmed DESC, reach_rank DESC, n_occurrences DESC, n_packages DESC, fingerprint DESC LIMIT 50")
def next_batch(spark, d):
    done = tables(spark, d)[1].filter("decided_by = 'llm:m1'").select("fingerprint")
    return triage.next_batch(work(spark, d), done, 50).select("fingerprint")


@query(BASE + """, a AS (SELECT fingerprint, CASE max(category) WHEN 'unknown' THEN 'security' ELSE max(category) END AS category FROM decision GROUP BY 1), same AS (SELECT ld.id, ld.fingerprint FROM ld JOIN a ON a.fingerprint = ld.fingerprint AND a.category = ld.category WHERE kind = 'heuristic' AND decided_by = 'doc-only' AND rule_version = 1)
SELECT 'stamp' AS what, count(*) AS n FROM ld WHERE kind = 'heuristic' AND id NOT IN (SELECT id FROM same) UNION ALL SELECT 'append', count(*) FROM a WHERE fingerprint NOT IN (SELECT fingerprint FROM same)""")
def record_pass(spark, d):
    """What a record pass would append and stamp if a rule now gave every fingerprint its last category by name, and security where that is unknown."""
    append, stamps = _record_pass(spark, d)
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return n(stamps, "stamp").unionByName(n(append, "append"))


def _record_pass(spark, d):
    """(rows to append, stamps) of the pass that `record_pass` counts."""
    decision, live, _, _ = tables(spark, d)
    last = F.max("category")
    desired = decision.groupBy("fingerprint").agg(F.when(last == "unknown", "security").otherwise(last).alias("category"))
    desired = desired.select("fingerprint", "category", F.lit("high").alias("confidence"), F.lit("doc-only").alias("decided_by"), F.lit(1).alias("rule_version"), F.lit(None).cast("string").alias("evidence"))
    return ledger.record_decisions(desired, live, "2024-05-01")


@query(BASE + """, a AS (SELECT fingerprint, CASE max(category) WHEN 'unknown' THEN 'security' ELSE max(category) END AS category FROM decision GROUP BY 1), same AS (SELECT ld.id, ld.fingerprint FROM ld JOIN a ON a.fingerprint = ld.fingerprint AND a.category = ld.category WHERE kind = 'heuristic' AND decided_by = 'doc-only' AND rule_version = 1)
SELECT 'stamp' AS what, id, NULL AS fingerprint, NULL AS category FROM ld WHERE kind = 'heuristic' AND id NOT IN (SELECT id FROM same) UNION ALL SELECT 'append', NULL, fingerprint, category FROM a WHERE fingerprint NOT IN (SELECT fingerprint FROM same)""")
def record_pass_rows(spark, d):
    """Which rows a record pass appends, and which it stamps."""
    append, stamps = _record_pass(spark, d)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return stamps.select(F.lit("stamp").alias("what"), "id", none("string", "fingerprint"), none("string", "category")).unionByName(append.select(F.lit("append").alias("what"), none("bigint", "id"), "fingerprint", "category"))


@query(BASE + """, o AS (SELECT fingerprint, kind, CASE WHEN id % 16 = 3 THEN detail || '/again' ELSE detail END AS detail, coalesce(evidence, '~') AS e FROM observation), w AS (SELECT fingerprint, list_sort(list(DISTINCT row(kind, detail, e))) AS x FROM o GROUP BY 1),
h AS (SELECT fingerprint, list_sort(list(DISTINCT row(kind, detail, coalesce(evidence, '~')))) AS x FROM lo GROUP BY 1), c AS (SELECT coalesce(w.fingerprint, h.fingerprint) AS fingerprint FROM w FULL JOIN h ON w.fingerprint = h.fingerprint WHERE w.x IS DISTINCT FROM h.x)
SELECT DISTINCT 'append' AS what, NULL::BIGINT AS id, o.fingerprint, kind, detail, md5(e) AS evidence FROM o JOIN c ON c.fingerprint = o.fingerprint UNION ALL SELECT 'stamp', lo.id, NULL, NULL, NULL, NULL FROM lo JOIN c ON c.fingerprint = lo.fingerprint""")
def observation_pass_rows(spark, d):
    """Which observations a record pass appends, and which it stamps."""
    _, _, obs, _ = tables(spark, d)
    detail = F.when(F.col("id") % 16 == 3, F.concat("detail", F.lit("/again"))).otherwise(F.col("detail"))
    desired = derive.table(spark, d, "observation").withColumn("detail", detail).select("fingerprint", "kind", "detail", "evidence", "rule_version")
    append, stamps = ledger.record_observations(desired, obs.filter("superseded_at IS NULL"), "scan", "2024-05-01")
    none = [F.lit(None).cast("string").alias(c) for c in ("fingerprint", "kind", "detail", "evidence")]
    rows = append.select(F.lit("append").alias("what"), F.lit(None).cast("bigint").alias("id"), "fingerprint", "kind", "detail", F.md5(F.coalesce("evidence", F.lit("~"))).alias("evidence"))
    return rows.unionByName(stamps.select(F.lit("stamp").alias("what"), "id", *none))


@query(BASE + ", w AS (SELECT fingerprint, list_sort(list(DISTINCT row(kind, CASE WHEN id % 16 = 3 THEN detail || '/again' ELSE detail END, coalesce(evidence, '~')))) AS x FROM observation GROUP BY 1), h AS (SELECT fingerprint, list_sort(list(DISTINCT row(kind, detail, coalesce(evidence, '~')))) AS x, count(*) AS n FROM lo GROUP BY 1) SELECT count(*) AS changed, sum(coalesce(len(w.x), 0))::BIGINT AS appended, sum(coalesce(h.n, 0))::BIGINT AS stamped FROM w FULL JOIN h ON w.fingerprint = h.fingerprint WHERE w.x IS DISTINCT FROM h.x")
def observation_pass(spark, d):
    """The difference between all observations ever made, some with another detail, and the live ones, as a record pass sees it."""
    _, _, obs, _ = tables(spark, d)
    detail = F.when(F.col("id") % 16 == 3, F.concat("detail", F.lit("/again"))).otherwise(F.col("detail"))
    desired = derive.table(spark, d, "observation").withColumn("detail", detail).select("fingerprint", "kind", "detail", "evidence", "rule_version")
    append, stamps = ledger.record_observations(desired, obs.filter("superseded_at IS NULL"), "scan", "2024-05-01")
    a = append.agg(F.count_distinct("fingerprint").alias("f"), F.count(F.lit(1)).alias("appended"))
    live = obs.filter("superseded_at IS NULL").select("id", "fingerprint")
    b = stamps.join(live, "id").agg(F.count(F.lit(1)).alias("stamped"))
    both = append.select("fingerprint").unionByName(stamps.join(live, "id").select("fingerprint")).agg(F.count_distinct("fingerprint").alias("changed"))
    return both.join(a.select("appended")).join(b)


@query(BASE + "SELECT CASE WHEN regexp_matches(decided_at, '^\\d{4}-\\d{2}') THEN substr(decided_at, 1, 7) ELSE 'undated' END AS month, count(*) AS n FROM decision GROUP BY 1")
def export_manifest(spark, d):
    return publish.shards(tables(spark, d)[0], "decided_at").groupBy("month").agg(F.count(F.lit(1)).alias("n"))


RESPONSES = f"WITH {derive.ctes('response')}, m AS (SELECT *, (conv_id + turn) % 6 AS k FROM response) "


@query(RESPONSES + "SELECT conv_id, turn, CASE k WHEN 0 THEN 'bugfix' WHEN 1 THEN 'security' WHEN 5 THEN 'packaging' ELSE 'unknown' END AS category, CASE k WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN k IN (2, 4) THEN 'no usable JSON object' WHEN k = 3 THEN 'category out of domain' END AS note FROM m")
def draft_responses(spark, d):
    return triage.parse_drafts(derive.table(spark, d, "response")).select("conv_id", "turn", "category", "confidence", "note")


@query(RESPONSES + "SELECT conv_id, turn, k IN (0, 3, 5) AS agrees, CASE k WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE k WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 5 THEN 'none' ELSE 'elevated' END AS risk FROM m")
def verification_responses(spark, d):
    rows = triage.parse_verifications(derive.table(spark, d, "response"))
    return triage.parse_risks(rows).select("conv_id", "turn", "agrees", "confidence", "risk")


@query(RESPONSES + """, r AS (SELECT conv_id, turn, CASE k WHEN 0 THEN 'bugfix' WHEN 1 THEN 'security' WHEN 5 THEN 'packaging' ELSE 'unknown' END AS category, k FROM m), c AS (SELECT *, CASE k WHEN 0 THEN concat_ws('; ', CASE WHEN turn % 2 = 1 THEN 'claim/content mismatch: author claims ''feature'' but content reads ''bugfix''' END)
 WHEN 1 THEN concat_ws('; ', 'verifier refuted the drafted category', CASE WHEN turn % 2 = 1 THEN 'claim/content mismatch: author claims ''feature'' but content reads ''security''' END)
 WHEN 5 THEN concat_ws('; ', 'draft confidence is low', 'verification confidence is low', CASE WHEN turn % 2 = 1 THEN 'claim/content mismatch: author claims ''feature'' but content reads ''packaging''' END)
 WHEN 3 THEN concat_ws('; ', 'draft confidence is low', 'verification confidence is low', CASE WHEN turn % 2 = 1 THEN 'claim/content mismatch: author claims ''feature'' but content reads ''unknown''' END)
 ELSE concat_ws('; ', 'verifier refuted the drafted category', 'draft confidence is low', 'verification confidence is low', CASE WHEN turn % 2 = 1 THEN 'claim/content mismatch: author claims ''feature'' but content reads ''unknown''' END) END AS why FROM r)
SELECT conv_id, turn, category, CASE WHEN why = '' THEN 'verified' ELSE 'needs_human' END AS routing, CASE WHEN why = '' THEN 'verifier confirmed the drafted category at sufficient confidence' ELSE why END AS reason FROM c""")
def triage_routing(spark, d):
    drafts = triage.parse_drafts(derive.table(spark, d, "response")).withColumnRenamed("confidence", "draft_confidence")
    rows = triage.parse_verifications(drafts).withColumnRenamed("confidence", "verify_confidence")
    rows = rows.withColumn("claim_category", F.when(F.col("turn") % 2 == 1, "feature").otherwise("unknown")).withColumn("dangerous", F.lit(0))
    return triage.routed(rows).select("conv_id", "turn", "category", "routing", "reason")


@query(RESPONSES + "SELECT model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens, sum(cache_read_tokens)::BIGINT / (sum(input_tokens) + sum(cache_read_tokens) + sum(cache_creation_tokens))::BIGINT AS cache_hit, (sum(input_tokens) * 3.0::DOUBLE + sum(output_tokens) * 15.0::DOUBLE + sum(cache_read_tokens) * 0.5::DOUBLE + sum(cache_creation_tokens) * 4.0::DOUBLE) / 1e6 AS cost FROM m GROUP BY 1")
def model_usage(spark, d):
    calls = derive.table(spark, d, "response")
    rates = calls.select("model").distinct().select("model", F.lit(3.0).alias("input_rate"), F.lit(15.0).alias("output_rate"), F.lit(0.5).alias("read_rate"), F.lit(4.0).alias("creation_rate"))
    return triage.usage(calls, rates)


@query(BASE + "SELECT q.id, q.fingerprint, q.draft_category, q.priority, risk.level AS risk, reach.level AS reach, coalesce(size.level, 'normal') AS reviewability FROM q LEFT JOIN risk ON risk.fingerprint = q.fingerprint LEFT JOIN reach ON reach.fingerprint = q.fingerprint LEFT JOIN size ON size.fingerprint = q.fingerprint WHERE reviewed_at IS NULL AND draft_category = 'security' AND coalesce(size.level, 'normal') = 'normal'")
def review_list(spark, d):
    rows = review.with_levels(ledger.pending(items(spark, d)), tables(spark, d)[2])
    return review.filtered(rows, category="security", reviewability="normal").orderBy(*review.live_order(rows)).select("id", "fingerprint", "draft_category", "priority", "risk", "reach", "reviewability")


@query(BASE + "SELECT 'residue' AS item, count(*) AS n FROM un UNION ALL SELECT 'pending', count(*) FROM q WHERE reviewed_at IS NULL UNION ALL SELECT 'hot residue', count(*) FROM un WHERE fingerprint IN (SELECT fingerprint FROM risk WHERE level = 'high') UNION ALL SELECT 'verdicts', count(*) FROM cv UNION ALL SELECT 'risk ' || level, count(*) FROM risk GROUP BY 1")
def ledger_status(spark, d):
    decision, live, obs, _ = tables(spark, d)
    return review.status(verdict.current(live), verdict.residue(decision, live), items(spark, d), obs)


@query(BASE + "SELECT fingerprint, '{\"category\":\"' || category || CASE WHEN confidence IS NULL THEN '' ELSE '\",\"confidence\":\"' || confidence END || '\",\"kind\":\"' || kind || CASE WHEN reach IS NULL THEN '' ELSE '\",\"reach\":\"' || reach END || '\",\"reason\":\"' || reason || CASE WHEN reviewability IS NULL THEN '' ELSE '\",\"reviewability\":\"' || reviewability END || CASE WHEN risk IS NULL THEN '' ELSE '\",\"risk\":\"' || risk END || '\"}' AS value FROM (" + ORACLE_SQL["verdict_bundle"][len(BASE):] + ") x")
def verdict_lines(spark, d):
    return publish.verdict_lines(verdict_bundle(spark, d))


@query(BASE + "SELECT 'unsized' AS reason, count(*) AS n FROM cv WHERE fingerprint NOT IN (SELECT fingerprint FROM lo WHERE kind = 'reviewability') UNION ALL SELECT 'unregistered', count(*) FROM (SELECT DISTINCT decided_by, rule_version FROM decision WHERE kind <> 'human') x WHERE NOT (decided_by = 'doc-only' AND rule_version = 1)")
def record_due(spark, d):
    decision, live, obs, _ = tables(spark, d)
    used = decision.filter("kind <> 'human'").select(F.col("decided_by").alias("rule_id"), F.col("rule_version").alias("version")).distinct()
    return verdict.record_due(verdict.current(live), obs.filter("superseded_at IS NULL"), used, used.filter("rule_id = 'doc-only' AND version = 1"))


@query(BASE + "SELECT CASE t WHEN 'd' THEN 'decision' ELSE 'observation' END AS \"table\", id FROM (SELECT 'd' AS t, id FROM ld WHERE decided_by = 'doc-only' AND rule_version = 1 UNION ALL SELECT 'o', id FROM lo WHERE observed_by = 'doc-only') x")
def superseded_rule(spark, d):
    _, live, obs, _ = tables(spark, d)
    return ledger.supersede_rule(live, obs.filter("superseded_at IS NULL"), "doc-only", 1, "2024-05-01").select("table", "id")


@query(BASE + """, g AS (SELECT fingerprint, max(id) AS id, arg_max(category, id) AS content, max(rule_version) AS v FROM decision GROUP BY 1), w AS (SELECT fingerprint, CASE WHEN id % 2 = 0 THEN 'security' ELSE 'bugfix' END AS category FROM g WHERE content = 'unknown' AND v = 2),
h AS (SELECT fingerprint, max(id) AS id, arg_max(category, id) AS category, arg_max(substr(decided_at, 1, 10), id) AS day, arg_max(decided_at IS NULL, id) AS undated FROM ld WHERE kind = 'llm' GROUP BY 1)
SELECT coalesce(w.fingerprint, h.fingerprint) AS fingerprint, h.id, CASE WHEN h.fingerprint IS NULL THEN 'append' WHEN w.fingerprint IS NULL THEN 'retract' WHEN NOT undated AND h.category = w.category AND '2024-02-15' < strftime(CAST(day AS DATE) + 30, '%Y-%m-%d') THEN 'skip' ELSE 'replace' END AS action FROM w FULL JOIN h ON w.fingerprint = h.fingerprint""")
def external_lifecycle(spark, d):
    """An outside record settles every fingerprint whose newest content is unknown and touches code (the guard); model rows play the live ones, fresh for 30 days."""
    decision, live, _, _ = tables(spark, d)
    newest = decision.groupBy("fingerprint").agg(F.max("id").alias("id"), F.max_by("category", "id").alias("content"), (F.max("rule_version") == 2).alias("code"))
    want = newest.filter(axes.should_settle(F.col("content"), F.col("code"))).select("fingerprint", F.when(F.col("id") % 2 == 0, "security").otherwise("bugfix").alias("category"), F.lit("s1").alias("input_snapshot"))
    have = verdict.latest(live, F.col("kind") == "llm", ["fingerprint"]).select("fingerprint", "id", "category", F.lit("s1").alias("input_snapshot"), axes.fresh_until(F.substring("decided_at", 1, 10)).alias("input_fresh_until"))
    return ledger.external_actions(want, have, "2024-02-15")
