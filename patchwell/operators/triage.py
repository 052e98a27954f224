"""Triage: work list and priorities, parsing of stored model responses, routing, rule mining, run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schemas
from . import axes

RISK_WEIGHT, INJECTION_WEIGHT, UNCONFIRMED_WEIGHT, REACH_WEIGHT = 1_000_000_000, 500_000_000, 100_000_000, 1_000_000
LONGEST = 400_000


def work_list(fingerprints: DataFrame, groups: DataFrame, observations: DataFrame) -> DataFrame:
    """Fingerprints with their group and signals; one without an index row is dropped, a missing rank is 0."""
    flag = lambda df, name: df.select("fingerprint", F.lit(1).alias(name))
    rows = fingerprints.join(groups.select("fingerprint", "n_occurrences", "n_packages"), "fingerprint")
    risk = axes.level_per_fingerprint(observations, schemas.RISK, schemas.RISK_LEVELS).withColumnRenamed("level", "risk")
    reach = axes.level_per_fingerprint(observations, schemas.REACH, schemas.REACH_LEVELS).withColumnRenamed("level", "reach")
    for side in (
        risk, reach, flag(axes.suspects(observations), "injection"), flag(axes.live_fingerprints(observations, schemas.DANGEROUS), "dangerous"),
        flag(axes.live_fingerprints(observations, schemas.PROVENANCE, "claim-unconfirmed"), "unconfirmed"),
    ):
        rows = rows.join(side, "fingerprint", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "fingerprint", "n_occurrences", "n_packages", axes.rank_of(F.col("risk"), schemas.RISK_LEVELS).alias("risk_rank"), axes.rank_of(F.col("reach"), schemas.REACH_LEVELS).alias("reach_rank"),
        zero("injection"), zero("dangerous"), zero("unconfirmed"),
    )


def prioritised(work: DataFrame) -> DataFrame:
    """Highest first. Constructs count here, but not in the stored integer."""
    return work.orderBy(*[F.desc(c) for c in ("risk_rank", "injection", "dangerous", "unconfirmed", "reach_rank", "n_occurrences", "n_packages", "fingerprint")])


def stored_priority() -> Column:
    return (
        F.col("risk_rank").cast("long") * RISK_WEIGHT + F.col("injection") * INJECTION_WEIGHT + F.col("unconfirmed") * UNCONFIRMED_WEIGHT
        + F.col("reach_rank") * REACH_WEIGHT + F.least(F.col("n_occurrences"), F.lit(REACH_WEIGHT - 1))
    )


def next_batch(work: DataFrame, done: DataFrame, n: int) -> DataFrame:
    """The first n of the prioritised list that aren't done; the anti-join stands below the limit."""
    return prioritised(work.join(done, "fingerprint", "left_anti")).limit(n)


def first_object(text: Column, schema: str) -> Column:
    """The first {...} of a response, up to the first closing brace, parsed; null fields where malformed."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*?\})", 1), F.lit("")), schema)


def _confidence(c: Column) -> Column:
    return F.when(c.isin(schemas.CONFIDENCES), c).otherwise("low")


def parse_drafts(responses: DataFrame) -> DataFrame:
    """category (unknown where missing or not assignable, with a note), confidence, reasoning of draft responses."""
    rows = responses.withColumn("o", first_object(F.col("text"), "category string, confidence string, reasoning string"))
    usable = F.col("o").isNotNull() & ~(F.col("o.category").isNull() & F.col("o.confidence").isNull() & F.col("o.reasoning").isNull())
    known = F.coalesce(F.col("o.category").isin(schemas.DRAFT_CATEGORIES), F.lit(False))
    note = F.when(~usable, "no usable JSON object").when(~known, "category out of domain")
    return rows.select(*responses.columns, F.when(known, F.col("o.category")).otherwise("unknown").alias("category"), _confidence(F.col("o.confidence")).alias("confidence"), F.coalesce("o.reasoning", F.lit("")).alias("reasoning"), note.alias("note"))


def parse_verifications(responses: DataFrame) -> DataFrame:
    """agrees (false where missing or not boolean), confidence (low then)."""
    rows = responses.withColumn("o", first_object(F.col("text"), "agrees boolean, confidence string"))
    return rows.select(*responses.columns, F.coalesce("o.agrees", F.lit(False)).alias("agrees"), F.when(F.col("o.agrees").isNull(), "low").otherwise(_confidence(F.col("o.confidence"))).alias("confidence"))


def parse_risks(responses: DataFrame) -> DataFrame:
    """Risk level; elevated where it can't be read."""
    rows = responses.withColumn("o", first_object(F.col("text"), "risk string, reason string"))
    return rows.select(*responses.columns, F.when(F.col("o.risk").isin(schemas.RISK_LEVELS), F.col("o.risk")).otherwise("elevated").alias("risk"), F.coalesce("o.reason", F.lit("")).alias("reason"))


def routed(rows: DataFrame) -> DataFrame:
    """Adds routing and reason. Columns: category, draft_confidence, agrees, verify_confidence, claim_category, dangerous (0 or 1)."""
    claim, draft = F.col("claim_category"), F.col("category")
    reasons = F.array_compact(F.array(
        F.when(~F.col("agrees"), "verifier refuted the drafted category"), F.when(F.col("draft_confidence") == "low", "draft confidence is low"),
        F.when(F.col("verify_confidence") == "low", "verification confidence is low"),
        F.when(claim.isNotNull() & (claim != "unknown") & (claim != draft), F.concat(F.lit("claim/content mismatch: author claims '"), claim, F.lit("' but content reads '"), draft, F.lit("'"))),
        F.when(F.col("dangerous") == 1, "a dangerous-construct observation is present"),
    ))
    human = F.size(reasons) > 0
    return rows.withColumn("routing", F.when(human, "needs_human").otherwise("verified")).withColumn("reason", F.when(human, F.array_join(reasons, "; ")).otherwise("verifier confirmed the drafted category at sufficient confidence"))


def skip_reason(injection: Column, oversized: Column, unlocked: Column, projected_length: Column) -> Column:
    """Why a fingerprint isn't sent to the model, or null: the first that holds."""
    return F.when(injection, "injection-suspect").when(oversized & ~unlocked, "oversized").when(projected_length > LONGEST, "too-long")


def locked(observations: DataFrame) -> DataFrame:
    return axes.live_fingerprints(observations, schemas.REVIEWABILITY, "oversized").join(axes.residue_unlocked(observations), "fingerprint", "left_anti")


def draft_evidence() -> Column:
    """What a model decision rests on, as JSON: the draft, its verification, the routing. Columns as for `triage_records`."""
    draft = F.struct("category", F.col("draft_confidence").alias("confidence"), "reasoning")
    check = F.struct("agrees", F.col("verify_confidence").alias("confidence"))
    return F.to_json(F.struct(draft.alias("draft"), "reason", "routing", check.alias("verification")))


def triage_records(results: DataFrame, live_decisions: DataFrame, pending: DataFrame, model: str, prompt_version: int, now: str) -> tuple[DataFrame, DataFrame]:
    """(decisions, queue items) of a run's results, one a fingerprint.

    results: fingerprint, category, draft_confidence, reasoning, agrees, verify_confidence, routing,
    reason, error (not null where the model gave no answer: unknown, low, for a human, so that it
    isn't tried again). A fingerprint that has a live decision of the model at this prompt version gets no other,
    and one with a pending item no second item.
    """
    by = f"llm:{model}"
    done = live_decisions.filter((F.col("decided_by") == by) & (F.col("rule_version") == prompt_version)).select("fingerprint").distinct()
    failed = F.col("error").isNotNull()
    rows = results.withColumn("evidence", F.when(failed, F.to_json(F.struct(F.col("error").alias("triage_error")))).otherwise(draft_evidence()))
    rows = rows.withColumn("category", F.when(failed, "unknown").otherwise(F.col("category"))).withColumn("confidence", F.when(failed, "low").otherwise(F.col("draft_confidence")))
    rows = rows.withColumn("routing", F.when(failed, "needs_human").otherwise(F.col("routing"))).withColumn("reason", F.coalesce("error", "reason"))
    decisions = rows.join(done, "fingerprint", "left_anti").select(
        "fingerprint", "category", "confidence", F.lit(by).alias("decided_by"), F.lit(prompt_version).alias("rule_version"), F.lit("llm").alias("kind"),
        "evidence", (F.col("routing") == "verified").alias("verified"), F.lit(now).alias("decided_at"),
    )
    items = rows.filter("routing = 'needs_human'").join(pending.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return decisions, items.select("fingerprint", "reason", F.col("category").alias("draft_category"), F.col("confidence").alias("draft_confidence"), F.lit(now).alias("enqueued_at"))


def run_statistics(results: DataFrame) -> DataFrame:
    """Counts of a run: by category, verified, for a human, by claim mismatch."""
    return results.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("routing") == "verified").alias("verified"), F.count_if(F.col("routing") == "needs_human").alias("needs_human"), F.count_if(F.col("reason").contains("mismatch")).alias("mismatches"))


def usage(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Token sums, share of cached input and cost for each model. rates: model and price of a million tokens of each kind."""
    total = calls.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")], F.count(F.lit(1)).alias("calls"))
    seen = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    cost = (F.col("input_tokens") * F.col("input_rate") + F.col("output_tokens") * F.col("output_rate") + F.col("cache_read_tokens") * F.col("read_rate") + F.col("cache_creation_tokens") * F.col("creation_rate")) / 1e6
    return total.join(rates, "model", "left").select("model", "calls", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", F.when(seen > 0, F.col("cache_read_tokens") / seen).otherwise(0.0).alias("cache_hit"), cost.alias("cost"))


def structural_key(profiles: DataFrame) -> Column:
    """Types and shape of a change, as text."""
    size = lambda c: F.when(F.col(c) == 0, "0").when(F.col(c) <= 5, "1-5").when(F.col(c) <= 50, "6-50").otherwise("51+")
    return F.concat_ws("|", F.array_join(F.array_sort(F.map_keys("file_types")), ","), size("added_lines"), size("removed_lines"), size("hunks"))


def candidate_rules(settled: DataFrame, least: int) -> DataFrame:
    """Clusters (category, key) of at least `least` settled members with their purity.

    settled: fingerprint, category, key, n_occurrences. A key must carry one category over all
    settled rows (pure); impure ones come with their spread, most members first.
    """
    clusters = settled.groupBy("category", "key").agg(F.count(F.lit(1)).alias("members"), F.sum("n_occurrences").alias("occurrences"))
    # The spread of a key is that of its clusters, a row a category: the settled rows are read once.
    of_key = Window.partitionBy("key")
    rows = clusters.select("*", F.count("category").over(of_key).alias("categories"), F.sum("members").over(of_key).alias("total"))
    rows = rows.filter((F.col("members") >= least) & F.col("key").isNotNull())
    return rows.withColumn("pure", F.col("categories") == 1).orderBy(F.desc("pure"), F.desc("members"), F.desc("occurrences"), "key", "category")
