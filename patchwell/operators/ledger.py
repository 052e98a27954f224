"""The decision ledger as append-only tables.

Nothing is updated in place. A row is live unless `supersession` names it; the first stamp stands.
The queue is a log of events, and an item's state is its latest one. A record pass is one outer join
of the rows that should be live with those that are, and yields what to append and what to stamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schemas


def with_stamps(rows: DataFrame, supersession: DataFrame, table: str) -> DataFrame:
    """All rows with superseded_at from the log."""
    first = supersession.filter(F.col("table") == table).groupBy("id").agg(F.min("superseded_at").alias("superseded_at"))
    return rows.drop("superseded_at").join(first, "id", "left")


def live(rows: DataFrame, supersession: DataFrame, table: str) -> DataFrame:
    stamped = supersession.filter(F.col("table") == table).select("id").distinct()
    return rows.join(stamped, "id", "left_anti")


def with_ids(rows: DataFrame, base: int, order: list[str], buckets: int = 4096) -> DataFrame:
    """Ids base+1.. in a total order of a batch. One batch is one pass's rows; ids are ranks, so reruns agree.

    Rows are ranked in buckets of a hash of the columns of `order`, which stand in the order of their
    number: no task ranks more than a bucket, and the offsets of the buckets, at most `buckets`
    numbers, are summed in one row.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("_bucket", "n"))).alias("n"))
    before = F.aggregate(F.sequence(F.lit(0), F.lit(buckets - 1)), F.array(F.lit(0).cast("bigint")), lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + F.coalesce(F.try_element_at("n", b), F.lit(0))))
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    ranked = rows.withColumn("_nth", nth).join(F.broadcast(counts.select(before.alias("_before"))))  # one row
    return ranked.withColumn("id", F.lit(base) + F.col("_before")[F.col("_bucket")] + F.col("_nth")).drop("_bucket", "_nth", "_before")


def register_rules(rules: DataFrame, known: DataFrame) -> DataFrame:
    """Rules (rule_id, version, ...) that aren't registered yet; kinds and purities are checked."""
    rules = rules.withColumn("kind", schemas.checked(F.col("kind"), schemas.KINDS, "rule kind")).withColumn("purity", schemas.checked(F.col("purity"), schemas.PURITIES, "purity"))
    return rules.dropDuplicates(["rule_id", "version"]).join(known, ["rule_id", "version"], "left_anti")


def supersede(live_rows: DataFrame, table: str, at: str, condition: Column) -> DataFrame:
    """Stamps for the live rows that meet the condition (by rule, fingerprint, or both)."""
    return live_rows.filter(condition).select(F.lit(table).alias("table"), "id", F.lit(at).alias("superseded_at"))


def supersede_rule(decisions: DataFrame, observations: DataFrame, rule_id: str, version: int, at: str) -> DataFrame:
    """Stamps for all live rows of a rule in both tables."""
    a = supersede(decisions, "decision", at, (F.col("decided_by") == rule_id) & (F.col("rule_version") == version))
    b = supersede(observations, "observation", at, (F.col("observed_by") == rule_id) & (F.col("rule_version") == version))
    return a.unionByName(b)


def exists(wanted: DataFrame, live_decisions: DataFrame) -> DataFrame:
    """Wanted (fingerprint, decided_by, rule_version) rows that have a live decision."""
    return wanted.join(live_decisions, ["fingerprint", "decided_by", "rule_version"], "left_semi")


def missing_observations(wanted: DataFrame, live_observations: DataFrame) -> DataFrame:
    """Wanted rows without a live observation of the same rule, detail and evidence (null matches null)."""
    o = live_observations
    same = (wanted["fingerprint"] == o["fingerprint"]) & (wanted["observed_by"] == o["observed_by"]) & (wanted["rule_version"] == o["rule_version"]) & wanted["detail"].eqNullSafe(o["detail"]) & wanted["evidence"].eqNullSafe(o["evidence"])
    return wanted.join(o, same, "left_anti")


def record_decisions(desired: DataFrame, live_decisions: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, stamps) that make the live heuristic decisions those desired.

    desired: fingerprint, category, confidence, decided_by, rule_version, evidence; one a fingerprint.
    A fingerprint whose live heuristic decision is the desired one is left alone; a differing one is
    stamped and replaced; model and human rows are never touched. Live rows of fingerprints that are
    not desired at all stay.
    """
    same = ["fingerprint", "decided_by", "rule_version", "category"]
    heuristic = live_decisions.filter("kind = 'heuristic'")
    append = desired.join(heuristic, same, "left_anti").withColumn("kind", F.lit("heuristic")).withColumn("decided_at", F.lit(now))
    outdated = heuristic.join(desired.select("fingerprint").distinct(), "fingerprint", "left_semi").join(desired, same, "left_anti")
    return append, outdated.select(F.lit("decision").alias("table"), "id", F.lit(now).alias("superseded_at"))


def record_observations(desired: DataFrame, live_observations: DataFrame, observed_by: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, stamps) for one observer: per fingerprint and rule version the set of (kind, detail, evidence) that should be live.

    Equal sets are left alone, so a second pass writes nothing; otherwise all live rows of the
    fingerprint are stamped and the desired ones appended. Fingerprints that lose all rows are retracted.
    """
    row = F.struct("kind", "detail", "evidence", "rule_version")
    want = desired.groupBy("fingerprint").agg(F.array_sort(F.collect_set(row)).alias("want"))
    mine = live_observations.filter(F.col("observed_by") == observed_by)
    have = mine.groupBy("fingerprint").agg(F.array_sort(F.collect_set(row)).alias("have"), F.collect_list("id").alias("ids"))
    changed = want.join(have, "fingerprint", "full_outer").filter(~F.col("want").eqNullSafe(F.col("have")))
    append = changed.select("fingerprint", F.explode("want").alias("r")).select("fingerprint", "r.*", F.lit(observed_by).alias("observed_by"), F.lit(now).alias("observed_at"))
    stamps = changed.select(F.lit("observation").alias("table"), F.explode("ids").alias("id"), F.lit(now).alias("superseded_at"))
    return append, stamps


def external_actions(desired: DataFrame, live_decisions: DataFrame, today: str) -> DataFrame:
    """Action for each fingerprint of an outside rule: append, skip (fresh, same snapshot), replace (stale or changed), retract.

    desired: fingerprint, category, input_snapshot. Live rows: fingerprint, id, category, input_snapshot, input_fresh_until.
    """
    d, h = desired.alias("d"), live_decisions.alias("h")
    j = d.join(h, F.col("d.fingerprint") == F.col("h.fingerprint"), "full_outer")
    fresh = (F.lit(today) < F.col("h.input_fresh_until")) & F.col("h.input_snapshot").eqNullSafe(F.col("d.input_snapshot")) & (F.col("h.category") == F.col("d.category"))
    action = F.when(F.col("h.fingerprint").isNull(), "append").when(F.col("d.fingerprint").isNull(), "retract").when(F.coalesce(fresh, F.lit(False)), "skip").otherwise("replace")
    return j.select(F.coalesce("d.fingerprint", "h.fingerprint").alias("fingerprint"), F.col("h.id").alias("id"), action.alias("action"))


def queue_state(items: DataFrame, events: DataFrame) -> DataFrame:
    """Items with their current priority and reviewed_at, after the events (item_id, event, priority, at) in order of `at`.

    Events: reviewed, reopened, reprioritised (only while pending).
    """
    last = lambda column, kinds: F.max_by(column, F.when(F.col("event").isin(kinds), F.struct("at", "event")))
    state = events.groupBy("item_id").agg(last("event", ["reviewed", "reopened"]).alias("event"), last("at", ["reviewed", "reopened"]).alias("at"), last("priority", ["reprioritised"]).alias("new_priority"))
    rows = items.drop("reviewed_at").join(state, items["id"] == state["item_id"], "left")
    return rows.withColumn("reviewed_at", F.when(F.col("event") == "reviewed", F.col("at"))).withColumn("priority", F.coalesce("new_priority", "priority")).drop("item_id", "event", "at", "new_priority")


def pending(items: DataFrame, draft_category: str | None = None) -> DataFrame:
    """Unreviewed items, highest priority first, then id."""
    rows = items.filter("reviewed_at IS NULL")
    return (rows if draft_category is None else rows.filter(F.col("draft_category") == draft_category)).orderBy(F.desc("priority"), "id")


def resolved_items(items: DataFrame, verdicts: DataFrame, at: str) -> DataFrame:
    """Events that close pending items whose verdict a heuristic has settled."""
    settled = verdicts.filter("kind = 'heuristic' AND category <> 'unknown'").select("fingerprint")
    return items.filter("reviewed_at IS NULL").join(settled, "fingerprint", "left_semi").select(F.col("id").alias("item_id"), F.lit("reviewed").alias("event"), F.lit(None).cast("bigint").alias("priority"), F.lit(at).alias("at"))


def requeue(fingerprints: DataFrame, live_decisions: DataFrame, items: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stamps of human decisions, reopening events, fingerprints that need a new item) to queue fingerprints again."""
    stamps = live_decisions.filter("kind = 'human'").join(fingerprints, "fingerprint", "left_semi").select(F.lit("decision").alias("table"), "id", F.lit(now).alias("superseded_at"))
    mine = items.join(fingerprints, "fingerprint", "left_semi")
    last = mine.groupBy("fingerprint").agg(F.max(F.struct("id", "reviewed_at")).alias("i"))
    events = last.filter("i.reviewed_at IS NOT NULL").select(F.col("i.id").alias("item_id"), F.lit("reopened").alias("event"), F.lit(None).cast("bigint").alias("priority"), F.lit(now).alias("at"))
    return stamps, events, fingerprints.join(mine, "fingerprint", "left_anti")


def human_verdicts(choices: DataFrame, items: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(decisions to append, queue events) of reviewers' choices (item_id, choice, category, signed_by, signature) on pending items: accept the draft, override it, or defer, which records nothing."""
    pending = items.filter("reviewed_at IS NULL").select(F.col("id").alias("item_id"), "fingerprint", "draft_category", F.col("reason").alias("queue_reason"))
    rows = choices.join(pending, "item_id").filter("choice <> 'defer'")
    category = schemas.checked(F.when(F.col("choice") == "accept", F.coalesce("draft_category", F.lit("unknown"))).otherwise(F.col("category")), schemas.ASSIGNABLE_CATEGORIES, "category")
    decisions = rows.select(
        "fingerprint", category.alias("category"), F.lit("high").alias("confidence"), F.concat(F.lit("human:"), "signed_by").alias("decided_by"), F.lit(1).alias("rule_version"), F.lit("human").alias("kind"), F.lit(True).alias("verified"),
        "signature", "signed_by", F.to_json(F.struct("choice", "draft_category", "queue_reason")).alias("evidence"), F.lit(now).alias("decided_at"),
    )
    return decisions, rows.select("item_id", F.lit("reviewed").alias("event"), F.lit(None).cast("bigint").alias("priority"), F.lit(now).alias("at"))


def history(decisions: DataFrame, n: int) -> DataFrame:
    """Newest human decisions, superseded ones included."""
    return decisions.filter("kind = 'human'").orderBy(F.desc("id")).limit(n)


def note_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_notes"))
