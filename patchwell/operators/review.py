"""What a reviewer sees: facets of the work list, its live order, context of a fingerprint, ledger status, risk runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from . import axes


def with_levels(items: DataFrame, observations: DataFrame) -> DataFrame:
    """Queue items with their live risk, reach and size levels; a missing size counts as normal."""
    rows = items
    for name, kind, domain in (("risk", schemas.RISK, schemas.RISK_LEVELS), ("reach", schemas.REACH, schemas.REACH_LEVELS), ("reviewability", schemas.REVIEWABILITY, schemas.SIZE_LEVELS)):
        rows = rows.join(axes.level_per_fingerprint(observations, kind, domain).withColumnRenamed("level", name), "fingerprint", "left")
    return rows.withColumn("reviewability", F.coalesce("reviewability", F.lit("normal")))


def filtered(rows: DataFrame, category: str | None = None, family: DataFrame | None = None, reviewability: str | None = None, reach: str | None = None) -> DataFrame:
    """Any of the facets together; `family` holds the fingerprints of a package."""
    for column, value in (("draft_category", category), ("reviewability", reviewability), ("reach", reach)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows if family is None else rows.join(family, "fingerprint", "left_semi")


def live_order(rows: DataFrame) -> list[Column]:
    """Order of the work list as it stands: live risk, live reach, stored priority."""
    return [F.desc(axes.rank_of(F.col("risk"), schemas.RISK_LEVELS)), F.desc(axes.rank_of(F.col("reach"), schemas.REACH_LEVELS)), F.desc("priority"), F.asc("id")]


def status(verdicts: DataFrame, residue: DataFrame, items: DataFrame, observations: DataFrame) -> DataFrame:
    """(item, n): residue, pending, residue at high risk, and each risk level."""
    risk = axes.level_per_fingerprint(observations, schemas.RISK, schemas.RISK_LEVELS)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")
    hot = residue.join(risk.filter("level = 'high'"), "fingerprint", "left_semi")
    out = n(residue, "residue").unionByName(n(items.filter("reviewed_at IS NULL"), "pending")).unionByName(n(hot, "hot residue")).unionByName(n(verdicts, "verdicts"))
    return out.unionByName(risk.groupBy(F.concat(F.lit("risk "), "level").alias("item")).agg(F.count(F.lit(1)).alias("n")))


def context(fingerprints: DataFrame, groups: DataFrame, claims: DataFrame, drafts: DataFrame, packages: DataFrame, facts: DataFrame, marks: DataFrame) -> DataFrame:
    """Each fingerprint with its representative row, claim, draft, carriers, package date and synopsis, and mark."""
    rows = fingerprints.join(groups, "fingerprint", "left")
    for side in (claims, drafts, packages, marks):
        rows = rows.join(side, "fingerprint", "left")
    return rows.join(facts, "source_package", "left")


def risk_records(scores: DataFrame, live_observations: DataFrame, now: str, rule_version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(observations to append, stamps): each new score (fingerprint, risk, reason, truncated) replaces the live one."""
    evidence = F.to_json(F.struct("reason", "truncated"))
    append = scores.select("fingerprint", F.lit(schemas.RISK).alias("kind"), F.col("risk").alias("detail"), evidence.alias("evidence"), F.lit("risk-gate").alias("observed_by"), F.lit(rule_version).alias("rule_version"), F.lit(now).alias("observed_at"))
    old = live_observations.filter(F.col("kind") == schemas.RISK).join(scores.select("fingerprint").distinct(), "fingerprint", "left_semi")
    return append, old.select(F.lit("observation").alias("table"), "id", F.lit(now).alias("superseded_at"))


def risk_statistics(scores: DataFrame) -> DataFrame:
    """Counts of a risk run by level: all, culled as benign, rated on a cut or a projected text."""
    return scores.groupBy("risk").agg(F.count(F.lit(1)).alias("n"), F.count_if("culled").alias("culled"), F.count_if("truncated").alias("truncated"), F.count_if("projected").alias("projected"))


def draft_reasoning(evidence: Column) -> Column:
    return F.get_json_object(evidence, "$.draft.reasoning")


def reviewed_package(evidence: Column) -> Column:
    return F.get_json_object(evidence, "$.package")
