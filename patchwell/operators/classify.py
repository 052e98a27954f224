"""From patch bodies to desired heuristic decisions: one a fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import diff, rules


def decisions(bodies: DataFrame) -> DataFrame:
    """fingerprint, category, confidence, decided_by, rule_version, evidence of bodies (body).

    Each distinct fingerprint is analysed once, on its smallest body.
    """
    rows = bodies.select(diff.fingerprint(F.col("body")).alias("fingerprint"), "body")
    one = rows.groupBy("fingerprint").agg(F.min("body").alias("body"))
    v = diff.profile(one, "fingerprint").withColumn("v", rules.first_rule())
    evidence = F.to_json(F.struct("added_lines", "hunks", "removed_lines", F.col("v.signal").alias("signal")))
    return v.select("fingerprint", "v.category", "v.confidence", F.col("v.rule_id").alias("decided_by"), "v.rule_version", evidence.alias("evidence"))
