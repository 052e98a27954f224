"""The current verdict, derived from live decisions, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas


def decision_rank() -> Column:
    """human 3, verified model 2, heuristic 1, unverified model 0; an unknown kind is an error."""
    kind = F.col("kind")
    return (
        F.when(kind == "human", 3).when((kind == "llm") & F.coalesce("verified", F.lit(False)), 2).when(kind == "heuristic", 1).when(kind == "llm", 0)
        .otherwise(F.raise_error(F.concat(F.lit("unknown decision kind: "), F.coalesce(kind, F.lit("null")))).cast("int"))
    )


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 2).when(confidence == "medium", 1).when(confidence == "low", 0).otherwise(-1)


def _winner() -> tuple[Column, Column]:
    """What a verdict keeps of a decision, and what decisions are compared by."""
    key = F.struct(decision_rank().alias("rank"), F.coalesce("decided_at", F.lit("")).alias("at"), confidence_rank(F.col("confidence")).alias("c"), F.col("id").alias("i"))
    return F.struct("category", "decided_by", "rule_version", "kind", "confidence", "evidence", "decided_at", F.col("id").alias("decision_id")), key


def current(live_decisions: DataFrame) -> DataFrame:
    """One winner a fingerprint: rank, then decided_at (null lowest), confidence, id. Partial aggregation, no sort."""
    row, key = _winner()
    return live_decisions.groupBy("fingerprint").agg(F.max_by(row, key).alias("v")).select("fingerprint", "v.*")


def maintained(before: DataFrame | None, appended: DataFrame, stamps: DataFrame, live_decisions: DataFrame) -> DataFrame:
    """The table of verdicts with the keys they won by (fingerprint, v, key), after a batch of appended decisions and new stamps.

    `before` is the table before the batch (None: nothing yet), `live_decisions` all that are live after it. A verdict is
    worked out anew only where a stamp names the decision that had won; elsewhere the winner meets the appended rows alone, so
    the old decisions of fingerprints without such a stamp are not compared. Equal to `current`, with `verdicts`.
    """
    row, key = _winner()
    stamped = stamps.filter(F.col("table") == "decision").select("id").distinct()
    added = appended.join(stamped, "id", "left_anti").select("fingerprint", row.alias("v"), key.alias("key"))
    if before is not None:
        lost = before.join(stamped.select(F.col("id").alias("lost")), F.col("key.i") == F.col("lost"), "left_semi").select("fingerprint")
        anew = live_decisions.join(lost, "fingerprint", "left_semi").select("fingerprint", row.alias("v"), key.alias("key"))
        added = before.join(lost, "fingerprint", "left_anti").unionByName(anew).unionByName(added)
    return added.groupBy("fingerprint").agg(F.max_by("v", "key").alias("v"), F.max("key").alias("key"))


def verdicts(table: DataFrame) -> DataFrame:
    """The verdicts of a maintained table, as `current` gives them."""
    return table.select("fingerprint", "v.*")


def residue(decisions: DataFrame, live_decisions: DataFrame) -> DataFrame:
    """Fingerprints whose verdict is unknown, or whose decisions are all superseded; in order."""
    unknown = current(live_decisions).filter("category = 'unknown'").select("fingerprint")
    lost = decisions.select("fingerprint").distinct().join(live_decisions, "fingerprint", "left_anti")
    return unknown.unionByName(lost).distinct().orderBy("fingerprint")


def latest(live_rows: DataFrame, condition: Column, keys: list[str]) -> DataFrame:
    """The live row with the highest id of each key that meets the condition."""
    rest = [c for c in live_rows.columns if c not in keys]
    return live_rows.filter(condition).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("id")).alias("r")).select(*keys, "r.*")


def known_fingerprints(decisions: DataFrame, items: DataFrame) -> DataFrame:
    return decisions.select("fingerprint").unionByName(items.select("fingerprint")).distinct()


def resolve_prefix(known: DataFrame, prefix: str, most: int = 11) -> DataFrame:
    """Fingerprints that start with a prefix, `most` at most: one resolves it, more are candidates."""
    return known.filter(F.col("fingerprint").startswith(prefix)).orderBy("fingerprint").limit(most)


def summary(decisions: DataFrame, live_decisions: DataFrame, live_observations: DataFrame) -> DataFrame:
    """(section, item, n): verdicts by category and by winning rule, live observations by detail, decisions by kind and superseded."""
    v = current(live_decisions)
    one = lambda df, section, item: df.groupBy(item.alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "item", "n")
    parts = [
        one(v, "category", F.col("category")), one(v, "rule", F.concat("decided_by", F.lit("@"), F.col("rule_version").cast("string"))),
        one(live_observations, "observation", F.concat("kind", F.lit("/"), F.coalesce("detail", F.lit("")))),
        one(decisions, "kind", F.col("kind")), one(decisions.join(live_decisions, "id", "left_anti"), "superseded", F.lit("decisions")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit(verdicts: DataFrame, n: int = 500) -> DataFrame:
    return verdicts.orderBy("kind", "decided_by", "category", "fingerprint").limit(n)


def facets(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts of every value of a domain, zeros included, in the domain's order."""
    all_values = rows.sparkSession.createDataFrame([(i, v) for i, v in enumerate(domain)], f"position int, {column} string")
    n = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return all_values.join(n, column, "left").select("position", column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def record_due(verdicts: DataFrame, live_observations: DataFrame, registry: DataFrame, rules: DataFrame) -> DataFrame:
    """(reason, n): verdicts without a size observation; registry versions the ledger lacks."""
    sized = live_observations.filter(F.col("kind") == schemas.REVIEWABILITY)
    a = verdicts.join(sized, "fingerprint", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unsized").alias("reason"), "n")
    b = registry.join(rules, ["rule_id", "version"], "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unregistered").alias("reason"), "n")
    return a.unionByName(b)
