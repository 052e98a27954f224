"""Axes beside the category: size, install-base reach, outside references, injection suspicion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions.text import bug_number, family_of, region_of

LARGE, OVERSIZED = 500, 5000
# Install fractions of the reach levels, inclusive.
CUTS = [("XL", 0.5), ("L", 0.1), ("M", 0.01), ("S", 0.001)]
FRESH_DAYS = 30


def size_level(changed: Column) -> Column:
    return F.when(changed <= LARGE, "normal").when(changed <= OVERSIZED, "large").otherwise("oversized")


def size_evidence(changed: Column) -> Column:
    return F.to_json(F.struct(changed.alias("changed_lines"), F.lit(LARGE).alias("large_over"), F.lit(OVERSIZED).alias("oversized_over")))


def fraction(inst: Column, anchor: Column) -> Column:
    return F.when(anchor > 0, inst / anchor).otherwise(0.0)


def reach_level(inst: Column, anchor: Column) -> Column:
    f = fraction(inst, anchor)
    out = F.when(F.lit(False), "")
    for level, least in CUTS:
        out = out.when(f >= least, level)
    return out.otherwise("XS")


def reach(carriers: DataFrame, binaries: DataFrame, installs: DataFrame, column: str = "inst") -> DataFrame:
    """Reach of each fingerprint: level, deciding binary, its installs, anchor.

    carriers (fingerprint, source), binaries (source, binaries array), installs (binary, inst, vote).
    An absent binary counts 0; a fingerprint none of whose sources lists binaries is `unknown`.
    Ties go to the first binary by name.
    """
    anchor = installs.agg(F.coalesce(F.max(column), F.lit(0)).alias("anchor"))
    per_source = binaries.select("source", F.explode("binaries").alias("binary")).distinct()
    counts = per_source.join(installs.select("binary", F.col(column).alias("inst")), "binary", "left").withColumn("inst", F.coalesce("inst", F.lit(0)))
    best = counts.groupBy("source").agg(F.max(F.struct("inst", F.col("binary"))).alias("top"), F.min_by("binary", F.struct(-F.col("inst"), F.col("binary"))).alias("binary"))
    rows = carriers.select("fingerprint", "source").distinct().join(best.select("source", F.col("top.inst").alias("inst"), "binary"), "source", "left")
    rows = rows.groupBy("fingerprint").agg(F.max("inst").alias("inst"), F.min_by("binary", F.when(F.col("inst").isNotNull(), F.struct(-F.col("inst"), F.col("binary")))).alias("binary"))
    rows = rows.join(F.broadcast(anchor))  # one row
    return rows.select("fingerprint", F.when(F.col("inst").isNull(), "unknown").otherwise(reach_level(F.col("inst"), F.col("anchor"))).alias("level"), "binary", "inst", "anchor")


def reach_evidence(snapshot_date: str) -> Column:
    inst, anchor = F.col("inst"), F.col("anchor")
    return F.to_json(F.struct(anchor.alias("anchor_inst"), "binary", reach_level(inst, anchor).alias("bucket"), F.bround(fraction(inst, anchor), 4).alias("fraction"), "inst", F.lit(snapshot_date).alias("snapshot_date")))


def verify_cves(claims: DataFrame, tracker: DataFrame) -> DataFrame:
    """Outcome for each claim (fingerprint, source, cves): confirmed, wrong-source, not-found or unknown, with the deciding CVE.

    The first claimed CVE that is on record for the claim's own source confirms; else wrong-source if
    any is on record elsewhere; unknown without a claim.
    """
    c = claims.select("fingerprint", "source", F.posexplode_outer("cves").alias("pos", "cve"))
    own = tracker.select("source", "cve", F.col("status").alias("own_status"), "fixed_version", F.lit(True).alias("own")).dropDuplicates(["source", "cve"])
    anywhere = tracker.select("cve", F.lit(True).alias("known")).distinct()
    rows = c.join(own, ["source", "cve"], "left").join(anywhere, "cve", "left")
    first = lambda column, flag: F.min_by(column, F.when(flag, F.col("pos")))
    g = rows.groupBy("fingerprint", "source").agg(
        F.count("cve").alias("n"), first("cve", F.col("own")).alias("hit"), first("own_status", F.col("own")).alias("status"),
        first("fixed_version", F.col("own")).alias("fixed_version"), first("cve", F.col("known")).alias("elsewhere"), first("cve", F.col("cve").isNotNull()).alias("claimed"),
    )
    outcome = F.when(F.col("n") == 0, "unknown").when(F.col("hit").isNotNull(), "confirmed").when(F.col("elsewhere").isNotNull(), "wrong-source").otherwise("not-found")
    return g.select("fingerprint", "source", outcome.alias("outcome"), F.coalesce("hit", "elsewhere", "claimed").alias("cve"), "status", "fixed_version")


def verify_bugs(claims: DataFrame, bugs: DataFrame) -> DataFrame:
    """Outcome for each claim (fingerprint, source, bugs array<struct<tracker,ref>>): confirmed by the first Debian bug filed against the source, else wrong-source, not-found or unknown."""
    c = claims.select("fingerprint", "source", F.posexplode_outer("bugs").alias("pos", "b")).withColumn("bug", F.when(F.col("b.tracker") == "debian", bug_number(F.col("b.ref"))))
    filed = bugs.select("bug", F.col("source").alias("filed_on")).dropDuplicates(["bug", "filed_on"])
    rows = c.join(filed, "bug", "left")
    own = F.col("filed_on") == F.col("source")
    g = rows.groupBy("fingerprint", "source").agg(
        F.count("bug").alias("n"), F.min_by("bug", F.when(own, F.col("pos"))).alias("hit"),
        F.min_by("bug", F.when(F.col("filed_on").isNotNull(), F.col("pos"))).alias("elsewhere"), F.min_by("bug", F.when(F.col("bug").isNotNull(), F.col("pos"))).alias("claimed"),
    )
    outcome = F.when(F.col("n") == 0, "unknown").when(F.col("hit").isNotNull(), "confirmed").when(F.col("elsewhere").isNotNull(), "wrong-source").otherwise("not-found")
    return g.select("fingerprint", "source", outcome.alias("outcome"), F.coalesce("hit", "elsewhere", "claimed").alias("bug"))


def should_settle(content_category: Column, touches_code: Column) -> Column:
    """Only unsettled content that touches code may be settled by an outside record."""
    return (content_category == "unknown") & touches_code


def fresh_until(snapshot_date: Column, days: int = FRESH_DAYS) -> Column:
    return F.date_format(F.date_add(snapshot_date.cast("date"), days), "yyyy-MM-dd")


def is_stale(horizon: Column, today: Column) -> Column:
    return today >= horizon


def level_per_fingerprint(observations: DataFrame, kind: str, domain: list[str]) -> DataFrame:
    """Latest live level of an axis for each fingerprint; details outside the domain don't count."""
    live = observations.filter((F.col("kind") == kind) & F.col("superseded_at").isNull() & F.col("detail").isin(domain))
    return live.groupBy("fingerprint").agg(F.max_by("detail", "id").alias("level"))


def rank_of(level: Column, domain: list[str]) -> Column:
    """Place in the domain; 0 where the level is missing or has none."""
    return F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, domain)), level), F.lit(0)) - 1, F.lit(0)).cast("int")


def injection_families(observations: DataFrame) -> DataFrame:
    live = observations.filter((F.col("kind") == schemas.INJECTION) & F.col("superseded_at").isNull())
    return live.groupBy("fingerprint").agg(F.array_join(F.array_sort(F.collect_set(family_of(F.col("detail")))), ", ").alias("families"))


def suspects(observations: DataFrame, region: str = "diff") -> DataFrame:
    live = observations.filter((F.col("kind") == schemas.INJECTION) & F.col("superseded_at").isNull())
    return live.filter(region_of(F.col("detail")) == region).select("fingerprint").distinct()


def live_fingerprints(observations: DataFrame, kind: str, detail: str | None = None) -> DataFrame:
    live = observations.filter((F.col("kind") == kind) & F.col("superseded_at").isNull())
    return (live if detail is None else live.filter(F.col("detail") == detail)).select("fingerprint").distinct()


def generated_marks(observations: DataFrame) -> DataFrame:
    """Live marks with their evidence parsed; malformed evidence is skipped."""
    schema = "coverage double, files array<struct<path:string,family:string,added:bigint,removed:bigint>>, generated_lines bigint, residue_lines bigint"
    live = observations.filter((F.col("kind") == schemas.GENERATED) & F.col("superseded_at").isNull()).withColumn("e", F.from_json("evidence", schema)).filter("e.files IS NOT NULL")
    return live.groupBy("fingerprint").agg(F.max_by(F.struct("detail", "e"), "id").alias("m")).select("fingerprint", "m.detail", "m.e.*")


def residue_unlocked(observations: DataFrame) -> DataFrame:
    """Oversized fingerprints whose hand-written rest is small enough to read."""
    return live_fingerprints(observations, schemas.REVIEWABILITY, "oversized").join(generated_marks(observations).filter(F.col("residue_lines") <= OVERSIZED).select("fingerprint"), "fingerprint")


def rescore_candidates(observations: DataFrame) -> DataFrame:
    """Marked fingerprints whose live risk row was rated on a cut text and without a projection."""
    risk = observations.filter((F.col("kind") == schemas.RISK) & F.col("superseded_at").isNull())
    risk = risk.filter((F.get_json_object("evidence", "$.truncated") == "true") & ~F.array_contains(F.json_object_keys("evidence"), "projected"))
    return risk.select("fingerprint").distinct().join(live_fingerprints(observations, schemas.GENERATED), "fingerprint")
