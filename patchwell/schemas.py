"""Closed value sets and table schemas. Schemas are explicit and versioned, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The domains of the data model.
STALENESS = ["current", "behind", "unknown"]
DIVERGENCE = ["patched", "clean", "native", "unknown"]
FORWARDING = ["forwarded", "debian-only", "unknown"]
CLAIM_CATEGORIES = ["security", "packaging", "documentation", "feature", "bugfix", "unknown"]
CONTENT_CATEGORIES = ["packaging", "documentation", "test", "unknown"]
DRAFT_CATEGORIES = ["packaging", "documentation", "bugfix", "security", "feature", "unknown"]
ASSIGNABLE_CATEGORIES = [*DRAFT_CATEGORIES, "test"]
FILE_TYPES = ["test", "build", "doc", "code", "data"]
KINDS = ["heuristic", "llm", "human"]
PURITIES = ["pure", "external"]
CONFIDENCES = ["high", "medium", "low"]
SIZE_LEVELS = ["normal", "large", "oversized"]
REACH_LEVELS = ["XS", "S", "M", "L", "XL"]
RISK_LEVELS = ["none", "low", "elevated", "high"]
DANGEROUS, REVIEWABILITY, REACH, RISK, INJECTION, GENERATED, PROVENANCE = "dangerous-construct", "reviewability", "reach", "security-risk", "llm-injection-suspect", "generated-content", "provenance"

LEDGER_VERSION, BUNDLE_VERSION, EXPORT_VERSION, FINGERPRINT_VERSION = 2, 1, 2, 1

DECISION = "id bigint, fingerprint string, category string, confidence string, decided_by string, rule_version int, kind string, evidence string, decided_at string, superseded_at string, input_snapshot string, input_fresh_until string, verified boolean, signature string, signed_by string"
OBSERVATION = "id bigint, fingerprint string, kind string, detail string, evidence string, observed_by string, rule_version int, observed_at string, superseded_at string"
QUEUE = "id bigint, fingerprint string, reason string, draft_category string, draft_confidence string, priority bigint, enqueued_at string, reviewed_at string"
RULE = "rule_id string, version int, kind string, purity string, category_enum_version int, description string, retired boolean"
NOTE = "id bigint, fingerprint string, body string, signed_by string, signature string, created_at string"
SUPERSESSION = "table string, id bigint, superseded_at string"
QUEUE_EVENT = "item_id bigint, event string, priority bigint, at string"
PROVENANCE_ROWS = "source_package string, version string, patch_name string, raw_sha256 string"
PACKAGE_ROWS = "source_package string, version string, state string, source_format string, n_patches int, changelog_date string, binaries array<string>, description string, error string"
FEED = "map<string,array<struct<repo:string,srcname:string,version:string,status:string>>>"
BUNDLE = "schema int, release string, generated_at string, staleness map<string,string>, divergence map<string,struct<version:string,state:string,total:bigint>>"
VERDICT_BUNDLE = "schema int, release string, generated_at string, verdicts map<string,struct<category:string,kind:string,confidence:string,reason:string,risk:string,reach:string,reviewability:string>>"
TRACKER = "map<string,map<string,struct<releases:map<string,struct<status:string,fixed_version:string>>>>>"


def checked(value: Column, domain: list[str], what: str) -> Column:
    """`value`, or an error if it is not null and not in the domain."""
    bad = value.isNotNull() & ~value.isin(domain)
    return F.when(bad, F.raise_error(F.concat(F.lit(f"unknown {what}: "), value)).cast("string")).otherwise(value)


def expect_version(df: DataFrame, column: str, version: int) -> DataFrame:
    """Rows of `df`; an error at the first row written by another schema version."""
    ok = F.col(column).eqNullSafe(F.lit(version))
    return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column).cast("string"), F.lit("none")))).cast("boolean")))
