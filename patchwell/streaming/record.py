"""Continuous record pass: patches arrive as JSON lines, decisions leave as appended rows.

Classification has no state across patches and the record pass is a difference against the ledger,
so a batch that is replayed after a failure writes nothing twice. No watermark is needed: identity
is the content's fingerprint. The rows and stamps of a batch bear its attempt, and are seen from the moment the batch is
committed: a reader between the writes, or after a failure, sees the ledger as it was before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import classify, ledger
from ..sources import commits

PATCHES = "patch_name string, body string"
#: Leading characters of a fingerprint that name its folder: a batch reads only the folders it has fingerprints of.
PREFIX = 2
KEPT = "id bigint, fingerprint string, category string, confidence string, decided_by string, rule_version int, kind string, evidence string, decided_at string"


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger table, empty before its first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def attempts(spark: SparkSession, ledger_dir: str) -> DataFrame:
    """The attempts that are committed, one a batch."""
    return read_json(spark, f"{ledger_dir}/{commits.COMMITS}", "attempt string")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Small files of JSON, empty before the first."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def decisions(spark: SparkSession, ledger_dir: str) -> DataFrame:
    """Decisions of committed batches."""
    return read_table(spark, f"{ledger_dir}/decision", f"{KEPT}, attempt string, prefix string").join(attempts(spark, ledger_dir), "attempt", "left_semi").drop("attempt")


def supersession(spark: SparkSession, ledger_dir: str) -> DataFrame:
    """Stamps of committed batches."""
    return read_table(spark, f"{ledger_dir}/supersession", f"{schemas.SUPERSESSION}, attempt string").join(attempts(spark, ledger_dir), "attempt", "left_semi").drop("attempt")


def live(spark: SparkSession, ledger_dir: str) -> DataFrame:
    """Live decisions as of the last committed batch."""
    return ledger.live(decisions(spark, ledger_dir).drop("prefix"), supersession(spark, ledger_dir), "decision")


def prefix() -> Column:
    return F.substring("fingerprint", 1, PREFIX).alias("prefix")


def record_batch(batch: DataFrame, ledger_dir: str, now: str, number: int | None = None) -> None:
    """Record one batch of patches: append what is new, stamp what changed, and commit both. A batch whose number is committed already does nothing."""
    spark = batch.sparkSession
    known = commits.numbers(spark, ledger_dir)
    if number is not None and number in known:
        return
    decided, stamped = decisions(spark, ledger_dir), supersession(spark, ledger_dir)
    base = read_table(spark, f"{ledger_dir}/decision", KEPT).agg(F.max("id")).first()[0] or 0  # reads one column; ids of failed attempts are not used again
    desired = classify.decisions(batch).persist()
    attempt = uuid.uuid4().hex
    try:
        prefixes = [r[0] for r in desired.select(prefix()).distinct().collect()]  # 256 at most
        mine = ledger.live(decided.filter(F.col("prefix").isin(prefixes)).drop("prefix"), stamped, "decision")
        append, stamps = ledger.record_decisions(desired, mine, now)
        rows = ledger.with_ids(append, base, ["fingerprint", "decided_by"]).select(*[f.split()[0] for f in KEPT.split(", ")], F.lit(attempt).alias("attempt"), prefix())
        rows.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(f"{ledger_dir}/decision")
        stamps.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{ledger_dir}/supersession")
        commits.commit(spark, ledger_dir, {"attempt": attempt}, number)
    finally:
        desired.unpersist()


def start(spark: SparkSession, patches_dir: str, ledger_dir: str, checkpoint_dir: str, clock: Callable[[int], str]) -> StreamingQuery:
    """Record all patches of a folder and those that come; `clock` gives the time of a batch."""
    stream = spark.readStream.schema(PATCHES).json(patches_dir)
    return stream.writeStream.foreachBatch(lambda df, epoch: record_batch(df, ledger_dir, clock(epoch), epoch + 1)).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
