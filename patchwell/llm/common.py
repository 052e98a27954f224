"""Helpers shared by the operators: shared storage, frame plumbing, 64-bit mixing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Ids up to this count may be broadcast (16 MB as longs); more take a shuffled join.
BROADCAST_IDS = 1_000_000


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="patchwell-")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. A local folder only where the session names none and there is only one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or _own_dir()


def clear(spark: SparkSession) -> None:
    """Delete what `store` has written for this application. Results that are still to be read from it are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/patchwell/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Drops a query's shuffle files when it ends; a stored table needs them no longer.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/patchwell/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """`df`, a table of ids and numbers, for a join: broadcast while it has at most BROADCAST_IDS rows, else left to a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def having_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose `key` is in `ids`."""
    return df.join(sized(ids), key, "left_semi")


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: a bijection on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def held_out(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 4 is 2: rows no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def portions(batches: Iterator[pa.RecordBatch], text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `most` bytes of their text column, or of one row: a worker holds few texts as objects at once."""
    for batch in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)
