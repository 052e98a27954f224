"""Committed folders: data is written first, to a folder of its own, and a small numbered file makes it visible.

A writer that fails leaves a folder that no commit names, and readers go on with the last commit. Each path
has one writer at a time. Paths may be in any store that Spark's file systems reach.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

COMMITS = "_commits"


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_folder() -> str:
    """A name that no other write has."""
    return f"data-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def numbers(spark: SparkSession, path: str) -> list[int]:
    fs, p = _at(spark, f"{path}/{COMMITS}")
    found = [re.fullmatch(r"(\d+)\.json", f.getPath().getName()) for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(m[1]) for m in found if m)


def read(spark: SparkSession, path: str, number: int) -> dict:
    fs, p = _at(spark, f"{path}/{COMMITS}/{number:012d}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, path: str) -> dict | None:
    """What the last commit says; None before the first."""
    known = numbers(spark, path)
    return read(spark, path, known[-1]) if known else None


def commit(spark: SparkSession, path: str, entry: dict, number: int | None = None) -> int:
    """Make an entry (a few KB) the last commit, or that of a given number; an error if that number is taken."""
    n = (numbers(spark, path) or [0])[-1] + 1 if number is None else number
    fs, to = _at(spark, f"{path}/{COMMITS}/{n:012d}.json")
    _, draft = _at(spark, f"{path}/{COMMITS}/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
    finally:
        out.close()
    if fs.exists(to) or not fs.rename(draft, to):
        fs.delete(draft, False)
        raise ValueError(f"commit {n} of {path} is taken")
    return n


def keep_last(spark: SparkSession, path: str, n: int = 2) -> None:
    """Delete the folders, and the commits, before the last n: a reader that began with the one before the last can end."""
    for number in numbers(spark, path)[:-n]:
        drop(spark, f"{path}/{read(spark, path, number)['folder']}")
        drop(spark, f"{path}/{COMMITS}/{number:012d}.json")
