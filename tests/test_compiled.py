"""Patches are built of shuffled numbers, and what is told of them is compiled: no fused method too long for the JVM, no line looked at by a lambda."""

import re

import pytest
from conftest import DATA

from patchwell.operators import diff, marks
from patchwell.plans import patch_queries, registry

NAMES = ["churn_order", "generated_files", "generated_coverage", "mark_report", "construct_tally", "content_profiles", "provably_benign"]


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_texts_are_made_after_the_shuffle(spark):
    below = plan(patch_queries.patches(spark, DATA)).rsplit("Exchange hashpartitioning(l_orderkey", 1)
    assert len(below) == 2 and "diff --git" not in below[1]


@pytest.mark.parametrize("name", NAMES)
def test_methods_are_short_enough_to_be_compiled(spark, name):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(registry.QUERIES[name](spark, DATA)._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < 8000


def test_no_lambda_looks_at_lines(spark):
    text = plan(registry.QUERIES["generated_files"](spark, DATA))
    assert not re.search(r"(?:transform|exists|filter)\((?:split|slice)\(", text)


def test_tally_in_one_pass(spark):
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan(registry.QUERIES["construct_tally"](spark, DATA)))) == 1


SECTIONS = [
    ("-# Generated by GNU Autoconf 2.13\n # x @generated generated by automake 1.16.1\n", ("automake", "1.16.1")), ("+# Generated from a\n+b by autoheader\n", (None, None)), ("-a\n+Generated by GNU Autoconf\n", ("autoconf", None)),
    ("+Generated from a b by autoheader\n-ltmain.sh (GNU libtool) 2.4.6.\n", ("autoheader", None)), (" @generatedx\n-@generated\n", ("@generated", None)),
]


def test_first_banner(spark):
    rows = [(i, f"--- a/x\n+++ b/x\n@@ -1 +1 @@\n{text}") for i, (text, _) in enumerate(SECTIONS)]
    got = marks.file_marks(diff.file_table(spark.createDataFrame(rows, "patch_id int, body string"), numbered=False)).orderBy("patch_id").collect()
    assert [(r.generator, r.version) for r in got] == [want for _, want in SECTIONS]
