"""Queries over patches read their tables once, scan no line twice, and agree with the line tables on odd diffs."""

import re

import pytest
from conftest import DATA

from patchwell.operators import diff, marks
from patchwell.plans import registry


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["display_chunks", "residue_projection", "mark_evidence", "samples_per_category", "classification_summary", "candidate_rules"])
def test_lineitem_is_read_once(spark, name):
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan(registry.QUERIES[name](spark, DATA)))) == 1


@pytest.mark.parametrize("name", ["diff_line_kinds", "residue_projection"])
def test_no_window_over_lines(spark, name):
    assert "Window" not in plan(registry.QUERIES[name](spark, DATA))


def test_filter_on_marks_scans_no_line(spark):
    p = spark.createDataFrame([("k", "--- a/x\n+++ b/x\n@@ -1 +1 @@\n+# Generated by GNU Autoconf 2.71\n")], "patch_id string, body string")
    text = plan(marks.file_marks(diff.file_table(p)).filter("family IS NOT NULL"))
    assert not any("Autoconf" in line for line in text.splitlines() if re.search(r"\bFilter\b", line))


ODD = [
    "text\n--- a/configure\n+++ b/configure\t2024\n@@ -1,2 +1,3 @@\n x \n+++ \n++++\n+a\n--\n-- -\n--- \n@@\n diff\ndiff --git a/z b/z\nindex 1..2\n--- a/y  d\n+++ b/y\n@@ -3 +4 @@\n+b\t\n-c\n",
    "--- a/po/x.po\r\n+++ b/po/x.po\r\n@@ -1 +1 @@\r\n+msgid \"a\"\r\n+msgstr \"b\"\r\n--- SQL\n--- more\n+++ /dev/null\n@@ -1 +0,0 @@\n-x \n+　\nold mode 1\nnew mode 2",
    "diff --git a/m b/m\nold mode 100644\nnew mode 100755\n", "@@ -1 +1 @@\n+a\n+++ b/configure\n+z\nindex 3\n--- q\n", "+++ b/lone\n+x\n", "", None,
    "--- a\n+++  \n+++ b/config.guess\n+timestamp='2020-01-01'\x0c+k\n@@ -1 +1 @@\n--- a/w\n-x\n+++ b/w\n@@ x\n-1\n+1 \n",
]


def test_rows_as_of_the_line_table(spark):
    p = spark.createDataFrame([(i, b) for i, b in enumerate(ODD)], "patch_id int, body string")
    lines = diff.line_table(p)
    rows = lambda df: sorted(map(repr, df.collect()))
    for size in (2, 1 << 20):
        assert rows(diff.line_kinds(p, size=size).groupBy("patch_id", "kind", "run_start").count()) == rows(lines.groupBy("patch_id", "kind", "run_start").count())
        assert rows(diff.hunks(diff.hunk_lines(p, size=size))) == rows(diff.hunks(lines))
    files = diff.file_table(p)
    assert rows(diff.file_table(p, numbered=False)) == rows(files.drop("start"))
    counts = lines.filter("file_no > 0").groupBy("patch_id", "file_no").pivot("kind", ["add", "del", "hunk"]).count().na.fill(0).collect()
    assert sorted((r.patch_id, r.file_no, r["add"], r["del"], r.hunk) for r in counts) == sorted((r.patch_id, r.file_no, r.added, r.removed, r.hunks) for r in files.collect())
    assert rows(marks.projected(p)) == rows(marks.projection(lines, marks.file_marks(files), p))
    with_files = diff.display_chunks(files, marks.file_marks(files).filter("family IS NOT NULL"))
    assert rows(diff.chunked(marks.file_marks(files).selectExpr("*", "family IS NOT NULL AS marked"))) == rows(with_files)
    left = {r.patch_id for r in p.select("patch_id", (diff.plain(p.body) == "").alias("e")).filter("e").collect()}
    assert {r.patch_id for r in diff.profile(p).filter("is_empty").collect()} == left
