"""The profile of a patch: lines are counted in one pass over the diff, and the rows of a patch go into counts and flags that compiled code adds up."""

import pytest
from conftest import DATA

from patchwell.operators import diff, rules
from patchwell.plans import registry

HEADER = "--- a/x.c\n+++ b/x.c\n@@ -1 +1 @@\n"
#: Body, then files, types, added, removed, hunks and the reason.
CASES = [
    (None, 0, None, 0, 0, 0, "no content changes"),
    ("@@ -1 +1 @@\n+a\n", 0, None, 0, 0, 0, None),
    (HEADER + "-int  a;  \n+int a;\n", 1, "code", 1, 1, 1, "white space only"),
    (HEADER + "+// b  \n+/* c */ \t\n+ \n", 1, "code", 3, 0, 1, "comments only"),
    # A header line without a path is a changed line, and so opens no file.
    (HEADER + "+++  \n--- \t\n", 1, "code", 1, 1, 1, None),
    (HEADER + "+// d\r+++ b/doc/e.md\r@@ -2 +2 @@\r+f", 2, "code,doc", 2, 0, 2, None),
    ("--- a/po/g.po\n+++ /dev/null\n@@ -1 +0 @@\n-g\n--- a/h\n+++ b/copyright  \n", 2, "data", 0, 1, 1, "translations, changelog or copyright only"),
    ("--- a/doc/i.md\n+++ b/doc/i.md\n+j", 1, "doc", 1, 0, 0, "documentation only"),
]


def test_counts_and_reasons(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "patch_id int, body string")
    got = diff.profile(rows).select("patch_id", "n_files", "types", "added_lines", "removed_lines", "hunks", rules.provably_benign()).orderBy("patch_id").collect()
    assert [tuple(r)[1:] for r in got] == [c[1:] for c in CASES]


@pytest.mark.parametrize("name", ["content_profiles", "provably_benign"])
def test_nothing_is_collected(spark, name):
    text = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text and "collect_list(CASE" not in text
    assert text.count("ObjectHashAggregate") <= 2  # those that put the bodies together
