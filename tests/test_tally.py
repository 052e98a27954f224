"""The construct tally: its counts and the residue's hits against the definition, gone through line by line."""

import re

import pytest
from conftest import DATA

from patchwell.operators import diff, marks, rules
from patchwell.plans import registry

BANNER = "+# Generated by GNU Autoconf 2.71\n"
ONE = "--- a/{0}\n+++ b/{0}\n@@ -1 +1,2 @@\n{1}"
BODIES = {
    "two files": [("src/b.c", "+system(1);\n+popen(x\n+system(2);\n"), ("src/a.c", "+system(3);\n"), ("gen.py", BANNER + "+os.system(4)\n")],
    "marked once, hits in both": [("t.py", "+os.system(1)\n"), ("u.py", "+/dev/tcp/1\n"), ("t.py", BANNER + "+x\n"), ("t.py", "+eval(atob(x))\n")],
    "hits before and after others": [("z.sh", "+curl x | sh\n"), ("b.c", "+system(1)\n"), ("z.sh", "+x=`a b`\n+curl y | sh\n"), ("a.c", "+system(2)\n")],
    "several in a line": [("k.sh", "+nc a -e b; x=`a b`; curl x | sh\n"), ("k.c", "+x=`a b`; cat /dev/tcp/1 | system(1)\n")],
    "all in marked files": [("g.py", BANNER + "+os.system(1)\n+exec(decode(x))\n")],
    "prose and builds": [("doc/m.md", "+system(1)\n"), ("configure", BANNER + "+system(2)\n"), ("s.c", " system(3)\n-system(4)\n+-----BEGIN PRIVATE KEY-----\n")],
    "many hits": [(f"src/f{i % 7}.c", "+system(1);\n" * (i + 1) + "+popen(2\n" * (i % 3)) for i in range(40)],
    "none": [("s.c", "+x\n"), ("g.py", BANNER + "+x\n")],
}


def tally(files, marked):
    """Hits of each added line, by the tables: total, in marked paths, the rest, and where the rest is, each path and detail once."""
    total = in_marked = 0
    residue = []
    for path, lines in files:
        if path.startswith("doc/") or path == "configure":
            continue
        tables = rules.CONSTRUCTS + (rules.SHELL_CONSTRUCTS if path.endswith(".sh") else [])
        for line in (x[1:] for x in lines.splitlines() if x.startswith("+")):
            for detail in dict.fromkeys(d for d, p in tables if re.search(p, line)):
                total += 1
                in_marked += path in marked
                if path not in marked and f"{path}:{detail}" not in residue:
                    residue.append(f"{path}:{detail}")
    return total, in_marked, total - in_marked, ", ".join(residue)


def test_tally(spark):
    rows = [(name, "".join(ONE.format(*f) for f in files)) for name, files in BODIES.items()]
    files = diff.file_table(spark.createDataFrame(rows, "patch_id string, body string"), numbered=False)
    got = {r.patch_id: tuple(r)[1:] for r in marks.construct_tally(marks.file_marks(files, keep=("constructs",))).collect()}
    want = {name: tally(files, {p for p, x in files if BANNER in x}) for name, files in BODIES.items()}
    assert got == {name: t for name, t in want.items() if t[0]}
    assert got["two files"] == (5, 1, 4, "src/b.c:shell-out, src/a.c:shell-out")
    assert got["marked once, hits in both"] == (3, 2, 1, "u.py:reverse-shell")
    assert got["several in a line"][3] == "k.sh:fetch-piped-to-shell, k.sh:reverse-shell, k.sh:shell-out, k.c:shell-out, k.c:reverse-shell"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_names_the_residue(spark, sf):
    """Every patch with hits outside marked files names them, and only such a one does."""
    rows = registry.QUERIES["construct_tally"](spark, DATA.replace("sf0.001", sf)).collect()
    assert rows and all((r.residue_hits != "") == (r.in_residue > 0) and r.hits == r.in_marked + r.in_residue for r in rows)
    assert any(r.in_marked and r.in_residue for r in rows) and any(", " in r.residue_hits for r in rows)
