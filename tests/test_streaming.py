"""The continuous record pass."""

import json

import pytest

from patchwell.operators import verdict
from patchwell.sources import commits
from patchwell.streaming import record


def body(path, line):
    return f"--- a/{path}\n+++ b/{path}\n@@ -1 +1 @@\n+{line}\n"


def test_record_stream(spark, tmp_path):
    patches, out = tmp_path / "in", str(tmp_path / "ledger")
    patches.mkdir()

    def add(name, *bodies):
        (patches / name).write_text("".join(json.dumps({"patch_name": "p", "body": b}) + "\n" for b in bodies))
        q = record.start(spark, str(patches), out, str(tmp_path / "ck"), lambda epoch: f"2024-01-0{epoch + 1}")
        q.awaitTermination()
        if q.exception():
            raise q.exception()

    def live():
        return record.live(spark, out)

    add("1.json", body("doc/a.md", "x"), body("doc/b.md", "x"), body("a.c", "f();"))
    assert sorted((r["category"], r["id"]) for r in live().collect()) in ([("documentation", 1), ("unknown", 2)], [("documentation", 2), ("unknown", 1)])
    add("2.json", body("debian/rules", "y"), body("a.c", "f();"))
    assert live().count() == 3 and {r["category"] for r in verdict.current(live().selectExpr("*", "cast(null as boolean) verified")).collect()} == {"documentation", "unknown", "packaging"}
    record.record_batch(spark.createDataFrame([("p", body("a.c", "f();"))], record.PATCHES), out, "2024-02-01")
    assert live().count() == 3


def test_readers_between_the_writes(spark, tmp_path, monkeypatch):
    """A batch is seen as a whole or not at all; a failed attempt leaves no trace, and a replayed batch nothing twice."""
    out = str(tmp_path / "ledger")
    batch = lambda *lines: spark.createDataFrame([("p", body("a.c", x)) for x in lines], record.PATCHES)
    rows = lambda: sorted((r["fingerprint"], r["decided_at"]) for r in record.live(spark, out).collect())
    assert rows() == []
    record.record_batch(batch("f();", "g();"), out, "2024-01-01", 1)
    before = rows()
    assert len(before) == 2
    seen, commit = [], commits.commit

    def stopped(*args):
        seen.append(rows())  # rows and stamps are written by now
        raise RuntimeError("stopped before the commit")

    monkeypatch.setattr(commits, "commit", stopped)
    with pytest.raises(RuntimeError):
        record.record_batch(batch("h();"), out, "2024-01-02", 2)
    assert seen == [before] and rows() == before
    monkeypatch.setattr(commits, "commit", commit)
    record.record_batch(batch("h();"), out, "2024-01-02", 2)
    after = rows()
    assert len(after) == 3 and set(before) < set(after)
    record.record_batch(batch("i();"), out, "2024-01-03", 2)  # the number is committed
    assert rows() == after
    ids = [r["id"] for r in record.live(spark, out).collect()]
    assert len(set(ids)) == 3
