"""Round trips of bundles and exports."""

import glob
import gzip

import pytest
from pyspark.sql import functions as F

from patchwell import schemas
from patchwell.operators import fingerprints, publish, verdict
from patchwell.sources import commits, readers


def test_bundle_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("b", "2"), ("a", "1")], "source string, newest string")
    d = spark.createDataFrame([("a", "1-1", "patched", 3)], "source string, version string, state string, total long")
    doc = publish.bundle(s, d, "r", "2024-01-01T00:00:00Z")
    assert doc.first()[0].index('"a":"1"') < doc.first()[0].index('"b":"2"')
    publish.write_bundle(doc, str(tmp_path / "b"))
    files = glob.glob(str(tmp_path / "b" / "part-*"))
    assert len(files) == 1 and gzip.open(files[0]).read().startswith(b'{"schema":1')
    s2, d2 = readers.bundle(spark, str(tmp_path / "b"), "r")
    assert sorted(map(tuple, s2.collect())) == [("a", "1"), ("b", "2")] and [tuple(r) for r in d2.collect()] == [("a", "1-1", "patched", 3)]
    with pytest.raises(Exception, match="another release"):
        readers.bundle(spark, str(tmp_path / "b"), "q")[0].collect()


def test_export_round_trip(spark, tmp_path):
    schema = "id bigint, fingerprint string, category string, decided_at string, evidence string"
    rows = [(1, "a", "x", "2024-01-05", None), (2, "b", "y", None, "e"), (3, "c", "z", "2024-02-01", "e"), (4, "d", "x", "2024-01-01", None)]
    df = spark.createDataFrame(rows, schema)
    manifest = publish.write_export(df, "decided_at", str(tmp_path / "x"))
    assert {r["month"]: r["n"] for r in manifest.collect()} == {"2024-01": 2, "2024-02": 1, "undated": 1}
    back = readers.export(spark, str(tmp_path / "x"), schema)
    assert sorted(map(tuple, back.collect())) == rows
    publish.write_export(back, "decided_at", str(tmp_path / "y"))
    read = lambda p: sorted(open(f).read() for f in glob.glob(str(tmp_path / p / "data-*" / "month=*" / "part-*")))
    assert read("x") == read("y")


def test_snapshot_guard(spark, tmp_path):
    with pytest.raises(ValueError):
        publish.write_snapshot(spark.createDataFrame([], "a long"), str(tmp_path / "s"))
    with pytest.raises(ValueError):
        publish.write_snapshot(spark.createDataFrame([(0,)], "a long"), str(tmp_path / "s"), "a")
    publish.write_snapshot(spark.createDataFrame([(1,)], "a long"), str(tmp_path / "s"), "a")
    assert readers.snapshot(spark, str(tmp_path / "s")).agg(F.max("a")).first()[0] == 1


def test_json_lines_keep_the_last_row_of_a_file(spark, tmp_path):
    """Provenance and outcome lines: of rows with one key the one that was appended last stands, whatever its values."""
    path = tmp_path / "rows.jsonl"
    lines = [f'{{"source_package": "p{i % 50}", "version": "1", "state": "s{(i * 7) % 300:03d}", "n_patches": {i}}}' for i in range(300)]
    path.write_text("\n".join([*lines[:120], "not json", *lines[120:]]) + "\n")
    rows = readers.json_lines(spark, str(path), schemas.PACKAGE_ROWS)
    last = fingerprints.last_rows(rows.filter("source_package IS NOT NULL"), ["source_package", "version"], "ord")
    assert sorted((r["source_package"], r["n_patches"], r["state"]) for r in last.collect()) == sorted((f"p{k}", 250 + k, f"s{((250 + k) * 7) % 300:03d}") for k in range(50))


def test_a_failed_export_leaves_the_one_before(spark, tmp_path):
    path, schema = str(tmp_path / "x"), "id bigint, at string, v string"
    with pytest.raises(FileNotFoundError):
        readers.export(spark, path, schema)
    first = spark.createDataFrame([(i, f"2024-0{1 + i % 3}-05", "a") for i in range(30)], schema)
    publish.write_export(first, "at", path)
    broken = first.withColumn("v", F.when(F.col("id") == 29, F.raise_error(F.lit("broken row")).cast("string")).otherwise("b"))
    with pytest.raises(Exception, match="broken row"):
        publish.write_export(broken.repartition(5), "at", path)
    assert sorted(map(tuple, readers.export(spark, path, schema).collect())) == sorted(map(tuple, first.collect()))
    manifest = publish.write_export(first.filter("id < 10"), "at", path)
    assert {r["month"]: r["n"] for r in manifest.collect()} == {"2024-01": 4, "2024-02": 3, "2024-03": 3} and readers.export(spark, path, schema).count() == 10
    publish.write_export(first.limit(0), "at", path)
    assert readers.export(spark, path, schema).count() == 0 == readers.export_manifest(spark, path).count() and len(commits.numbers(spark, path)) == 2


def test_a_refused_snapshot_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path / "s")
    publish.write_snapshot(spark.range(5).withColumnRenamed("id", "a"), path, "a")
    held = readers.snapshot(spark, path)
    for rows in (spark.range(0).withColumnRenamed("id", "a"), spark.range(1).withColumnRenamed("id", "a")):
        with pytest.raises(ValueError):
            publish.write_snapshot(rows, path, "a")
        assert readers.snapshot(spark, path).count() == 5
    publish.write_snapshot(spark.range(7).withColumnRenamed("id", "a"), path, "a")
    assert held.count() == 5 and readers.snapshot(spark, path).count() == 7  # a reader that began before ends
    assert len(glob.glob(f"{path}/data-*")) == 2


def test_corpus_build_resumes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    work = spark.createDataFrame([(f"s{i}", "1") for i in range(40)] + [("s1", "1")], "source string, version string")
    calls = []

    def fetch(rows, failing=0):
        calls.append({r[0] for r in rows.select("source").collect()})
        n = F.substring("source", 2, 9).cast("int")
        texts = F.when(n % 7 == failing, None).when(n % 5 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("a"), F.concat(F.lit("body "), n % 9), F.lit("b"), F.lit("shared")))
        return rows.select("source", "version", F.lit("3.0 (quilt)").alias("format"), texts.alias("texts"))

    commit, n = commits.commit, [0]

    def stopped(*args):
        n[0] += 1
        if n[0] == 3:
            raise RuntimeError("stopped after the bodies of a step")
        return commit(*args)

    monkeypatch.setattr(commits, "commit", stopped)
    with pytest.raises(RuntimeError):
        publish.build_corpus(work, fetch, path, steps=5)
    assert len(commits.numbers(spark, path)) == 2
    monkeypatch.setattr(commits, "commit", commit)
    publish.build_corpus(work, fetch, path, steps=5)
    failing = {f"s{i}" for i in range(0, 40, 7)}
    assert set().union(*calls[3:]) == {f"s{i}" for i in range(40)} - ((calls[0] | calls[1]) - failing)
    one = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    outcomes = readers.corpus_outcomes(spark, path)
    assert outcomes.select("source_package").distinct().count() == 40 and {r[0] for r in outcomes.filter("error = 'fetch-failed'").select("source_package").collect()} == failing
    assert outcomes.filter("error IS NULL").count() == 34
    done = len(calls)
    publish.build_corpus(work, lambda rows: fetch(rows, failing=9), path, steps=5)  # the failed ones again, nothing else
    outcomes = fingerprints.outcomes(readers.corpus_outcomes(spark, path).filter("error IS NULL"))
    assert set().union(*calls[done:]) == failing and {r["state"]: r["n"] for r in outcomes.collect()} == {"clean": 8, "patched": 32}
    stored = readers.corpus_bodies(spark, path)
    assert stored.count() == stored.select("sha").distinct().count() == 10
    patches = readers.corpus_patches(spark, path)
    assert patches.count() == 64 == patches.dropDuplicates().count() and set(one(patches.select("raw_sha256").distinct(), "raw_sha256")) == set(one(stored, "sha"))
    done = len(calls)
    publish.build_corpus(work, fetch, path, steps=5)
    assert len(calls) == done


def test_maintained_verdicts(spark):
    """After random batches of decisions and stamps, the maintained table is what all live decisions give."""
    import random

    r, schema = random.Random(3), "id long, fingerprint string, category string, decided_by string, rule_version int, kind string, confidence string, evidence string, decided_at string, verified boolean"
    every, stamps, table = [], [], None
    for batch in range(4):
        new = [(batch * 100 + i, f"f{r.randint(0, 12)}", r.choice("ab"), "r", 1, r.choice(["human", "llm", "heuristic"]), r.choice(["high", "low", None]), None, r.choice(["2024-01-01", "2024-02-01", None]), r.choice([True, False, None])) for i in range(30)]
        every += new
        fresh = [("decision", i, "x") for i in r.sample([e[0] for e in every], 12)] + [("observation", 1, "x")]
        stamps += fresh
        gone = {i for t, i, _ in stamps if t == "decision"}
        live = spark.createDataFrame([e for e in every if e[0] not in gone], schema)
        table = verdict.maintained(table, spark.createDataFrame(new, schema), spark.createDataFrame(fresh, schemas.SUPERSESSION), live)
        table = spark.createDataFrame(table.collect(), table.schema)  # as stored
        assert sorted(map(repr, verdict.verdicts(table).collect())) == sorted(map(repr, verdict.current(live).collect()))


def test_prefix_reads_one_folder(spark, tmp_path):
    path = str(tmp_path / "i")
    known = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("fingerprint"))
    publish.write_index(known.union(known), path)
    found = readers.known_index(spark, path, "3f1")
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan and len(found.inputFiles()) >= 1
    want = sorted(r[0] for r in known.filter("fingerprint like '3f%'").collect())
    assert sorted(r[0] for r in verdict.resolve_prefix(found, "3f").collect()) == want[:11]
    assert readers.known_index(spark, path, "").count() == 3000
