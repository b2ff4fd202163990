"""Command-line jobs on small inputs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rarebucket.plans import jobs
from rarebucket.sources import reports, synthetic


def test_fasta_job(spark, tmp_path):
    random.seed(1)
    genome = "".join(random.choice("ACGT") for _ in range(20000))
    (tmp_path / "a.fa").write_text(f">a\n{genome}\n")
    (tmp_path / "b.fa").write_text(f">b\n{genome[:10000]}\n>c\n{genome[10000:]}\n")
    out = jobs.fasta_runs(spark, str(tmp_path / "a.fa"), str(tmp_path / "b.fa"), 25, 2048, 1, 1)
    rows = out.collect()
    assert out.columns == reports.RUN_HEADER.split(",")
    assert [r.phase for r in rows] == ["warmup", "measured"]
    assert {(r.wkid, r.ani, r.sequence_bases, r.valid_kmers, r.status) for r in rows} == {(1.0, 1.0, 40000, 2 * 19976, "ok")}
    for r in rows:
        parts = (r.preprocess_ms, r.construction_ms, r.comparison_ms, r.metric_ms)
        assert min(parts) > 0 and abs(sum(parts) - r.total_ms) < 1e-6
        assert r.reference_sha256 == hashlib.sha256((tmp_path / "a.fa").read_bytes()).hexdigest()
    assert {(r.lower, r["equal"], r.higher) for r in jobs.compare_files(spark, str(tmp_path / "a.fa"), str(tmp_path / "b.fa")).collect()} == {(0, rows[0]["equal"], 0)}


def test_fasta_runs_then_gate(spark, tmp_path, monkeypatch):
    """Runs of two kinds as CSV, then the gate on both files, with either outcome; a run that fails is a row and fails the gate."""
    random.seed(2)
    for name in "ab":
        (tmp_path / f"{name}.fa").write_text(">x\n" + "".join(random.choice("ACGT") for _ in range(3000)) + "\n")
    both = [f"--{side}={tmp_path / name}.fa" for side, name in (("reference", "a"), ("query", "b"))]
    slower = {"old": 1.0, "new": 0.0}

    def run(s, *a, f=jobs.timed_run):
        found = f(s, *a)
        return found | {c: found[c] + 1e6 * slower[name] for c in ("total_ms", "construction_ms")}

    for name in slower:
        monkeypatch.setattr(jobs, "timed_run", run)
        assert jobs.main(["fasta", *both, "--runs=2", "--warmup=1", f"--backend={name}", f"--csv={tmp_path / name}"]) == 0
    files = ["--runs-csv", str(tmp_path / "old"), str(tmp_path / "new")]
    assert jobs.main(["gate", *files, "--fast=new", "--slow=old", f"--json={tmp_path / 'gate'}"]) == 0
    assert jobs.main(["gate", *files, "--fast=old", "--slow=new"]) == 1
    verdict = spark.read.json(str(tmp_path / "gate")).first()
    assert verdict.go and verdict.speedup > 1 and verdict.fast_construction < verdict.slow_construction

    def broken(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(jobs, "timed_run", broken)
    assert jobs.main(["fasta", *both, "--runs=1", "--warmup=0", "--backend=new", f"--csv={tmp_path / 'bad'}"]) == 1
    assert [(r.status, r.error) for r in spark.read.option("header", True).csv(str(tmp_path / "bad")).collect()] == [("failed", "RuntimeError: lost")]
    assert jobs.main(["gate", *files, str(tmp_path / "bad"), "--fast=new", "--slow=old"]) == 1


def test_acceptance_from_the_command_line(spark, tmp_path):
    """Metrics of two systems in CSV files: equal ones pass, a baseline without a metric or a worse own side fails."""
    own = [(a, r, a / 100 + 0.0001 * r, (a / 100) ** 25) for a in (85.0, 99.0) for r in range(3)]
    worse = [(a, r, x + 0.01, w) for a, r, x, w in own]
    for name, rows in (("own", own), ("same", own), ("worse", worse), ("none", [(a, r, None, None) for a, r, _, _ in own])):
        reports.write_csv(spark.createDataFrame(rows, jobs.METRIC_SCHEMA), str(tmp_path / name))
    status = lambda a, b: jobs.main(["acceptance", f"--own={tmp_path / a}", f"--baseline={tmp_path / b}", f"--json={tmp_path / (a + b)}"])
    assert (status("own", "same"), status("worse", "own"), status("own", "none")) == (0, 1, 1)
    assert {r.identity: r["pass"] for r in spark.read.json(str(tmp_path / "ownsame")).collect()} == {85.0: True, 99.0: True}


def test_trial_rows(spark):
    """One plan for all points gives the keys of each point alone."""
    rows = jobs.trial_rows(spark, (3, 15), 2, 42)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
    for p in (3, 15):
        for t in range(2):
            want = synthetic.distinct_keys(spark, 1 << p, synthetic.trial_seed(42, p, t)).select("key")
            got = rows.filter(F.col("id") == f"{p}-{t}").select("key")
            assert got.count() == 1 << p and got.exceptAll(want).count() == 0


def test_experiments(spark):
    rows = jobs.accuracy(spark, (8, 10), 2, 42).collect()
    assert len(rows) == 16 and all(r["Absolute Error"] < 0.2 for r in rows)
    assert jobs.throughput(spark, [4096], 2, 1).count() == 2
    both = {(r.left_id, r.right_id): r for r in jobs.profile(spark, 4096, 42).collect()}
    assert both["left", "right"].lower == both["right", "left"].higher
    assert all(abs(r.mae) < 3 for r in jobs.synthetic_errors(spark, 1, 4000).filter("identity >= 95").collect())


def test_whole_genomes_are_registered(spark, sf, monkeypatch):
    """The registered query has the job's full sizes; here it is run on shorter genomes."""
    from rarebucket.plans import catalog

    asked = []
    monkeypatch.setattr(jobs, "synthetic_errors", lambda s, *sizes, f=jobs.synthetic_errors: asked.append(sizes) or f(s, 1, 20_000))
    rows = catalog.QUERIES["genome_identity"](spark, sf).collect()
    assert asked == [(5, 1 << 20)] and {r.identity for r in rows} == set(jobs.LEVELS)
    assert all(r.mae < 1 and r.invalid_rate == 0 for r in rows if r.identity >= 95)


def test_bad_job(spark):
    with pytest.raises(SystemExit):
        jobs.main(["fasta", "--reference", "x", "--query", "y", "--k", "99"])
