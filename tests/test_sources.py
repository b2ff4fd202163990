"""Sequences, FASTA files, synthetic genomes and result tables."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rarebucket.functions import sequences as Q
from rarebucket.operators import reports as P
from rarebucket.functions.hashing import mix
from rarebucket.sources import fasta, files, reports, synthetic


@pytest.mark.parametrize(
    ("records", "k", "kmers", "stats"),
    [
        (["ACGTACGT"], 3, [30, 30, 56, 56, 30, 30], (8, 6, 0)), (["ACGTNACGT"], 3, [30, 30, 30, 30], (8, 4, 0)), (["ACGNNACGT"], 5, [], (7, 0, 1)), (["ATNGT"], 2, [2, 14], (4, 2, 0)),
        (["ACGTAC"], 3, [30, 30, 56, 56], (6, 4, 0)), (["ACGT", ""], 3, [30, 30], (4, 2, 0)), ([], 3, [], (0, 0, 0)), (["AC", "GT"], 3, [30, 30], (4, 2, 0)), (["acgt"], 3, [30, 30], (4, 2, 0)),
        (["AC GT"], 3, [30, 30], (4, 2, 0)), (["ACGTRYN"], 5, [], (4, 0, 1)), (["AC", "NGT"], 3, [], (4, 0, 1)),
    ],
)
def test_fasta_files(spark, tmp_path, records, k, kmers, stats):
    path = tmp_path / "x.fa"
    path.write_text("".join(f">r{i} ACGT\n{r}\n" for i, r in enumerate(records)))
    row = fasta.parsed(spark, str(path), k).first() if records else None
    if records:
        assert (row.kmers, (row.bases, row.valid_kmers, row.invalid_windows)) == (kmers, stats)
    for size in (1, 3, 7, 1000):
        rows = fasta.ranges(spark, str(path), k, size)
        assert sorted(r.kmer for r in fasta.range_kmers(rows, k).collect()) == sorted(kmers)
        assert tuple(fasta.range_statistics(rows, k).first())[1:] == stats


def test_long_file_in_ranges(spark, tmp_path):
    random.seed(3)
    body = "".join(random.choice("ACGTACGTACGTN") for _ in range(4000))
    lines = [body[i : i + 61] for i in range(0, len(body), 61)]
    lines.insert(20, ">second ACGTACGTACGT")
    path = tmp_path / "long.fa"
    path.write_text(">first\n" + "\n".join(lines) + "\n")
    whole = fasta.parsed(spark, str(path), 11).first()
    rows = fasta.ranges(spark, str(path), 11, 333)
    assert sorted(r.kmer for r in fasta.range_kmers(rows, 11).collect()) == sorted(whole.kmers)
    assert tuple(fasta.range_statistics(rows, 11).first())[1:] == (whole.bases, whole.valid_kmers, whole.invalid_windows)


def test_missing_file(spark):
    with pytest.raises(Exception, match="(?i)path|exist"):
        fasta.parsed(spark, "/nowhere/x.fa", 3).count()
    with pytest.raises(FileNotFoundError):
        fasta.ranges(spark, "/nowhere/x.fa", 3)


@pytest.mark.parametrize("text", [">h\nACGTAC>GTTTACG\nAC\n", "ACGT>A\n>AC>GT\nAC>\n>\n\nGT", ">a\r\nAC\r\n>b\r\n>c\r\nGT>T\r\n", "\n\n>x", ">only a header"])
def test_marks_inside_lines(spark, tmp_path, text):
    """A > is a header as a line's first character alone, wherever ranges are cut."""
    path = tmp_path / "x.fa"
    path.write_text(text)
    want = "".join(line for line in text.replace("\r", "").split("\n") if not line.startswith(">"))
    assert fasta.sequences(spark, str(path)).first().sequence.replace("\n", "").replace("\r", "") == want
    for size in range(1, len(text) + 2):
        reader = fasta.FastaReader({"path": str(path), "k": "3", "chunk_bytes": str(size)})
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert "".join(r[3] for r in rows) == want, size
        done = ""
        for _, _, before, body in rows:
            assert before == done[-3:], size
            done += body


def test_many_packed_and_fastq_files(spark, tmp_path):
    """Folders, patterns, gzip and FASTQ give what the plain files give, at any size of piece."""
    random.seed(9)
    genome = "".join(random.choice("ACGTN") for _ in range(700))
    lines = [genome[i : i + 70] for i in range(0, 700, 70)]
    plain = ">a\n" + "\n".join(lines[:4]) + "\n>b>\n" + "\n".join(lines[4:]) + "\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.fa").write_text(plain)
    (tmp_path / "in" / "y.fa.gz").write_bytes(gzip.compress(plain.encode()))
    (tmp_path / "in" / "z.fq").write_text("".join(f"@r{i}\n{line}\n+\n{'@>+I'[i % 4] * len(line)}\n" for i, line in enumerate(lines)))
    want = sorted(spark.createDataFrame([(genome,)], "s string").select(F.explode(Q.kmers(F.col("s"), 5)).alias("kmer")).toPandas()["kmer"])
    for path in (str(tmp_path / "in"), str(tmp_path / "in" / "*.f*"), [str(tmp_path / "in" / n) for n in ("x.fa", "y.fa.gz", "z.fq")]):
        for size in (1, 64, 1 << 20):
            rows = fasta.range_kmers(fasta.ranges(spark, path, 5, size), 5).toPandas()
            assert {p[-4:] for p in rows["path"]} == {"x.fa", "a.gz", "z.fq"}
            assert all(sorted(g["kmer"]) == want for _, g in rows.groupby("path"))
    assert {r.path[-4:]: sorted(r.kmers) for r in fasta.parsed(spark, str(tmp_path / "in"), 5).collect()} == dict.fromkeys(("x.fa", "a.gz", "z.fq"), want)


def test_checksums(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    (tmp_path / "b").write_bytes(bytes(range(256)) * 40_000)
    (tmp_path / "c").write_bytes(b"")
    got = {r.path[-1]: r.sha256 for r in files.checksums(spark, str(tmp_path)).collect()}
    assert got == {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in "abc"}
    assert got["a"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_seeds_and_streams():
    """Values of the seed chain, the stream and the genomes, number by number."""
    state = 42 ^ 7
    for value in (25, 2048, 900, 3):
        state = mix(state) ^ value
    assert synthetic.derived_seed(42, 7, (25, 2048, 900), 3) == mix(state)
    assert synthetic.derived_seed(0, 0, (), 0) == 0  # the mixing keeps 0
    assert synthetic.trial_seed(42, 8, 1) == mix(42 ^ 8 << 32 ^ 1)
    numbers, now = [], 99
    for _ in range(5000):
        now = mix(now)
        numbers.append(now)
    assert synthetic.stream(99, 5000).tolist() == numbers
    for identity in (0.0, 0.5, 0.85, 0.999, 1.0):
        first, second = synthetic.genome_pair(99, 1000, identity)
        at, want = 1000, []
        for base in first:
            low = numbers[at] < (1 - identity) * 2.0**64
            at += 1
            if low:
                base = "ACGT".replace(base, "")[numbers[at] % 3]
                at += 1
            want.append(base)
        assert first == "".join("ACGT"[n & 3] for n in numbers[:1000]) and second == "".join(want)


def test_longest_kmer(spark):
    random.seed(5)
    s = "".join(random.choice("ACGT") for _ in range(31))
    code = {"A": 0, "C": 1, "T": 2, "G": 3}
    fwd = rev = 0
    for a, b in zip(s, reversed(s), strict=True):
        fwd, rev = fwd << 2 | code[a], rev << 2 | code[b] ^ 2
    row = spark.createDataFrame([(s,)], "s string").select(Q.forward(F.col("s")).alias("f"), Q.canonical(F.col("s")), Q.kmers(F.col("s"), 31)).withColumn("r", Q.reverse_complement_packed(F.col("f"), 31)).first()
    assert tuple(row) == (fwd, max(fwd, rev), [max(fwd, rev)], rev)


def test_genomes(spark):
    rows = synthetic.genomes(spark, [90.0, 100.0], 2, 2000).collect()
    assert len(rows) == 4
    for r in rows:
        same = sum(a == b for a, b in zip(r.reference, r["query"], strict=True)) / 2000
        assert abs(same - r.identity / 100) < 0.03 and (r.identity < 100 or same == 1)
    assert len({r.reference for r in rows}) == 4


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 2, 0, 1.5, 2.0, 3.0), ("b", 1, 2, 1, None, 2.0, 3.0)], reports.THROUGHPUT_SCHEMA)
    for name in ("x", "y"):
        reports.write_csv(rows, str(tmp_path / name))
    back = reports.load_csv(spark, str(tmp_path / "x"), reports.THROUGHPUT_SCHEMA)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    both = [str(tmp_path / "x"), str(tmp_path / "y")]
    assert reports.union_csv(spark, both, "count long, absent string").count() == 4
    named = reports.union_csv(spark, both, "count long", lambda df, path: df.withColumn("file", F.lit(path[-1])))
    assert sorted(r.file for r in named.collect()) == ["x", "x", "y", "y"]
    assert reports.run_table(rows).columns == reports.RUN_HEADER.split(",") and len(set(reports.RUN_HEADER.split(","))) == 60
    reports.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert {len(r.sha256) for r in files.checksums(spark, str(tmp_path / "x")).collect()} == {64}


def test_acceptance_without_baseline_fails(spark):
    rows = spark.createDataFrame([(90.0, "own", 0.9, 0.07), (90.0, "baseline", None, None)], "identity double, system string, ani double, wkid double")
    assert P.acceptance(rows).first()["pass"] is False


def test_go_gate(spark):
    rows = [("measured", "f", 1.0, 1.0, "ok"), ("measured", "s", 2.0, 2.0, "ok"), ("warmup", "f", 9.0, 9.0, "bad")]
    row = P.go_gate(spark.createDataFrame(rows, "phase string, backend string, total_ms double, construction_ms double, status string"), "f", "s").first()
    assert row.go and row.speedup == 2.0


@pytest.mark.parametrize("k", [1, 2, 5, 31])
def test_both_forms_of_kmers(spark, k, monkeypatch):
    random.seed(k)
    texts = ["".join(random.choice("ACGTacgt ACGT\tN\u00e9") for _ in range(n)) for n in (0, 1, 30, 31, 32, 400)] + [None, "", "A" * 70]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    want = sorted(map(tuple, rows.select("i", F.explode(Q.kmers(F.col("s"), k))).collect()))
    for size in (1 << 20, 7):
        monkeypatch.setattr(Q, "SLICE", size)
        assert sorted(map(tuple, Q.exploded(rows, "s", k, "i").collect())) == want
    assert Q.exploded(rows, "s", k).count() == len(want)
