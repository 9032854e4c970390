"""Readers and writers on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from quadrat.sources import readers
from quadrat.streaming.checkpoints import windowed_totals


def put(path, text):
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(text)
    return str(path)


@pytest.mark.parametrize("name", ["c.tsv", "c.csv", "c.tsv.gz"])
def test_counts_in_both_orientations(spark, tmp_path, name):
    sep = readers.separator(name)
    text = "\n".join(sep.join(r) for r in [("id", "s1", "s2", "note"), ("f1", "3", "0", "x"), ("f2", "bad", "7", "y")]) + "\n"
    path = put(tmp_path / name, text)
    if name.endswith(".gz"):
        import os

        with gzip.open(path, "wt") as out:
            out.write(text)
        assert os.path.getsize(path)
    got = sorted(tuple(r) for r in readers.read_counts(spark, path, keep=["s1", "s2"]).collect())
    assert got == [("f1", "s1", 3), ("f2", "s2", 7)]
    flipped = sorted(tuple(r) for r in readers.read_counts(spark, path, "rows", ["s1", "s2"]).collect())
    assert flipped == [("s1", "f1", 3), ("s2", "f2", 7)]


def test_blast6_best_hits(spark, tmp_path):
    line = lambda q, s, p, n, ln: "\t".join(map(str, [q, s, p, n, ln, 0, 0, 1, n, 1, n, 1e-9, 90.0]))
    with open(tmp_path / "a.m8", "w") as out:
        out.write("\n".join([line("q1", "s2", 99.0, 90, 100), line("q1", "s1", 99.0, 80, 100), line("q1", "s3", 98.0, 99, 100), line("q2", "s1", 96.0, 90, 100), line("q3", "s1", 99.0, 40, 100), line("q4", "s1", 99.0, 40, 0)]))
    hits = readers.read_blast6(spark, str(tmp_path / "*.m8"))
    assert [(r["qseqid"], r["sseqid"]) for r in readers.best_hits(hits).collect()] == [("q1", "s1")]
    assert hits.first()["source_file"] == "a.m8"


def test_fasta_round_trip(spark, tmp_path):
    with open(tmp_path / "x.fa", "w") as out:
        out.write(">a;size=3 first\nacg\nT\n>b\nGG\n")
    df = readers.read_fasta(spark, str(tmp_path / "x.fa"))
    assert sorted((r["id"], r["seq"]) for r in df.collect()) == [("a;size=3", "ACGT"), ("b", "GG")]
    readers.write_fasta(df, str(tmp_path / "out"), F.concat_ws("||", "id", F.lit("tax")))
    assert sorted((r["id"], r["seq"]) for r in readers.read_fasta(spark, str(tmp_path / "out")).collect()) == [("a;size=3||tax", "ACGT"), ("b||tax", "GG")]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        readers.write_fasta(df, str(tmp_path / "out"))


def test_fastq_pairs(spark, tmp_path):
    for n in ("s1_R1_001.fastq", "s1_R2_001.fastq", "s2_R1.fastq", "other.txt"):
        (tmp_path / n).write_text("x")
    got = {r["stem"]: (r["r1"], r["r2"]) for r in readers.read_fastq_pairs(spark, str(tmp_path)).collect()}
    assert got == {"s1": ("s1_R1_001.fastq", "s1_R2_001.fastq"), "s2": ("s2_R1.fastq", None)}


def test_ragged_fields(spark, tmp_path):
    (tmp_path / "m.txt").write_text("Sequence_ID\thaplo\nq1\tH1\textra\n\n  \nq2\nq1\tH0\n")
    got = {r[0]: r[1] for r in readers.read_two_fields(spark, str(tmp_path / "m.txt"), ("id", "haplo"), "sequence_id").collect()}
    assert got == {"q1": "H0", "q2": None}


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text('<graphml><graph><node id="n0"><data key="d0">a</data></node><node id="n1"/><edge source="n0" target="n1"><data key="w">0.5</data></edge></graph></graphml>')
    nodes, edges = readers.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {r["id"]: dict(r["data"] or {}) for r in nodes.collect()} == {"n0": {"d0": "a"}, "n1": {}}
    assert [(r["a"], r["b"], r["data"]["w"]) for r in edges.collect()] == [("n0", "n1", "0.5")]


def test_named_files_and_square(spark, tmp_path):
    readers.write_table(spark.createDataFrame([(1, "x")], "k int, v string"), str(tmp_path / "summary_type_duleg"))
    got = readers.read_named_files(spark, str(tmp_path / "summary_type_duleg" / "*.csv"), r"part-(\d+)", ["part"])
    assert got.columns[-1] == "part"
    wide = readers.square(spark.createDataFrame([("a", "b", 0.5)], "id1 string, id2 string, dist double")).orderBy("id1").collect()
    assert [tuple(r) for r in wide] == [("a", 0.0, 0.5), ("b", 0.5, 0.0)]


def test_windowed_totals_stream_and_batch_agree(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") * 60).cast("timestamp").alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "events"))
    batch = sorted(tuple(r) for r in windowed_totals(spark.read.parquet(str(tmp_path / "events"))).collect())
    stream = windowed_totals(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("totals").collect()) == batch
