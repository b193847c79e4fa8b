"""Local files are listed, read and written by tasks, with the lines that Spark's reader gives."""

import os
import random
import re

from pyspark.sql import functions as F

from heaplens.sources import lines as L
from heaplens.sources.globs import Glob, Visible


def _spark_lines(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_blocks_give_the_lines_of_sparks_reader(spark, tmp_path, monkeypatch):
    """Whatever ends lines have and wherever blocks are cut, each line is there once and in order."""
    monkeypatch.setattr(L, "BLOCK", 7)
    monkeypatch.setattr(L, "ROWS", 2)
    rng, want = random.Random(1), {}
    texts = [b"", b"\n", b"a", b"a\r", b"\r\n\r\n", b"\xef\xbb\xbfbom\nx", b"a\r\nb\rc\n\nd", "é\nü\r\n".encode() * 5, b"x" * 40 + b"\r" + b"y" * 20, *(bytes(rng.choice(b"ab\r\n") for _ in range(60)) for _ in range(12))]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.log").write_bytes(text)
        if text:
            want[f"{tmp_path}/{k}.log"] = _spark_lines(spark, f"{tmp_path}/{k}.log")
    rows = L.read_lines(spark, f"{tmp_path}/*.log").collect()
    got = {p: [r.line for r in sorted((r for r in rows if r.path == p), key=lambda r: (r.split, r.pos))] for p in want}
    assert got == want and len(rows) == sum(map(len, want.values()))
    assert len({r.split for r in rows}) > 5
    heads = L.read_heads(spark, f"{tmp_path}/*.log", count=3).collect()
    assert {p: [r.line for r in sorted((r for r in heads if r.path == p), key=lambda r: r.pos)] for p in want} == {p: x[:3] for p, x in want.items()}


def test_heads_end_with_a_long_line(spark, tmp_path):
    for name, text in {"a": "x\n" + "é" * 12 + "\nz\n", "b": "é" * 10 + "\ny", "c": "q" * 900_000}.items():
        (tmp_path / f"{name}.log").write_text(text)
    heads = sorted((r.path[-5], r.pos, r.line) for r in L.read_heads(spark, f"{tmp_path}/*.log", max_line=10).collect())
    assert heads == [("a", 0, "x"), ("a", 1, "é" * 11), ("b", 0, "é" * 10), ("b", 1, "y"), ("c", 0, "q" * 11)]


def test_lists_and_lines_of_many_files_stay_with_tasks(spark, tmp_path, monkeypatch):
    """Of many local files no reader lists or opens each by its name, and they are dealt to all cores."""
    monkeypatch.setattr(L, "WIDE", 3)
    for k in range(60):
        (tmp_path / f"user={k}").mkdir()
        (tmp_path / f"user={k}" / "gc.log").write_text(f"[0.1s] Using G1\n{k}\n")
    lines, heads = L.read_lines(spark, f"{tmp_path}/*/*.log"), L.read_heads(spark, f"{tmp_path}/**.log")
    for df in (lines, heads):
        assert df.inputFiles() == [] and df.select(F.spark_partition_id()).distinct().count() >= 8
        assert df.count() == 120 and sorted(int(r.line) for r in df.where("line NOT LIKE '[%'").collect()) == list(range(60))


def test_hidden_names(spark, tmp_path):
    """Hidden files aren't listed, folders with hidden names only where a pattern names them."""
    for name in ("_x/a.log", ".y/b.log", "even=1/c.log", "_k=1/d.log", "_SUCCESS.log", ".e.log", "f.log"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x\n")
    found = lambda p: sorted(os.path.relpath(r.path, tmp_path) for r in L.list_files(spark, f"{tmp_path}/{p}").collect())
    assert found("**.log") == ["_k=1/d.log", "even=1/c.log", "f.log"] and found("*.log") == ["f.log"]
    assert found("*/*.log") == [".y/b.log", "_k=1/d.log", "_x/a.log", "even=1/c.log"] and found("_x/**.log") == ["_x/a.log"]
    assert Visible([Glob("/l/*/**.log")]).shows("/l/_x/a.log") and not Visible([Glob("/l/*/**.log")]).shows("/l/x/_y/a.log")


def test_packed_files_are_read_beside_plain_ones(spark, tmp_path):
    import gzip

    (tmp_path / "a.log").write_text("plain\n")
    with gzip.open(tmp_path / "b.log.gz", "wt") as f:
        f.write("packed\n")
    assert sorted((os.path.basename(r.path), r.line) for r in L.read_lines(spark, f"file://{tmp_path}/*").collect()) == [("a.log", "plain"), ("b.log.gz", "packed")]
    assert sorted(r.line for r in L.read_heads(spark, f"{tmp_path}/*").collect()) == ["packed", "plain"]


def test_texts_are_whole_files(spark, tmp_path):
    """Each value's file is there under its own name only, in order, also where a value goes over several batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(200).select((F.col("id") % 9).alias("k"), F.col("id").cast("string").alias("line")).repartition(3, "k").sortWithinPartitions("k", F.col("line").cast("int"))
        L.write_texts(rows, str(tmp_path), lambda k: f"odd={k % 2}/{k}.txt")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = sorted(os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs)
    assert files == sorted(f"odd={k % 2}/{k}.txt" for k in range(9))
    for name in files:
        k = int(re.search(r"(\d+)\.txt", name)[1])
        assert (tmp_path / name).read_text().split() == [str(x) for x in range(k, 200, 9)]
