"""Appends that happen once, the signature index, and runs that arrive late."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from detectlab.functions.shingles import jaccard, shingles
from detectlab.operators import sigindex
from detectlab.sources import manifest, readers
from detectlab.streaming import streams
from detectlab.streaming.runs import ROCKSDB, with_predecessors


def run_table(spark, totals):
    return spark.createDataFrame([("scan", "2024-01-01T00:00:00Z", t) for t in totals], "type string, timestamp string, total long").coalesce(1)


def test_appends_are_numbered_and_made_once(spark, tmp_path):
    log = str(tmp_path / "log")
    assert readers.read_runs(spark, log).count() == 0
    assert readers.append_runs(run_table(spark, [5]), log, "first") == 0
    with ThreadPoolExecutor(4) as tries:
        same = list(tries.map(lambda _: readers.append_runs(run_table(spark, [7, 8]), log, "second"), range(4)))
    assert set(same) == {1}
    with ThreadPoolExecutor(3) as tries:
        others = list(tries.map(lambda i: readers.append_runs(run_table(spark, [100 + i]), log, f"other {i}"), range(3)))
    assert sorted(others) == [2, 3, 4]
    assert readers.append_runs(run_table(spark, [5]), log, "first") == 0
    assert readers.append_runs(run_table(spark, [9]), log) == 5
    rows = readers.read_runs(spark, log).orderBy("run_seq").collect()
    assert [r.total for r in rows[:3]] == [5, 7, 8] and sorted(r.total for r in rows) == [5, 7, 8, 9, 100, 101, 102]
    assert rows[-1].total == 9 and [r.run_seq for r in rows] == list(range(1, 8))


def test_an_append_without_its_manifest_file_is_not_read(spark, tmp_path):
    log = str(tmp_path / "log")

    def broken(folder):
        run_table(spark, [1]).write.json(folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        manifest.AppendLog(spark, log).append("a", broken)
    assert readers.read_runs(spark, log).count() == 0
    readers.append_runs(run_table(spark, [2]), log, "a")
    assert [r.total for r in readers.read_runs(spark, log).collect()] == [2]


def test_loose_lines_and_appends_together(spark, tmp_path):
    (tmp_path / "old.json").write_text('{"type":"scan","timestamp":"2024-01-01T00:00:00Z","total":1}\n\nbroken\n')
    readers.append_runs(run_table(spark, [2]), str(tmp_path), "new")
    assert sorted(r.total for r in readers.read_runs(spark, str(tmp_path)).collect()) == [1, 2]


def test_index_finds_what_the_exact_join_finds(spark, tmp_path):
    base = [f"w{i} " * 1 for i in range(60)]
    rows = []
    for i in range(40):
        words = [w.strip() for w in base]
        for k in range(i % 8):
            words[(7 * i + 11 * k) % 60] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    rows += [(100, ""), (101, None), (102, "two words"), (103, "two words"), (104, "nothing in common with the others at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "index")
    sigindex.write_index(docs.where("doc_id % 2 = 0"), "doc_id", "text", path)
    probes = docs.where("doc_id % 2 = 1")
    found = {r.doc_id: (r.registered, round(r.jaccard, 9)) for r in sigindex.probe_index(probes, "doc_id", "text", path, 0.5).collect()}
    left = probes.select("doc_id", shingles(F.col("text")).alias("a")).where("size(a) > 0")
    right = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("r"), shingles(F.col("text")).alias("b")).where("size(b) > 0")
    want = {}
    for r in left.crossJoin(right).select("doc_id", "r", jaccard(F.col("a"), F.col("b")).alias("j")).where("j >= 0.5").collect():
        best = want.get(r.doc_id)
        if best is None or (r.j, -r.r) > (best[1], -best[0]):
            want[r.doc_id] = (r.r, r.j)
    assert len(want) > 15 and found == {k: (a, round(b, 9)) for k, (a, b) in want.items()}
    with pytest.raises(ValueError):
        sigindex.probe_index(probes, "doc_id", "text", path, 0.2)


def test_late_runs_meet_their_predecessor(spark, tmp_path):
    rows = [[("a", 1, 1, 50.0), ("a", 4, 4, 80.0), ("b", 2, 2, 10.0), (None, 2, 9, 1.0)], [("a", 2, 2, 60.0), ("a", 3, 3, None)], [("a", 20, 20, 1.0), ("b", 20, 21, 5.0)]]
    path = str(tmp_path / "in")
    for i, part in enumerate(rows):
        df = spark.createDataFrame(part, "label string, day int, run_seq long, rate double")
        df.select("label", F.timestamp_seconds(F.col("day") * 86400).alias("ts"), "run_seq", "rate").coalesce(1).write.parquet(f"{path}/part={i}")
    stream = spark.readStream.schema("label string, ts timestamp, run_seq long, rate double").option("recursiveFileLookup", "true").option(
        "maxFilesPerTrigger", 1).parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        streams.to_files(with_predecessors(stream, "label", "ts", "run_seq", "rate", "5 days"), str(tmp_path / "out"), str(tmp_path / "check"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.label, r.run_seq, r.previous, r.rate) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1, None, 50.0), ("a", 2, 50.0, 60.0), ("a", 4, 60.0, 80.0), ("b", 2, None, 10.0)]
