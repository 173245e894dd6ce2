"""Stream queries: the table's file is read as a stream until it is exhausted, and the sink's files are the result."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F


from detectlab.plans.corpus_queries import RUNS
from detectlab.plans.derived import run_log
from detectlab.plans.registry import query
from detectlab.plans.text_queries import spans_sql
from detectlab.session import materialise, read_table, shared_dir
from detectlab.streaming import streams as T
from detectlab.streaming.runs import ROCKSDB, with_predecessors


def _stream(spark, sf_dir, table):
    """The table's files as a stream. A table is one file or a folder of them; the pattern matches either."""
    schema = read_table(spark, sf_dir, table).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}[.]parquet")


def _out(spark, name):
    base = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    return f"{base}/data", f"{base}/checkpoint"


def _run_to_files(spark, stream, name):
    path, checkpoint = _out(spark, name)
    T.to_files(stream, path, checkpoint)
    return spark.read.schema(stream.schema).parquet(path)


@query("stream_detection", f"SELECT doc_id, category, match, start FROM ({spans_sql('documents', 'doc_id')})")
def stream_detection(spark, sf_dir):
    docs = _stream(spark, sf_dir, "documents").select("doc_id", "text")
    return _run_to_files(spark, T.detect_stream(docs, ["doc_id"]), "detect")


@query("stream_running_counters", "SELECT event_type, count(*) AS tested, count(*) FILTER (WHERE value > 10) AS detected, count(*) FILTER (WHERE NOT value > 10) AS evaded FROM events GROUP BY event_type")
def stream_running_counters(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").select("event_type", (F.col("value") > 10).alias("caught"))
    path, checkpoint = _out(spark, "counters")
    T.latest_to_files(T.running_counters(events, "event_type", "caught"), path, checkpoint)
    batches = spark.read.schema("event_type string, tested long, detected long, evaded long, batch int").parquet(path)
    return T.latest_rows(batches, "event_type", ("tested", "detected", "evaded"))


@query("stream_windowed_rate",
       "SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_type, tested, detected FROM (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS tested, count(*) FILTER (WHERE value > 10) AS detected "
       "FROM events GROUP BY ALL) WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_windowed_rate(spark, sf_dir):
    """Windows that the watermark has passed, which are the final ones."""
    events = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("value") > 10).alias("caught"))
    return _run_to_files(spark, T.windowed_rate(events, "ts", "event_type", "caught"), "windows")


@query("stream_windowed_rate_all",
       "SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS tested, count(*) FILTER (WHERE value > 10) AS detected FROM events GROUP BY ALL")
def stream_windowed_rate_all(spark, sf_dir):
    """All windows, those that are still open at the end of the stream with what they hold: the last update of each."""
    events = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("value") > 10).alias("caught"))
    path, checkpoint = _out(spark, "all-windows")
    T.latest_to_files(T.windowed_rate(events, "ts", "event_type", "caught"), path, checkpoint)
    batches = spark.read.schema("window_start timestamp, window_end timestamp, event_type string, tested long, detected long, batch int").parquet(path)
    return T.latest_rows(batches, ["window_start", "window_end", "event_type"], ("tested", "detected"))


_SLIDES = "(SELECT date_trunc('day', ts) - INTERVAL 1 DAY * k AS window_start, event_type, value, ts FROM events CROSS JOIN (SELECT unnest([0, 1, 2]) AS k))"


@query("stream_sliding_rate",
       "SELECT window_start, window_start + INTERVAL 3 DAY AS window_end, event_type, count(*) AS tested, count(*) FILTER (WHERE value > 10) AS detected "
       f"FROM {_SLIDES} GROUP BY ALL")
def stream_sliding_rate(spark, sf_dir):
    """Windows of three days that begin every day; each event counts in three."""
    events = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("value") > 10).alias("caught"))
    path, checkpoint = _out(spark, "sliding")
    T.latest_to_files(T.windowed_rate(events, "ts", "event_type", "caught", "3 days", "1 day"), path, checkpoint)
    batches = spark.read.schema("window_start timestamp, window_end timestamp, event_type string, tested long, detected long, batch int").parquet(path)
    return T.latest_rows(batches, ["window_start", "window_end", "event_type"], ("tested", "detected"))


#: Files of ten days each; every fiftieth event comes with the file after the next.
_PART_SQL = "date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) // 10 + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END"
_LATE_SQL = (
    f"parts AS (SELECT *, {_PART_SQL} AS part FROM events), tops AS (SELECT part, max(ts) AS latest FROM parts GROUP BY part), "
    "marks AS (SELECT p.part, max(t.latest) - INTERVAL 1 HOUR AS mark FROM (SELECT DISTINCT part FROM parts) p LEFT JOIN tops t ON t.part < p.part GROUP BY p.part), "
    "judged AS (SELECT p.*, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, FALSE) AS late FROM parts p JOIN marks USING (part))")


def _disordered(spark, sf_dir):
    """The events as files that a stream reads one by one, some events far behind their time."""
    path, checkpoint = _out(spark, "disordered")
    events = read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("value") > 10).alias("caught"))
    part = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 10) + F.when(F.col("event_id") % 50 == 0, 2).otherwise(0)
    named = events.withColumn("part", part.cast("int"))
    for (number,) in sorted(named.select("part").distinct().collect()):
        named.where(F.col("part") == number).drop("part").coalesce(1).write.parquet(f"{path}/part={number}")
    return spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def _split(spark, sf_dir):
    path, checkpoint = _out(spark, "split")
    T.split_late(_disordered(spark, sf_dir), "ts", "event_type", "caught", path, checkpoint)
    return path


@query("stream_late_rows", f"WITH {_LATE_SQL} SELECT event_id, ts, event_type FROM judged WHERE late")
def stream_late_rows(spark, sf_dir):
    """Events beyond the watermark of their batch, which windowed aggregation drops."""
    path = _split(spark, sf_dir)
    return spark.read.schema("event_id long, ts timestamp, event_type string").parquet(f"{path}/late").select("event_id", "ts", "event_type")


@query("stream_counts_and_late_rows",
       "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS tested, count(*) FILTER (WHERE value > 10) AS detected FROM events GROUP BY ALL")
def stream_counts_and_late_rows(spark, sf_dir):
    """Counts in time and late rows together are the batch."""
    path = _split(spark, sf_dir)
    counts = spark.read.schema("window_start timestamp, event_type string, tested long, detected long").parquet(f"{path}/counts")
    late = spark.read.schema("ts timestamp, event_type string, caught boolean").parquet(f"{path}/late").select(
        F.date_trunc("day", "ts").alias("window_start"), "event_type", F.lit(1).alias("tested"), F.col("caught").cast("int").alias("detected"))
    both = counts.select("window_start", "event_type", "tested", "detected").unionByName(late)
    return both.groupBy("window_start", "event_type").agg(F.sum("tested").alias("tested"), F.sum("detected").alias("detected"))


@query("stream_unique_runs", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY ALL")
def stream_unique_runs(spark, sf_dir):
    """Every event line twice, as after a repeated append; one of each is left."""
    events = _stream(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    kept = _run_to_files(spark, T.unique_runs(events, "ts", ["event_id"]), "unique")
    return kept.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("stream_drop_alerts",
       f"SELECT scanner_label AS label, run_seq, previous, pass_rate AS rate FROM (SELECT *, lag(pass_rate) OVER (PARTITION BY scanner_label ORDER BY run_seq) AS previous FROM ({RUNS}) WHERE type = 'scan') WHERE previous - pass_rate > 5")
def stream_drop_alerts(spark, sf_dir):
    path, _ = _out(spark, "runs")
    runs = run_log(spark, sf_dir).filter(F.col("type") == "scan").select("scanner_label", "run_seq", "pass_rate")
    runs.write.parquet(path)
    stream = spark.readStream.schema(runs.schema).parquet(path)
    return _run_to_files(spark, T.drop_alerts(stream, "scanner_label", "run_seq", "pass_rate", 5.0), "alerts")


@query("stream_late_runs",
       "SELECT label, run_seq, previous, rate FROM (SELECT scanner_label AS label, run_seq, ts, pass_rate AS rate, lag(pass_rate) OVER (PARTITION BY scanner_label ORDER BY ts, run_seq) AS previous "
       f"FROM ({RUNS}) WHERE type = 'scan') WHERE ts <= (SELECT max(ts) FROM ({RUNS}) WHERE type = 'scan') - INTERVAL 8 DAY")
def stream_late_runs(spark, sf_dir):
    """Files of three days of runs; every third run comes with the next file, and is still compared with the run before it."""
    path, _ = _out(spark, "late-runs")
    runs = run_log(spark, sf_dir).filter(F.col("type") == "scan").select("scanner_label", "ts", "run_seq", "pass_rate")
    part = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 3) + F.when(F.col("run_seq") % 3 == 0, 1).otherwise(0)
    named = materialise(runs.withColumn("part", part.cast("int")), "runs")
    for (number,) in sorted(named.select("part").distinct().collect()):
        named.where(F.col("part") == number).drop("part").coalesce(1).write.parquet(f"{path}/part={number}")
    stream = spark.readStream.schema(runs.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKSDB)
    try:
        return _run_to_files(spark, with_predecessors(stream, "scanner_label", "ts", "run_seq", "pass_rate", "8 days"), "predecessors")
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
