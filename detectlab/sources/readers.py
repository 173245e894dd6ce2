"""Sources with explicit schemas: scan results, run logs, false-positive reports, payloads, dictionaries, archives."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detectlab.operators.detect import severity
from detectlab.operators.history import scan_label
from detectlab.operators.rates import number_in_group
from detectlab.operators.scoring import tallies
from detectlab.sources.manifest import APPENDS, AppendLog

PAYLOAD = "struct<value:string,category:string,category_type:string,label:string>"
VARIANT = "struct<value:string,generator:string,technique:string,transform_name:string,strategy:string>"
RESULT = (f"struct<payload:{PAYLOAD},variant:{VARIANT},detected:boolean,severity:string,duration_ms:double,error:string,"
          "confidence:double,sub_category:string,validator:string,entropy_classification:string,bin_brand:string,"
          "bin_country:string,bin_card_type:string,bin_issuer:string>")
COUNTS = "struct<pass:long,fail:long,error:long>"
META = (f"struct<timestamp:string,scanner:string,total:long,pass:long,fail:long,error:long,pass_rate:double,"
        f"summary_by_category:map<string,{COUNTS}>>")
SCAN_SCHEMA = f"meta {META}, results array<{RESULT}>"
RUN_SCHEMA = (
    "timestamp string, type string, scanner_label string, tool string, categories array<string>, "
    "strategies array<string>, total long, pass long, fail long, error long, pass_rate double, total_tested long, "
    "total_flagged long, fp_rate double, commit_hash string, archive_file string, "
    "technique_success_rates map<string,double>")
FP_SCHEMA = (
    "tool string, mode string, count_per_category long, total_tested long, total_flagged long, "
    "overall_false_positive_rate double, by_category map<string,struct<total:long,flagged:long,"
    "false_positive_rate:double,flagged_values:array<string>>>")


def read_scans(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Result rows of scan documents; a document without ``meta`` or ``results`` gives none.

    ``multi_line`` is for indented documents; documents of one line each split better without it.
    """
    docs = spark.read.schema(SCAN_SCHEMA).option("multiLine", multi_line).json(path)
    rows = docs.filter(F.col("meta").isNotNull() & F.col("results").isNotNull()).select(
        F.input_file_name().alias("run_id"), F.col("meta.timestamp").alias("run_ts"), F.posexplode("results").alias("ord", "r"))
    return rows.select(
        "run_id", "run_ts", F.col("ord").cast("long").alias("payload_id"), F.col("ord").alias("ordinal"),
        F.col("r.payload.value").alias("payload_value"), F.col("r.payload.category").alias("category"),
        F.col("r.payload.label").alias("label"), F.col("r.variant.generator").alias("generator"),
        F.col("r.variant.technique").alias("technique"), F.col("r.variant.transform_name").alias("transform_name"),
        F.col("r.variant.strategy").alias("strategy"), F.col("r.variant.value").alias("variant"),
        F.coalesce("r.detected", F.lit(False)).alias("detected"), F.coalesce("r.error", F.lit("")).alias("error"),
        "r.confidence", "r.sub_category", "r.validator", "r.entropy_classification", "r.bin_brand", "r.bin_country",
        "r.bin_card_type", "r.bin_issuer", "r.duration_ms",
    ).withColumn("severity", severity(F.col("detected"), F.col("error")))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run log lines; blank and broken lines are skipped. A log that is not there yet is empty.

    ``run_seq`` counts the runs in append order: by the number of their append in the manifest (lines of a log without one come
    first), then by timestamp, by when the file was written, by its name, and by the place in the file. Spark reads large files
    first, so the order in which it hands out lines says nothing.
    """
    log = AppendLog(spark, path)
    numbers = log.folders()
    found = [spark.read.text(p).select("value", "_metadata") for p in ([path] if log.has_files(path) else [])]
    if numbers:
        found.append(spark.read.text(list(numbers)).select("value", "_metadata"))
    lines = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "value string, _metadata struct<file_path:string,file_modification_time:timestamp,file_block_start:long>")
    lines = lines.select(
        "value", F.col("_metadata.file_modification_time").alias("__written"), F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"))
    # One row an append.
    appends = spark.createDataFrame([(p.rsplit("/", 1)[1], n) for p, n in numbers.items()], "__folder string, __number long")
    folder = F.regexp_extract("__file", f"/{APPENDS}/[^/]+/([^/]+)/[^/]+$", 1)
    lines = lines.withColumn("__folder", folder).join(appends, "__folder", "left").drop("__folder")
    places = ["__written", "__file", "__block", "__line"]
    parsed = lines.select(*places, F.from_json("value", RUN_SCHEMA, {"mode": "PERMISSIVE"}).alias("r"),
                          F.try_parse_json("value").isNotNull().alias("ok"),
                          F.coalesce("__number", F.get_json_object("value", "$.append_seq").cast("long")).alias("__append"))
    kept = parsed.filter(F.col("ok") & F.col("r").isNotNull() & (F.size(F.array_compact(F.array(
        "r.timestamp", "r.type", "r.tool"))) > 0)).select(
        *places, "__append", F.try_to_timestamp("r.timestamp").alias("ts"), F.col("r.timestamp").alias("ts_raw"), "r.*").drop("timestamp")
    numbered = number_in_group(kept, [], ["__append", "ts", *places], "run_seq")
    return numbered.select("run_seq", *[c for c in kept.columns if c not in (*places, "__append")])


def read_false_positives(spark: SparkSession, path: str) -> DataFrame:
    """One row per category of each report."""
    docs = spark.read.schema(FP_SCHEMA).option("multiLine", True).json(path)
    return docs.filter(F.col("by_category").isNotNull()).select(
        F.input_file_name().alias("run_id"), "tool", "total_tested", "total_flagged",
        F.explode("by_category").alias("category", "c")).select(
        "run_id", "tool", "total_tested", "total_flagged", "category", F.col("c.total").alias("total"),
        F.col("c.flagged").alias("flagged"), F.col("c.flagged_values").alias("flagged_values"))


def read_payloads(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A user's payload table with at least value and category."""
    schema = "value string, category string, label string"
    reader = spark.read.schema(schema)
    return (reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)).withColumn(
        "payload_id", F.xxhash64("category", "value"))


def read_dictionary(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Registered values from CSV with a header, from JSON lines, or from JSON documents with a ``values`` array."""
    if fmt == "csv":
        return spark.read.schema("category string, label string, value string").option("header", True).option(
            "escape", '"').csv(path)
    entry = "struct<value:string,category:string,label:string>"
    docs = spark.read.schema(f"values array<{entry}>, category string, label string, value string").json(path)
    one = F.struct(F.col("value"), F.col("category"), F.col("label"))
    return docs.select(F.inline(F.coalesce("values", F.array(one)))).select("category", "label", "value")


def archive_runs(results: DataFrame, path: str) -> None:
    """Append results partitioned by day and sanitised label; nothing is overwritten."""
    results.withColumn("scanner_label", scan_label()).withColumn("run_date", F.to_date("ts")).write.mode("append").partitionBy(
        "run_date", "scanner_label").parquet(path)


def run_rows(results: DataFrame, kind: str = "scan") -> DataFrame:
    """One log row per run_id from outcome rows: counts, rate, categories and strategies seen."""
    counted = results.groupBy("run_id").agg(
        *tallies(results), F.array_sort(F.collect_set("category")).alias("categories"),
        F.array_sort(F.collect_set("strategy")).alias("strategies"))
    return counted.withColumn("type", F.lit(kind)).withColumn("pass_rate", F.when(
        F.col("total") > 0, F.floor((F.col("pass") * 2000 + F.col("total")) / (F.col("total") * 2)) / 10.0).otherwise(0.0))


def append_runs(runs: DataFrame, path: str, append: str | None = None) -> int:
    """Appends runs to the log, all or none, and gives the number of the append.

    ``append`` names it: a repeated append of the same name, after a failure or at the same time, leaves one. Without a name each
    call is an append of its own.
    """
    name = re.sub(r"[^A-Za-z0-9._-]", "_", append) if append else uuid.uuid4().hex
    return AppendLog(runs.sparkSession, path).append(name, lambda folder: runs.write.json(folder))


def backfill(spark: SparkSession, pattern: str) -> DataFrame:
    """Run rows from loose documents: scans by their ``results``, false-positive reports by their ``by_category``."""
    docs = spark.read.schema(f"{SCAN_SCHEMA}, {FP_SCHEMA}").option("multiLine", True).json(pattern).select(
        "*", F.col("_metadata.file_path").alias("archive_file"), F.col("_metadata.file_modification_time").alias("mtime"))
    scans = docs.filter(F.col("meta").isNotNull() & F.col("results").isNotNull()).select(
        F.lit("scan").alias("type"), "archive_file", F.coalesce(F.try_to_timestamp("meta.timestamp"), "mtime").alias("ts"),
        F.col("meta.scanner").alias("scanner_label"), F.col("meta.total").alias("total"), F.col("meta.pass").alias("pass"),
        F.col("meta.fail").alias("fail"), F.col("meta.pass_rate").alias("pass_rate"))
    fps = docs.filter(F.col("by_category").isNotNull()).select(
        F.lit("falsepos").alias("type"), "archive_file", F.col("mtime").alias("ts"), "tool", "total_tested",
        "total_flagged", F.col("overall_false_positive_rate").alias("fp_rate"))
    return scans.unionByName(fps, allowMissingColumns=True)


PAYMENT = ("PmtInfId string, PmtMtd string, Dbtr struct<Nm:string>, CdtTrfTxInf struct<PmtId:struct<EndToEndId:string>,Amt:string,"
           "CdtrAcct:struct<Id:struct<IBAN:string>>,CdtrAgt:struct<FinInstnId:struct<BIC:string>>,RmtInf:struct<Ustrd:string>>")


def read_payments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Payments of XML files, one a ``PmtInf`` element, and apart from them the text of elements that can't be read."""
    rows = (spark.read.format("xml").option("rowTag", "PmtInf").option("mode", "PERMISSIVE").option("ignoreSurroundingSpaces", "false")
            .option("columnNameOfCorruptRecord", "broken").schema(f"{PAYMENT}, broken string").load(path))
    payments = rows.where(F.col("broken").isNull()).select(
        F.col("PmtInfId").alias("id"), F.col("CdtTrfTxInf.PmtId.EndToEndId").alias("e2e"), F.col("Dbtr.Nm").alias("debtor"),
        F.col("CdtTrfTxInf.Amt").alias("amount"), F.col("CdtTrfTxInf.CdtrAcct.Id.IBAN").alias("iban"),
        F.col("CdtTrfTxInf.CdtrAgt.FinInstnId.BIC").alias("bic"), F.col("CdtTrfTxInf.RmtInf.Ustrd").alias("free"))
    return payments, rows.where(F.col("broken").isNotNull()).select("broken")
