"""Saved reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.reports import REPORT
from lectern.settings import LISTED_QUERY_CHARS

CORRUPT = "_corrupt_record"
OF_RUN = "."  # between a run and the rest of a report's id


MANIFEST = "run string, saved_at timestamp, reports bigint"


def save_reports(reports: DataFrame, path: str, format: str = "json", run: str | None = None) -> DataFrame:
    """Append reports with ``report_id`` and ``saved_at``; returns ``qid, report_id`` as saved.

    ``format`` is ``json`` (one object per line), ``parquet``, or ``text`` for the answers alone.

    Every save has a folder of its own and, once that is whole, a line in the manifest. A save that names its ``run`` can be
    repeated: its report ids follow from the run and the question, a run that is in the manifest adds nothing, and what one that
    failed half-way has left is written over. A run's repeated questions share an id.
    """
    spark = reports.sparkSession
    if format == "text":
        reports.select("answer").write.mode("append").text(path)
        return reports.select("qid")
    name = run or _run_id(spark)
    folder = f"{path}/run={name}"
    # without a named run ids are random: they are fixed in the written files and read back from there
    rest = F.md5(F.to_json(F.struct("qid", "query", "mode"))) if run else F.expr("uuid()")
    stamped = reports.withColumn("report_id", F.concat(F.lit(f"{name}{OF_RUN}"), rest)).withColumn("saved_at", F.current_timestamp())
    if run is None or not any(r.run == run for r in read_manifest(spark, path).where(F.col("run") == run).collect()):
        stamped.write.format(format).mode("overwrite").save(folder)
        made = spark.read.schema("saved_at timestamp").format(format).load(folder)
        line = made.agg(F.lit(name).alias("run"), F.max("saved_at").alias("saved_at"), F.count(F.lit(1)).alias("reports"))
        line.coalesce(1).write.mode("append").json(f"{path}/_manifest")
    reader = spark.read.schema(stamped.select("qid", "report_id").schema)
    return reader.format(format).load(folder)


def _run_id(spark: SparkSession) -> str:
    return spark.range(1).select(F.expr("uuid()")).first()[0]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``run, saved_at, reports`` of every save that was completed; empty where there is none yet."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/_manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def find_report(spark: SparkSession, path: str, report_id: str, format: str = "json", qid: str = "bigint") -> DataFrame:
    """The saved report with this id, or no row; only the folder of its run is read."""
    run = report_id.rsplit(OF_RUN, 1)[0]
    known = read_manifest(spark, path).where(F.col("run") == run).select("run").distinct().collect()
    return load_report(_read_runs(spark, path, [r.run for r in known], format, qid), report_id)


def newest_reports(spark: SparkSession, path: str, limit: int = 20, format: str = "json", qid: str = "bigint") -> DataFrame:
    """:func:`list_reports` of the saves at ``path``; only the newest runs that together have ``limit`` reports are read.

    The reports of a run are saved at one time, so older runs can't have any of the newest reports.
    """
    lines = read_manifest(spark, path).dropDuplicates(["run"])
    by_time = lines.groupBy("saved_at").agg(F.sum("reports").alias("reports"), F.collect_list("run").alias("runs"))
    found, runs = 0, []
    # every time has a report at least, or it is passed over: no more than ``limit`` rows are needed
    for r in by_time.where("reports > 0").orderBy(F.desc("saved_at")).limit(limit).collect():
        if found >= limit:
            break
        found, runs = found + r.reports, runs + r.runs
    return list_reports(_read_runs(spark, path, runs, format, qid), limit)


def _read_runs(spark: SparkSession, path: str, runs: Sequence[str], format: str, qid: str) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], f"report_id string, saved_at timestamp, {REPORT.format(qid=qid)}")
    return read_reports(spark, [f"{path}/run={r}" for r in sorted(runs)], format, qid)


def read_reports(spark: SparkSession, path: str | list[str], format: str = "json", qid: str = "bigint") -> DataFrame:
    """All saved reports; lines that are not JSON are left out."""
    schema = f"report_id string, saved_at timestamp, {REPORT.format(qid=qid)}"
    reader = spark.read.option("recursiveFileLookup", True)
    if format == "json":
        # parsed from text: Spark refuses plain counts over a JSON reader's corrupt-record column
        lines = reader.text(path).where(F.trim("value") != "")
        options = {"columnNameOfCorruptRecord": CORRUPT}
        parsed = lines.select(F.from_json("value", f"{schema}, {CORRUPT} string", options).alias("r")).select("r.*")
        return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return reader.schema(schema).format(format).load(path)


def load_report(reports: DataFrame, report_id: str) -> DataFrame:
    """The report with this id, or no row."""
    return reports.where(F.col("report_id") == report_id)


def list_reports(reports: DataFrame, limit: int = 20) -> DataFrame:
    """The newest reports in eight columns."""
    return (
        reports.orderBy(F.desc("saved_at"), F.asc("report_id"))
        .limit(limit)
        .select(
            F.coalesce("report_id", F.lit("")).alias("report_id"),
            F.coalesce("title", F.lit("Untitled")).alias("title"),
            F.coalesce("mode", F.lit("")).alias("mode"),
            F.left(F.coalesce("query", F.lit("")), F.lit(LISTED_QUERY_CHARS)).alias("query"),
            F.col("metadata.timestamp").alias("timestamp"),
            "saved_at",
            F.coalesce("metadata.generation_time", F.lit(0.0)).alias("generation_time"),
            F.coalesce("metadata.total_hits", F.lit(0)).alias("total_hits"),
        )
    )
