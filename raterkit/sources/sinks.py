"""Sinks: JSON lines, partitioned response files, CSV tables, result reuse, report.

Everything is written by Spark writers from executors; nothing is collected.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

from raterkit.functions.text import path_safe

PARTITION_COLUMNS = ["stem", "model_dir", "question"]


# a compressed file is read by one task, so it ends after so many records
RECORDS_PER_COMPRESSED_FILE = 100_000


def _json_writer(df: DataFrame, mode: str, compression: str | None) -> DataFrameWriter:
    writer = df.write.mode(mode).option("ignoreNullFields", "false")
    if compression is None:
        return writer
    return writer.option("compression", compression).option("maxRecordsPerFile", RECORDS_PER_COMPRESSED_FILE)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    """JSON lines (UTF-8, non-ASCII kept as is), NULL fields written as null.

    ``compression="gzip"`` for lines that would not fit as text; ``sources.jsonl.read_responses`` reads both.
    """
    _json_writer(df, mode, compression).json(path)


def write_json_document(df: DataFrame, path: str) -> None:
    """A one-row table (counters, a report) as one indented JSON document."""
    document = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"pretty": "true", "ignoreNullFields": "false"})
    df.limit(1).select(document.alias("value")).coalesce(1).write.mode("overwrite").text(path)


COMMITS = "_commits"
_JOB_ID = re.compile(r"[A-Za-z0-9._-]+")


def committed_attempts(spark: SparkSession, out_dir: str) -> DataFrame:
    """``job, attempt`` of the appends that were completed: one attempt per job, the first to commit."""
    schema = "job string, attempt string, written timestamp"
    try:
        lines = spark.read.schema(schema).json(f"{out_dir.rstrip('/')}/{COMMITS}")
    except AnalysisException:  # no job has committed here
        lines = spark.createDataFrame([], schema)
    return lines.groupBy("job").agg(F.min_by("attempt", F.struct("written", "attempt")).alias("attempt"))


def append_responses(records: DataFrame, out_dir: str, job: str) -> bool:
    """S7 for a job that may run more than once: its records are appended exactly once.

    The records go to folders of their own for this attempt (``.../job=<job>/attempt=<id>/``), and the
    job's line in the commit manifest is written last. ``read_responses`` takes only folders of
    committed attempts, so an attempt that died, or lost a race, is as if it had not been. A job
    that has committed is not run again. Returns whether this call appended.
    """
    if not _JOB_ID.fullmatch(job):
        raise ValueError(f"a job id names a folder: letters, digits, '.', '_' and '-' only, not {job!r}")
    spark = records.sparkSession
    if not committed_attempts(spark, out_dir).where(F.col("job") == job).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    named = records.withColumns({"job": F.lit(job), "attempt": F.lit(attempt)})
    write_responses(named, out_dir, extra_partitions=["job", "attempt"])
    line = spark.createDataFrame([(job, attempt)], "job string, attempt string").withColumn("written", F.current_timestamp())
    line.coalesce(1).write.mode("append").json(f"{out_dir.rstrip('/')}/{COMMITS}")
    return True


def write_responses(records: DataFrame, out_dir: str, mode: str = "append",
                    extra_partitions: list[str] | None = None) -> None:
    """Response records under ``stem=<stem>/model_dir=<model>/question=<id>/``.

    The last level is the question id, else the question's text, else the stem (an empty value
    counts as missing). Partition columns are copies, so the files keep every record field
    (readers use recursive lookup, which turns partition discovery off). ``mode='overwrite'``
    (S8, one sample file at a time) takes a trailing ``_samples`` off the stem, and with dynamic
    partition overwrite replaces only the partitions being written.
    """
    cols = set(records.columns)
    stem = F.col("stem") if "stem" in cols else F.concat(F.lit("question_"), F.coalesce(F.col("question_id"), F.lit("")))
    if mode == "overwrite":
        stem = F.regexp_replace(stem, "_samples$", "")
    names = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("question_id", "question_text", "question") if c in cols]
    out = records.select(
        *[c for c in records.columns if c not in ("stem", "model_safe", "question", "question_text")],
        stem.alias("stem"),
        path_safe(F.col("model")).alias("model_dir"),
        F.coalesce(*names, stem).alias("question"),
    )
    parts = PARTITION_COLUMNS + list(extra_partitions or [])
    # dynamic overwrite as a write option: only the partitions written are replaced, and the
    # session's own setting is left alone
    (out.write.mode(mode).option("ignoreNullFields", "false").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*parts).json(out_dir))


def write_samples(samples: DataFrame, samples_dir: str, mode: str = "overwrite") -> None:
    """Sample records, one folder per question (``question_dir=<id>/part-*.json``); the
    partition column is a copy, so every record keeps all its fields."""
    samples.withColumn("question_dir", F.col("question_id").cast("string")).write.mode(mode).option(
        "ignoreNullFields", "false").partitionBy("question_dir").json(samples_dir)


def question_folder(question_id: Column) -> Column:
    """Folder value of a question id: NULL and the empty string share the default partition."""
    return F.nullif(question_id.cast("string"), F.lit(""))


def write_checkpoint(records: DataFrame, checkpoint_dir: str, compression: str | None = None) -> None:
    """Append completed responses to the checkpoint folder (kept apart from the outputs), in folders by
    question and model, so that a resumed job reads those of its own requests only
    (``sources.jsonl.completed_requests``). The folder columns are copies. ``compression`` as in ``write_jsonl``."""
    kept = records.select(*[c for c in records.columns if c not in ("stem", "model_safe", "question_text")])
    kept = kept.withColumns({"question_dir": question_folder(F.col("question_id")), "model_dir": path_safe(F.col("model"))})
    _json_writer(kept, "append", compression).partitionBy("question_dir", "model_dir").json(checkpoint_dir)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header line."""
    df.write.mode(mode).option("header", "true").csv(path)


_MANIFEST = "manifest string, version string, note string, written timestamp"


def input_state(spark: SparkSession, *paths: str | None) -> list:
    """Number, total size, latest change and a hash over name, size and time of the files under
    the paths: one aggregate in Spark, one row back. A rewritten or added file changes it."""
    files = None
    for path in paths:
        if path is None:
            continue
        try:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        except AnalysisException:
            continue
        found = found.select("path", "length", "modificationTime")
        files = found if files is None else files.unionByName(found)
    if files is None:
        return []
    row = files.agg(
        F.count(F.lit(1)), F.sum("length"), F.max(F.unix_micros("modificationTime")),
        F.bit_xor(F.xxhash64("path", "length", "modificationTime")),
    ).first()
    return list(row)


def stored_result(spark: SparkSession, path: str, manifest: dict) -> tuple[DataFrame, str | None] | None:
    """The latest table stored at ``path`` for the manifest, and the note stored with it."""
    try:
        known = spark.read.schema(_MANIFEST).json(f"{path}/manifest")
        row = known.where(F.col("manifest") == json.dumps(manifest, sort_keys=True)).orderBy(F.desc("written")).first()
        return None if row is None else (spark.read.parquet(f"{path}/{row.version}"), row.note)
    except AnalysisException:  # nothing stored yet
        return None


def store_result(spark: SparkSession, path: str, table: DataFrame, manifest: dict, note: str | None = None) -> DataFrame:
    """Write a table to a fresh folder and only then add its line to the manifest, so that a job
    that dies in between leaves the earlier result valid and the new folder unused."""
    version = f"data-{uuid.uuid4().hex}"
    table.write.parquet(f"{path}/{version}")
    line = spark.createDataFrame([(json.dumps(manifest, sort_keys=True), version, note)], "manifest string, version string, note string")
    line.withColumn("written", F.current_timestamp()).write.mode("append").json(f"{path}/manifest")
    return spark.read.parquet(f"{path}/{version}")


def reuse_or_compute(spark: SparkSession, path: str, compute, manifest: dict, force: bool = False) -> DataFrame:
    """A stored result table is reused when present, not forced, and written for the same
    inputs and parameters (``manifest``); otherwise ``compute()`` is stored and read back."""
    found = None if force else stored_result(spark, path, manifest)
    return found[0] if found is not None else store_result(spark, path, compute(), manifest)


_OPEN, _ROW, _CLOSE = 0, 1, 2


def report_lines(summary: DataFrame, ttest: DataFrame, topics: DataFrame, dist: DataFrame, category_source: DataFrame) -> DataFrame:
    """The lines of the report's JSON document with their place in it (``part, step, a, b, text``).

    Every row of a result table is a line of its own inside the frame of its part, so a table
    with any number of rows (topics, where the question id is the category) is never one value.
    """
    def line(rows: DataFrame, part: int, step: int, text: Column, order: list[str]) -> DataFrame:
        keys = [*[F.col(f"`{c}`").cast("string") for c in order], F.lit(""), F.lit("")][:2]
        return rows.select(F.lit(part).alias("part"), F.lit(step).alias("step"), keys[0].alias("a"), keys[1].alias("b"), text.alias("text"))

    def as_json(rows: DataFrame, first: list[str]) -> Column:
        columns = first + [c for c in rows.columns if c not in first]
        return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})

    spark = summary.sparkSession
    one = spark.range(1)
    source = F.to_json(F.struct(F.first("prompt_category_source").alias("prompt_category_source")), {"ignoreNullFields": "false"})
    test = ttest.agg(F.first(F.struct(*ttest.columns), ignorenulls=True).alias("t")).select(
        F.coalesce(F.to_json("t", {"ignoreNullFields": "false"}), F.lit("null")).alias("t"))
    out = line(category_source.agg(source.alias("s")).select(F.expr("substring(s, 2, length(s) - 2)").alias("s")), 0, _OPEN, F.concat(F.lit("{"), F.col("s")), [])
    out = out.unionByName(line(test, 2, _OPEN, F.concat(F.lit(',"severity_bias_ttest":'), F.col("t")), []))
    tables = {1: ("metrics_summary", summary, ["model"]), 3: ("topic_bias_means", topics, ["model", "prompt_category"]),
              4: ("hitl_distribution", dist, ["model", "hitl_status"])}
    for part, (name, rows, first) in tables.items():
        out = out.unionByName(line(one, part, _OPEN, F.lit(f',"{name}":['), []))
        out = out.unionByName(line(rows, part, _ROW, as_json(rows, first), first))
        out = out.unionByName(line(one, part, _CLOSE, F.lit("]"), []))
    return out.unionByName(line(one, 5, _CLOSE, F.lit("}"), []))


def write_report_json(lines: DataFrame, path: str) -> None:
    """The report as one JSON document: its lines in order, streamed through one writer (a
    sort that may spill; no table is held)."""
    order = Window.partitionBy().orderBy("part", "step", F.col("a").asc_nulls_first(), F.col("b").asc_nulls_first())
    follows = (F.col("step") == _ROW) & (F.lag("step").over(order) == _ROW)
    text = F.concat(F.when(follows, F.lit(",")).otherwise(F.lit("")), F.col("text"))
    lines.select(text.alias("value")).write.mode("overwrite").text(path)
