"""Incremental scoring with Structured Streaming (checkpointed evaluate-and-resume).

New sample files arriving in a folder are planned (samples x models x runs),
filtered against the responses already written by earlier epochs (J6
anti-join, reading only the partitions of the batch's questions), scored, and
written once to the responses checkpoint (partitioned by question and epoch),
from which the partitioned response folder (S7) is copied. The stream's own
checkpoint records which sample files were consumed, so a restarted job resumes
where it stopped; a retried epoch re-scores only its own requests and
overwrites exactly its own partitions, so nothing is duplicated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from raterkit.operators.scoring import Scorer, pending_plan, response_records, score
from raterkit.sources.jsonl import RESPONSE_SCHEMA, SAMPLE_GLOB, SAMPLE_SCHEMA, parse_jsonl_lines
from raterkit.sources.sinks import write_responses

_WITH_STEM = T.StructType(RESPONSE_SCHEMA.fields + [T.StructField(c, T.StringType(), True) for c in ("stem", "question_text")])


def _folder(question_id: F.Column) -> F.Column:
    """Folder value of a question id: NULL and the empty string share the default partition."""
    return F.nullif(question_id.cast("string"), F.lit(""))


def _completed(spark: SparkSession, checkpoint_dir: str, epoch_id: int, batch: DataFrame) -> DataFrame | None:
    """Responses written by earlier epochs for the questions of this micro-batch.

    The checkpoint is partitioned by question and epoch. Its schema is given, so ids keep their
    text ('007' stays '007'), and a semi-join with the batch's questions picks the partitions (a
    retried epoch must not skip its own requests).
    """
    try:
        lines = spark.read.schema("value string, question_dir string, batch long").text(checkpoint_dir)
        lines.isEmpty()
    except AnalysisException:  # nothing written yet
        return None
    wanted = batch.select(_folder(F.col("question_id")).alias("_q")).distinct()
    lines = lines.where(F.col("batch") != epoch_id)
    lines = lines.join(wanted, lines["question_dir"].eqNullSafe(wanted["_q"]), "left_semi")
    return parse_jsonl_lines(lines.select("value"), RESPONSE_SCHEMA)


def start_scoring_stream(
    spark: SparkSession,
    samples_dir: str,
    models: Sequence[str],
    out_dir: str,
    responses_checkpoint: str,
    stream_checkpoint: str,
    *,
    runs: int = 3,
    scorer: Scorer | None = None,
    scorer_factory: Callable[[], Scorer] | None = None,
    dry_run: bool = False,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes what is there and stops."""
    reader = spark.readStream.schema(SAMPLE_SCHEMA).option("pathGlobFilter", SAMPLE_GLOB)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    samples = reader.json(samples_dir).withColumn("row", F.col("row").try_cast("long"))

    def batch(df: DataFrame, epoch_id: int) -> None:
        bspark = df.sparkSession
        todo = pending_plan(df, models, runs, _completed(bspark, responses_checkpoint, epoch_id, df))
        records = response_records(score(todo, scorer, dry_run=dry_run, scorer_factory=scorer_factory))
        # Scorer output is written once, to this epoch's checkpoint partitions (dynamic
        # overwrite: a retried epoch replaces exactly them); the partitioned outputs are
        # copied from those files, so the scorer is never re-run for the second sink.
        (records.withColumn("question_dir", _folder(F.col("question_id"))).withColumn("batch", F.lit(epoch_id))
         .write.mode("overwrite").option("ignoreNullFields", "false").option("partitionOverwriteMode", "dynamic")
         .partitionBy("question_dir", "batch").json(responses_checkpoint))
        written = bspark.read.schema("value string, question_dir string, batch long").text(responses_checkpoint).where(F.col("batch") == epoch_id)
        written = parse_jsonl_lines(written.select("value"), _WITH_STEM)
        write_responses(written.withColumn("batch", F.lit(epoch_id)), out_dir, mode="overwrite",
                        extra_partitions=["batch"])

    writer = samples.writeStream.foreachBatch(batch).option("checkpointLocation", stream_checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
