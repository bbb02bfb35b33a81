"""Cells of response files, kept between runs: a new file adds its own and nothing else is read.

A store holds generations. Each is the cells (``operators.cells``) of the files that were new when it
was made, with a list of these files, and counts from the moment its line stands in the commit log,
which is written last. As cells are mergeable, the state of all files is the union of the
generations. A file that is gone or has changed (size or time) cannot be taken out of them: then a new
epoch begins, and everything is read once more. A run that dies leaves a generation without a
line, which nothing reads.

Prompt columns of the responses' own are not part of cells; the log says which of them had values.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from raterkit.operators.align import align_inputs
from raterkit.operators.cells import cells_of
from raterkit.sources.jsonl import read_response_files, response_files

OPTIONAL = ["prompt_category", "category", "topic", "prompt_question", "question", "prompt"]
_LOG = "epoch string, generation string, present array<string>, written timestamp"
_FILES = "path string, length long, modified long"


@dataclass
class StoredCells:
    """The cells of all files; the optional columns with values; how many files this run has read."""

    cells: DataFrame
    present: set[str]
    files_read: int


def _log(spark: SparkSession, store: str) -> list:
    """Lines of the newest epoch, one per generation."""
    try:
        lines = spark.read.schema(_LOG).json(f"{store}/log").collect()
    except AnalysisException:  # a new store
        return []
    newest = max(lines, key=lambda r: r.written).epoch if lines else None
    return [r for r in lines if r.epoch == newest]


def _of(spark: SparkSession, store: str, kind: str, log: list) -> DataFrame:
    return spark.read.parquet(*[f"{store}/{kind}/{r.generation}" for r in log])


def stored_cells(spark: SparkSession, store: str, inputs: str, checkpoint: str | None = None, force: bool = False) -> StoredCells | None:
    """The cells of the response files under ``inputs``, reading only files that the store does not hold.

    ``force`` starts anew. None where there is no response (``read_responses`` then says so or falls
    back to the checkpoint's own folder).
    """
    files = response_files(spark, inputs, checkpoint)
    log = [] if force else _log(spark, store)
    identity = ["path", "length", "modified"]
    if log:
        known = _of(spark, store, "files", log)
        if not known.join(files, identity, "left_anti").isEmpty():
            log = []
        else:
            files = files.join(known, identity, "left_anti")
    epoch = log[0].epoch if log else uuid.uuid4().hex
    new = files.collect()  # names, as Spark's own listing holds them
    if new:
        # which optional columns have values is observed as the cells are made: the files are parsed once
        seen = Observation()
        responses = read_response_files(spark, [r.path for r in new])
        responses = responses.observe(seen, *[F.max(F.col(c).isNotNull()).alias(c) for c in OPTIONAL])
        aligned = align_inputs(responses, None, source="samples.category", defer_prompts=True)
        generation = uuid.uuid4().hex
        cells_of(aligned).write.parquet(f"{store}/cells/{generation}")
        present = sorted(c for c in OPTIONAL if seen.get[c])
        spark.createDataFrame([tuple(r) for r in new], _FILES).write.parquet(f"{store}/files/{generation}")
        line = spark.createDataFrame([(epoch, generation, present)], "epoch string, generation string, present array<string>")
        line.withColumn("written", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{store}/log")
        log = _log(spark, store)
    if not log:
        return None
    cells = _of(spark, store, "cells", log)
    if cells.isEmpty():
        return None
    return StoredCells(cells, {c for r in log for c in r.present or []}, len(new))
