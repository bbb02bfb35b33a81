"""JSON-lines sources: tolerant scan, response input resolution, sample map.

Schemas are declared (no inference pass). Ids and ``run`` are read as strings
and typed later with ``try_cast``, so a type mismatch in one field is not
mistaken for an undecodable line.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterkit.functions.parse import is_json_object
from raterkit.functions.text import path_safe_name
from raterkit.operators.align import sample_map
from raterkit.sources.sinks import committed_attempts, question_folder

CORRUPT = "_corrupt_record"
_WHOLE_OBJECT = r"(?s)^\s*\{.*\}\s*$"
_BRACE_WITHIN = r"\}\s*\S"
# what the parse of a line as an element of a list does not tell: a bracket after an object, a token in single quotes
_BRACKET_OR_QUOTE = r"\}\s*\]|[{\[,:]\s*'"
_JSON_SPACE = " \t\n\r"
_FEEDS = "\x0b\x0c"  # may follow the last brace, but are no white space of JSON
CHECKPOINT_NAME = "checkpoint.jsonl"
# response files: JSON lines as text, or as Spark's writer names them when it compresses (write_jsonl, write_checkpoint)
RESPONSE_GLOB = "{*.jsonl,*.json,part-*.json.gz}"
SAMPLE_GLOB = "question_*_samples.jsonl"
# sample files as the sampler names them, or as Spark's writer names them (write_samples)
SAMPLE_FILES_GLOB = "{question_*_samples.jsonl,part-*.json}"

SCORES = T.StructType([T.StructField(k, T.StringType(), True) for k in ("grammar", "lexical", "coherence", "task")])
RESPONSE_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), True),
    T.StructField("run", T.StringType(), True),
    T.StructField("sample_row", T.StringType(), True),
    T.StructField("question_id", T.StringType(), True),
    T.StructField("respondent_id", T.StringType(), True),
    T.StructField("response", T.StringType(), True),
    T.StructField("raw", T.StringType(), True),
    T.StructField("parsed", SCORES, True),
    # optional columns that name the prompt; one without any value counts as absent
    *[T.StructField(c, T.StringType(), True)
      for c in ("prompt_category", "category", "topic", "prompt_question", "question", "prompt")],
])
SAMPLE_SCHEMA = T.StructType([
    T.StructField("respondent_id", T.StringType(), True),
    T.StructField("question", T.StringType(), True),
    T.StructField("question_id", T.StringType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("prompt_category", T.StringType(), True),
    T.StructField("prompt", T.StringType(), True),
    T.StructField("response", T.StringType(), True),
    T.StructField("submitted_at", T.StringType(), True),
    T.StructField("source_file", T.StringType(), True),
    T.StructField("row", T.StringType(), True),
])


def parse_jsonl_lines(lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Keep the text lines that are one whole JSON object and expand them with ``schema``.

    Dropped: blank lines, broken JSON, text or another object after it, bare arrays or numbers. A line is
    parsed once, as the only element of a list, so that what follows its first object is read as
    well; only lines with a bracket after an object, or with single quotes, take a second look. The
    records come out of a generator, below which no later filter is pushed (it would parse again).
    Other columns of ``lines`` (file name, partition values) are kept.
    """
    v = F.col(value)
    listed = T.StructType([T.StructField("v", T.ArrayType(schema), True), T.StructField(CORRUPT, T.StringType(), True)])
    text = F.concat(F.lit('{"v":['), F.rtrim(v, F.lit(_JSON_SPACE + _FEEDS)), F.lit("]}"))
    parsed = lines.withColumn(
        "_r", F.from_json(text, listed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    )
    odd = ((v.contains("]") | v.contains("'")) & v.rlike(_BRACKET_OR_QUOTE)) | ~F.rtrim(v, F.lit(_JSON_SPACE)).endswith("}")
    # a line with a brace before its last may hold a second object
    alone = ~odd | ~v.rlike(_BRACE_WITHIN) | is_json_object(value)
    ok = v.rlike(_WHOLE_OBJECT) & F.col(f"_r.{CORRUPT}").isNull() & (F.size("_r.v") == 1) & alone
    others = [c for c in lines.columns if c != value]
    kept = parsed.select(*others, F.explode(F.when(ok, F.col("_r.v"))).alias("_record"))
    return kept.select(*[F.col(f"_record.`{f.name}`").alias(f.name) for f in schema.fields], *others)


def _lines(spark: SparkSession, path: str | list[str], recursive: bool = False, glob: str | None = None) -> DataFrame:
    """Text lines ``value`` with their ``_source_file``."""
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("_source_file"))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, *,
               recursive: bool = False, glob: str | None = None) -> DataFrame:
    """One JSON object per line (see ``parse_jsonl_lines``); adds ``_source_file``."""
    return parse_jsonl_lines(_lines(spark, path, recursive, glob), schema)


def _files(spark: SparkSession, path: str) -> DataFrame | None:
    """URIs of the files under ``path`` as the readers report them; None if there is no such path."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException:
        return None
    return found.select(F.col("_metadata.file_path").alias("_source_file"))  # names only, no content


_ATTEMPT = "/job=([^/]+)/attempt=([^/]+)/"


def uncommitted_attempts(spark: SparkSession, path: str) -> list[str]:
    """Attempts of ``sinks.append_responses`` under ``path`` that are not to be read: those of jobs that
    died, or lost a race. Found among file names; what comes back is one name for each of them."""
    files = _files(spark, path)
    if files is None:
        return []
    uri = F.col("_source_file")
    attempts = files.select(F.regexp_extract(uri, _ATTEMPT, 1).alias("job"), F.regexp_extract(uri, _ATTEMPT, 2).alias("attempt"))
    attempts = attempts.where("attempt <> ''").distinct().join(committed_attempts(spark, path), ["job", "attempt"], "left_anti")
    return [r.attempt for r in attempts.collect()]


def response_files(spark: SparkSession, path: str, checkpoint: str | None = None) -> DataFrame:
    """The files that ``read_responses`` takes records from: ``path, length, modified`` (microseconds; no content)."""
    reader = spark.read.format("binaryFile")
    if not path.endswith((".jsonl", ".json")):
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", RESPONSE_GLOB)
    found = reader.load(path).select("path", "length", F.unix_micros("modificationTime").alias("modified"))
    if path.endswith((".jsonl", ".json")):
        return found
    found = found.where(~F.col("path").endswith("/" + CHECKPOINT_NAME))
    left_out = uncommitted_attempts(spark, path)
    if left_out:
        found = found.where(~F.regexp_extract("path", _ATTEMPT, 2).isin(left_out))
    if checkpoint:
        try:
            own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(checkpoint).select("path")
            found = found.join(own, "path", "left_anti")
        except AnalysisException:  # no checkpoint yet
            pass
    return found


def _literal(path: str) -> str:
    """A path whose characters stand for themselves, not for a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def read_response_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Response records of the named files; rows without a model are dropped."""
    return read_jsonl(spark, [_literal(p) for p in paths], RESPONSE_SCHEMA).where(F.col("model").isNotNull())


MOST_FOLDERS = 10_000


def completed_requests(spark: SparkSession, checkpoint_dir: str, samples: DataFrame, models: list[str]) -> DataFrame | None:
    """Keys of the completed responses that can concern a job's requests: ``model, run, sample_row,
    respondent_id``; None if there is no checkpoint.

    The checkpoint lies in folders by question and model (``sinks.write_checkpoint``); those of other
    models and, up to ``MOST_FOLDERS`` questions, of other questions are not read. Beyond that many, a
    semi-join takes the questions. No text column leaves the scan.
    """
    try:
        lines = spark.read.schema("value string, question_dir string, model_dir string").text(checkpoint_dir)
    except AnalysisException:
        return None
    # files beside the folders (written before there were any) have neither value
    lines = lines.where(F.col("model_dir").isNull() | F.col("model_dir").isin([path_safe_name(m) for m in models]))
    wanted = samples.select(question_folder(F.col("question_id")).alias("_q")).distinct()
    some = [r._q for r in wanted.limit(MOST_FOLDERS + 1).collect()]
    if len(some) <= MOST_FOLDERS:
        lines = lines.where(F.col("question_dir").isNull() | F.col("question_dir").isin([q for q in some if q is not None]))
    else:
        beside = lines.where("question_dir is null")
        lines = lines.join(wanted, F.col("question_dir") == F.col("_q"), "left_semi").unionByName(beside)
    keys = T.StructType([f for f in RESPONSE_SCHEMA.fields if f.name in ("model", "run", "sample_row", "respondent_id")])
    return parse_jsonl_lines(lines.select("value"), keys)  # narrow before any shuffle by key


def read_responses(spark: SparkSession, path: str, checkpoint: str | None = None) -> DataFrame:
    """S3: response records from ``path``.

    * a path ending in ``.jsonl``/``.json`` is read as one file;
    * a folder: every ``*.jsonl``/``*.json``/``part-*.json.gz`` under it (recursively) except checkpoint files
      (by name, or every file under ``checkpoint`` when that folder is given) and of appends that
      were not completed (``sinks.append_responses``);
    * when that yields nothing, the checkpoint (``checkpoint`` or ``<path>/checkpoint.jsonl``);
    * ``FileNotFoundError`` when there are no records there either.

    Rows without a model are dropped (a folder may also hold samples or cleaned records).
    """
    has_model = F.col("model").isNotNull()
    if path.endswith((".jsonl", ".json")):
        df = read_jsonl(spark, path, RESPONSE_SCHEMA).where(has_model)
    else:
        lines = _lines(spark, path, recursive=True, glob=RESPONSE_GLOB)
        lines = lines.where(~F.col("_source_file").endswith("/" + CHECKPOINT_NAME))
        left_out = uncommitted_attempts(spark, path)
        if left_out:
            lines = lines.where(~F.regexp_extract("_source_file", _ATTEMPT, 2).isin(left_out))
        own = _files(spark, checkpoint) if checkpoint else None
        if own is not None:  # lines of other files are not parsed, and none is shuffled to find that out
            lines = lines.join(F.broadcast(own), "_source_file", "left_anti")
        df = parse_jsonl_lines(lines, RESPONSE_SCHEMA).where(has_model)
    if not df.isEmpty():
        return df
    ck_path = checkpoint or f"{path.rstrip('/')}/{CHECKPOINT_NAME}"
    try:
        df = read_jsonl(spark, ck_path, RESPONSE_SCHEMA, recursive=not ck_path.endswith(".jsonl")).where(has_model)
        empty = df.isEmpty()
    except AnalysisException:
        empty = True
    if empty:
        raise FileNotFoundError(f"no response records under {path} and none in a checkpoint")
    return df


def find_samples(spark: SparkSession, inputs: str) -> str | None:
    """The folder ``samples`` beside or in the input folder (beside or in a file's folder), if any."""
    base = inputs.rstrip("/")
    if base.endswith((".jsonl", ".json")):
        base = base.rsplit("/", 1)[0]
    parent = base.rsplit("/", 1)[0]
    for folder in (f"{parent}/samples", f"{base}/samples"):
        if _files(spark, folder) is not None:
            return folder
    return None


def read_samples(spark: SparkSession, samples_dir: str) -> DataFrame:
    """Sample records (``question_*_samples.jsonl`` files, or a ``write_samples`` folder)."""
    return read_jsonl(spark, samples_dir, SAMPLE_SCHEMA, recursive=True, glob=SAMPLE_FILES_GLOB)


def load_sample_mapping(spark: SparkSession, samples_dir: str) -> DataFrame:
    """question_id -> prompt_category, prompt_question from the sample files."""
    s = read_samples(spark, samples_dir).withColumn("row", F.col("row").try_cast("long"))
    return sample_map(s)
