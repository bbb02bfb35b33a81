"""Rater responses, samples and answer sheets derived from the driver's tables.

The reference consumes JSONL of model outputs; the test tables have none, so
these plans derive the same shapes from ``lineitem``, ``part``,
``documents``, ``pages``, ``orders`` and ``conversations`` with plain
integer/string arithmetic that DuckDB can restate exactly (see
``raterkit.plans.oracle``). Their work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterkit.functions.parse import with_parsed
from raterkit.plans.tables import table

# Model label is the return flag; each model adds its own offset to the task score.
MODEL_TASK_OFFSET = {"A": 0, "N": 1, "R": 2}
DEFECT_MODULUS = 17
UNSCORED_MODULUS = 97


def _s(c) -> F.Column:
    return c.cast("string")


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem = one (model, essay, run) rater output with a raw text.

    ``l_orderkey % 17`` picks a defect of the raw text: 0 null scores, 1 an error,
    2 reordered keys, 3 decimals, 4 prose with four digits, 5 fenced JSON; model A
    with ``l_partkey % 97 = 0`` always answers with null scores. Written as one SQL
    projection (a single call into the JVM).
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"
    )
    offset = " ".join(f"WHEN l_returnflag = '{m}' THEN {o}" for m, o in MODEL_TASK_OFFSET.items())
    scores = li.selectExpr(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag",
        "CAST(l_partkey % 8 AS STRING) AS g",
        "CAST((l_partkey * 3) % 7 + l_orderkey % 2 AS STRING) AS lx",
        "CAST(l_partkey % 5 + CASE WHEN l_partkey % 4 = 0 THEN l_suppkey % 4 ELSE 0 END AS STRING) AS c",
        f"CAST((l_linenumber + l_suppkey) % 2 + 1 + CASE {offset} ELSE 0 END AS STRING) AS t",
        f"CASE WHEN l_returnflag = 'A' AND l_partkey % {UNSCORED_MODULUS} = 0 THEN 0 "
        f"ELSE l_orderkey % {DEFECT_MODULUS} END AS defect",
    )
    raw = """CASE defect
        WHEN 0 THEN '{"grammar":null,"lexical":null,"coherence":null,"task":null}'
        WHEN 1 THEN 'ERROR: timeout'
        WHEN 2 THEN concat('{"task": ', t, ', "grammar": ', g, ', "lexical": ', lx, ', "coherence": ', c, '}')
        WHEN 3 THEN concat('{"grammar": ', g, '.0, "lexical": ', lx, '.0, "coherence": ', c, '.0, "task": ', t, '.0}')
        WHEN 4 THEN concat('Scores - grammar ', g, ', lexical ', lx, ', coherence ', c, ', task ', t, '.')
        WHEN 5 THEN concat('```json', char(10), '{"grammar":', g, ',"lexical":', lx, ',"coherence":', c,
                           ',"task":', t, '}', char(10), '```')
        ELSE concat('{"grammar": ', g, ', "lexical": ', lx, ', "coherence": ', c, ', "task": ', t, '}')
      END AS raw"""
    return scores.selectExpr(
        "l_orderkey", "l_linenumber", "l_returnflag AS model", "l_linenumber AS run", "l_partkey AS sample_row",
        "CAST(l_partkey % 3 AS STRING) AS question_id", "CAST(l_partkey AS STRING) AS respondent_id", raw,
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint-shaped records: raw text plus the ``parsed`` struct a scorer run stores."""
    return with_parsed(raw_responses(spark, sf_dir))


def part_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample records for the prompt map: one per part, question id ``p_partkey % 3``."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return p.select(
        _s(F.col("p_partkey") % 3).alias("question_id"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("question"),
        F.col("p_partkey").alias("row"),
    )


def document_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answer sheet: documents are text answers (question = source, type = lang);
    pages are audio answers (empty text, URL). Rows interleave: doc 2i+1, page 2i+2."""
    docs = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") * 2 + 1).alias("row"),
        F.col("text").alias("textResponse"),
        F.col("source").alias("questionText"),
        F.col("source").alias("questionId"),
        F.col("lang").alias("questionType"),
        _s(F.col("doc_id") % 101).alias("nim"),
        F.lit(None).cast("string").alias("audioResponseUrl"),
    )
    pages = table(spark, sf_dir, "pages").select(
        (F.col("page_id") * 2 + 2).alias("row"),
        F.lit(None).cast("string").alias("textResponse"),
        F.lit(None).cast("string").alias("questionText"),
        F.lit(None).cast("string").alias("questionId"),
        F.lit("audio").alias("questionType"),
        _s(F.col("page_id") % 101).alias("nim"),
        F.col("url").alias("audioResponseUrl"),
    )
    return docs.unionByName(pages)


def order_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer sheet from orders: question id = customer, type = order priority, answer = status."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return o.select(
        (F.col("o_orderkey") + 1).alias("row"),
        F.col("o_orderstatus").alias("textResponse"),
        _s(F.col("o_custkey")).alias("questionId"),
        F.col("o_orderpriority").alias("questionType"),
    )


def conversation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample records to score: each assistant turn answers the user turn before it."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    a = conv.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("response"))
    u = conv.where(F.col("role") == "user").select(
        F.col("conv_id"), (F.col("turn") + 1).alias("turn"), F.col("text").alias("question")
    )
    s = a.join(u, ["conv_id", "turn"], "left")
    return s.select(
        F.col("turn").alias("row"),
        _s(F.col("conv_id") % 3).alias("question_id"),
        _s(F.col("conv_id")).alias("respondent_id"),
        F.col("question"),
        F.col("response"),
    )
