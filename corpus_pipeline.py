"""Corpus pipeline: language ID, line dedup, near-duplicate documents, personal data, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's input. All stages but
the last return the columns of ``documents``; the last returns the pieces of the packed
sequences. ``ORACLE_SQL`` is None: language ID, the personal-data field and the tokenizer are
not expressible in SQL (tests compare the stages with brute force instead).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from raterkit.llm.language_id import language_stage
from raterkit.llm.line_dedup import line_stage
from raterkit.llm.lsh_forest import near_stage
from raterkit.llm.packing import packing_stage
from raterkit.llm.pii_crf import pii_stage
from raterkit.llm.tables import table
from raterkit.session import cut_lineage

STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_stage),
    ("personal_data", pii_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
