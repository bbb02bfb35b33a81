"""Response alignment: typing, essay identity, prompt map join, category source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterkit.functions.parse import SCORES_TYPE, with_scores
from raterkit.session import cut_lineage

UNMAPPED_CATEGORY = "unknown"


def sample_map(samples: DataFrame) -> DataFrame:
    """One row per question id with the first non-empty category and question (first by ``row``).

    ``category`` falls back to ``prompt_category`` and ``question`` to ``prompt``
    (empty string falls through), rows without a question id are dropped.
    """
    cols = set(samples.columns)

    def pick(primary: str, fallback: str) -> F.Column:
        a = F.nullif(F.col(primary).cast("string"), F.lit("")) if primary in cols else F.lit(None).cast("string")
        b = F.col(fallback).cast("string") if fallback in cols else F.lit(None).cast("string")
        return F.coalesce(a, b)

    order = F.col("row") if "row" in cols else F.monotonically_increasing_id()
    s = samples.select(
        F.col("question_id").cast("string").alias("question_id"),
        pick("category", "prompt_category").alias("prompt_category"),
        pick("question", "prompt").alias("prompt_question"),
        order.alias("_order"),
    ).where(F.col("question_id").isNotNull() & (F.col("question_id") != ""))
    # the first row with a value, as a number per question (a hash aggregate); the few rows that these
    # numbers name are joined back, and ties among them go to the smaller value
    firsts = s.groupBy("question_id").agg(
        F.min(F.when(F.col("prompt_category").isNotNull(), F.col("_order"))).alias("_category_at"),
        F.min(F.when(F.col("prompt_question").isNotNull(), F.col("_order"))).alias("_question_at"),
    )

    def first_of(column: str, at: str) -> DataFrame:
        named = s.select("question_id", "_order", column).join(firsts.select("question_id", F.col(at).alias("_order")), ["question_id", "_order"])
        order = Window.partitionBy("question_id").orderBy(F.col(column).asc_nulls_last())
        return named.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("question_id", column)

    out = firsts.select("question_id").join(first_of("prompt_category", "_category_at"), "question_id", "left")
    return out.join(first_of("prompt_question", "_question_at"), "question_id", "left")


def essay_id(respondent: F.Column, question: F.Column, row: F.Column) -> F.Column:
    """``respondent|question|row``; a NULL component becomes '' (not the text 'None')."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (respondent, question, row)]
    return F.concat_ws("|", *parts)


def values_present(df: DataFrame, names: list[str]) -> set[str]:
    """Which of the named columns hold any value (one aggregate over those columns, one row back).

    With a declared schema every column exists; one without a value counts as absent."""
    own = [c for c in names if c in df.columns]
    if not own:
        return set()
    row = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in own]).first()
    return {c for c in own if row[c]}


def _mapped(responses: DataFrame, prompt_map: DataFrame) -> DataFrame:
    """Question ids of responses for which the map has a category."""
    ids = responses.select(F.col("question_id").cast("string").alias("question_id")).distinct()
    return ids.join(prompt_map.where(F.col("prompt_category").isNotNull()).select("question_id"), "question_id", "left_semi")


def has_category(rows: DataFrame, prompt_map: DataFrame) -> bool:
    """Whether the map has a category for any question of the rows."""
    return not _mapped(rows, prompt_map).isEmpty()


def _fallback(present: set[str]) -> str:
    return next((c for c in ("category", "topic") if c in present), "question_id")


def category_source(responses: DataFrame, prompt_map: DataFrame | None = None) -> DataFrame:
    """P10 provenance as a one-row table: which column supplies ``prompt_category``.

    Decided after the join with the map: a category of the responses' own or of the map for any
    response, else the first of category, topic and question id that has values."""
    present = values_present(responses, ["prompt_category", "category", "topic"])
    if "prompt_category" in present:
        return responses.sparkSession.range(1).select(F.lit("samples.category").alias("prompt_category_source"))
    if prompt_map is None:
        return responses.sparkSession.range(1).select(F.lit(_fallback(present)).alias("prompt_category_source"))
    found = _mapped(responses, prompt_map).agg(F.count(F.lit(1)).alias("n"))
    return found.select(
        F.when(F.col("n") > 0, F.lit("samples.category")).otherwise(F.lit(_fallback(present))).alias("prompt_category_source")
    )


def typed_responses(responses: DataFrame) -> DataFrame:
    """Scored responses with typed run and string ids; rows without a model are dropped."""
    df = responses.where(F.col("model").isNotNull())
    if "total_score" not in df.columns:
        if "parsed" not in df.columns:  # records without parsed scores fall back to the raw JSON
            df = df.withColumn("parsed", F.lit(None).cast(SCORES_TYPE))
        df = with_scores(df)
    return df.withColumns({
        "run": F.coalesce(F.col("run").cast("string").try_cast("double").try_cast("int"), F.lit(0)),
        "sample_row": F.col("sample_row").cast("string"),
        "respondent_id": F.col("respondent_id").cast("string"),
        "question_id": F.col("question_id").cast("string"),
    })


def align_inputs(responses: DataFrame, prompt_map: DataFrame | None = None, source: str | None = None,
                 defer_prompts: bool = False) -> DataFrame:
    """P9-P11 + J1 + R3/R4: typed, scored responses keyed by ``essay_id``.

    * rows without a model are dropped (a directory may hold model-less records);
    * ``run``: numeric, missing -> 0; ids as strings (integers print as '12');
    * left join with the prompt map on ``question_id`` (map columns lose on clashes, unless the
      responses' own column has no value);
    * ``prompt_category``: ``source`` names the column to use; ``None`` decides as the
      reference does (see ``category_source``; two small probes of ids and null flags);
    * ``prompt_question``: the responses' own, the map's, else their ``question`` or ``prompt``.

    ``defer_prompts=True`` (with ``source='samples.category'``): the prompt columns are not
    added per response; the analysis joins the question-grain prompt table onto the essays
    after aggregating (``Analysis(prompts=...)``), so long prompt texts are neither hashed nor
    carried per response. The values are the same.
    """
    identity = essay_id(F.col("respondent_id"), F.col("question_id"), F.col("sample_row"))
    if defer_prompts:
        df = typed_responses(responses).drop("prompt_category", "prompt_question")
        return df.withColumns({"essay_id": identity, "prompt_category_source": F.lit(source or "samples.category")})
    if prompt_map is not None:
        # written once, so that its size is known before the join: a map of few questions is broadcast, and
        # responses are not dealt out by question, of which there may be three
        prompt_map = cut_lineage(prompt_map, "prompts")
    kept = responses.where(F.col("model").isNotNull())
    optional = ["prompt_category", "category", "topic", "prompt_question", "question", "prompt"]
    if source is None:
        present = values_present(kept, optional)
        mapped = prompt_map is not None and "prompt_category" not in present and has_category(kept, prompt_map)
        source = "samples.category" if mapped or "prompt_category" in present else _fallback(present)
    else:
        present = {c for c in optional if c in responses.columns}
    df = typed_responses(kept).drop(*[c for c in optional if c not in present])
    if prompt_map is not None:
        new = [c for c in ("prompt_category", "prompt_question") if c not in present]
        df = df.join(prompt_map.select("question_id", *new), "question_id", "left")
    src_col = {"samples.category": "prompt_category"}.get(source, source)
    if src_col not in df.columns:
        src_col = "question_id"
    values = {
        "prompt_category": F.coalesce(F.col(src_col).cast("string"), F.lit(UNMAPPED_CATEGORY)),
        "essay_id": identity,
        "prompt_category_source": F.lit(source),
    }
    if "prompt_question" not in df.columns:
        pq = next((F.col(c) for c in ("question", "prompt") if c in present), F.lit(None))
        values["prompt_question"] = pq.cast("string")
    return df.withColumns(values)
