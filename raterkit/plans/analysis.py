"""The analysis stage as one Spark plan: responses -> aligned -> essays -> every result table.

``Analysis`` builds each table lazily from the aligned responses; nothing is
collected. ``materialize`` writes the responses' cells (``operators.cells``: one mergeable
row per model, essay and run) once under the session's checkpoint folder, in buckets by
essay, so the result branches (essays, ICC, routing, bias) read them without another
exchange instead of re-parsing the raw responses; ``persist_essays`` writes the essay table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterkit.functions.parse import is_error
from raterkit.operators import bias, cells, icc, metrics
from raterkit.operators.align import align_inputs, category_source, sample_map
from raterkit.plans import responses as rsp
from raterkit.session import cut_bucketed, cut_lineage


# Columns every result table needs; the raw and response texts are dropped before the cut.
NARROW_COLUMNS = [
    "model", "essay_id", "run", "total_score", "respondent_id", "question_id", "sample_row",
    "prompt_category", "prompt_question", "is_error", "prompt_category_source",
]


@dataclass
class Analysis:
    """Result tables of the analysis stage, built lazily from aligned responses.

    ``aligned``: output of ``align_inputs``; ``prompts``: optional question-grain prompt
    table joined onto the essays after aggregation; thresholds and the unscored-essay
    policy parameterise the routing. Call ``materialize()`` before reading several tables.
    """

    aligned: DataFrame
    cv_threshold: float = metrics.CV_THRESHOLD
    range_threshold: float = metrics.RANGE_THRESHOLD
    unscored: str = "approve"
    prompts: DataFrame | None = None  # question-grain prompt table, joined after aggregation
    cells: DataFrame | None = None  # written by ``materialize``, or given
    _essays: DataFrame | None = field(default=None, repr=False)

    def essay_table(self, dedupe_runs: bool = False) -> DataFrame:
        """A1 with the prompt columns (attached at essay grain when ``prompts`` is set)."""
        if self.cells is None or dedupe_runs or self._carries_prompts:
            essays = metrics.essay_metrics(self.aligned, dedupe_runs=dedupe_runs)
        else:
            essays = cells.scores_of_cells(self.cells)
        if self.prompts is not None:
            essays = metrics.attach_prompts(essays, self.prompts)
        return essays

    @property
    def essays(self) -> DataFrame:
        if self._essays is None:
            self._essays = self.essay_table()
        return self._essays

    def persist_essays(self) -> "Analysis":
        self._essays = cut_lineage(self.essays, "essays")
        return self

    @property
    def _carries_prompts(self) -> bool:
        """Whether the responses have prompt columns of their own, which cells do not hold."""
        return "prompt_category" in self.aligned.columns

    def materialize(self) -> "Analysis":
        """Write the responses' cells once (reliable, shared storage); the result tables read them
        instead of re-scanning and re-parsing the raw responses. Responses with prompt columns of
        their own are first written as a narrow table, from which those columns are read."""
        if self._carries_prompts:
            self.aligned = cut_lineage(self.aligned.select(*[c for c in NARROW_COLUMNS if c in self.aligned.columns]), "aligned")
        self.cells = cut_bucketed(cells.cells_of(self.aligned), cells.KEYS, "cells")
        self._essays = None
        return self

    @property
    def scores(self) -> DataFrame:
        """The essay table without ids and prompts: all that model-grain results need."""
        if self._essays is not None:
            return self._essays
        return metrics.essay_scores(self.aligned) if self.cells is None else cells.scores_of_cells(self.cells, ids=False)

    @property
    def routed(self) -> DataFrame:
        return metrics.apply_hitl(self.essays, self.cv_threshold, self.range_threshold, self.unscored)

    @property
    def routed_scores(self) -> DataFrame:
        return metrics.apply_hitl(self.scores, self.cv_threshold, self.range_threshold, self.unscored)

    @property
    def distribution(self) -> DataFrame:
        return metrics.hitl_distribution(self.routed_scores)

    def pair_names(self, first: int = 1, second: int = 2) -> tuple[str | None, str | None]:
        return bias.model_pair(self.aligned if self.cells is None else self.cells, first, second)

    @property
    def icc(self) -> DataFrame:
        return icc.icc_by_model(self.aligned) if self.cells is None else icc.icc_of_runs(cells.runs_of_cells(self.cells))

    @property
    def summary(self) -> DataFrame:
        return metrics.model_summary(self.routed_scores, self.icc)

    @property
    def ttest(self) -> DataFrame:
        return bias.severity_ttest(self.scores, names=self.pair_names())

    @property
    def bland_altman(self) -> DataFrame:
        return bias.bland_altman(self.scores, names=self.pair_names())

    @property
    def topics(self) -> DataFrame:
        return bias.topic_means(self.essays)

    @property
    def category_source(self) -> DataFrame:
        """P10 provenance (one row): decided from the responses and the prompt map."""
        if self.prompts is not None:
            return category_source(self.aligned, self.prompts)
        return self.aligned.select("prompt_category_source").limit(1)


def testdata_analysis(spark: SparkSession, sf_dir: str, **kwargs) -> Analysis:
    """Analysis over responses derived from ``lineitem`` with the prompt map from ``part``."""
    aligned = align_inputs(
        rsp.responses(spark, sf_dir), None, source="samples.category", defer_prompts=True,
    ).withColumn("is_error", is_error(F.col("raw")))
    return Analysis(aligned, prompts=sample_map(rsp.part_samples(spark, sf_dir)), **kwargs)
