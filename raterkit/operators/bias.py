"""Between-rater bias: paired essays, t-test, Bland-Altman, topic means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterkit.functions.stats import student_t_two_sided_p
from raterkit.functions.text import short_model_name

LOA_Z = 1.96
SIGNIFICANCE_LEVEL = 0.05


def ranked_models(essays: DataFrame, top: int | None = None) -> DataFrame:
    """Distinct models numbered by name (the first ``top`` only, when given). The distinct
    step reduces the input to one row per model before anything is ordered."""
    models = essays.select("model").distinct()
    if top is not None:
        models = models.orderBy("model").limit(top)
    return models.withColumn("model_rank", F.row_number().over(Window.orderBy("model")))


def model_pair(responses: DataFrame, first: int = 1, second: int = 2) -> tuple[str | None, str | None]:
    """Names of the models at two places of the alphabet, from any table with ``model`` (a partial
    aggregate; at most ``max(first, second)`` names come back). None where there is no such place."""
    rows = responses.select("model").where("model is not null").distinct().orderBy("model").limit(max(first, second)).collect()
    names = [r.model for r in rows] + [None] * max(first, second)
    return names[first - 1], names[second - 1]


def named_pairs(essays: DataFrame, names: tuple[str | None, str | None], dropna: bool = True) -> DataFrame:
    """J2 for two models by name: one ``groupBy(essay_id)`` with fixed-width buffers."""
    of = [F.col("model") == F.lit(n) for n in names]
    p = essays.where(of[0] | of[1]).groupBy("essay_id").agg(
        *[F.max(F.when(is_model, F.col("mean_total"))).alias(f"mean_{i}") for i, is_model in enumerate(of, 1)],
        *[F.max(is_model.cast("int")).alias(f"_has{i}") for i, is_model in enumerate(of, 1)],
    ).where("_has1 = 1 and _has2 = 1")
    if dropna:
        p = p.where("mean_1 is not null and mean_2 is not null")
    return p.select(
        "essay_id", F.lit(names[0]).cast("string").alias("model_1"), F.lit(names[1]).cast("string").alias("model_2"), "mean_1", "mean_2",
        ((F.col("mean_1") + F.col("mean_2")) / 2.0).alias("pair_mean"), (F.col("mean_1") - F.col("mean_2")).alias("diff"),
    )


def essay_pairs(essays: DataFrame, first: int = 1, second: int = 2, dropna: bool = True,
                names: tuple[str | None, str | None] | None = None) -> DataFrame:
    """J2 without a self-join: one ``groupBy(essay_id)`` picks the two models' essay means.

    Models ``first`` and ``second`` by name (default the first two, as the reference), or the
    two ``names`` themselves, which spares the essay table a second use.
    Columns: essay_id, model_1, model_2, mean_1, mean_2, pair_mean, diff.
    """
    if names is not None:
        return named_pairs(essays, names, dropna)
    r = ranked_models(essays, top=max(first, second)).where(F.col("model_rank").isin(first, second))
    # the two model names travel as grouping keys (constant), keeping the per-essay
    # aggregate free of string buffers (a hash aggregate)
    everything = Window.partitionBy()
    r = r.select(
        "model", "model_rank",
        F.max(F.when(F.col("model_rank") == first, F.col("model"))).over(everything).alias("model_1"),
        F.max(F.when(F.col("model_rank") == second, F.col("model"))).over(everything).alias("model_2"),
    )
    e = essays.select("model", "essay_id", "mean_total").join(r, "model")
    is1, is2 = F.col("model_rank") == first, F.col("model_rank") == second
    p = e.groupBy("essay_id", "model_1", "model_2").agg(
        F.max(F.when(is1, F.col("mean_total"))).alias("mean_1"),
        F.max(F.when(is2, F.col("mean_total"))).alias("mean_2"),
        F.max(is1.cast("int")).alias("_has1"),
        F.max(is2.cast("int")).alias("_has2"),
    ).where((F.col("_has1") == 1) & (F.col("_has2") == 1))
    if dropna:
        p = p.where(F.col("mean_1").isNotNull() & F.col("mean_2").isNotNull())
    return p.select(
        "essay_id", "model_1", "model_2", "mean_1", "mean_2",
        ((F.col("mean_1") + F.col("mean_2")) / 2.0).alias("pair_mean"),
        (F.col("mean_1") - F.col("mean_2")).alias("diff"),
    )


def all_pairs(essays: DataFrame) -> DataFrame:
    """J2 for every pair of models in one pass: ``model_1, model_2`` (in order of name) and ``diff``, a row
    per essay that both have a mean for.

    One exchange on the essay id brings the essay's vector of model means together (a row per model); its
    pairs are made there and go into the partial sums of the pair, so they are not shuffled.
    """
    scored = essays.where("mean_total is not null and model is not null")
    means = scored.groupBy("essay_id").agg(F.array_sort(F.collect_list(F.struct("model", "mean_total"))).alias("m"))
    later = lambda x, i: F.transform(
        F.slice(F.col("m"), i + 2, F.size("m")),
        lambda y: F.struct(x["model"].alias("model_1"), y["model"].alias("model_2"), (x["mean_total"] - y["mean_total"]).alias("diff"),
                           ((x["mean_total"] + y["mean_total"]) / 2.0).alias("pair_mean")),
    )
    pairs = means.where(F.size("m") >= 2).select("essay_id", F.explode(F.flatten(F.transform("m", later))).alias("p"))
    return pairs.select("essay_id", "p.*")


def pair_moments(pairs: DataFrame) -> DataFrame:
    """Per pair of models: ``n_pairs, mean_diff, sd_diff`` and whether all differences are equal."""
    return pairs.groupBy("model_1", "model_2").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg("diff").alias("mean_diff"),
        F.stddev_samp("diff").alias("sd_diff"),
        (F.min("diff") == F.max("diff")).alias("degenerate"),
    )


def ttest_of(moments: DataFrame) -> DataFrame:
    """M2 from the moments of pairs: t = 0, p = 1 and ``degenerate`` where all differences are equal."""
    t = F.col("mean_diff") / (F.col("sd_diff") / F.sqrt(F.col("n_pairs").cast("double")))
    tstat = F.when(F.col("degenerate"), F.lit(0.0)).otherwise(t)
    p = F.when(F.col("degenerate"), F.lit(1.0)).otherwise(student_t_two_sided_p(t, (F.col("n_pairs") - 1).cast("double")))
    return moments.select("model_1", "model_2", tstat.alias("tstat"), p.alias("pvalue"), "n_pairs", "degenerate")


def limits_of(moments: DataFrame, z: float = LOA_Z) -> DataFrame:
    """M3 from the moments of pairs."""
    mean, sd = F.col("mean_diff"), F.col("sd_diff")
    return moments.select("model_1", "model_2", "n_pairs", mean.alias("bias"), "sd_diff", (mean - z * sd).alias("loa_lower"), (mean + z * sd).alias("loa_upper"))


def severity_ttest_all(essays: DataFrame) -> DataFrame:
    """M2 for every pair of models that share an essay."""
    return ttest_of(pair_moments(all_pairs(essays)))


def bland_altman_all(essays: DataFrame, z: float = LOA_Z) -> DataFrame:
    """M3 for every pair of models that share an essay."""
    return limits_of(pair_moments(all_pairs(essays)), z)


def severity_ttest(essays: DataFrame, first: int = 1, second: int = 2, names: tuple[str | None, str | None] | None = None) -> DataFrame:
    """M2: paired t-test of essay means, model 1 minus model 2.

    No row when fewer than two models or no complete pair. When all differences are
    equal (incl. one pair) t = 0, p = 1 and ``degenerate`` is true.
    """
    return ttest_of(pair_moments(essay_pairs(essays, first, second, names=names)))


def significance(ttest: DataFrame, level: float = SIGNIFICANCE_LEVEL) -> DataFrame:
    """M5: verdict of the t-test; direction of model 1 relative to model 2."""
    sig = F.col("pvalue") < level
    return ttest.select(
        "model_1", "model_2", "tstat", "pvalue", "n_pairs",
        sig.alias("significant"),
        F.when(~sig, F.lit("none")).when(F.col("tstat") < 0, F.lit("lower")).otherwise(F.lit("higher")).alias("direction"),
        short_model_name(F.col("model_1")).alias("model_1_short"),
        short_model_name(F.col("model_2")).alias("model_2_short"),
    )


def bland_altman(essays: DataFrame, first: int = 1, second: int = 2, z: float = LOA_Z,
                 names: tuple[str | None, str | None] | None = None) -> DataFrame:
    """M3: bias = mean difference, limits = bias -/+ z * sample sd, over complete pairs."""
    return limits_of(pair_moments(essay_pairs(essays, first, second, names=names)), z)


def topic_means(essays: DataFrame) -> DataFrame:
    """A4: mean of essay means per (model, prompt category)."""
    return essays.groupBy("model", "prompt_category").agg(F.avg("mean_total").alias("topic_mean"))


def topic_delta(topics: DataFrame) -> DataFrame:
    """Topic mean minus the unweighted mean of that model's topic means
    (window over the small model x category table)."""
    avg_topic = F.avg("topic_mean").over(Window.partitionBy("model"))
    return topics.select(
        "model", "prompt_category", "topic_mean",
        (F.col("topic_mean") - avg_topic).alias("delta_vs_topic_avg"),
    )


def topic_matrix(topics: DataFrame, categories: list[str]) -> DataFrame:
    """Topic means with one column per category that the caller names (``topic_means`` is
    the long form for any number of categories)."""
    return topics.groupBy("model").pivot("prompt_category", categories).agg(F.first("topic_mean"))


def topic_range(deltas: DataFrame) -> DataFrame:
    """A10: colour-scale bounds of the raw and delta matrices, widened by 1 when equal."""
    agg = deltas.agg(
        F.min("topic_mean").alias("zmin"), F.max("topic_mean").alias("zmax"),
        F.min("delta_vs_topic_avg").alias("dmin"), F.max("delta_vs_topic_avg").alias("dmax"),
    )
    zmin = F.coalesce(F.col("zmin"), F.lit(0.0))
    zmax = F.coalesce(F.col("zmax"), F.lit(1.0))
    dmin = F.coalesce(F.col("dmin"), F.lit(-1.0))
    dmax = F.coalesce(F.col("dmax"), F.lit(1.0))
    return agg.select(
        zmin.alias("zmin"), F.when(zmin == zmax, zmax + 1.0).otherwise(zmax).alias("zmax"),
        dmin.alias("dmin"), F.when(dmin == dmax, dmax + 1.0).otherwise(dmax).alias("dmax"),
    )


def category_question_list(essays: DataFrame) -> DataFrame:
    """A5 in long form: the distinct (category, question) pairs, one row each."""
    return (
        essays.where(F.col("prompt_category").isNotNull() & F.col("prompt_question").isNotNull())
        .select("prompt_category", "prompt_question")
        .distinct()
    )


def category_questions(essays: DataFrame) -> DataFrame:
    """A5: per category the sorted distinct prompt questions joined by newlines.

    The text of a category is one value, so this suits categories with a bounded number of
    questions (a report's); ``category_question_list`` is the form for any number.
    """
    return category_question_list(essays).groupBy("prompt_category").agg(
        F.array_join(F.array_sort(F.collect_list("prompt_question")), "\n").alias("questions")
    )
