"""DuckDB SQL restating each registered query (the correctness oracle).

The SQL is written independently of the Spark plans from the same definitions;
it runs on the driver's tables registered as views. Shared CTEs are composed
as text so every statement is a plain SQL string. Doubles are rounded to 9
places on both sides, as in ``raterkit.plans.queries``.
"""

from __future__ import annotations

D = 9  # rounding digits for doubles

STRICT_RE = r'\{\s*"grammar"\s*:\s*(\d+),\s*"lexical"\s*:\s*(\d+),\s*"coherence"\s*:\s*(\d+),\s*"task"\s*:\s*(\d+)\s*\}'
DIGIT_RE = r"\b([0-9])\b"
WHOLE_OBJECT_RE = r"^\s*\{[\s\S]*\}\s*$"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _v(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


RAW = f"""
li AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS model,
         l_partkey % 8 AS g,
         (l_partkey * 3) % 7 + l_orderkey % 2 AS lx,
         l_partkey % 5 + CASE WHEN l_partkey % 4 = 0 THEN l_suppkey % 4 ELSE 0 END AS c,
         (l_linenumber + l_suppkey) % 2 + 1
           + CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS t,
         CASE WHEN l_returnflag = 'A' AND l_partkey % 97 = 0 THEN 0 ELSE l_orderkey % 17 END AS defect
  FROM lineitem
),
raw AS (
  SELECT l_orderkey, l_linenumber, model, l_linenumber AS run, l_partkey AS sample_row,
         {_v('l_partkey % 3')} AS question_id, {_v('l_partkey')} AS respondent_id,
         CASE defect
           WHEN 0 THEN '{{"grammar":null,"lexical":null,"coherence":null,"task":null}}'
           WHEN 1 THEN 'ERROR: timeout'
           WHEN 2 THEN '{{"task": ' || {_v('t')} || ', "grammar": ' || {_v('g')} || ', "lexical": ' || {_v('lx')}
                       || ', "coherence": ' || {_v('c')} || '}}'
           WHEN 3 THEN '{{"grammar": ' || {_v('g')} || '.0, "lexical": ' || {_v('lx')} || '.0, "coherence": '
                       || {_v('c')} || '.0, "task": ' || {_v('t')} || '.0}}'
           WHEN 4 THEN 'Scores - grammar ' || {_v('g')} || ', lexical ' || {_v('lx')} || ', coherence '
                       || {_v('c')} || ', task ' || {_v('t')} || '.'
           WHEN 5 THEN '```json' || chr(10) || '{{"grammar":' || {_v('g')} || ',"lexical":' || {_v('lx')}
                       || ',"coherence":' || {_v('c')} || ',"task":' || {_v('t')} || '}}' || chr(10) || '```'
           ELSE '{{"grammar": ' || {_v('g')} || ', "lexical": ' || {_v('lx')} || ', "coherence": ' || {_v('c')}
                || ', "task": ' || {_v('t')} || '}}'
         END AS raw
  FROM li
),
parsed AS (
  SELECT *,
         regexp_matches(raw, {_q(STRICT_RE)}) AS sm,
         regexp_extract_all(raw, {_q(DIGIT_RE)}, 1) AS dg
  FROM raw
),
parsed2 AS (
  SELECT *,
         (sm OR len(dg) >= 4) AS has_parsed,
         CASE WHEN sm THEN TRY_CAST(regexp_extract(raw, {_q(STRICT_RE)}, 1) AS BIGINT)
              WHEN len(dg) >= 4 THEN TRY_CAST(dg[1] AS BIGINT) END AS p_grammar,
         CASE WHEN sm THEN TRY_CAST(regexp_extract(raw, {_q(STRICT_RE)}, 2) AS BIGINT)
              WHEN len(dg) >= 4 THEN TRY_CAST(dg[2] AS BIGINT) END AS p_lexical,
         CASE WHEN sm THEN TRY_CAST(regexp_extract(raw, {_q(STRICT_RE)}, 3) AS BIGINT)
              WHEN len(dg) >= 4 THEN TRY_CAST(dg[3] AS BIGINT) END AS p_coherence,
         CASE WHEN sm THEN TRY_CAST(regexp_extract(raw, {_q(STRICT_RE)}, 4) AS BIGINT)
              WHEN len(dg) >= 4 THEN TRY_CAST(dg[4] AS BIGINT) END AS p_task,
         (regexp_matches(raw, {_q(WHOLE_OBJECT_RE)}) AND json_valid(raw)) AS whole_json
  FROM parsed
),
scored AS (
  SELECT *,
         CASE WHEN has_parsed THEN CAST(p_grammar AS DOUBLE)
              WHEN whole_json THEN TRY_CAST(json_extract_string(raw, '$.grammar') AS DOUBLE) END AS grammar,
         CASE WHEN has_parsed THEN CAST(p_lexical AS DOUBLE)
              WHEN whole_json THEN TRY_CAST(json_extract_string(raw, '$.lexical') AS DOUBLE) END AS lexical,
         CASE WHEN has_parsed THEN CAST(p_coherence AS DOUBLE)
              WHEN whole_json THEN TRY_CAST(json_extract_string(raw, '$.coherence') AS DOUBLE) END AS coherence,
         CASE WHEN has_parsed THEN CAST(p_task AS DOUBLE)
              WHEN whole_json THEN TRY_CAST(json_extract_string(raw, '$.task') AS DOUBLE) END AS task
  FROM parsed2
),
totals AS (
  SELECT *, grammar + lexical + coherence + task AS total_score FROM scored
),
pmap AS (
  SELECT question_id,
         arg_min(prompt_category, rw) FILTER (WHERE prompt_category IS NOT NULL) AS prompt_category,
         arg_min(prompt_question, rw) FILTER (WHERE prompt_question IS NOT NULL) AS prompt_question
  FROM (SELECT {_v('p_partkey % 3')} AS question_id, COALESCE(NULLIF(p_type, ''), NULL) AS prompt_category,
               COALESCE(NULLIF(p_name, ''), NULL) AS prompt_question, p_partkey AS rw FROM part) s
  WHERE question_id IS NOT NULL AND question_id <> ''
  GROUP BY question_id
),
aligned AS (
  SELECT t.*, COALESCE(m.prompt_category, 'unknown') AS prompt_category, m.prompt_question,
         {_v('t.sample_row')} AS sample_row_s,
         COALESCE(t.respondent_id, '') || '|' || COALESCE(t.question_id, '') || '|'
           || COALESCE({_v('t.sample_row')}, '') AS essay_id
  FROM totals t LEFT JOIN pmap m ON t.question_id = m.question_id
  WHERE t.model IS NOT NULL
),
essays AS (
  SELECT model, essay_id,
         min(respondent_id) AS respondent_id, min(question_id) AS question_id, min(sample_row_s) AS sample_row,
         min(prompt_category) AS prompt_category, min(prompt_question) AS prompt_question,
         avg(total_score) AS mean_total,
         COALESCE(stddev_samp(total_score), 0.0) AS sd_total,
         min(total_score) AS min_total, max(total_score) AS max_total,
         count(total_score) AS n_runs,
         COALESCE(max(total_score) - min(total_score), 0.0) AS range_total
  FROM aligned GROUP BY model, essay_id
),
essays2 AS (
  SELECT *, CASE WHEN mean_total IS NULL OR mean_total = 0 THEN 0.0 ELSE sd_total / mean_total END AS cv_total
  FROM essays
),
routed AS (
  SELECT *, CASE WHEN round(cv_total, 12) < 0.15 AND range_total <= 2.0 THEN 'Auto-Approve'
                 ELSE 'Flagged for Review' END AS hitl_status
  FROM essays2
),
dist AS (
  SELECT model, hitl_status, count(*) AS count,
         count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY model) AS pct
  FROM routed GROUP BY model, hitl_status
),
xr AS (
  SELECT model, essay_id, run, avg(total_score) AS x
  FROM aligned WHERE total_score IS NOT NULL GROUP BY model, essay_id, run
),
kr AS (SELECT model, count(DISTINCT run) AS k FROM xr GROUP BY model),
xe AS (
  SELECT xr.*, kr.k,
         count(*) OVER (PARTITION BY xr.model, essay_id) AS n_e,
         avg(x) OVER (PARTITION BY xr.model, essay_id) AS m_e
  FROM xr JOIN kr ON xr.model = kr.model
),
bal AS (SELECT * FROM xe WHERE n_e = k),
rmeans AS (SELECT model, run, avg(x) AS m_r FROM bal GROUP BY model, run),
gmeans AS (SELECT model, avg(x) AS g FROM bal GROUP BY model),
ss AS (
  SELECT b.model, sum((b.m_e - gm.g) * (b.m_e - gm.g)) AS ssb,
         sum((b.x - b.m_e - rm.m_r + gm.g) * (b.x - b.m_e - rm.m_r + gm.g)) AS sse,
         count(*) AS cells, min(b.k) AS k
  FROM bal b JOIN rmeans rm ON b.model = rm.model AND b.run = rm.run JOIN gmeans gm ON b.model = gm.model
  GROUP BY b.model
),
iccv AS (
  SELECT model,
         CASE WHEN k >= 2 AND cells / k >= 2
                   AND (ssb / (cells / k - 1.0)) + (k - 1.0) * (sse / ((cells / k - 1.0) * (k - 1.0))) <> 0
              THEN ((ssb / (cells / k - 1.0)) - (sse / ((cells / k - 1.0) * (k - 1.0))))
                   / ((ssb / (cells / k - 1.0)) + (k - 1.0) * (sse / ((cells / k - 1.0) * (k - 1.0)))) END AS icc_total
  FROM (SELECT model, ssb, sse, CAST(cells AS DOUBLE) AS cells, CAST(k AS DOUBLE) AS k FROM ss) s
),
icc_counts AS (
  SELECT model, CAST(count(DISTINCT essay_id) AS BIGINT) AS icc_n_essays_total,
         CAST(count(DISTINCT CASE WHEN n_e = k THEN essay_id END) AS BIGINT) AS icc_n_essays_balanced,
         CAST(min(k) AS BIGINT) AS icc_n_raters
  FROM xe GROUP BY model
),
icc AS (
  SELECT m.model, iccv.icc_total,
         COALESCE(c.icc_n_essays_total, 0) AS icc_n_essays_total,
         COALESCE(c.icc_n_essays_balanced, 0) AS icc_n_essays_balanced,
         COALESCE(c.icc_n_raters, 0) AS icc_n_raters
  FROM (SELECT DISTINCT model FROM aligned) m
  LEFT JOIN icc_counts c ON m.model = c.model LEFT JOIN iccv ON m.model = iccv.model
),
summary AS (
  SELECT s.*, i.icc_total, i.icc_n_essays_total, i.icc_n_essays_balanced, i.icc_n_raters,
         p."auto-approve", p.flagged_for_review
  FROM (SELECT model, count(essay_id) AS n_essays, avg(mean_total) AS mean_total, stddev_samp(mean_total) AS sd_total,
               avg(sd_total) AS mean_sd, avg(range_total) AS mean_range, avg(cv_total) AS mean_cv
        FROM routed GROUP BY model) s
  LEFT JOIN icc i ON s.model = i.model
  LEFT JOIN (SELECT model, max(CASE WHEN hitl_status = 'Auto-Approve' THEN pct END) AS "auto-approve",
                    max(CASE WHEN hitl_status = 'Flagged for Review' THEN pct END) AS flagged_for_review
             FROM dist GROUP BY model) p ON s.model = p.model
),
mrank AS (SELECT model, row_number() OVER (ORDER BY model) AS model_rank FROM (SELECT DISTINCT model FROM essays2) d),
pairs AS (
  SELECT e.essay_id,
         max(CASE WHEN r.model_rank = 1 THEN e.model END) AS model_1,
         max(CASE WHEN r.model_rank = 2 THEN e.model END) AS model_2,
         max(CASE WHEN r.model_rank = 1 THEN e.mean_total END) AS mean_1,
         max(CASE WHEN r.model_rank = 2 THEN e.mean_total END) AS mean_2
  FROM essays2 e JOIN mrank r ON e.model = r.model
  WHERE r.model_rank IN (1, 2)
  GROUP BY e.essay_id
  HAVING max(CASE WHEN r.model_rank = 1 THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN r.model_rank = 2 THEN 1 ELSE 0 END) = 1
),
pairs2 AS (
  SELECT *, (mean_1 + mean_2) / 2.0 AS pair_mean, mean_1 - mean_2 AS diff
  FROM pairs WHERE mean_1 IS NOT NULL AND mean_2 IS NOT NULL
),
ttest AS (
  SELECT model_1, model_2, count(*) AS n_pairs, avg(diff) AS mean_diff, stddev_samp(diff) AS sd_diff,
         (min(diff) = max(diff)) AS degenerate
  FROM pairs2 GROUP BY model_1, model_2
),
ttest2 AS (
  SELECT model_1, model_2,
         CASE WHEN degenerate THEN 0.0 ELSE mean_diff / (sd_diff / sqrt(CAST(n_pairs AS DOUBLE))) END AS tstat,
         n_pairs, degenerate
  FROM ttest
),
topics AS (
  SELECT model, prompt_category, avg(mean_total) AS topic_mean FROM essays2 GROUP BY model, prompt_category
),
tdelta AS (
  SELECT model, prompt_category, topic_mean,
         topic_mean - avg(topic_mean) OVER (PARTITION BY model) AS delta_vs_topic_avg
  FROM topics
)
"""


def with_analysis(select_sql: str) -> str:
    """Prefix a SELECT with the shared response/essay CTEs."""
    return "WITH " + RAW.strip().rstrip(",") + "\n" + select_sql


def r(col: str, alias: str | None = None, digits: int = D) -> str:
    """A rounded column with its alias."""
    return f"round({col}, {digits}) AS {alias or col}"


def _clamp(e: str) -> str:
    return f"(CASE WHEN abs({e}) < 1e-300 THEN 1e-300 ELSE {e} END)"


def _beta_cf(a: str, b: str, x: str, iterations: int = 5000) -> str:
    """Lentz continued fraction of the incomplete beta as a DuckDB list_reduce."""
    qab, qap, qam = f"({a} + {b})", f"({a} + 1.0)", f"({a} - 1.0)"
    m = "CAST(m AS DOUBLE)"
    d0 = f"(1.0 / {_clamp(f'(1.0 - {qab} * {x} / {qap})')})"
    ne = f"({m} * ({b} - {m}) * {x} / (({qam} + 2 * {m}) * ({a} + 2 * {m})))"
    d1 = f"(1.0 / {_clamp(f'(1.0 + {ne} * acc.d)')})"
    c1 = _clamp(f"(1.0 + {ne} / acc.c)")
    no = f"(-({a} + {m}) * ({qab} + {m}) * {x} / (({a} + 2 * {m}) * ({qap} + 2 * {m})))"
    d2 = f"(1.0 / {_clamp(f'(1.0 + {no} * {d1})')})"
    c2 = _clamp(f"(1.0 + {no} / {c1})")
    delta = f"({d2} * {c2})"
    nxt = (f"{{'c': {c2}, 'd': {d2}, 'h': acc.h * {d1} * {c1} * {delta}, "
           f"'done': abs({delta} - 1.0) < 1e-16}}")
    init = f"{{'c': 1.0::DOUBLE, 'd': {d0}::DOUBLE, 'h': {d0}::DOUBLE, 'done': false}}"
    return (f"(list_reduce(range(1, {iterations + 1}), lambda acc, m: "
            f"CASE WHEN acc.done THEN acc ELSE {nxt} END, {init})).h")


def t_two_sided_p(t: str, df: str) -> str:
    """Two-sided Student-t p-value: I_x(df/2, 1/2) with x = df / (df + t^2)."""
    x = f"({df} / ({df} + {t} * {t}))"
    a, b = f"({df} / 2.0)", "0.5"
    front = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1.0 - {x}))"
    direct = f"({front} * {_beta_cf(a, b, x)} / {a})"
    mirrored = f"(1.0 - {front} * {_beta_cf(b, a, f'(1.0 - {x})')} / {b})"
    return (f"(CASE WHEN {x} <= 0.0 THEN 0.0 WHEN {x} >= 1.0 THEN 1.0 "
            f"WHEN {x} < ({a} + 1.0) / ({a} + {b} + 2.0) THEN {direct} ELSE {mirrored} END)")


_PVALUE = (
    "CASE WHEN degenerate THEN 1.0 ELSE "
    + t_two_sided_p("(mean_diff / (sd_diff / sqrt(CAST(n_pairs AS DOUBLE))))", "CAST(n_pairs - 1 AS DOUBLE)")
    + " END"
)

ORACLE: dict[str, str] = {}

ORACLE["parse_strict"] = with_analysis(f"""
SELECT l_orderkey, l_linenumber, model, sm AS strict_match,
       CASE WHEN sm THEN TRY_CAST(regexp_extract(raw, {_q(STRICT_RE)}, 1) AS BIGINT) END AS strict_grammar,
       CASE WHEN sm THEN TRY_CAST(regexp_extract(raw, {_q(STRICT_RE)}, 2) AS BIGINT) END AS strict_lexical,
       CASE WHEN sm THEN TRY_CAST(regexp_extract(raw, {_q(STRICT_RE)}, 3) AS BIGINT) END AS strict_coherence,
       CASE WHEN sm THEN TRY_CAST(regexp_extract(raw, {_q(STRICT_RE)}, 4) AS BIGINT) END AS strict_task
FROM parsed""")

ORACLE["parse_fallback"] = with_analysis("""
SELECT l_orderkey, l_linenumber, model,
       CASE WHEN sm THEN 'strict' WHEN len(dg) >= 4 THEN 'digits' ELSE 'none' END AS parse_method,
       CAST(len(dg) AS BIGINT) AS n_digits,
       CASE WHEN len(dg) >= 4 THEN TRY_CAST(dg[1] AS BIGINT) END AS digit_grammar,
       CASE WHEN len(dg) >= 4 THEN TRY_CAST(dg[2] AS BIGINT) END AS digit_lexical,
       CASE WHEN len(dg) >= 4 THEN TRY_CAST(dg[3] AS BIGINT) END AS digit_coherence,
       CASE WHEN len(dg) >= 4 THEN TRY_CAST(dg[4] AS BIGINT) END AS digit_task
FROM parsed""")

ORACLE["score_extract"] = with_analysis(f"""
SELECT l_orderkey, l_linenumber, model, {r('grammar')}, {r('lexical')}, {r('coherence')}, {r('task')}
FROM scored""")

ORACLE["total_score"] = with_analysis(f"""
SELECT l_orderkey, l_linenumber, model, run, {r('total_score')}, starts_with(raw, 'ERROR:') AS is_error
FROM totals""")

ORACLE["parse_failure_rate"] = with_analysis(f"""
SELECT model, count(*) AS submitted,
       CAST(sum(CASE WHEN scored_n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid,
       CAST(sum(CASE WHEN scored_n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failed,
       {r('sum(CASE WHEN scored_n = 0 THEN 1 ELSE 0 END) * 100.0 / count(*)', 'failed_pct')},
       CAST(sum(n_resp) AS BIGINT) AS responses, CAST(sum(n_err) AS BIGINT) AS error_responses,
       CAST(sum(n_out) AS BIGINT) AS out_of_range_responses
FROM (SELECT model, essay_id, count(total_score) AS scored_n, count(*) AS n_resp,
             sum(CASE WHEN starts_with(raw, 'ERROR:') THEN 1 ELSE 0 END) AS n_err,
             sum(CASE WHEN COALESCE(grammar < 0 OR grammar > 9 OR lexical < 0 OR lexical > 9 OR coherence < 0
                                    OR coherence > 9 OR task < 0 OR task > 9, false) THEN 1 ELSE 0 END) AS n_out
      FROM aligned GROUP BY model, essay_id) e
GROUP BY model""")

ORACLE["essay_identity"] = with_analysis("""
SELECT l_orderkey, l_linenumber, model, run, essay_id, sample_row_s AS sample_row, prompt_category, prompt_question
FROM aligned""")

ORACLE["category_source"] = with_analysis("""
SELECT CASE WHEN max(CASE WHEN prompt_category IS NOT NULL THEN 1 ELSE 0 END) = 1
            THEN 'samples.category' ELSE 'question_id' END AS prompt_category_source
FROM aligned""")

_ESSAY_COLS = (
    f"model, essay_id, respondent_id, question_id, sample_row, prompt_category, prompt_question, "
    f"{r('mean_total')}, {r('sd_total')}, {r('min_total')}, {r('max_total')}, n_runs, "
    f"{r('range_total')}, {r('cv_total')}"
)
ORACLE["essay_metrics"] = with_analysis(f"SELECT {_ESSAY_COLS} FROM essays2")
ORACLE["hitl_routing"] = with_analysis(f"SELECT {_ESSAY_COLS}, hitl_status FROM routed")
ORACLE["hitl_distribution"] = with_analysis(f"SELECT model, hitl_status, count, {r('pct')} FROM dist")
ORACLE["icc_by_model"] = with_analysis(
    f"SELECT model, {r('icc_total')}, icc_n_essays_total, icc_n_essays_balanced, icc_n_raters FROM icc")
ORACLE["model_summary"] = with_analysis(f"""
SELECT model, n_essays, {r('mean_total')}, {r('sd_total')}, {r('mean_sd')}, {r('mean_range')}, {r('mean_cv')},
       {r('icc_total')}, icc_n_essays_total, icc_n_essays_balanced, icc_n_raters,
       {r('"auto-approve"', '"auto-approve"')}, {r('flagged_for_review')}
FROM summary""")

ORACLE["severity_pairs"] = with_analysis(f"""
SELECT essay_id, model_1, model_2, {r('mean_1')}, {r('mean_2')}, {r('pair_mean')}, {r('diff')} FROM pairs2""")
ORACLE["severity_ttest"] = with_analysis(f"SELECT model_1, model_2, {r('tstat')}, n_pairs, degenerate FROM ttest2")
ORACLE["severity_pvalue"] = with_analysis(f"""
SELECT model_1, model_2, n_pairs, printf('%.9e', {_PVALUE}) AS pvalue FROM ttest""")
ORACLE["bland_altman"] = with_analysis(f"""
SELECT model_1, model_2, n_pairs, {r('mean_diff', 'bias')}, {r('sd_diff')},
       {r('mean_diff - 1.96 * sd_diff', 'loa_lower')}, {r('mean_diff + 1.96 * sd_diff', 'loa_upper')}
FROM ttest""")
ORACLE["significance"] = with_analysis(f"""
SELECT model_1, model_2, {r('tstat')}, n_pairs, (p < 0.05) AS significant,
       CASE WHEN NOT (p < 0.05) THEN 'none' WHEN tstat < 0 THEN 'lower' ELSE 'higher' END AS direction,
       regexp_extract(model_1, '[^/]*$') AS model_1_short, regexp_extract(model_2, '[^/]*$') AS model_2_short
FROM (SELECT model_1, model_2, n_pairs,
             CASE WHEN degenerate THEN 0.0 ELSE mean_diff / (sd_diff / sqrt(CAST(n_pairs AS DOUBLE))) END AS tstat,
             {_PVALUE} AS p
      FROM ttest) s""")
ORACLE["topic_bias"] = with_analysis(f"SELECT model, prompt_category, {r('topic_mean')} FROM topics")
ORACLE["topic_delta"] = with_analysis(
    f"SELECT model, prompt_category, {r('topic_mean')}, {r('delta_vs_topic_avg')} FROM tdelta")
_TOPIC_COLUMNS = ", ".join(
    f"max(CASE WHEN prompt_category = '{c}' THEN round(topic_mean, 9) END) AS \"{c}\""
    for c in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
)
ORACLE["topic_matrix"] = with_analysis(f"SELECT model, {_TOPIC_COLUMNS} FROM topics GROUP BY model")
ORACLE["category_question_list"] = with_analysis("""
SELECT DISTINCT prompt_category, prompt_question FROM essays2
WHERE prompt_category IS NOT NULL AND prompt_question IS NOT NULL""")
ORACLE["topic_range"] = with_analysis(f"""
SELECT {r('zmin')}, {r('CASE WHEN zmin = zmax THEN zmax + 1.0 ELSE zmax END', 'zmax')},
       {r('dmin')}, {r('CASE WHEN dmin = dmax THEN dmax + 1.0 ELSE dmax END', 'dmax')}
FROM (SELECT COALESCE(min(topic_mean), 0.0) AS zmin, COALESCE(max(topic_mean), 1.0) AS zmax,
             COALESCE(min(delta_vs_topic_avg), -1.0) AS dmin, COALESCE(max(delta_vs_topic_avg), 1.0) AS dmax
      FROM tdelta) s""")
ORACLE["category_questions"] = with_analysis("""
SELECT prompt_category, array_to_string(list_sort(list(prompt_question)), chr(10)) AS questions
FROM (SELECT DISTINCT prompt_category, prompt_question FROM essays2
      WHERE prompt_category IS NOT NULL AND prompt_question IS NOT NULL) d
GROUP BY prompt_category""")


# --------------------------------------------------------------------------- text functions
# RE2 has ASCII \s; these classes spell out Unicode White_Space (plus U+001C-U+001F,
# which Python counts as blank) to agree with Python's str methods.
from raterkit.functions.text import (  # noqa: E402  (fixed word lists and thresholds)
    CATEGORY_RULES, DEFAULT_SALT, GIBBERISH_FRAGMENTS,
)
from raterkit.plans.queries import FRENCH_STOPWORDS, SAMPLE_N  # noqa: E402

_BL = r"\s\x{0B}\x{85}\pZ\x{1C}-\x{1F}"
_WS = r"\s\x{0B}\x{85}\pZ"


def norm_sql(x: str) -> str:
    """T1 in DuckDB SQL."""
    s = f"replace(replace(COALESCE(CAST({x} AS VARCHAR), ''), '@CAPS1', ''), '@CAPS2', '')"
    s = f"regexp_replace({s}, '[\\x00-\\x1f\\x7f]+', ' ', 'g')"
    s = f"replace(replace(replace(replace({s}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    s = f"regexp_replace({s}, '[{_WS}]+', ' ', 'g')"
    return f"trim({s})"


def renorm_sql(n: str) -> str:
    """Second normalization, only where it can change the text."""
    return f"(CASE WHEN regexp_matches({n}, '@CAPS[12]|&(nbsp|amp|lt|gt);') THEN {norm_sql(n)} ELSE {n} END)"


def tokens_sql(n: str) -> str:
    """Tokens of normalized text."""
    return f"(CASE WHEN {n} = '' THEN 0 ELSE len(string_split({n}, ' ')) END)"


def ustrip_sql(x: str) -> str:
    """Unicode-blank strip."""
    return f"regexp_replace({x}, '^[{_BL}]+|[{_BL}]+$', '', 'g')"


def gib_sql(x: str) -> str:
    """T6 in DuckDB SQL."""
    st = ustrip_sql(x)
    toks = f"regexp_split_to_array({st}, '[{_BL}]+')"
    return (
        f"(CASE WHEN {x} IS NULL OR {x} = '' THEN false "
        f"WHEN length({st}) = 0 THEN true "
        f"WHEN length(regexp_replace({st}, '[\\pL\\pN{_BL}]', '', 'g')) / length({st}) > 0.3 THEN true "
        f"WHEN regexp_matches(lower({st}), '{'|'.join(GIBBERISH_FRAGMENTS)}') THEN true "
        f"WHEN len(list_filter({toks}, lambda t: length(t) = 1)) / len({toks}) > 0.4 THEN true "
        f"ELSE false END)"
    )


def stop_hits_sql(n: str, words) -> str:
    """Distinct stop words among the tokens."""
    arr = "[" + ", ".join(_q(w) for w in words) + "]"
    return f"len(list_intersect(string_split(lower({n}), ' '), {arr}))"


def stop_lang_sql(raw: str, n: str, words, min_hits: int = 2) -> str:
    """T5 in DuckDB SQL."""
    return f"(CASE WHEN {raw} IS NULL OR {raw} = '' THEN false ELSE {stop_hits_sql(n, words)} >= {min_hits} END)"


def category_sql(x: str) -> str:
    """T3 in DuckDB SQL."""
    parts = [f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'unknown'"]
    for label, kws in CATEGORY_RULES:
        cond = " OR ".join(f"contains(lower({x}), {_q(k)})" for k in kws)
        parts.append(f"WHEN {cond} THEN {_q(label)}")
    return " ".join(parts) + " ELSE 'other' END"


def anon_sql(x: str, salt: str = DEFAULT_SALT) -> str:
    """T2 in DuckDB SQL."""
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE substr(sha256({x} || {_q(salt)}), 1, 12) END)"


TEXTS = """
texts AS (
  SELECT 'documents' AS src, doc_id AS id, CAST(0 AS BIGINT) AS id2, text FROM documents
  UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations
  UNION ALL SELECT 'pages', page_id, CAST(0 AS BIGINT), html FROM pages
)"""

ORACLE["normalize_text"] = f"WITH {TEXTS} SELECT src, id, id2, {norm_sql('text')} AS normalized FROM texts"
ORACLE["word_count"] = f"WITH {TEXTS} SELECT src, id, id2, CAST({tokens_sql(norm_sql('text'))} AS BIGINT) AS word_count FROM texts"
ORACLE["gibberish"] = f"WITH {TEXTS} SELECT src, id, id2, {gib_sql('text')} AS is_gibberish FROM texts"
ORACLE["stopword_language"] = f"""WITH {TEXTS}
SELECT src, id, id2, CAST({stop_hits_sql(norm_sql('text'), FRENCH_STOPWORDS)} AS BIGINT) AS stopword_hits,
       {stop_lang_sql('text', norm_sql('text'), FRENCH_STOPWORDS)} AS is_stopword_language
FROM texts"""
ORACLE["noisy_text"] = f"""WITH {TEXTS}, n AS (SELECT src, id, id2, {norm_sql('text')} AS norm FROM texts)
SELECT src, id, id2, ({gib_sql('norm')} OR {stop_lang_sql('norm', renorm_sql('norm'), FRENCH_STOPWORDS)}) AS is_noisy
FROM n"""
ORACLE["detect_category"] = f"""
SELECT 'documents' AS src, doc_id AS id, {category_sql('text')} AS category FROM documents
UNION ALL SELECT 'benchmark', item_id, {category_sql('text')} FROM benchmark"""
ORACLE["anonymize"] = f"""
SELECT c_custkey, {anon_sql('c_name')} AS anon_default, {anon_sql('c_name', 's3cret')} AS anon_salted FROM customer"""
ORACLE["short_hash"] = "SELECT doc_id, substr(sha256(text), 1, 16) AS short_hash, sha256(text) AS full_hash FROM documents"
ORACLE["path_safe_names"] = """
SELECT page_id, translate(url, '/\\', '__') AS path_safe, regexp_extract(url, '[^/]*$') AS short_name,
       lower(replace('Flagged for ' || url, ' ', '_')) AS status_column
FROM pages"""

# --------------------------------------------------------------------------- cleaning

ANSWERS = """
answers AS (
  SELECT doc_id * 2 + 1 AS row, text AS textResponse, source AS questionText, source AS questionId,
         lang AS questionType, CAST(doc_id % 101 AS VARCHAR) AS nim, CAST(NULL AS VARCHAR) AS audioResponseUrl
  FROM documents
  UNION ALL
  SELECT page_id * 2 + 2, NULL, NULL, NULL, 'audio', CAST(page_id % 101 AS VARCHAR), url FROM pages
)"""


def classified_sql(resp="textResponse", q="questionText", typ="questionType", who="nim",
                   qid="questionId", words=FRENCH_STOPWORDS, min_length=40, source_file="'documents+pages'") -> str:
    """P3-P5 classification of the answer sheet CTE ``answers`` in DuckDB SQL."""
    qid_expr = f"NULLIF({qid}, '')" if qid else "CAST(NULL AS VARCHAR)"
    return f"""
c0 AS (
  SELECT row, {norm_sql(resp)} AS norm1, NULLIF({q}, '') AS raw_q, NULLIF({typ}, '') AS raw_type,
         NULLIF({who}, '') AS raw_who, NULLIF(audioResponseUrl, '') AS audio, {qid_expr} AS question_id
  FROM answers
),
c1 AS (SELECT *, {renorm_sql('norm1')} AS norm2 FROM c0),
c2 AS (
  SELECT *,
         CASE WHEN norm1 = '' AND audio IS NOT NULL THEN 'audio_only'
              WHEN norm1 = '' OR {tokens_sql('norm2')} < {min_length} THEN 'short_or_empty'
              WHEN {gib_sql('norm1')} OR {stop_lang_sql('norm1', 'norm2', words)} THEN 'filtered_noisy'
              ELSE 'kept' END AS status,
         CASE WHEN raw_q IS NOT NULL THEN {norm_sql('raw_q')} END AS question
  FROM c1
),
classified AS (
  SELECT CAST(row AS BIGINT) AS row, status, question, question_id, raw_type AS type,
         CASE WHEN status <> 'audio_only' THEN {category_sql("COALESCE(raw_q, '')")} END AS category,
         CASE WHEN status <> 'audio_only' THEN norm1 END AS response,
         CASE WHEN status = 'audio_only' THEN 'audio' ELSE 'text' END AS response_type,
         CASE WHEN status = 'audio_only' THEN audio END AS audio_url,
         {anon_sql('raw_who')} AS respondent_id,
         CAST(NULL AS VARCHAR) AS submission_id, CAST(NULL AS VARCHAR) AS exam_id, CAST(NULL AS VARCHAR) AS submitted_at,
         CAST({source_file} AS VARCHAR) AS source_file,
         sha256(CASE WHEN status = 'audio_only' THEN 'audio:' || audio
                     ELSE 'text:' || COALESCE(question_id, question, '') || '|' || norm1 END) AS dedupe_key
  FROM c2
)"""


_RECORD_COLS = ("question, question_id, type, category, response, response_type, audio_url, respondent_id, "
                "submission_id, exam_id, submitted_at, source_file, row")

ORACLE["clean_records"] = f"""WITH {ANSWERS}, {classified_sql()}
SELECT {_RECORD_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY row) AS rn
  FROM classified WHERE status IN ('audio_only', 'kept')) d
WHERE rn = 1"""
ORACLE["clean_records_all"] = f"""WITH {ANSWERS}, {classified_sql()}
SELECT {_RECORD_COLS} FROM classified WHERE status IN ('audio_only', 'kept')"""
ORACLE["clean_counters"] = f"""WITH {ANSWERS}, {classified_sql()}
SELECT count(*) AS total_rows,
       CAST(sum(CASE WHEN status = 'audio_only' THEN 1 ELSE 0 END) AS BIGINT) AS audio_only,
       CAST(sum(CASE WHEN status = 'short_or_empty' THEN 1 ELSE 0 END) AS BIGINT) AS short_or_empty,
       CAST(sum(CASE WHEN status = 'filtered_noisy' THEN 1 ELSE 0 END) AS BIGINT) AS filtered_noisy,
       CAST(sum(CASE WHEN status IN ('audio_only', 'kept') THEN 1 ELSE 0 END)
            - count(DISTINCT CASE WHEN status IN ('audio_only', 'kept') THEN dedupe_key END) AS BIGINT) AS deduped,
       CAST(count(DISTINCT CASE WHEN status IN ('audio_only', 'kept') THEN dedupe_key END) AS BIGINT) AS kept
FROM classified"""
ORACLE["dedupe_exact"] = """
SELECT text_hash, doc_id, source FROM (
  SELECT sha256(text) AS text_hash, doc_id, source,
         row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) d
WHERE rn = 1"""
ORACLE["resolve_columns"] = f"""WITH {ANSWERS}, {classified_sql(qid=None, source_file='NULL')}
SELECT row, status, question, type, category, respondent_id, dedupe_key FROM classified"""

# --------------------------------------------------------------------------- sampling

DOC_QUESTIONS = f"""
top3 AS (
  SELECT question_id, n_answers, question_rank FROM (
    SELECT question_id, n_answers, row_number() OVER (ORDER BY n_answers DESC, question_id ASC) AS question_rank
    FROM (SELECT CAST(questionId AS VARCHAR) AS question_id, count(*) AS n_answers FROM answers
          WHERE COALESCE({ustrip_sql('textResponse')} <> '', false) AND questionId IS NOT NULL
          GROUP BY 1) c) r
  WHERE question_rank <= 3
),
valid AS (
  SELECT a.*, CAST(a.questionId AS VARCHAR) AS question_id, {norm_sql('a.textResponse')} AS norm
  FROM answers a
  WHERE CAST(a.questionId AS VARCHAR) IN (SELECT question_id FROM top3)
    AND {tokens_sql(norm_sql('a.textResponse'))} >= 40
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sha256('42|' || CAST(row AS VARCHAR)), row) AS sample_rank
  FROM valid
),
samples AS (
  SELECT {anon_sql("NULLIF(nim, '')")} AS respondent_id, {norm_sql('questionText')} AS question, question_id,
         questionType AS type, {category_sql(norm_sql('questionText'))} AS category, norm AS response,
         CAST(NULL AS VARCHAR) AS submitted_at, CAST(NULL AS VARCHAR) AS source_file, CAST(row AS BIGINT) AS row,
         sample_rank
  FROM ranked WHERE sample_rank <= {SAMPLE_N}
)"""

ORACLE["detect_questions_by_type"] = """
SELECT CAST(o_custkey AS VARCHAR) AS question_id, min(o_orderkey + 1) AS first_row
FROM orders WHERE regexp_matches(lower(o_orderpriority), 'urgent') AND o_custkey IS NOT NULL
GROUP BY 1"""
ORACLE["top_questions"] = f"WITH {ANSWERS}, {DOC_QUESTIONS} SELECT question_id, n_answers, question_rank FROM top3"
ORACLE["sample_per_question"] = f"WITH {ANSWERS}, {DOC_QUESTIONS} SELECT * FROM samples"
ORACLE["sampling_summary"] = f"""WITH {ANSWERS}, {DOC_QUESTIONS}
SELECT question_id, count(*) AS total_valid, CAST(least(count(*), {SAMPLE_N}) AS BIGINT) AS sampled
FROM valid GROUP BY question_id"""
ORACLE["select_samples"] = f"""WITH {ANSWERS}, {DOC_QUESTIONS},
files AS (SELECT DISTINCT 'question_' || question_id || '_samples.jsonl' AS sample_file FROM samples),
first_files AS (SELECT sample_file FROM (SELECT sample_file, row_number() OVER (ORDER BY sample_file) AS r FROM files) f
                WHERE r <= 2)
SELECT 'question_' || question_id || '_samples.jsonl' AS sample_file, question_id, row, sample_rank
FROM samples
WHERE 'question_' || question_id || '_samples.jsonl' IN (SELECT sample_file FROM first_files) AND sample_rank <= 5"""


# --------------------------------------------------------------------------- scoring plan
from raterkit.operators.scoring import PROMPT_HEADER  # noqa: E402
from raterkit.functions.parse import DRY_RUN_TEXT  # noqa: E402
from raterkit.plans.queries import PLAN_MODELS  # noqa: E402

_MODELS_VALUES = ", ".join(f"({_q(m)})" for m in PLAN_MODELS)

CSAMPLES = f"""
csamples AS (
  SELECT a.turn AS row, CAST(a.conv_id % 3 AS VARCHAR) AS question_id, CAST(a.conv_id AS VARCHAR) AS respondent_id,
         u.text AS question, a.text AS response
  FROM conversations a
  LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user'
  WHERE a.role = 'assistant'
),
prompts AS (
  SELECT *, {_q(PROMPT_HEADER)} || 'Question: ' || COALESCE(question, 'None') || chr(10) || chr(10) || 'Response: '
            || COALESCE(response, 'None') || chr(10) AS prompt
  FROM csamples
),
plan AS (
  SELECT m.model, CAST(r.run AS INTEGER) AS run, p.row AS sample_row, p.question_id, p.respondent_id,
         p.question, p.response, p.prompt, 'question_' || COALESCE(p.question_id, '') AS stem,
         translate(m.model, '/\\', '__') AS model_safe
  FROM prompts p CROSS JOIN (VALUES {_MODELS_VALUES}) m(model) CROSS JOIN range(1, 4) r(run)
),
dry AS (
  SELECT *, {_q(DRY_RUN_TEXT)} AS raw, CAST(7 AS DOUBLE) AS grammar, CAST(7 AS DOUBLE) AS lexical,
         CAST(7 AS DOUBLE) AS coherence, CAST(7 AS DOUBLE) AS task, CAST(28 AS DOUBLE) AS total_score,
         COALESCE(respondent_id, '') || '|' || COALESCE(question_id, '') || '|' || COALESCE(CAST(sample_row AS VARCHAR), '') AS essay_id
  FROM plan
)"""

ORACLE["prompt_text"] = f"WITH {CSAMPLES} SELECT row, question_id, respondent_id, prompt FROM prompts"
ORACLE["score_plan"] = f"""WITH {CSAMPLES}
SELECT model, run, sample_row, question_id, respondent_id, stem, model_safe, sha256(prompt) AS prompt_sha256 FROM plan"""
ORACLE["resume_antijoin"] = f"""WITH {CSAMPLES}
SELECT model, run, sample_row, question_id, respondent_id FROM plan
WHERE NOT (run <= 2 OR model = {_q(PLAN_MODELS[1])})"""
ORACLE["dry_run_scores"] = f"""WITH {CSAMPLES}
SELECT model, run, sample_row, question_id, respondent_id, grammar, lexical, coherence, task, total_score FROM dry"""
ORACLE["response_records"] = f"""WITH {CSAMPLES}
SELECT model, run, sample_row, question_id, respondent_id, response, raw,
       CAST(7 AS BIGINT) AS parsed_grammar, CAST(7 AS BIGINT) AS parsed_lexical,
       CAST(7 AS BIGINT) AS parsed_coherence, CAST(7 AS BIGINT) AS parsed_task
FROM dry"""
ORACLE["dry_run_summary"] = f"""WITH {CSAMPLES},
e AS (SELECT model, essay_id, avg(total_score) AS mean_total FROM dry GROUP BY model, essay_id)
SELECT model, count(*) AS n_essays, round(avg(mean_total), 9) AS mean_total, round(stddev_samp(mean_total), 9) AS sd_total,
       CAST(0 AS DOUBLE) AS mean_sd, CAST(0 AS DOUBLE) AS mean_range, CAST(0 AS DOUBLE) AS mean_cv,
       CAST(NULL AS DOUBLE) AS icc_total, count(*) AS icc_n_essays_total, count(*) AS icc_n_essays_balanced,
       CAST({3} AS BIGINT) AS icc_n_raters, CAST(100 AS DOUBLE) AS "auto-approve", CAST(NULL AS DOUBLE) AS flagged_for_review
FROM e GROUP BY model"""
ORACLE["dry_run_ttest"] = f"""WITH {CSAMPLES}
SELECT min(model) AS model_1, max(model) AS model_2, CAST(0 AS DOUBLE) AS tstat, CAST(1 AS DOUBLE) AS pvalue,
       count(DISTINCT essay_id) AS n_pairs, true AS degenerate
FROM dry"""

# --------------------------------------------------------------------------- report tables

ORACLE["boxplot_summary"] = with_analysis(f"""
SELECT model, count(mean_total) AS n_scored,
       {r('quantile_cont(mean_total, 0.0)', 'q_min')}, {r('quantile_cont(mean_total, 0.25)', 'q1')},
       {r('quantile_cont(mean_total, 0.5)', 'median')}, {r('quantile_cont(mean_total, 0.75)', 'q3')},
       {r('quantile_cont(mean_total, 1.0)', 'q_max')}
FROM essays2 GROUP BY model""")

_LONG = """
long AS (
  SELECT 'mean_total' AS metric, model, mean_total AS value FROM summary
  UNION ALL SELECT 'icc_total', model, icc_total FROM summary
  UNION ALL SELECT 'auto-approve', model, "auto-approve" FROM summary
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC NULLS LAST, model) AS rk,
         max(value) OVER (PARTITION BY metric) AS best
  FROM long
)"""

ORACLE["leaderboard"] = with_analysis(f""", {_LONG.strip()}
SELECT metric, model AS best_model, {r('value', 'best_value')}, regexp_extract(model, '[^/]*$') AS best_model_short
FROM ranked WHERE rk = 1 AND value IS NOT NULL""")
ORACLE["relative_to_best"] = with_analysis(f""", {_LONG.strip()}
SELECT metric, model, {r('value')},
       {r('CASE WHEN best > 0 THEN value / best * 100.0 ELSE 0.0 END', 'pct_of_best')},
       (rk = 1 AND value IS NOT NULL) AS is_best
FROM ranked""")
ORACLE["badges"] = with_analysis(f""", {_LONG.strip()}
SELECT s.model,
       CASE WHEN s.model = (SELECT model FROM ranked WHERE metric = 'icc_total' AND rk = 1 AND value IS NOT NULL)
            THEN 'Most Reliable'
            WHEN s.model = (SELECT model FROM ranked WHERE metric = 'mean_total' AND rk = 1 AND value IS NOT NULL)
            THEN 'Highest Score' END AS badge,
       regexp_extract(s.model, '[^/]*$') AS model_short
FROM summary s""")
ORACLE["exec_summary"] = with_analysis(f"""
SELECT count(*) AS n_models, CAST(sum(n_essays) AS BIGINT) AS total_essays, {r('avg("auto-approve")', 'avg_auto_approve')},
       max(CASE WHEN rk = 1 THEN regexp_extract(model, '[^/]*$') END) AS most_reliable,
       {r('max(CASE WHEN rk = 1 THEN icc_total END)', 'most_reliable_icc')}
FROM (SELECT *, row_number() OVER (ORDER BY icc_total DESC NULLS LAST, model) AS rk FROM summary) s""")


# --------------------------------------------------------------------------- extras
ORACLE["scan_rows"] = "SELECT doc_id, doc_id + 1 AS row FROM documents"
ORACLE["essay_metrics_dedupe_runs"] = with_analysis(f"""
, cellsd AS (
  SELECT model, essay_id, run, min(respondent_id) AS respondent_id, min(question_id) AS question_id,
         min(sample_row_s) AS sample_row_s, min(prompt_category) AS prompt_category,
         min(prompt_question) AS prompt_question, avg(total_score) AS total_score
  FROM aligned GROUP BY model, essay_id, run
),
ed AS (
  SELECT model, essay_id, min(respondent_id) AS respondent_id, min(question_id) AS question_id,
         min(sample_row_s) AS sample_row, min(prompt_category) AS prompt_category,
         min(prompt_question) AS prompt_question, avg(total_score) AS mean_total,
         COALESCE(stddev_samp(total_score), 0.0) AS sd_total, min(total_score) AS min_total,
         max(total_score) AS max_total, count(total_score) AS n_runs,
         COALESCE(max(total_score) - min(total_score), 0.0) AS range_total
  FROM cellsd GROUP BY model, essay_id
),
ed2 AS (SELECT *, CASE WHEN mean_total IS NULL OR mean_total = 0 THEN 0.0 ELSE sd_total / mean_total END AS cv_total FROM ed)
SELECT {_ESSAY_COLS} FROM ed2""")
ORACLE["model_summary_scored"] = with_analysis(f"""
SELECT model, count(*) AS n_scored, {r('avg(sd_total)', 'mean_sd_scored')}, {r('avg(range_total)', 'mean_range_scored')},
       {r('avg(cv_total)', 'mean_cv_scored')},
       {r("avg(CASE WHEN hitl_status = 'Auto-Approve' THEN 1.0 ELSE 0.0 END) * 100.0", 'auto_approve_scored_pct')}
FROM routed WHERE n_runs > 0 GROUP BY model""")


# --------------------------------------------------------------------------- sources and sinks
ORACLE["tolerant_jsonl"] = with_analysis("""
, lines AS (SELECT unnest(string_split(raw, chr(10))) AS line FROM raw)
SELECT json_extract_string(line, '$.grammar') AS grammar, json_extract_string(line, '$.lexical') AS lexical,
       json_extract_string(line, '$.coherence') AS coherence, json_extract_string(line, '$.task') AS task
FROM lines WHERE json_valid(line) AND starts_with(ltrim(line), '{')""")
ORACLE["partitioned_append"] = with_analysis("""
SELECT model, CAST(run AS VARCHAR) AS run, CAST(sample_row AS VARCHAR) AS sample_row, question_id, respondent_id, raw,
       CAST(p_grammar AS VARCHAR) AS parsed_grammar, CAST(p_lexical AS VARCHAR) AS parsed_lexical,
       CAST(p_coherence AS VARCHAR) AS parsed_coherence, CAST(p_task AS VARCHAR) AS parsed_task
FROM parsed2""")
ORACLE["input_resolution"] = f"""WITH {CSAMPLES}
SELECT model, CAST(run AS VARCHAR) AS run, CAST(sample_row AS VARCHAR) AS sample_row, question_id, respondent_id, raw
FROM dry"""
ORACLE["sample_map"] = with_analysis("SELECT question_id, prompt_category, prompt_question FROM pmap")

# --------------------------------------------------------------------------- routing policy options
ORACLE["hitl_distribution_unscored_flag"] = with_analysis(f"""
, r2 AS (SELECT model, CASE WHEN n_runs = 0 THEN 'Flagged for Review' ELSE hitl_status END AS hitl_status FROM routed)
SELECT model, hitl_status, count(*) AS count,
       {r('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY model)', 'pct')}
FROM r2 GROUP BY model, hitl_status""")
ORACLE["hitl_distribution_unscored_exclude"] = with_analysis(f"""
SELECT model, hitl_status, count(*) AS count,
       {r('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY model)', 'pct')}
FROM routed WHERE n_runs > 0 GROUP BY model, hitl_status""")

# --------------------------------------------------------------------------- a chosen model pair
ORACLE["severity_ttest_pair_1_3"] = with_analysis(f"""
, p13 AS (
  SELECT e.essay_id,
         max(CASE WHEN r.model_rank = 1 THEN e.model END) OVER () AS model_1,
         max(CASE WHEN r.model_rank = 3 THEN e.model END) OVER () AS model_2,
         e.model, r.model_rank, e.mean_total
  FROM essays2 e JOIN mrank r ON e.model = r.model WHERE r.model_rank IN (1, 3)
),
pp AS (
  SELECT essay_id, max(CASE WHEN model_rank = 1 THEN mean_total END) AS m1,
         max(CASE WHEN model_rank = 3 THEN mean_total END) AS m2,
         max(model_1) AS model_1, max(model_2) AS model_2
  FROM p13 GROUP BY essay_id
  HAVING max(CASE WHEN model_rank = 1 THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN model_rank = 3 THEN 1 ELSE 0 END) = 1
),
d AS (SELECT model_1, model_2, m1 - m2 AS diff FROM pp WHERE m1 IS NOT NULL AND m2 IS NOT NULL)
SELECT model_1, model_2,
       {r('CASE WHEN min(diff) = max(diff) THEN 0.0 ELSE avg(diff) / (stddev_samp(diff) / sqrt(CAST(count(*) AS DOUBLE))) END', 'tstat')},
       count(*) AS n_pairs, (min(diff) = max(diff)) AS degenerate
FROM d GROUP BY model_1, model_2""")

# --------------------------------------------------------------------------- category columns of response files


def _file_oracle(category: str, question: str | None, source: str) -> str:
    text = f", {question} AS prompt_question" if question else ""
    return with_analysis(f"""
SELECT model, CAST(run AS INTEGER) AS run, essay_id, {category} AS prompt_category{text},
       '{source}' AS prompt_category_source, {r('total_score')}
FROM aligned""")


ORACLE["file_category"] = _file_oracle("'cat' || (sample_row % 5)", "'Question ' || question_id", "category")
ORACLE["file_topic"] = _file_oracle("'topic' || (sample_row % 4)", None, "topic")
ORACLE["file_question_id"] = _file_oracle("question_id", "CAST(NULL AS VARCHAR)", "question_id")
ORACLE["essay_grain"] = with_analysis(f"""
, g AS (
  SELECT model, essay_id, run, total_score, CASE WHEN run % 2 = 0 THEN 'P' || (run % 3) END AS pc,
         CASE WHEN run > 2 THEN respondent_id END AS resp
  FROM aligned
)
SELECT model, essay_id, arg_min(resp, run) FILTER (WHERE resp IS NOT NULL) AS respondent_id,
       arg_min(pc, run) FILTER (WHERE pc IS NOT NULL) AS prompt_category, {r('avg(total_score)', 'mean_total')},
       {r('COALESCE(max(total_score) - min(total_score), 0.0)', 'range_total')}, count(total_score) AS n_runs
FROM g GROUP BY model, essay_id""")

# --------------------------------------------------------------------------- sinks and reuse
ORACLE["jsonl_sink"] = f"WITH {CSAMPLES} SELECT row, question_id, respondent_id, question, response FROM csamples"
ORACLE["json_document"] = ORACLE["clean_counters"]
ORACLE["overwrite_layout"] = f"""WITH {CSAMPLES}
SELECT 'question_' || question_id AS stem, model_safe AS model_dir,
       CASE question_id WHEN '0' THEN '0' WHEN '1' THEN 'What is it?' ELSE 'question_' || question_id END AS question,
       count(*) AS responses
FROM dry GROUP BY ALL"""
ORACLE["csv_sink"] = ORACLE["topic_bias"]
ORACLE["result_reuse"] = ORACLE["hitl_distribution"]
ORACLE["report_json"] = with_analysis(f"""
SELECT (SELECT CASE WHEN max(CASE WHEN prompt_category <> 'unknown' THEN 1 ELSE 0 END) = 1
                    THEN 'samples.category' ELSE 'question_id' END FROM aligned) AS prompt_category_source,
       (SELECT n_pairs FROM ttest2) AS n_pairs, model, n_essays, {r('mean_total')}, {r('icc_total')}
FROM summary""")
ORACLE["batch_scorer"] = f"""WITH {CSAMPLES},
lengths AS (SELECT *, length(prompt) AS p, length(model) AS m FROM plan)
SELECT model, run, sample_row, respondent_id, CAST(p % 8 AS DOUBLE) AS grammar, CAST(p % 7 AS DOUBLE) AS lexical,
       CAST(m % 6 AS DOUBLE) AS coherence, CAST((p + m) % 10 AS DOUBLE) AS task,
       CAST(p % 8 + p % 7 + m % 6 + (p + m) % 10 AS DOUBLE) AS total_score
FROM lengths"""
ORACLE["raw_json_scores"] = with_analysis(f"""
, own AS (
  SELECT l_orderkey, l_linenumber, model,
         {', '.join(f"CASE WHEN whole_json THEN TRY_CAST(json_extract_string(raw, '$.{k}') AS DOUBLE) END AS {k}"
                    for k in ("grammar", "lexical", "coherence", "task"))}
  FROM parsed2
)
SELECT *, grammar + lexical + coherence + task AS total_score FROM own""")
ORACLE["select_samples_by_name"] = f"""WITH {ANSWERS}, {DOC_QUESTIONS}
SELECT 'question_' || question_id || '_samples.jsonl' AS sample_file, question_id, row, sample_rank
FROM samples WHERE question_id IN ('src0', 'src1', 'src10') AND sample_rank <= 3"""

# --------------------------------------------------------------------------- all pairs, jobs, checkpoints, cells
_ALL_PAIRS = """
, ap AS (
  SELECT a.model AS model_1, b.model AS model_2, a.mean_total - b.mean_total AS diff
  FROM essays2 a JOIN essays2 b ON a.essay_id = b.essay_id AND a.model < b.model
  WHERE a.mean_total IS NOT NULL AND b.mean_total IS NOT NULL
),
am AS (
  SELECT model_1, model_2, count(*) AS n_pairs, avg(diff) AS mean_diff, stddev_samp(diff) AS sd_diff, min(diff) = max(diff) AS degenerate
  FROM ap GROUP BY model_1, model_2
)"""
ORACLE["severity_ttest_all"] = with_analysis(f"""{_ALL_PAIRS}
SELECT model_1, model_2, {r('CASE WHEN degenerate THEN 0.0 ELSE mean_diff / (sd_diff / sqrt(CAST(n_pairs AS DOUBLE))) END', 'tstat')}, n_pairs, degenerate
FROM am""")
ORACLE["bland_altman_all"] = with_analysis(f"""{_ALL_PAIRS}
SELECT model_1, model_2, n_pairs, {r('mean_diff', 'bias')}, {r('sd_diff')},
       {r('mean_diff - 1.96 * sd_diff', 'loa_lower')}, {r('mean_diff + 1.96 * sd_diff', 'loa_upper')}
FROM am""")
ORACLE["resume_from_checkpoint"] = f"""WITH {CSAMPLES}
SELECT model, run, sample_row, question_id, respondent_id FROM plan
WHERE model = {_q(PLAN_MODELS[0])} AND run = 3"""
ORACLE["append_twice"] = with_analysis("""
SELECT model, CAST(run AS VARCHAR) AS run, CAST(sample_row AS VARCHAR) AS sample_row, question_id, respondent_id, raw
FROM parsed2""")
ORACLE["incremental_cells"] = with_analysis(f"""
SELECT model, essay_id, question_id, {r('mean_total')}, {r('sd_total')}, {r('range_total')}, n_runs, hitl_status
FROM routed""")
ORACLE["raw_json_strict"] = with_analysis(f"""
, tailed AS (
  SELECT l_orderkey, l_linenumber, model,
         raw || CASE l_orderkey % 5 WHEN 0 THEN ' ' || raw WHEN 1 THEN ',' || raw WHEN 2 THEN '}}' WHEN 3 THEN ' ' || chr(9) ELSE '' END AS raw
  FROM parsed2
),
whole AS (SELECT *, regexp_matches(raw, {_q(WHOLE_OBJECT_RE)}) AND json_valid(raw) AS one FROM tailed),
own AS (
  SELECT l_orderkey, l_linenumber, model,
         {', '.join(f"CASE WHEN one THEN TRY_CAST(json_extract_string(raw, '$.{k}') AS DOUBLE) END AS {k}"
                    for k in ("grammar", "lexical", "coherence", "task"))}
  FROM whole
)
SELECT *, grammar + lexical + coherence + task AS total_score FROM own""")
