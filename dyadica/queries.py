"""Registered queries of the core operators, with the DuckDB SQL that checks them.

Floats are rounded to six places on both sides. A query without SQL has no equivalent there
(draws, Python parsers, iterative fits) and is tested against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import cues, parsing, stats, text
from .operators import attempts, describe, inference, judging, outcome, permutation, probes, terms, topics, training, vectors
from .plans import design, prompts, waves
from .schema import CONTROL, FRAMINGS, clean_keys, flag, level_codes, no_nan, normalize_label
from .session import cut_lineage, table, trimmed
from .sources.readers import persona_texts

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """The columns (or all doubles) rounded to six places."""
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(c), 6) for c in names})


# ---- SQL pieces ---------------------------------------------------------------------------
def c_(x: str) -> str:
    return f"lower(regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"


def p_(x: str) -> str:
    return f"coalesce(nullif({c_(x)}, ''), 'none')"


def label_(x: str) -> str:
    bare = f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9 ]+', ' ', 'g'))"
    led = f"regexp_replace({bare}, '^(the\\s+)?(user|person|they|he|she)\\s+(is|wants|seeks|needs)\\s+', '')"
    return f"trim(regexp_replace({led}, '\\s+', ' ', 'g'))"


def erfc_(x: str) -> str:
    t, inner = f"(1 / (1 + ({x}) / 2))", "0.0"
    for c in reversed(stats.ERFC_FIT):
        inner = f"({inner} * {t} + ({c}))"
    return f"({t} * exp(-({x}) * ({x}) + {inner}))"


def normal_p_(z: str) -> str:
    return f"least(1.0, {erfc_(f'abs({z}) / sqrt(2.0)')})"


def bh_(src: str, p: str, ties: str) -> str:
    return f"""(SELECT * EXCLUDE (_m, _r), CASE WHEN {p} IS NOT NULL THEN least(1.0, min({p} * _m / _r) OVER (PARTITION BY {p} IS NULL ORDER BY _r DESC ROWS UNBOUNDED PRECEDING)) END AS q
    FROM (SELECT *, count(*) OVER (PARTITION BY {p} IS NULL) AS _m, row_number() OVER (PARTITION BY {p} IS NULL ORDER BY {p}, {ties}) AS _r FROM {src}))"""


A = f"""a AS (SELECT DISTINCT run_id, cell_key, probe, {p_('persona_type')} AS persona_type, {p_('persona_id')} AS persona_id, prompt_type,
 {c_('prompt_id')} AS prompt_id, rep, rank, assumption, description, probability, probability_norm, parse_status, has_response FROM assumptions)"""
T = f"""t AS (SELECT DISTINCT run_id, cell_key, probe, {p_('persona_type')} AS persona_type, {p_('persona_id')} AS persona_id, prompt_type,
 {c_('prompt_id')} AS prompt_id, rep, regexp_replace({c_('teacher_id')}, '[\\s-]+', '_', 'g') AS teacher,
 regexp_replace({c_('dimension')}, '[\\s-]+', '_', 'g') AS dimension, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, parse_status FROM teacher_labels)"""
S = """p AS (SELECT persona_type, persona_id, prompt_id, prompt_type, avg(score) AS s FROM t WHERE dimension = 'user_rightness' AND score IS NOT NULL GROUP BY ALL),
w AS (SELECT persona_type, persona_id, prompt_id, max(CASE WHEN prompt_type = 'original_post' THEN ln(least(greatest(s, 1e-6), 1 - 1e-6) / (1 - least(greatest(s, 1e-6), 1 - 1e-6))) END) AS lo,
 max(CASE WHEN prompt_type = 'flipped_story' THEN ln(least(greatest(s, 1e-6), 1 - 1e-6) / (1 - least(greatest(s, 1e-6), 1 - 1e-6))) END) AS lf FROM p GROUP BY ALL),
sc AS (SELECT *, lo > 0 AS eligible, CASE WHEN lo > 0 AND lf IS NOT NULL THEN lf > 0 END AS outcome, CASE WHEN lo > 0 AND lf IS NOT NULL THEN lf END AS outcome_logit FROM w)"""


# ---- tables -------------------------------------------------------------------------------
def _assumptions(spark: SparkSession, d: str) -> DataFrame:
    return clean_keys(table(spark, d, "assumptions")).distinct()


def _name(col: Column) -> Column:
    return F.regexp_replace(trimmed(col), r"(?U)[\s-]+", "_")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    t = clean_keys(table(spark, d, "teacher_labels")).drop("explanation", "labelled_at").distinct()
    t = t.withColumn("teacher", _name(F.col("teacher_id"))).withColumn("dimension", _name(F.col("dimension"))).withColumn("score", no_nan(F.col("score")))
    return t.drop("teacher_id").distinct()


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Paired outcomes: the mean rightness of a framing stands for its forced choice."""
    t = _labels(spark, d).filter("dimension = 'user_rightness' and score is not null")
    per = t.groupBy("persona_type", "persona_id", "prompt_id", "prompt_type").agg(F.avg("score").alias("s"))
    return outcome.binary_scores(per.withColumn("yes", stats.log_odds(F.col("s"))).withColumn("no", F.lit(0.0)), "yes", "no")


def _outcome_labels(spark: SparkSession, d: str) -> DataFrame:
    """Normalised labels with their normalised probability."""
    a = _assumptions(spark, d).filter("assumption is not null").withColumn("label", normalize_label(F.col("assumption"))).filter("label <> ''")
    y = F.col("probability_norm")
    return a.filter(y.isNotNull()).withColumn("y", y)


# ---- outcomes -----------------------------------------------------------------------------
@query(
    f"""WITH {T}, {S}, b AS (SELECT avg(CAST(outcome AS INT)) AS control_mean FROM sc WHERE persona_type = 'none')
SELECT persona_type, count(outcome) AS n, round(avg(CAST(outcome AS INT)), 6) AS mean, round(any_value(control_mean), 6) AS control_mean,
 round(CASE WHEN any_value(control_mean) > 0 THEN avg(CAST(outcome AS INT)) / any_value(control_mean) END, 6) AS lift FROM sc, b GROUP BY persona_type"""
)
def paired_outcome_lift(spark, d):
    y = F.col("outcome").cast("double")
    return rounded(outcome.summarize(_scores(spark, d), ["persona_type"], y, F.col("persona_type") == CONTROL))


@query(
    f"""WITH {T}, {S} SELECT persona_type, count(*) AS units, count(lo) AS original, count(lf) AS flipped, count(lo + lf) AS paired,
 CAST(coalesce(sum(CAST(eligible AS INT)), 0) AS BIGINT) AS eligible, count(outcome) AS scored, CAST(coalesce(sum(CAST(outcome AS INT)), 0) AS BIGINT) AS positive,
 round(avg(CAST(outcome AS INT)), 6) AS rate FROM sc GROUP BY persona_type"""
)
def coverage_funnel(spark, d):
    return rounded(outcome.coverage(_scores(spark, d), ["persona_type"]))


@query(
    f"""WITH {T}, {S}, {A}, r AS (SELECT DISTINCT cell_key, persona_type, persona_id, prompt_id FROM a),
pc AS (SELECT persona_type, persona_id, prompt_id, avg(outcome_logit) AS v FROM sc GROUP BY ALL), pp AS (SELECT persona_type, persona_id, avg(outcome_logit) AS v FROM sc GROUP BY ALL),
j AS (SELECT r.*, pc.v AS cv, pc.prompt_id IS NOT NULL AS cm, pp.v AS pv, pp.persona_id IS NOT NULL AS pm FROM r LEFT JOIN pc USING (persona_type, persona_id, prompt_id)
 LEFT JOIN pp ON r.persona_type = pp.persona_type AND r.persona_id = pp.persona_id),
m AS (SELECT avg(CAST(cm AS INT)) AS cell_match, avg(CAST(pm AS INT)) AS person_match FROM j)
SELECT cell_key, round(CASE WHEN cell_match > 0 THEN cv ELSE pv END, 6) AS outcome_logit, CASE WHEN cell_match > 0 THEN 'cell' ELSE 'person' END AS level,
 round(cell_match, 6) AS cell_match, round(person_match, 6) AS person_match FROM j, m"""
)
def attach_level_auto(spark, d):
    rows = _assumptions(spark, d).select("cell_key", "persona_type", "persona_id", "prompt_id").distinct()
    keys = ["persona_type", "persona_id"]
    out = outcome.attach_scores(rows, _scores(spark, d), "outcome_logit", [*keys, "prompt_id"], keys)
    return rounded(out.select("cell_key", "outcome_logit", "level", "cell_match", "person_match"))


OUT = f"""{A}, o AS (SELECT persona_type, persona_id, prompt_id, prompt_type, cell_key, {label_('assumption')} AS label, probability_norm AS y FROM a WHERE assumption IS NOT NULL AND probability_norm IS NOT NULL),
u AS (SELECT prompt_id, cell_key, label, avg(y) AS y FROM o WHERE label <> '' GROUP BY ALL)"""


@query(
    f"""WITH {OUT}, c AS (SELECT label, prompt_id, count(*) AS n1, sum(y) AS s1 FROM u GROUP BY ALL),
st AS (SELECT prompt_id, count(*) AS n, sum(y) AS s, coalesce(var_samp(y), 0) AS v FROM u GROUP BY ALL),
j AS (SELECT c.*, n, s, v, n - n1 AS n0 FROM c JOIN st USING (prompt_id) WHERE n > n1),
wi AS (SELECT label, sum(n1 * (s1 / n1 - (s - s1) / n0)) / sum(n1) AS within_delta, sqrt(sum(n1 * n1 * v * (1.0 / n1 + 1.0 / n0))) / sum(n1) AS within_se, count(*) AS n_strata,
 CAST(sum(CASE WHEN v > 0 THEN n1 ELSE 0 END) AS BIGINT) AS n_informative FROM j GROUP BY label),
pl AS (SELECT label, count(*) AS n, sum(y) AS s, avg(y) AS mean FROM u GROUP BY label HAVING count(*) >= 5), g AS (SELECT count(*) AS gn, sum(y) AS gs FROM u),
r AS (SELECT pl.label, pl.n, pl.mean, CASE WHEN gn > pl.n THEN pl.mean - (gs - pl.s) / (gn - pl.n) END AS delta, within_delta, within_se, n_strata, n_informative,
 CASE WHEN within_se > 0 THEN within_delta / within_se END AS z FROM pl CROSS JOIN g LEFT JOIN wi USING (label)),
rp AS (SELECT *, {normal_p_('z')} AS p0 FROM r), rq AS (SELECT * EXCLUDE (p0), CASE WHEN z IS NOT NULL THEN p0 END AS p FROM rp)
SELECT label, n, round(mean, 6) AS mean, round(delta, 6) AS delta, round(within_delta, 6) AS within_delta, round(within_se, 6) AS within_se, n_strata, n_informative, round(z, 6) AS z, round(p, 6) AS p, round(q, 6) AS q
FROM {bh_('rq', 'p', 'label')}"""
)
def label_rank_within(spark, d):
    a = _outcome_labels(spark, d)
    return rounded(outcome.rank_labels(a, "label", "prompt_id", "y", ["prompt_id", "cell_key"], 5))


@query(
    f"""WITH {OUT}, st AS (SELECT prompt_id, count(*) AS n, min(y) AS lo, max(y) AS hi FROM o WHERE label <> '' GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS strata, CAST(sum(CAST(lo < hi AS INT)) AS BIGINT) AS varying, (SELECT count(DISTINCT persona_id) FROM o WHERE label <> '') AS persons FROM st"""
)
def design_diagnostics(spark, d):
    return outcome.design_diagnostics(_outcome_labels(spark, d), "prompt_id", "persona_id", "y")


@query(
    f"""WITH {OUT}, v AS (SELECT prompt_id, cell_key, max(y) AS y FROM o WHERE label <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY y, cell_key) / count(*) OVER (PARTITION BY prompt_id) AS share FROM v),
k AS (SELECT prompt_id, count(DISTINCT y) AS k FROM v GROUP BY ALL)
SELECT prompt_id, cell_key, CASE WHEN k >= 3 THEN CASE WHEN share <= 1.0 / 3 THEN 'low' WHEN share <= 2.0 / 3 THEN 'mid' ELSE 'high' END END AS tercile FROM r JOIN k USING (prompt_id)"""
)
def tercile_within(spark, d):
    v = _outcome_labels(spark, d).groupBy("prompt_id", "cell_key").agg(F.max("y").alias("y"))
    return outcome.within_terciles(v, "prompt_id", "y", "cell_key").select("prompt_id", "cell_key", "tercile")


ATT = f"""{T}, {S}, {A}, lb AS (SELECT cell_key, persona_type, persona_id, prompt_id, prompt_type, {label_('assumption')} AS label FROM a WHERE assumption IS NOT NULL),
pc AS (SELECT persona_type, persona_id, prompt_id, avg(outcome_logit) AS v FROM sc GROUP BY ALL), pp AS (SELECT persona_type, persona_id, avg(outcome_logit) AS v FROM sc GROUP BY ALL),
ja AS (SELECT lb.*, pc.v AS cv, pc.prompt_id IS NOT NULL AS cm, pp.v AS pv FROM lb LEFT JOIN pc USING (persona_type, persona_id, prompt_id) LEFT JOIN pp ON lb.persona_type = pp.persona_type AND lb.persona_id = pp.persona_id WHERE label <> ''),
o AS (SELECT prompt_id, prompt_type, cell_key, persona_id, label, CASE WHEN (SELECT avg(CAST(cm AS INT)) > 0 FROM ja) THEN cv ELSE pv END AS y FROM ja), oy AS (SELECT * FROM o WHERE y IS NOT NULL)"""


def _scored_labels(spark: SparkSession, d: str) -> DataFrame:
    """Normalised labels with their cell's paired outcome, joined by cell or else by person."""
    a = _assumptions(spark, d).filter("assumption is not null").withColumn("label", normalize_label(F.col("assumption"))).filter("label <> ''")
    keys = ["persona_type", "persona_id"]
    return outcome.attach_scores(a, _scores(spark, d), "outcome_logit", [*keys, "prompt_id"], keys).withColumn("y", F.col("outcome_logit"))


@query(
    f"""WITH {ATT}, u AS (SELECT prompt_id, cell_key, label, avg(y) AS y FROM oy GROUP BY ALL), c AS (SELECT label, prompt_id, count(*) AS n1, sum(y) AS s1 FROM u GROUP BY ALL),
st AS (SELECT prompt_id, count(*) AS n, sum(y) AS s, coalesce(var_samp(y), 0) AS v FROM u GROUP BY ALL), j AS (SELECT c.*, n, s, v, n - n1 AS n0 FROM c JOIN st USING (prompt_id) WHERE n > n1),
wi AS (SELECT label, sum(n1 * (s1 / n1 - (s - s1) / n0)) / sum(n1) AS within_delta, sqrt(sum(n1 * n1 * v * (1.0 / n1 + 1.0 / n0))) / sum(n1) AS within_se, count(*) AS n_strata,
 CAST(sum(CASE WHEN v > 0 THEN n1 ELSE 0 END) AS BIGINT) AS n_informative FROM j GROUP BY label),
pl AS (SELECT label, count(*) AS n, sum(y) AS s, avg(y) AS mean FROM u GROUP BY label), g AS (SELECT count(*) AS gn, sum(y) AS gs FROM u)
SELECT pl.label, pl.n, round(pl.mean, 5) AS mean, round(CASE WHEN gn > pl.n THEN pl.mean - (gs - pl.s) / (gn - pl.n) END, 5) AS delta, round(within_delta, 5) AS within_delta, round(within_se, 5) AS within_se, n_strata, n_informative
FROM pl CROSS JOIN g LEFT JOIN wi USING (label)"""
)
def label_outcome_rank(spark, d):
    """Labels by the paired outcome of the cells that they were stated in."""
    out = outcome.rank_labels(_scored_labels(spark, d), "label", "prompt_id", "y", ["prompt_id", "cell_key"], 1).drop("z", "p", "q")
    return out.withColumns({c: F.round(c, 5) for c in ("mean", "delta", "within_delta", "within_se")})


@query(
    f"""WITH {ATT}, st AS (SELECT prompt_id, count(*) AS n, min(y) AS lo, max(y) AS hi FROM oy GROUP BY ALL)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, count(*) AS strata, CAST(coalesce(sum(CAST(lo < hi AS INT)), 0) AS BIGINT) AS varying, (SELECT count(DISTINCT persona_id) FROM oy) AS persons FROM st"""
)
def outcome_diagnostics(spark, d):
    return outcome.design_diagnostics(_scored_labels(spark, d), "prompt_id", "persona_id", "y")


@query(f"WITH {ATT} SELECT cell_key, label, round(y, 6) AS y FROM oy")
def scored_assumptions(spark, d):
    """Assumptions restricted to cells with an outcome (a semi join to the scored rows)."""
    a = _scored_labels(spark, d).select("cell_key", "label", "y").filter("y is not null")
    return rounded(a)


# ---- attempts -----------------------------------------------------------------------------
LOG = "l AS (SELECT DISTINCT * FROM attempt_log), k AS (SELECT *, coalesce(error, '') = '' AND trim(coalesce(raw, '')) <> '' AS ok FROM l)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attempt_log").distinct()


@query(
    f"WITH {LOG} SELECT cell_key, seq, ok, error FROM (SELECT *, row_number() OVER (PARTITION BY cell_key ORDER BY ok DESC, seq DESC) AS r FROM k) WHERE r = 1"
)
def attempt_canonical(spark, d):
    ok = attempts.succeeded(F.col("error"), F.col("raw"))
    lean = _log(spark, d).select("cell_key", "seq", "error", "raw")
    kept = attempts.latest_success(lean, "cell_key", "seq", ok)
    return kept.select("cell_key", "seq", ok.alias("ok"), "error")


@query(
    f"""WITH {LOG}, c AS (SELECT cell_key, count(*) AS n FROM k GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS attempts, count(*) AS cells, CAST(sum(CAST(n > 1 AS INT)) AS BIGINT) AS retried, CAST(sum(n - 1) AS BIGINT) AS extra FROM c"""
)
def attempt_diagnostics(spark, d):
    return attempts.attempt_counts(_log(spark, d), "cell_key")


@query(
    f"""WITH {LOG} SELECT cell_key, count(*) AS attempts, bool_or(ok) AS completed, arg_max(error, seq) AS last_error, NOT bool_or(ok) AND count(*) >= 2 AS exhausted FROM k GROUP BY cell_key"""
)
def attempt_completion(spark, d):
    return attempts.completion(_log(spark, d), "cell_key", "seq", attempts.succeeded(F.col("error"), F.col("raw")), 2)


@query(
    f"""WITH {LOG}, done AS (SELECT DISTINCT cell_key FROM k WHERE ok) SELECT DISTINCT cell_key FROM k WHERE cell_key NOT IN (SELECT cell_key FROM done)"""
)
def resume_antijoin(spark, d):
    log = _log(spark, d)
    done = log.filter(attempts.succeeded(F.col("error"), F.col("raw")))
    return attempts.remaining(log.select("cell_key").distinct(), done, ["cell_key"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def keep_last_event(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return attempts.keep_last(e, ["user_id"], "event_id")


# ---- descriptives -------------------------------------------------------------------------
@query(
    f"""WITH {A}, c AS (SELECT run_id, probe, persona_type, cell_key, min(parse_status) AS s, max(CAST(has_response AS INT)) AS r FROM a GROUP BY ALL)
SELECT run_id, probe, persona_type, count(*) AS cells, round(avg(CAST(s IN ('clean', 'repaired', 'salvaged') AS INT)), 6) AS parsed, round(avg(CAST(s = 'clean' AS INT)), 6) AS clean, round(avg(r), 6) AS reply FROM c GROUP BY ALL"""
)
def health(spark, d):
    return rounded(describe.health(_assumptions(spark, d)))


@query(
    f"""WITH {A}, f AS (SELECT run_id, probe, persona_type, {label_('assumption')} AS label FROM a WHERE rank = 1),
n AS (SELECT run_id, probe, persona_type, label, count(*) AS n FROM f WHERE label <> '' GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY run_id, probe, persona_type) AS share, row_number() OVER (PARTITION BY run_id, probe, persona_type ORDER BY n DESC, label) AS r FROM n)
SELECT s.run_id, s.probe, s.persona_type, s.label, s.n, round(s.share, 6) AS share, round(c.share, 6) AS control_share, round(s.share / c.share, 6) AS lift
FROM s LEFT JOIN s c ON c.persona_type = 'none' AND c.run_id = s.run_id AND c.probe = s.probe AND c.label = s.label WHERE s.r <= 3"""
)
def top_label_lift(spark, d):
    return rounded(describe.top_labels(_assumptions(spark, d), 3, 1))


@query(
    f"""WITH {A}, c AS (SELECT run_id, probe, persona_type, prompt_type, cell_key, max(probability_norm) AS top, coalesce(-sum(CASE WHEN probability_norm > 0 THEN probability_norm * log2(probability_norm) END), 0) AS e FROM a GROUP BY ALL)
SELECT run_id, probe, persona_type, prompt_type, count(*) AS cells, round(avg(top), 6) AS top1_mass, round(avg(e), 6) + 0.0 AS entropy_bits FROM c GROUP BY ALL"""
)
def confidence_entropy(spark, d):
    return rounded(describe.confidence(_assumptions(spark, d))).withColumn("entropy_bits", F.col("entropy_bits") + 0.0)


@query(
    f"""WITH {A}, f AS (SELECT *, {label_('assumption')} AS label FROM a WHERE rank = 1),
w AS (SELECT run_id, probe, persona_type, persona_id, prompt_id, rep, min(CASE WHEN prompt_type = 'original_post' THEN label END) AS o, min(CASE WHEN prompt_type = 'flipped_story' THEN label END) AS g FROM f WHERE label <> '' GROUP BY ALL)
SELECT run_id, probe, persona_type, count(*) AS pairs, round(avg(CAST(o = g AS INT)), 6) AS unchanged FROM w WHERE o IS NOT NULL AND g IS NOT NULL GROUP BY ALL"""
)
def framing_flip(spark, d):
    return rounded(describe.framing_flip(_assumptions(spark, d), 1))


@query(
    f"""WITH {T}, s AS (SELECT run_id, probe, persona_type, dimension, count(*) AS n_rows, count(score) AS n, avg(score) AS mean, stddev_samp(score) AS sd FROM t GROUP BY ALL)
SELECT s.*, round(s.mean, 6) AS mean, round(s.sd, 6) AS sd, round(c.mean, 6) AS control_mean, round(s.mean - c.mean, 6) AS delta, round(CASE WHEN c.mean > 0 THEN s.mean / c.mean END, 6) AS ratio
FROM (SELECT run_id, probe, persona_type, dimension, n_rows, n FROM s) x JOIN s USING (run_id, probe, persona_type, dimension) LEFT JOIN s c ON c.persona_type = 'none' AND c.run_id = s.run_id AND c.probe = s.probe AND c.dimension = s.dimension""".replace(
        "SELECT s.*, round(s.mean", "SELECT s.run_id, s.probe, s.persona_type, s.dimension, s.n_rows, s.n, round(s.mean"
    )
)
def structured_scores(spark, d):
    return rounded(describe.structured_scores(_labels(spark, d)))


@query(
    f"""WITH {T}, w AS (SELECT persona_type, persona_id, prompt_id, teacher, dimension, avg(CASE WHEN prompt_type = 'original_post' THEN score END) AS o, avg(CASE WHEN prompt_type = 'flipped_story' THEN score END) AS g FROM t WHERE score IS NOT NULL GROUP BY ALL)
SELECT dimension, count(*) AS pairs, round(avg(abs(g - o)), 6) AS abs_change, round(avg(g - o), 6) AS change, round(covar_samp(o, g) / (stddev_samp(o) * stddev_samp(g)), 6) AS r FROM w WHERE o IS NOT NULL AND g IS NOT NULL GROUP BY ALL"""
)
def structured_flip(spark, d):
    return rounded(describe.structured_flip(_labels(spark, d), ["persona_type", "persona_id", "prompt_id", "teacher"]))


@query(
    f"""WITH {A}, c AS (SELECT persona_type, cell_key, parse_status, sum(probability) AS total, count(probability) AS k FROM a GROUP BY ALL)
SELECT persona_type, parse_status, count(*) AS cells, round(avg(total), 6) AS prob_sum, round(stddev_samp(total), 6) AS prob_sum_sd, round(avg(k), 6) AS n_probabilities FROM c GROUP BY ALL"""
)
def parse_report(spark, d):
    return rounded(describe.parse_report(_assumptions(spark, d)))


PROFILE = ["lang", "source", "kind", "n_chars"]


@query(
    "WITH x AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM documents" for c in PROFILE)
    + """), l AS (SELECT "column", value, count(*) AS n FROM x GROUP BY ALL), p AS (SELECT "column", CAST(sum(CASE WHEN value IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS filled, count(value) AS levels,
 CAST(sum(CAST(n >= 20 AND value IS NOT NULL AS INT)) AS BIGINT) AS large_levels FROM l GROUP BY ALL)
SELECT *, CASE WHEN levels < 2 THEN 'constant' WHEN levels > 50 THEN 'too many levels' WHEN large_levels < 2 THEN 'levels too small' END AS reason, reason IS NULL AS usable FROM p"""
)
def column_profile(spark, d):
    return describe.column_profile(table(spark, d, "documents"), PROFILE, 50, 20)


@query("SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY lang) >= 20 THEN lang END AS lang FROM documents")
def collapse_levels(spark, d):
    return describe.collapse_levels(table(spark, d, "documents").select("doc_id", "lang"), "lang", 20)


@query(
    "SELECT 'probe' AS \"column\", count(DISTINCT probe) <= 1 AS \"constant\" FROM parsed_probes UNION ALL SELECT 'run_id', count(DISTINCT run_id) <= 1 FROM parsed_probes UNION ALL SELECT 'status', count(DISTINCT status) <= 1 FROM parsed_probes"
)
def constant_columns(spark, d):
    return describe.constant_columns(table(spark, d, "parsed_probes"), ["probe", "run_id", "status"])


@query(
    "SELECT kind, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS total, round(avg(length(coalesce(text, ''))), 6) AS mean, round(quantile_cont(CAST(length(coalesce(text, '')) AS DOUBLE), 0.95), 6) AS p95, CAST(max(length(coalesce(text, ''))) AS DOUBLE) AS top FROM documents GROUP BY kind"
)
def length_census(spark, d):
    docs = table(spark, d, "documents").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    return rounded(describe.census(docs, "n", ["kind"]))


@query(
    f"""WITH {A}, m AS (SELECT run_id, persona_type, avg(probability_norm) AS metric FROM a GROUP BY ALL) SELECT run_id, persona_type, round(metric, 6) AS metric, round(metric / avg(metric) OVER (PARTITION BY run_id) - 1, 6) AS deviation FROM m"""
)
def facet_deviation(spark, d):
    m = _assumptions(spark, d).groupBy("run_id", "persona_type").agg(F.avg("probability_norm").alias("metric"))
    return rounded(describe.facet_deviation(m, "run_id", "persona_type", "metric"))


@query(
    f"""WITH {A}, m AS (SELECT run_id, persona_type, avg(probability_norm) AS v FROM a GROUP BY ALL), x AS (SELECT *, v > avg(v) OVER (PARTITION BY run_id) AS above FROM m WHERE v IS NOT NULL)
SELECT persona_type, bool_and(above) AS all_models, bool_or(above) AS any_model, round(min(v), 6) AS least, round(max(v), 6) AS most, count(DISTINCT run_id) AS models FROM x GROUP BY ALL"""
)
def facet_verdicts(spark, d):
    m = _assumptions(spark, d).groupBy("run_id", "persona_type").agg(F.avg("probability_norm").alias("v")).filter("v is not null")
    m = m.withColumn("above", F.col("v") > F.avg("v").over(W.partitionBy("run_id")))
    return rounded(describe.verdicts(m, ["persona_type"], "run_id", F.col("above"), "v"))


@query("WITH m AS (SELECT alias, count(*) AS n_rows FROM parsed_probes GROUP BY ALL) SELECT alias, n_rows, max(n_rows) OVER () AS full_rows, n_rows < max(n_rows) OVER () AS partial FROM m")
def partial_grids(spark, d):
    return describe.partial_grids(table(spark, d, "parsed_probes"), "alias")


# ---- terms --------------------------------------------------------------------------------
STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOPWORDS) + "]"
ECHO = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in text.PROMPT_ECHO) + "]"
BREAKS_SQL = text.BREAKS.replace("'", "''")


def grams_(src: str, keys: str, n: int, stop: bool) -> str:
    """CTEs that end in g(keys, row, term): distinct n-grams of the column ``txt`` of ``src``."""
    ban = f"list_concat({STOP}, {ECHO})" if stop else ECHO
    toks = f"list_filter(regexp_extract_all(seg, '[a-z0-9]+(?:''[a-z]+)?'), lambda x: NOT list_contains({ban}, x))"
    gram = " || ' ' || ".join(f"k[i + {j}]" for j in range(n))
    return f"""s0 AS (SELECT {keys}, row_number() OVER () AS rid, txt FROM {src}),
s1 AS (SELECT {keys}, rid, unnest(regexp_split_to_array(replace(lower(coalesce(txt, '')), '’', ''''), '{BREAKS_SQL}')) AS seg FROM s0),
s2 AS (SELECT {keys}, rid, {toks} AS k FROM s1), s3 AS (SELECT {keys}, rid, k, unnest(range(1, len(k) - {n} + 2)) AS i FROM s2 WHERE len(k) >= {n}),
g AS (SELECT DISTINCT {keys}, rid, {gram} AS term FROM s3)"""


def shares_(n: int, stop: bool, least: int) -> str:
    return f"""WITH {A}, src AS (SELECT persona_type, cell_key, concat_ws('. ', coalesce(assumption, ''), coalesce(description, '')) AS txt FROM a), {grams_('src', 'persona_type, cell_key', n, stop)},
tt AS (SELECT persona_type, count(*) AS rt, count(DISTINCT cell_key) AS ct FROM src GROUP BY ALL),
c AS (SELECT persona_type, term, count(*) AS n_rows, count(DISTINCT cell_key) AS n_cells FROM g GROUP BY ALL), o AS (SELECT c.*, n_rows / rt AS rs, n_cells / ct AS cs FROM c JOIN tt USING (persona_type))
SELECT o.persona_type, o.term, o.n_rows, o.n_cells, round(o.rs, 6) AS row_share, round(o.cs, 6) AS cell_share, round(b.rs, 6) AS control_share, round(o.rs / b.rs, 6) AS lift
FROM o LEFT JOIN o b ON b.persona_type = 'none' AND b.term = o.term WHERE o.n_rows >= {least}"""


def _texted(spark: SparkSession, d: str) -> DataFrame:
    return _assumptions(spark, d).withColumn("txt", text.label_text(F.col("assumption"), F.col("description")))


def _shares(spark: SparkSession, d: str, n: int, least: int) -> DataFrame:
    out = terms.ngram_shares(_texted(spark, d), "cell_key", "persona_type", "txt", n, "unigrams", least)
    return rounded(out.drop("rows_total", "cells_total"))


@query(shares_(1, True, 3))
def unigram_shares(spark, d):
    return _shares(spark, d, 1, 3)


@query(shares_(2, False, 3))
def bigram_shares(spark, d):
    return _shares(spark, d, 2, 3)


@query(
    f"""WITH {A}, src AS (SELECT persona_type, prompt_type, assumption AS txt FROM a), {grams_('src', 'persona_type, prompt_type', 1, True)}
SELECT term, persona_type, prompt_type, count(*) AS n, CAST(grouping(term, persona_type, prompt_type) AS BIGINT) AS level FROM g GROUP BY GROUPING SETS ((term), (term, persona_type), (term, prompt_type), (term, persona_type, prompt_type))"""
)
def ngram_grouping_sets(spark, d):
    return terms.ngram_grouping_sets(_assumptions(spark, d), "assumption", 1, "persona_type", "prompt_type")


@query(
    f"""WITH {A} SELECT run_id, count(*) AS n_rows, count(DISTINCT cell_key) AS cells, count(DISTINCT CASE WHEN {label_('assumption')} <> '' THEN {label_('assumption')} END) AS labels,
 round(avg(len(regexp_extract_all(lower(coalesce(description, '')), '[a-z]+'))), 6) AS tokens FROM a GROUP BY ALL"""
)
def corpus_profile(spark, d):
    a = _assumptions(spark, d).withColumn("label", normalize_label(F.col("assumption")))
    return rounded(terms.corpus_profile(a, ["run_id"], "cell_key", "label", "description"))


def word_z_(n: str, own: str, rest: str, others: str, prior: str) -> str:
    a0 = f"greatest({prior}, 1)"
    a1, a2 = f"({n} + {a0})", f"({rest} + {a0})"
    return f"(ln({a1} / ({own} - {a1})) - ln({a2} / ({others} - {a2}))) / sqrt(1.0 / {a1} + 1.0 / {a2})"


@query(
    f"""WITH {A}, w AS (SELECT persona_type, unnest(regexp_extract_all(lower(coalesce(description, '')), '[a-z]+')) AS term FROM a), c AS (SELECT persona_type, term, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY ALL),
pr AS (SELECT term, sum(n) AS prior FROM c GROUP BY ALL), ow AS (SELECT persona_type, sum(n) AS own FROM c GROUP BY ALL), al AS (SELECT sum(prior) AS tokens, sum(greatest(prior, 1)) AS mass FROM pr)
SELECT persona_type, term, CAST(n AS BIGINT) AS n, CAST(prior AS BIGINT) AS prior, round({word_z_('n', '(own + mass)', '(prior - n)', '(tokens - own + mass)', 'prior')}, 6) AS z FROM c JOIN pr USING (term) JOIN ow USING (persona_type), al WHERE prior >= 10"""
)
def logodds_contrast(spark, d):
    return rounded(terms.group_contrasts(_assumptions(spark, d), "persona_type", "description", 10))


@query(
    f"""WITH {A}, r AS (SELECT DISTINCT prompt_id, prompt_type, {label_('assumption')} AS label FROM a WHERE rank = 1), rl AS (SELECT * FROM r WHERE label <> ''),
pt AS (SELECT {c_('prompt_id')} AS prompt_id, prompt_type, max(text) AS txt FROM prompts WHERE text IS NOT NULL GROUP BY ALL),
w AS (SELECT prompt_id, prompt_type, unnest(regexp_extract_all(lower(txt), '[a-z]+')) AS term FROM pt), wc AS (SELECT prompt_id, prompt_type, term, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY ALL),
tg AS (SELECT label, term, sum(n) AS n FROM rl JOIN wc USING (prompt_id, prompt_type) GROUP BY ALL), pr AS (SELECT term, sum(n) AS prior FROM wc GROUP BY ALL), ow AS (SELECT label, sum(n) AS own FROM tg GROUP BY ALL),
al AS (SELECT sum(prior) AS tokens, sum(greatest(prior, 1)) AS mass FROM pr), z AS (SELECT label, term, n, prior, {word_z_('n', '(own + mass)', '(prior - n)', '(tokens - own + mass)', 'prior')} AS z FROM tg JOIN pr USING (term) JOIN ow USING (label), al WHERE n >= 3)
SELECT label, term, CAST(n AS BIGINT) AS n, CAST(prior AS BIGINT) AS prior, round(z, 6) AS z FROM z WHERE z > 1.96"""
)
def marked_words(spark, d):
    a = _assumptions(spark, d).filter("rank = 1").withColumn("label", normalize_label(F.col("assumption"))).filter("label <> ''")
    t = clean_keys(table(spark, d, "prompts")).filter("text is not null").groupBy("prompt_id", "prompt_type").agg(F.max("text").alias("text"))
    return rounded(terms.marked_words(a, t, ["prompt_id", "prompt_type"], "label", "text", 3))


@query(
    f"""WITH {A}, v AS (SELECT probability_norm AS p, description FROM a WHERE probability_norm IS NOT NULL AND description IS NOT NULL), q AS (SELECT quantile_cont(p, 1 / 3.0) AS lo, quantile_cont(p, 2 / 3.0) AS hi FROM v),
sd AS (SELECT CASE WHEN p <= lo THEN 'low' WHEN p > hi THEN 'high' END AS side, description FROM v, q), w AS (SELECT side, unnest(regexp_extract_all(lower(description), '[a-z]+')) AS term FROM sd WHERE side IS NOT NULL), c AS (SELECT side, term, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY ALL),
pr AS (SELECT term, sum(n) AS prior FROM c GROUP BY ALL), ow AS (SELECT side, sum(n) AS own FROM c GROUP BY ALL), al AS (SELECT sum(prior) AS tokens, sum(greatest(prior, 1)) AS mass FROM pr)
SELECT side, term, CAST(n AS BIGINT) AS n, CAST(prior AS BIGINT) AS prior, round({word_z_('n', '(own + mass)', '(prior - n)', '(tokens - own + mass)', 'prior')}, 6) AS z FROM c JOIN pr USING (term) JOIN ow USING (side), al WHERE prior >= 10"""
)
def tercile_words(spark, d):
    """Words of well and badly scored explanations (quantile cuts, then the word contrast)."""
    a = _assumptions(spark, d).filter("probability_norm is not null and description is not null")
    return rounded(terms.tercile_words(a, "probability_norm", "description", 10))


# ---- topics -------------------------------------------------------------------------------
TOP = f"""{A}, tp AS (SELECT *, {label_('assumption')} AS label FROM a WHERE assumption IS NOT NULL), tk AS (SELECT *, regexp_extract(label, '^[a-z0-9]+') AS topic FROM tp WHERE label <> '')"""


def _topics(spark: SparkSession, d: str) -> DataFrame:
    """A given assignment for the topic statistics: the first word of the label."""
    a = _assumptions(spark, d).filter("assumption is not null").withColumn("label", normalize_label(F.col("assumption"))).filter("label <> ''")
    return a.withColumn("topic", F.regexp_extract("label", "^[a-z0-9]+", 0))


@query(
    f"""WITH {TOP}, c AS (SELECT topic, label, count(*) AS c FROM tk GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY c DESC, label) AS r FROM c),
s AS (SELECT topic, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY ALL), e AS (SELECT topic, string_agg(label, ' | ' ORDER BY r) AS examples FROM r WHERE r <= 3 GROUP BY ALL)
SELECT topic, n, round(n / sum(n) OVER (), 6) AS share, examples FROM s LEFT JOIN e USING (topic)"""
)
def topic_info(spark, d):
    return rounded(topics.topic_info(_topics(spark, d), "topic", "label"))


SHARES = f"{TOP}, n0 AS (SELECT run_id, persona_type, topic, count(*) AS n FROM tk GROUP BY ALL), sh AS (SELECT *, n / sum(n) OVER (PARTITION BY run_id, persona_type) AS share FROM n0)"


@query(
    f"""WITH {SHARES} SELECT s.run_id, s.persona_type, s.topic, s.n, round(s.share, 6) AS share, round(b.share, 6) AS control_share, round(s.share / b.share, 6) AS lift FROM sh s LEFT JOIN sh b ON b.persona_type = 'none' AND b.run_id = s.run_id AND b.topic = s.topic"""
)
def topic_shares(spark, d):
    return rounded(topics.topic_shares(_topics(spark, d), "topic", ["run_id"], "persona_type"))


@query(f"WITH {SHARES} SELECT run_id, persona_type, count(*) AS topics, round(-sum(share * log2(share)), 6) + 0.0 AS bits FROM sh GROUP BY ALL")
def topic_entropy(spark, d):
    s = topics.topic_shares(_topics(spark, d), "topic", ["run_id"], "persona_type")
    return rounded(topics.topic_entropy(s, ["run_id", "persona_type"])).withColumn("bits", F.col("bits") + 0.0)


@query(
    f"""WITH {TOP}, c AS (SELECT topic, prompt_id, CAST(count(*) AS DOUBLE) AS c FROM tk GROUP BY ALL)
SELECT topic, round(CASE WHEN count(*) > 1 THEN (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(count(*)) ELSE 0 END, 6) AS spread, count(*) AS items FROM c GROUP BY ALL"""
)
def topic_spread(spark, d):
    return rounded(topics.topic_spread(_topics(spark, d), "topic", "prompt_id"))


@query(
    f"""WITH {TOP}, x AS (SELECT topic, unnest(regexp_extract_all(lower(coalesce(description, '')), '[a-z]+')) AS term FROM tk), tf AS (SELECT topic, term, count(*) AS tf FROM x GROUP BY ALL), sz AS (SELECT topic, sum(tf) AS size FROM tf GROUP BY ALL),
m AS (SELECT avg(size) AS mean FROM sz), al AS (SELECT term, sum(tf) AS alln FROM tf GROUP BY ALL), w AS (SELECT topic, term, tf / size * ln(1 + mean / alln) AS weight FROM tf JOIN sz USING (topic) JOIN al USING (term), m),
wr AS (SELECT *, round(weight, 9) AS w9 FROM w) SELECT topic, term, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS INT) AS rank FROM wr QUALIFY rank <= 5"""
)
def class_terms(spark, d):
    t = _topics(spark, d).withColumn("w", text.bare_words(F.col("description")))
    return rounded(topics.class_term_weights(t, "topic", "w", 5), "weight")


@query(
    f"""WITH {TOP} SELECT cell_key, topic, count(*) AS n FROM tk GROUP BY ALL"""
)
def topic_indicators(spark, d):
    return topics.topic_indicators(_topics(spark, d), "cell_key", "topic")


@query()
def topic_model(spark, d):
    """Cluster topics of the response vectors (k-means stand-in), with their sizes."""
    rows = topics.fit_topics(table(spark, d, "response_vectors"), "vec_id", "vector", 12, seed=5)
    return rows.groupBy("topic").agg(F.count("*").alias("n"))


@query(
    f"""WITH {A}, x AS (SELECT DISTINCT cell_key, rank, {label_('assumption')} AS label, probability_norm FROM a WHERE rank IS NOT NULL)
SELECT cell_key, count(*) AS n, round(max(probability_norm), 6) AS top_mass, list_extract(list(label ORDER BY rank, label), 1) AS first_label, list_sort(list_distinct(list(label) FILTER (label <> ''))) AS labels FROM x GROUP BY ALL"""
)
def response_table(spark, d):
    a = _assumptions(spark, d).filter("rank is not null").select("cell_key", "rank", normalize_label(F.col("assumption")).alias("label"), "probability_norm").distinct()
    return rounded(a.groupBy("cell_key").agg(
        F.count("*").alias("n"), F.max("probability_norm").alias("top_mass"), F.min(F.struct("rank", "label"))["label"].alias("first_label"), F.array_sort(F.collect_set(F.when(F.col("label") != "", F.col("label")))).alias("labels")
    ), "top_mass")


# ---- vectors ------------------------------------------------------------------------------
EMB = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), un AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM e)"
DIM = 64


@query(
    f"""WITH {EMB}, x AS (SELECT label, unnest(range(1, 65)) AS i, u FROM un), s AS (SELECT label, i, sum(u[i]) AS s, count(*) AS n FROM x GROUP BY ALL), g AS (SELECT label, any_value(n) AS n, sum(s * s) AS t FROM s GROUP BY ALL)
SELECT label, n, round(n * (n - 1) / 2.0, 6) AS pairs, round(1 - (t - n) / (n * (n - 1.0)), 6) AS distance FROM g WHERE n >= 2"""
)
def group_distance(spark, d):
    return rounded(vectors.group_distance(table(spark, d, "embeddings"), ["label"], "embedding", DIM))


@query(
    f"""WITH {EMB}, x AS (SELECT label, unnest(range(1, 65)) AS i, u FROM un), s AS (SELECT label, i, sum(u[i]) AS s, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT label, sqrt(sum(s * s)) AS l FROM s GROUP BY ALL)
SELECT label, any_value(n) AS n, list(round(s / l, 5) ORDER BY i) AS mean_vector FROM s JOIN t USING (label) GROUP BY label"""
)
def mean_vectors(spark, d):
    out = vectors.mean_vectors(table(spark, d, "embeddings"), ["label"], "embedding", DIM)
    return out.withColumn("mean_vector", F.transform("mean_vector", lambda x: F.round(x, 5)))


@query(
    f"""WITH {EMB}, c AS (SELECT vec_id % 50 AS g, u FROM un WHERE label = 0 QUALIFY row_number() OVER (PARTITION BY vec_id % 50 ORDER BY vec_id) = 1), b AS (SELECT vec_id % 50 AS g, vec_id, u FROM un WHERE label <> 0)
SELECT b.vec_id, round(1 - list_dot_product(b.u, c.u), 6) AS distance FROM b JOIN c USING (g)"""
)
def cosine_to_control(spark, d):
    e = table(spark, d, "embeddings").withColumn("g", F.col("vec_id") % 50)
    first = e.filter("label = 0").groupBy("g").agg(F.min("vec_id").alias("vec_id"))
    kept = e.filter("label <> 0").unionByName(e.filter("label = 0").join(first, ["g", "vec_id"], "left_semi"))
    return rounded(vectors.distance_to_control(kept, ["g"], "embedding", F.col("label") == 0).select("vec_id", "distance"))


#: Usable response vectors by cleaned keys, as unit vectors.
RV = f"""rv AS (SELECT vec_id, model, {p_('persona_type')} AS persona_type, {c_('prompt_id')} AS prompt_id, prompt_type, assumption, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM response_vectors
 WHERE vector IS NOT NULL AND len(vector) > 0 AND NOT list_bool_or(list_transform(vector, lambda x: isnan(x)))), ru AS (SELECT * EXCLUDE (v), list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM rv WHERE list_sum(list_transform(v, lambda x: x * x)) > 0)"""


def _responses(spark: SparkSession, d: str) -> DataFrame:
    return clean_keys(table(spark, d, "response_vectors"))


@query(
    f"""WITH {RV}, cx AS (SELECT model, prompt_type, prompt_id, i, avg(u[i]) AS x FROM ru, (SELECT unnest(range(1, 97)) AS i) WHERE persona_type = 'none' GROUP BY ALL), cc AS (SELECT model, prompt_type, prompt_id, list(x ORDER BY i) AS c FROM cx GROUP BY ALL)
SELECT vec_id, round(1 - list_dot_product(u, c) / sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) AS distance FROM ru JOIN cc USING (model, prompt_type, prompt_id) WHERE persona_type <> 'none'"""
)
def distance_to_control(spark, d):
    """How far each response is from the mean control response of its model and prompt."""
    out = vectors.distance_to_control(_responses(spark, d), ["model", "prompt_type", "prompt_id"], "vector", F.col("persona_type") == CONTROL)
    return rounded(out.select("vec_id", "distance"))


@query(
    f"""WITH {RV}, w AS (SELECT *, greatest(1.0 - vec_id % 5, 0) AS wt FROM ru), x AS (SELECT model, prompt_type, unnest(range(1, 97)) AS i, u, wt FROM w), s AS (SELECT model, prompt_type, i, count(*) AS n, sum(wt) AS sw, sum(wt * u[i]) AS a, sum(u[i]) AS b FROM x GROUP BY ALL),
m AS (SELECT model, prompt_type, i, n, CASE WHEN sw > 0 THEN a ELSE b END AS m FROM s), l AS (SELECT model, prompt_type, sqrt(sum(m * m)) AS l FROM m GROUP BY ALL)
SELECT model, prompt_type, any_value(n) AS n, list(round(m / l, 5) ORDER BY i) AS mean_vector FROM m JOIN l USING (model, prompt_type) GROUP BY ALL"""
)
def weighted_vectors(spark, d):
    """Weighted mean response per model and framing; rows of weight 0 or less do not count."""
    rows = _responses(spark, d).withColumn("weight", 1.0 - F.col("vec_id") % 5)
    out = vectors.mean_vectors(rows, ["model", "prompt_type"], "vector", 96, "weight")
    return out.withColumn("mean_vector", F.transform("mean_vector", lambda x: F.round(x, 5)))


@query(
    f"""WITH {RV}, x AS (SELECT persona_type, prompt_type, model, unnest(range(1, 97)) AS i, u FROM ru), s AS (SELECT persona_type, prompt_type, model, i, sum(u[i]) AS s, count(*) AS n FROM x GROUP BY ALL),
g AS (SELECT persona_type, prompt_type, model, any_value(n) AS n, sum(s * s) AS t FROM s GROUP BY ALL HAVING any_value(n) >= 2), d AS (SELECT persona_type, n * (n - 1) / 2.0 AS w, 1 - (t - n) / (n * (n - 1.0)) AS d FROM g)
SELECT persona_type, round(sum(w * d) / sum(w), 6) AS distance, round(sum(w), 6) AS pairs, count(*) AS groups FROM d GROUP BY ALL"""
)
def pooled_distance(spark, d):
    """Mean pairwise distance per facet, pooled over models and framings by their pairs."""
    per = vectors.group_distance(_responses(spark, d), ["persona_type", "prompt_type", "model"], "vector", 96)
    return rounded(vectors.pooled(per, ["persona_type"], "distance", "pairs"))


@query()
def ridge_probe(spark, d):
    """Held-out metrics of a ridge probe on embeddings, trained on four fifths by hash."""
    e = table(spark, d, "embeddings").withColumn("y", (F.col("label") == 0).cast("double"))
    test = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    model = vectors.ridge(e.filter(~test), "embedding", "y", DIM, 1.0)
    return rounded(probes.regression_metrics(vectors.predict(e.filter(test), "embedding", model), [], "y", "prediction"))


@query()
def logistic_probe(spark, d):
    """Held-out AUC of a balanced logistic probe on embeddings."""
    e = table(spark, d, "embeddings").withColumn("y", F.col("label") == 0)
    test = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    model = probes.fit_logistic(e.filter(~test), "embedding", "y")
    return probes.auc(vectors.predict(e.filter(test), "embedding", model), [], "prediction", "y")


# ---- inference ----------------------------------------------------------------------------
BLOCK = f"{A}, bl AS (SELECT run_id, prompt_type, persona_type, avg(probability_norm) AS y FROM a WHERE persona_type <> 'none' AND probability_norm IS NOT NULL GROUP BY ALL), b0 AS (SELECT persona_type || '|' || run_id AS block, prompt_type AS level, y * 100 AS y FROM bl)"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    a = _assumptions(spark, d).filter((F.col("persona_type") != CONTROL) & F.col("probability_norm").isNotNull())
    per = a.groupBy("run_id", "prompt_type", "persona_type").agg((F.avg("probability_norm") * 100).alias("y"))
    return per.select(F.concat_ws("|", "persona_type", "run_id").alias("block"), F.col("prompt_type").alias("level"), "y")


def scored_(src: str) -> str:
    return f"""(SELECT *, CASE WHEN null_sd > 1e-12 AND expected >= 5 THEN {normal_p_('z')} END AS p FROM (SELECT *, CASE WHEN null_sd > 1e-12 THEN (observed - expected) / null_sd END AS z FROM {src}))"""


@query(
    f"""WITH {BLOCK}, f AS (SELECT block FROM b0 GROUP BY 1 HAVING count(*) = 2 AND count(DISTINCT level) = 2), r AS (SELECT * FROM b0 WHERE block IN (SELECT block FROM f)),
m AS (SELECT avg(y) AS m, var_pop(y) AS v FROM r GROUP BY block), nl AS (SELECT count(*) AS blocks, sum(m) AS expected, sqrt(sum(v)) AS null_sd FROM m), o AS (SELECT level, sum(y) AS observed, any_value(blocks) AS blocks, any_value(expected) AS expected, any_value(null_sd) AS null_sd FROM r, nl GROUP BY level)
SELECT level, round(observed, 6) AS observed, blocks, round(expected, 6) AS expected, round(null_sd, 6) AS null_sd, round(z, 6) AS z, round(p, 6) AS p FROM {scored_('o')}"""
)
def blocked_perm_closed(spark, d):
    return rounded(inference.blocked_null(_blocks(spark, d), "block", "level", "y", 2))


@query()
def blocked_perm_draws(spark, d):
    """Monte-Carlo p of the same test, 500 draws."""
    return inference.blocked_draws(_blocks(spark, d), "block", "level", "y", 2, 500, 7)


@query(
    f"""WITH {A}, r AS (SELECT prompt_type AS stratum, persona_type AS level, probability_norm AS y FROM a WHERE probability_norm IS NOT NULL), s AS (SELECT stratum, count(*) AS N, avg(y) AS m, var_pop(y) AS v FROM r GROUP BY ALL),
c AS (SELECT stratum, level, count(*) AS k, sum(y) AS s FROM r GROUP BY ALL), o AS (SELECT level, CAST(sum(k) AS BIGINT) AS n, sum(s) AS observed, sum(k * m) AS expected, sqrt(sum(CASE WHEN N > 1 THEN k * (N - k) / (N - 1.0) * v ELSE 0 END)) AS null_sd FROM c JOIN s USING (stratum) GROUP BY ALL)
SELECT level, n, round(observed, 6) AS observed, round(expected, 6) AS expected, round(null_sd, 6) AS null_sd, round(z, 6) AS z, round(p, 6) AS p FROM {scored_('o')}"""
)
def stratified_perm_closed(spark, d):
    a = _assumptions(spark, d).select(F.col("prompt_type").alias("stratum"), F.col("persona_type").alias("level"), F.col("probability_norm").alias("y"))
    return rounded(inference.stratified_null(a, "stratum", "level", "y"))


@query(
    f"""WITH {A}, cl AS (SELECT persona_id, min(persona_type) AS level, sum(probability_norm) AS s FROM a WHERE probability_norm IS NOT NULL GROUP BY ALL), g AS (SELECT count(*) AS N, avg(s) AS m, var_pop(s) AS v FROM cl), c AS (SELECT level, count(*) AS k, sum(s) AS s FROM cl GROUP BY ALL),
o AS (SELECT level, k AS n, s AS observed, k * m AS expected, sqrt(k * (N - k) / (N - 1.0) * v) AS null_sd FROM c, g)
SELECT level, n, round(observed, 6) AS observed, round(expected, 6) AS expected, round(null_sd, 6) AS null_sd, round(z, 6) AS z, round(p, 6) AS p FROM {scored_('o')}"""
)
def cluster_perm_closed(spark, d):
    a = _assumptions(spark, d).select("persona_id", F.col("persona_type").alias("level"), F.col("probability_norm").alias("y"))
    return rounded(inference.cluster_null(a, "persona_id", "level", "y"))


@query(
    f"""WITH {TOP}, hits AS (SELECT DISTINCT cell_key, persona_type, prompt_type, topic FROM tk), un AS (SELECT DISTINCT cell_key, persona_type, prompt_type FROM tk), sz AS (SELECT persona_type, count(*) AS n FROM un GROUP BY ALL), nn AS (SELECT count(*) AS tn FROM un),
kk AS (SELECT persona_type, topic, count(*) AS k FROM hits GROUP BY ALL), ka AS (SELECT topic, count(*) AS tk_ FROM hits GROUP BY ALL), gr AS (SELECT sz.persona_type, ka.topic, n, coalesce(k, 0) AS k, tk_, tn FROM sz CROSS JOIN ka CROSS JOIN nn LEFT JOIN kk ON kk.persona_type = sz.persona_type AND kk.topic = ka.topic),
sn AS (SELECT prompt_type, persona_type, CAST(count(*) AS DOUBLE) AS sn FROM un GROUP BY ALL), st AS (SELECT prompt_type, CAST(count(*) AS DOUBLE) AS sb FROM un GROUP BY ALL), sk AS (SELECT prompt_type, topic, CAST(count(*) AS DOUBLE) AS sk FROM hits GROUP BY ALL),
nl AS (SELECT persona_type, topic, sum(sn * sk / sb) AS expected, sqrt(sum(CASE WHEN sb > 1 THEN sn * (sb - sn) / (sb - 1) * (sk / sb) * (1 - sk / sb) ELSE 0 END)) AS null_sd FROM sn JOIN st USING (prompt_type) JOIN sk USING (prompt_type) GROUP BY ALL),
x AS (SELECT gr.persona_type, gr.topic, n, k, k / n AS rate, CASE WHEN tn > n THEN (tk_ - k) / (tn - n) END AS re, ln((k + 0.5) * (tn - n - tk_ + k + 0.5) / ((n - k + 0.5) * (tk_ - k + 0.5))) AS log_or,
 sqrt(1 / (k + 0.5) + 1 / (n - k + 0.5) + 1 / (tk_ - k + 0.5) + 1 / (tn - n - tk_ + k + 0.5)) AS se, expected, null_sd, CAST(k AS DOUBLE) AS observed FROM gr LEFT JOIN nl ON nl.persona_type = gr.persona_type AND nl.topic = gr.topic), y AS (SELECT * FROM {scored_('x')})
SELECT persona_type, topic, n, k, round(rate, 6) AS rate, round(re, 6) AS rate_elsewhere, round(rate - re, 6) AS delta, round(CASE WHEN re > 0 THEN rate / re END, 6) AS lift, round(log_or, 6) AS log_or, round(se, 6) AS se, round(expected, 6) AS expected, round(null_sd, 6) AS null_sd, round(z, 6) AS z, round(p, 6) AS p, round(q, 6) AS q
FROM {bh_('y', 'p', 'persona_type, topic')}"""
)
def contrast_table(spark, d):
    return rounded(inference.contrast_table(_topics(spark, d), "persona_type", "topic", "cell_key", "prompt_type"))


@query(
    f"""WITH {TOP}, c AS (SELECT persona_type, topic, CAST(count(*) AS DOUBLE) AS o FROM tk GROUP BY ALL), r AS (SELECT persona_type, sum(o) AS r FROM c GROUP BY ALL), k AS (SELECT topic, sum(o) AS c FROM c GROUP BY ALL),
g AS (SELECT sum(o) AS t FROM c), q AS (SELECT sum(o * o / (r * k.c)) AS q FROM c JOIN r USING (persona_type) JOIN k USING (topic)), x AS (SELECT t * (q - 1) AS chi2, (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM k) AS nc, t FROM g, q)
SELECT round(chi2, 4) AS chi2, (nr - 1) * (nc - 1) AS dof, round(sqrt(chi2 / (t * (least(nr, nc) - 1))), 6) AS cramers_v FROM x"""
)
def chi2_cramers_v(spark, d):
    n = _topics(spark, d).groupBy("persona_type", "topic").agg(F.count("*").alias("n"))
    return rounded(inference.chi_square(n, "persona_type", "topic").select(F.round("chi2", 4).alias("chi2"), "dof", "cramers_v"), "cramers_v")


@query(
    f"""WITH {TOP}, w AS (SELECT topic, CAST(sum(CAST(prompt_type = 'original_post' AS INT)) AS DOUBLE) AS a, CAST(sum(CAST(prompt_type = 'flipped_story' AS INT)) AS DOUBLE) AS b FROM tk GROUP BY ALL), g AS (SELECT sum(a) AS ta, sum(b) AS tb FROM w),
x AS (SELECT a / ta AS p, b / tb AS q FROM w, g) SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js_bits FROM x"""
)
def js_divergence(spark, d):
    n = _topics(spark, d).groupBy("prompt_type", "topic").agg(F.count("*").alias("n"))
    return rounded(inference.js_divergence(n, "prompt_type", "topic", *FRAMINGS))


UNIT = "persona_type, persona_id, prompt_id, run_id"


@query(
    f"""WITH {TOP}, h AS (SELECT DISTINCT {UNIT}, prompt_type, topic FROM tk), pr AS (SELECT {UNIT} FROM h GROUP BY ALL HAVING count(DISTINCT prompt_type) = 2),
w AS (SELECT {UNIT}, topic, max(CAST(prompt_type = 'original_post' AS INT)) AS a, max(CAST(prompt_type = 'flipped_story' AS INT)) AS b FROM h SEMI JOIN pr USING ({UNIT}) GROUP BY ALL)
SELECT topic, CAST(sum(CAST(a > b AS INT)) AS BIGINT) AS only_first, CAST(sum(CAST(b > a AS INT)) AS BIGINT) AS only_second FROM w GROUP BY ALL"""
)
def mcnemar_counts(spark, d):
    return inference.discordance(_topics(spark, d), UNIT.split(", "), "topic", "prompt_type", *FRAMINGS)


@query(
    f"""WITH {TOP}, h AS (SELECT DISTINCT {UNIT}, prompt_type, topic FROM tk), pr AS (SELECT {UNIT} FROM h GROUP BY ALL HAVING count(DISTINCT prompt_type) = 2),
w AS (SELECT {UNIT}, topic, max(CAST(prompt_type = 'original_post' AS INT)) AS a, max(CAST(prompt_type = 'flipped_story' AS INT)) AS b FROM h SEMI JOIN pr USING ({UNIT}) GROUP BY ALL),
n AS (SELECT topic, CAST(sum(CAST(a > b AS INT)) AS BIGINT) AS only_first, CAST(sum(CAST(b > a AS INT)) AS BIGINT) AS only_second FROM w GROUP BY ALL),
t AS (SELECT topic, only_first, only_second, only_first + only_second AS n, unnest(range(0, least(only_first, only_second) + 1)) AS i FROM n),
x AS (SELECT topic, only_first, only_second, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * sum(list_reduce(list_prepend(1.0, list_transform(range(1, i + 1), lambda j: CAST(j AS DOUBLE))), lambda acc, j: acc * (n - j + 1) / j)) * pow(0.5, n)) END AS p FROM t GROUP BY topic, only_first, only_second, n)
SELECT topic, only_first, only_second, round(p, 6) AS p, round(q, 6) AS q FROM {bh_('x', 'p', 'topic')}"""
)
def mcnemar_test(spark, d):
    """The same counts with exact p and q."""
    n = inference.discordance(_topics(spark, d), UNIT.split(", "), "topic", "prompt_type", *FRAMINGS)
    return rounded(inference.benjamini_hochberg(n.withColumn("p", stats.mcnemar_p(F.col("only_first"), F.col("only_second"))), "p", ["topic"]))


@query(
    f"""WITH r AS (SELECT l_suppkey, avg(l_discount) AS x, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT l_suppkey, CASE WHEN n > 1 THEN exp(-100 * x) * 50 END AS p0 FROM r), c AS (SELECT l_suppkey, least(p0, 1.0) AS p FROM p)
SELECT l_suppkey, round(p, 6) AS p, round(q, 6) AS q FROM {bh_('c', 'p', 'l_suppkey')}"""
)
def bh_fdr(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("x"), F.count("*").alias("n"))
    p = r.select("l_suppkey", F.least(F.when(F.col("n") > 1, F.exp(-100 * F.col("x")) * 50), F.lit(1.0)).alias("p"))
    return rounded(inference.benjamini_hochberg(p, "p", ["l_suppkey"]))


@query(
    """WITH r AS (SELECT o_orderpriority AS d, o_custkey AS c, CAST(o_orderstatus = 'F' AS DOUBLE) AS x, o_totalprice / 1000 AS y FROM orders), m AS (SELECT d, avg(x) AS mx, avg(y) AS my FROM r GROUP BY ALL), q AS (SELECT d, c, x - mx AS x, y - my AS y FROM r JOIN m USING (d)),
f AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT d) AS dd FROM q), u AS (SELECT c, sum(x * (y - b * x)) AS u FROM q, f GROUP BY ALL), g AS (SELECT sum(u * u) AS m, count(*) AS g FROM u),
s AS (SELECT b, sqrt(m * (g / (g - 1.0)) * ((n - 1.0) / (n - 1 - dd))) / sxx AS se, n, g, dd FROM f, g) SELECT round(b, 6) AS beta, round(se, 6) AS se, round(b / se, 6) AS z, n, g AS clusters, dd AS strata FROM s"""
)
def fe_ols_cluster(spark, d):
    o = table(spark, d, "orders").withColumn("x", (F.col("o_orderstatus") == "F").cast("double")).withColumn("y", F.col("o_totalprice") / 1000)
    return rounded(inference.fixed_effect_slope(o, "o_orderpriority", "o_custkey", "x", "y").drop("p"))


@query(
    f"""WITH {TOP}, hits AS (SELECT DISTINCT cell_key, persona_type, topic FROM tk), un AS (SELECT DISTINCT cell_key, persona_type FROM tk), sz AS (SELECT persona_type, CAST(count(*) AS DOUBLE) AS n FROM un GROUP BY ALL), k AS (SELECT persona_type, topic, count(*) AS k FROM hits GROUP BY ALL),
x AS (SELECT persona_type, n, k / n AS rate, sqrt(n) AS sd FROM k JOIN sz USING (persona_type))
SELECT persona_type, count(*) AS size, round(quantile_cont({stats.normal_quantile(0.975) + stats.normal_quantile(0.8)!r} * sd / n, 0.5), 6) AS median_detectable, round(min({stats.normal_quantile(0.975) + stats.normal_quantile(0.8)!r} * sd / n), 6) AS least_detectable, round(max(abs(rate)), 6) AS largest_seen FROM x GROUP BY ALL"""
)
def min_detectable(spark, d):
    t = _topics(spark, d)
    sizes = t.select("cell_key", "persona_type").distinct().groupBy("persona_type").agg(F.count("*").cast("double").alias("n"))
    k = t.select("cell_key", "persona_type", "topic").distinct().groupBy("persona_type", "topic").agg(F.count("*").alias("k"))
    x = k.join(sizes, "persona_type").withColumn("rate", F.col("k") / F.col("n")).withColumn("sd", F.sqrt("n"))
    return rounded(inference.detectable_difference(x, ["persona_type"], "n", "sd", "rate"))


@query("SELECT l_returnflag, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.025), 6) AS low, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.975), 6) AS high FROM lineitem GROUP BY ALL")
def null_band(spark, d):
    return rounded(inference.null_band(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]))


@query()
def bootstrap_ci(spark, d):
    """Cluster bootstrap of the mean score over persons, 400 draws."""
    t = _labels(spark, d).filter("dimension = 'user_rightness' and score between 0 and 1")
    return rounded(inference.bootstrap_ci(t, "persona_id", "score", 400, 0.95, 3))


# Facet by topic, in blocks of (model, framing): the counts of the three most common topics, the levels shuffled over framings.
PERM = f"""{TOP}, top3 AS (SELECT topic FROM tk GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 3),
fc AS (SELECT run_id, prompt_type, persona_type, topic FROM tk SEMI JOIN top3 USING (topic) WHERE persona_type <> 'none'),
pb AS (SELECT DISTINCT run_id, prompt_type, persona_type FROM tk WHERE persona_type <> 'none'),
cnt AS (SELECT pb.run_id || '|' || pb.prompt_type AS b, pb.prompt_type AS g, pb.persona_type AS l, t.topic AS f, count(fc.topic) AS v FROM pb CROSS JOIN top3 t LEFT JOIN fc ON fc.run_id = pb.run_id AND fc.prompt_type = pb.prompt_type AND fc.persona_type = pb.persona_type AND fc.topic = t.topic GROUP BY ALL),
nlev AS (SELECT count(DISTINCT l) AS k FROM cnt), okb AS (SELECT b FROM cnt, nlev GROUP BY b HAVING count(DISTINCT l) = max(k)),
arr AS (SELECT b, g, l, list(v ORDER BY f) AS v FROM cnt SEMI JOIN okb USING (b) GROUP BY ALL), fs AS (SELECT list(topic ORDER BY topic) AS fs FROM top3),
idx AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY l) - 1 AS i FROM arr), dr AS (SELECT unnest(range(0, 201)) AS draw),
mix AS (SELECT draw, b, v, row_number() OVER (PARTITION BY draw, b ORDER BY CASE WHEN draw = 0 THEN lpad(CAST(i AS VARCHAR), 9, '0') ELSE md5('7|' || draw || '|' || b || '|' || i) END) - 1 AS place FROM idx, dr),
lng AS (SELECT m.draw, x.g AS "group", x.l AS level, unnest(fs.fs) AS feature, CAST(unnest(m.v) AS DOUBLE) AS v FROM mix m JOIN idx x ON x.b = m.b AND x.i = m.place, fs)"""
MOMENTS = """, mo AS (SELECT {k}, max(s) FILTER (draw = 0) AS observed, avg(s) FILTER (draw > 0) AS null_mean, stddev_samp(s) FILTER (draw > 0) AS null_sd FROM {src} GROUP BY {k}),
hit AS (SELECT {k}, count(*) FILTER (draw > 0 AND abs(s - null_mean) >= abs(observed - null_mean) - 1e-9) AS hits, count(*) FILTER (draw > 0) AS draws FROM {src} JOIN mo USING ({k}) GROUP BY {k}),
pp AS (SELECT *, CASE WHEN observed IS NOT NULL THEN (hits + 1) / (draws + 1) END AS p_mc, CASE WHEN null_sd > 1e-12 THEN (observed - null_mean) / null_sd END AS z FROM mo JOIN hit USING ({k}))"""


def _draws(spark: SparkSession, d: str) -> DataFrame:
    """Draws of the facets over the counts of the three most common topics, within model and framing."""
    t = _topics(spark, d)
    top = [r["topic"] for r in t.groupBy("topic").count().orderBy(F.desc("count"), "topic").limit(3).collect()]
    own = t.filter(F.col("persona_type") != CONTROL).groupBy("run_id", "prompt_type", "persona_type").agg(*[F.count_if(F.col("topic") == x).alias(x) for x in top])
    levels = own.select("persona_type").distinct().count()
    blocks = own.withColumn("block", F.concat_ws("|", "run_id", "prompt_type"))
    return permutation.long_sums(permutation.draw_sums(blocks, "block", "persona_type", sorted(top), levels, 200, 7, "prompt_type"), sorted(top))


@query(
    f"""WITH {PERM}, sm AS (SELECT draw, level, feature, sum(v) AS s FROM lng GROUP BY ALL){MOMENTS.format(k='level, feature', src='sm')}
SELECT level, feature, round(observed, 6) AS observed, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round(z, 6) AS z, round(p_mc, 6) AS p_mc, round(CASE WHEN null_sd > 1e-12 AND null_mean >= 5 THEN {normal_p_('z')} END, 6) AS p_normal, coalesce(null_sd > 1e-12 AND null_mean >= 5, false) AS usable FROM pp"""
)
def perm_both_p(spark, d):
    s = _draws(spark, d).groupBy("draw", "level", "feature").agg(F.sum("s").alias("s"))
    return rounded(permutation.both_p(s, ["level", "feature"]))


@query(
    f"""WITH {PERM}, ce AS (SELECT draw, "group", level, feature, sum(v) AS s FROM lng GROUP BY ALL HAVING sum(v) > 0), rc AS (SELECT *, sum(s) OVER (PARTITION BY draw, "group", level) AS r, sum(s) OVER (PARTITION BY draw, "group", feature) AS c FROM ce),
pd AS (SELECT draw, "group", sum(s) AS t, sum(s) * (sum(s * s / (r * c)) - 1) AS chi2, count(DISTINCT level) AS nr, count(DISTINCT feature) AS nc FROM rc GROUP BY ALL), ob AS (SELECT "group", chi2 AS stat, t, nr, nc FROM pd WHERE draw = 0),
nu AS (SELECT pd."group", count(*) FILTER (pd.chi2 >= ob.stat - 1e-9) AS hits, count(*) AS draws FROM pd JOIN ob ON ob."group" = pd."group" WHERE pd.draw > 0 GROUP BY ALL)
SELECT ob."group", round(stat, 4) AS chi2, (nr - 1) * (nc - 1) AS dof, round((hits + 1) / (draws + 1), 6) AS p_permutation, round(sqrt(greatest(stat, 0) / (t * (least(nr, nc) - 1))), 6) AS cramers_v, draws FROM ob JOIN nu ON nu."group" = ob."group\""""
)
def perm_omnibus(spark, d):
    out = permutation.omnibus(_draws(spark, d)).drop("p_asymptotic")  # its tail is a fit, tested against literals
    return rounded(out.withColumn("chi2", F.round("chi2", 4)), "p_permutation", "cramers_v")


@query(
    f"""WITH {PERM}, ls AS (SELECT draw, "group", level, feature, sum(v) AS s FROM lng GROUP BY ALL), sh AS (SELECT *, CASE WHEN sum(s) OVER (PARTITION BY draw, "group", level) > 1e-12 THEN s / sum(s) OVER (PARTITION BY draw, "group", level) ELSE 0 END AS share FROM ls),
wd AS (SELECT draw, level, feature, max(share) FILTER ("group" = 'original_post') AS a, max(share) FILTER ("group" = 'flipped_story') AS b, max(s) FILTER ("group" = 'original_post') AS sa, max(s) FILTER ("group" = 'flipped_story') AS sb, a - b AS s FROM sh GROUP BY ALL){MOMENTS.format(k='level, feature', src='wd')}
SELECT level, feature, round(a, 6) AS share_first, round(b, 6) AS share_second, round(observed, 6) AS difference, round(z, 5) AS z, round(p_mc, 6) AS p_mc, coalesce(null_sd > 1e-12 AND least(sa, sb) >= 5, false) AS testable FROM pp LEFT JOIN (SELECT * EXCLUDE (draw, s) FROM wd WHERE draw = 0) USING (level, feature)"""
)
def perm_interaction(spark, d):
    out = permutation.share_interaction(_draws(spark, d), *FRAMINGS).drop("p_normal")
    return rounded(out.withColumn("z", F.round("z", 5)), "share_first", "share_second", "difference", "p_mc")


@query(
    f"""WITH {T}, r AS (SELECT persona_id AS g, sum(score) AS s, count(*) AS n FROM t WHERE dimension = 'user_rightness' AND score BETWEEN 0 AND 1 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (ORDER BY sha256('3|bootstrap|' || g), g) - 1 AS i, count(*) OVER () AS k FROM r), p AS (SELECT draw, CAST('0x' || left(md5('3|' || draw || '|' || i), 15) AS BIGINT) % k AS i FROM k, (SELECT unnest(range(1, 401)) AS draw)),
m AS (SELECT draw, sum(s) / sum(n) AS m FROM p JOIN k USING (i) GROUP BY ALL)
SELECT round((SELECT sum(s) / sum(n) FROM r), 6) AS mean, (SELECT count(*) FROM r) AS clusters, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m"""
)
def bootstrap_multinomial(spark, d):
    t = _labels(spark, d).filter("dimension = 'user_rightness' and score between 0 and 1")
    return rounded(permutation.bootstrap_means(t, "persona_id", "score", 400, 0.95, 3))


# ---- probes -------------------------------------------------------------------------------
@query(
    f"""WITH {T} SELECT cell_key, dimension, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, count(score) AS votes, count(DISTINCT teacher) AS teachers, round(stddev_samp(score), 6) AS sd, min(score) AS least, max(score) AS most FROM t WHERE score IS NOT NULL GROUP BY ALL"""
)
def vote_aggregate(spark, d):
    return rounded(probes.aggregate_votes(_labels(spark, d), ["cell_key", "dimension"], "teacher", "score"), "mean", "median", "sd")


@query(
    f"""WITH {T}, m AS (SELECT cell_key, dimension, teacher, avg(score) AS s FROM t WHERE score IS NOT NULL GROUP BY ALL), j AS (SELECT a.teacher AS ta, b.teacher AS tb, a.s AS x, b.s AS y FROM m a JOIN m b ON a.cell_key = b.cell_key AND a.dimension = b.dimension AND a.teacher < b.teacher)
SELECT ta AS teacher_a, tb AS teacher_b, count(*) AS cells, round(avg(abs(x - y)), 6) AS mad, round(quantile_cont(abs(x - y), 0.5), 6) AS median_ad, round(avg(CAST(abs(x - y) > 0.2 + 1e-9 AS INT)), 6) AS far_share, round(CASE WHEN stddev_samp(x) * stddev_samp(y) > 1e-12 THEN covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) END, 6) AS r FROM j GROUP BY ALL"""
)
def teacher_agreement(spark, d):
    return rounded(probes.teacher_agreement(_labels(spark, d), ["cell_key", "dimension"], "teacher", "score").drop("total"))


@query(
    f"""WITH {T}, m AS (SELECT cell_key, dimension, teacher, CAST(avg(score) AS DECIMAL(18, 9)) AS s FROM t WHERE score IS NOT NULL GROUP BY ALL), j AS (SELECT a.teacher AS ta, b.teacher AS tb, abs(a.s - b.s) AS g FROM m a JOIN m b ON a.cell_key = b.cell_key AND a.dimension = b.dimension AND a.teacher < b.teacher)
SELECT ta AS teacher_a, tb AS teacher_b, count(*) AS cells, CAST(sum(g) AS DOUBLE) AS total, round(CAST(sum(g) AS DOUBLE) / count(*), 6) AS mad, round(avg(CAST(g > 0.2 AS INT)), 6) AS far_share FROM j GROUP BY ALL"""
)
def teacher_gaps(spark, d):
    """Absolute differences of each pair of teachers, summed exactly."""
    out = probes.teacher_agreement(_labels(spark, d), ["cell_key", "dimension"], "teacher", "score")
    return rounded(out.select("teacher_a", "teacher_b", "cells", "total", "mad", "far_share"), "mad", "far_share")


@query(
    f"""WITH {T}, v AS (SELECT *, coalesce(score BETWEEN 0 AND 1, false) AS ok FROM t), w AS (SELECT *, CASE WHEN ok THEN score END AS s FROM v)
SELECT teacher, dimension, count(*) AS n_rows, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS valid, CAST(sum(CAST(NOT ok AS INT)) AS BIGINT) AS invalid, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd, CAST(sum(CAST(s <= 0.2 AS INT)) AS BIGINT) AS low_tail, CAST(sum(CAST(s >= 0.8 AS INT)) AS BIGINT) AS high_tail FROM w GROUP BY ALL"""
)
def label_quality(spark, d):
    ok = F.coalesce(F.col("score").between(0, 1), F.lit(False))
    return rounded(probes.label_quality(_labels(spark, d), ["teacher", "dimension"], "score", ok))


RANKED = "SELECT *, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS r FROM"


@query(
    f"""WITH s AS (SELECT l_returnflag AS g, l_extendedprice AS x, l_discount >= 0.05 AS y FROM lineitem), r AS ({RANKED} s), a AS (SELECT g, CAST(sum(CAST(y AS INT)) AS BIGINT) AS p, count(*) AS n, sum(CASE WHEN y THEN r ELSE 0 END) AS t FROM r GROUP BY ALL)
SELECT g AS l_returnflag, n, p AS n_pos, round((t - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * (n - p)), 6) AS auc FROM a"""
)
def auc_by_source(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_discount") >= 0.05).alias("y"))
    return rounded(probes.auc(rows, ["l_returnflag"], "l_extendedprice", "y"))


@query(
    f"""WITH s AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem), a AS ({RANKED} s), b AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM a)
SELECT g AS l_returnflag, count(*) AS n, round(corr(r, ry), 6) AS rho FROM b GROUP BY ALL"""
)
def spearman_by_source(spark, d):
    return rounded(probes.spearman(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


@query(
    """WITH s AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500.0 AS f FROM lineitem) SELECT l_returnflag, count(*) AS n, round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(y)), 6) AS r2, round(sqrt(avg((y - f) * (y - f))), 4) AS rmse, round(avg(abs(y - f)), 4) AS mae FROM s GROUP BY ALL"""
)
def regression_metrics(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("f"))
    m = probes.regression_metrics(rows, ["l_returnflag"], "y", "f")
    return m.select("l_returnflag", "n", F.round("r2", 6).alias("r2"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@query(
    """WITH q AS (SELECT o_orderpriority, quantile_cont(CAST(o_totalprice AS DOUBLE), 0.25) AS lo, quantile_cont(CAST(o_totalprice AS DOUBLE), 0.75) AS hi FROM orders GROUP BY ALL) SELECT o_orderkey, CASE WHEN o_totalprice >= hi THEN 'top' WHEN o_totalprice <= lo THEN 'bottom' END AS extreme FROM orders JOIN q USING (o_orderpriority)"""
)
def extreme_classes(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    x = probes.extreme_classes(o, ["o_orderpriority"], "o_totalprice")
    return x.select("o_orderkey", F.when(F.col("extreme"), "top").when(~F.col("extreme"), "bottom").alias("extreme"))


@query(
    """WITH m AS (SELECT l_returnflag AS k, l_linenumber AS layer, round(corr(l_quantity, l_extendedprice) * corr(l_quantity, l_extendedprice), 9) AS r2 FROM lineitem GROUP BY ALL) SELECT k, arg_max(layer, (r2, -layer)) AS best, round(max(r2), 6) AS r2 FROM m GROUP BY ALL"""
)
def best_layer(spark, d):
    r = F.corr("l_quantity", "l_extendedprice")
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k"), F.col("l_linenumber").alias("layer")).agg(F.round(r * r, 9).alias("r2")).withColumn("rmse", F.lit(0.0))
    return rounded(probes.best_layer(m, ["k"], "layer"), "r2")


@query(
    """WITH m AS (SELECT l_returnflag AS k, l_linenumber AS layer, round(corr(l_quantity, l_extendedprice) * corr(l_quantity, l_extendedprice), 1) AS r2, sqrt(avg((l_extendedprice - l_quantity * 1500.0) * (l_extendedprice - l_quantity * 1500.0))) AS rmse FROM lineitem GROUP BY ALL)
SELECT k, arg_max(layer, (r2, -rmse, -layer)) AS best, max(r2) AS r2 FROM m GROUP BY ALL"""
)
def best_layer_by_error(spark, d):
    """The same choice where R squared ties, so that the error decides."""
    r, e = F.corr("l_quantity", "l_extendedprice"), F.col("l_extendedprice") - F.col("l_quantity") * 1500.0
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k"), F.col("l_linenumber").alias("layer")).agg(F.round(r * r, 1).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return probes.best_layer(m, ["k"], "layer")


@query(
    f"""WITH {T.replace('parse_status FROM', 'parse_status, labelled_at FROM')}, v AS (SELECT *, coalesce(score BETWEEN 0 AND 1, false) AS ok FROM t)
SELECT cell_key, teacher, dimension, ok, epoch_us(labelled_at) AS at FROM (SELECT *, row_number() OVER (PARTITION BY cell_key, teacher, dimension ORDER BY ok DESC, labelled_at DESC) AS r FROM v) WHERE r = 1"""
)
def valid_then_latest(spark, d):
    """Per cell, teacher and dimension, the newest valid label, or else the newest."""
    t = clean_keys(table(spark, d, "teacher_labels")).withColumn("teacher", _name(F.col("teacher_id"))).withColumn("dimension", _name(F.col("dimension"))).withColumn("score", no_nan(F.col("score")))
    ok = F.coalesce(F.col("score").between(0, 1), F.lit(False))
    rows = t.select(F.concat_ws("|", "cell_key", "teacher", "dimension").alias("_k"), "cell_key", "teacher", "dimension", ok.alias("ok"), F.unix_micros("labelled_at").alias("at")).distinct()
    return attempts.latest_success(rows, "_k", "at", F.col("ok")).drop("_k")


@query(
    f"""WITH {A}, m AS (SELECT run_id, persona_type, avg(probability_norm) AS v FROM a GROUP BY ALL HAVING avg(probability_norm) IS NOT NULL) SELECT run_id, persona_type, round(v, 6) AS metric FROM m ORDER BY round(v, 9) DESC, run_id, persona_type LIMIT 10"""
)
def top_facets(spark, d):
    """The ten facets of greatest mean probability over all models (a top-k report)."""
    m = _assumptions(spark, d).groupBy("run_id", "persona_type").agg(F.avg("probability_norm").alias("v")).filter("v is not null")
    return m.orderBy(F.desc(F.round("v", 9)), "run_id", "persona_type").limit(10).select("run_id", "persona_type", F.round("v", 6).alias("metric"))


@query(
    """WITH s AS (SELECT l_linestatus, l_quantity > 25 AS t, l_extendedprice > 30000 AS g FROM lineitem), c AS (SELECT l_linestatus, count(*) AS n, avg(CAST(t = g AS INT)) AS a, CAST(sum(CAST(t AND g AS INT)) AS DOUBLE) AS tp, sum(CAST(NOT t AND g AS INT)) AS fp, sum(CAST(t AND NOT g AS INT)) AS fn FROM s GROUP BY ALL)
SELECT l_linestatus, n, round(a, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""
)
def classification_metrics(spark, d):
    rows = table(spark, d, "lineitem").select("l_linestatus", (F.col("l_quantity") > 25).alias("t"), (F.col("l_extendedprice") > 30000).alias("g"))
    return rounded(probes.classification_metrics(rows, ["l_linestatus"], "t", "g"))


@query(
    """SELECT o_orderkey, round(b - a, 6) AS logit_no, round(exp(b - m), 6) AS p_no, round(m, 6) AS log_candidate_mass, round(exp(m), 6) AS candidate_mass FROM (SELECT *, greatest(a, b) + ln(1 + exp(-abs(a - b))) AS m FROM (SELECT o_orderkey, -o_totalprice / 99991 AS a, -o_custkey / 1000.0 AS b FROM orders))"""
)
def candidate_scores(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (-F.col("o_totalprice") / 99991).alias("a"), (-F.col("o_custkey") / 1000.0).alias("b"))
    return rounded(probes.candidate_scores(o, "a", "b").drop("a", "b"))


@query(
    """WITH s AS (SELECT o_custkey AS u, o_orderstatus AS arm, avg(o_totalprice) AS v FROM orders GROUP BY ALL), b AS (SELECT u, v AS b FROM s WHERE arm = 'O' AND v > 150000) SELECT arm, count(*) AS units, round(avg(v - b), 4) AS change FROM s JOIN b USING (u) WHERE arm <> 'O' GROUP BY ALL"""
)
def steering_effect(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("u"), F.col("o_orderstatus").alias("arm")).agg(F.avg("o_totalprice").alias("v"))
    e = probes.steering_effect(s.withColumn("eligible", F.col("v") > 150000), ["u"], "arm", "O", ["arm"], "v")
    return e.withColumn("change", F.round("change", 4))


# ---- designs ------------------------------------------------------------------------------
PP = f"pe AS (SELECT DISTINCT {p_('persona_type')} AS persona_type, {p_('persona_id')} AS persona_id FROM personas), po AS (SELECT DISTINCT {c_('prompt_id')} AS prompt_id, prompt_type FROM prompts WHERE text IS NOT NULL)"


@query(f"WITH {PP} SELECT prompt_id FROM po GROUP BY 1 HAVING count(DISTINCT prompt_type) = 2")
def eligible_division(spark, d):
    return design.eligible_ids(clean_keys(table(spark, d, "prompts")).filter("text is not null"), "prompt_id", "prompt_type", 2)


GRID = f"""{PP}, pq AS (SELECT prompt_id FROM po GROUP BY 1 HAVING count(DISTINCT prompt_type) = 2), pz AS (SELECT * FROM po WHERE prompt_id IN (SELECT prompt_id FROM pq)), ps AS (SELECT 'none' AS persona_type, 'none' AS persona_id UNION ALL SELECT * FROM pe WHERE persona_type <> 'none'),
gd AS (SELECT persona_type, persona_id, prompt_type, prompt_id, CAST(rep AS INT) AS rep FROM ps, pz, (SELECT unnest([0, 1]) AS rep))"""


def _factors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """People of all facets, and the paired prompts."""
    return design.facet_factors(clean_keys(table(spark, d, "personas")), clean_keys(table(spark, d, "prompts")).filter("text is not null"))


@query(f"WITH {GRID} SELECT persona_type, prompt_type, count(*) AS cells, count(DISTINCT persona_id) AS persons, count(DISTINCT prompt_id) AS prompts FROM gd GROUP BY ALL")
def design_grid_all(spark, d):
    return design.factor_summary(*_factors(spark, d), 2)


@query(f"WITH {GRID}, cv AS (SELECT DISTINCT {p_('persona_type')} AS persona_type, {p_('persona_id')} AS persona_id, prompt_type, {c_('prompt_id')} AS prompt_id, rep FROM attempt_log) SELECT persona_type, prompt_type, count(*) AS n FROM gd ANTI JOIN cv USING (persona_type, persona_id, prompt_type, prompt_id, rep) GROUP BY ALL")
def wave_except_all(spark, d):
    return design.factor_wave(*_factors(spark, d), 2, clean_keys(table(spark, d, "attempt_log")))


@query(
    f"""WITH c AS (SELECT DISTINCT run_id, sha256({p_('persona_type')} || '|' || {p_('persona_id')} || '|' || prompt_type || '|' || {c_('prompt_id')} || '|' || rep) AS h FROM attempt_log),
s AS (SELECT run_id, h[1:2] AS slot, count(*) AS n, sha256(string_agg(h, ',' ORDER BY h)) AS d FROM c GROUP BY ALL) SELECT run_id, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(d, ',' ORDER BY slot)) AS digest FROM s GROUP BY ALL"""
)
def coord_digest(spark, d):
    return design.coordinates_digest(clean_keys(table(spark, d, "attempt_log")), list(("persona_type", "persona_id", "prompt_type", "prompt_id", "rep")), ["run_id"])


@query(
    f"""WITH c AS (SELECT DISTINCT run_id, sha256({p_('persona_type')} || '|' || {p_('persona_id')} || '|' || prompt_type || '|' || {c_('prompt_id')} || '|' || rep) AS h FROM attempt_log),
w AS (SELECT run_id, count(*) AS n, sum(CAST('0x' || h[1:15] AS HUGEINT)) AS a, sum(CAST('0x' || h[16:30] AS HUGEINT)) AS b, sum(CAST('0x' || h[31:45] AS HUGEINT)) AS c, sum(CAST('0x' || h[46:60] AS HUGEINT)) AS e FROM c GROUP BY ALL)
SELECT run_id, n AS n_rows, sha256(n || '|' || a || '|' || b || '|' || c || '|' || e) AS digest FROM w"""
)
def coord_checksum(spark, d):
    return design.coordinates_checksum(clean_keys(table(spark, d, "attempt_log")), list(("persona_type", "persona_id", "prompt_type", "prompt_id", "rep")), ["run_id"])


def part_(key: str, src: str, tag: str) -> str:
    n, r = "count(*) OVER ()", f"row_number() OVER (ORDER BY sha256('7|{tag}|' || {key}), {key})"
    return f"SELECT {key}, CASE WHEN {r} <= floor({n} * 0.7 + 0.5) THEN 'train' WHEN {r} <= floor({n} * (0.7 + 0.15) + 0.5) THEN 'validation' ELSE 'test' END AS part FROM (SELECT DISTINCT {key} FROM {src})"


PARTS = {"train": 0.7, "validation": 0.15, "test": 0.15}


@query(f"WITH {PP} " + part_("persona_id", "pe", "person"))
def hash_split(spark, d):
    return design.hash_partitions(clean_keys(table(spark, d, "personas")), "persona_id", 7, "person", PARTS, "part")


@query(
    f"""WITH {PP}, ce AS (SELECT DISTINCT {p_('persona_id')} AS persona_id, {c_('prompt_id')} AS prompt_id FROM attempt_log), a AS ({part_('persona_id', "(SELECT persona_id FROM ce WHERE persona_id <> 'none')", 'person')}), b AS ({part_('prompt_id', 'ce', 'prompt')})
SELECT ce.persona_id, ce.prompt_id, CASE WHEN ce.persona_id = 'none' THEN b.part WHEN a.part = b.part THEN a.part ELSE 'cross_' || a.part || '_' || b.part END AS split FROM ce LEFT JOIN a ON a.persona_id = ce.persona_id LEFT JOIN b ON b.prompt_id = ce.prompt_id"""
)
def two_axis_split(spark, d):
    cells = clean_keys(table(spark, d, "attempt_log")).select("persona_id", "prompt_id").distinct()
    a = design.hash_partitions(cells.filter(F.col("persona_id") != CONTROL), "persona_id", 7, "person", PARTS, "person_part")
    b = design.hash_partitions(cells, "prompt_id", 7, "prompt", PARTS, "prompt_part")
    return design.two_axis_splits(cells, a, b).select("persona_id", "prompt_id", "split")


@query(
    f"""WITH {PP}, a AS (SELECT persona_id, row_number() OVER (ORDER BY sha256('7|person|' || persona_id), persona_id) - 1 AS i FROM (SELECT DISTINCT persona_id FROM pe)), b AS (SELECT prompt_id, row_number() OVER (ORDER BY sha256('7|prompt|' || prompt_id), prompt_id) - 1 AS j FROM (SELECT DISTINCT prompt_id FROM po)), n AS (SELECT count(*) AS n FROM b)
SELECT DISTINCT persona_id, prompt_id FROM (SELECT persona_id, (i * 3 + o) % n AS j FROM a, n, (SELECT unnest([0, 1, 2]) AS o)) JOIN b USING (j)"""
)
def sparse_pairs(spark, d):
    return design.sparse_pairs(clean_keys(table(spark, d, "personas")), clean_keys(table(spark, d, "prompts")).filter("text is not null"), 3, 7)


@query("SELECT o_orderkey, CAST(('0x' || right(sha256(CAST(o_orderkey AS VARCHAR)), 4)) AS INT) % 16 AS shard FROM orders")
def hash_shards(spark, d):
    return table(spark, d, "orders").select("o_orderkey", design.hash_shard(F.col("o_orderkey"), 16).alias("shard"))


@query(f"SELECT {c_('prompt_id')} AS prompt_id, min(seq) AS first_seen FROM attempt_log GROUP BY 1")
def ordered_unique(spark, d):
    return design.ordered_unique(clean_keys(table(spark, d, "attempt_log")), "prompt_id", "seq")


@query(
    f"""WITH pl AS (SELECT DISTINCT cell_key FROM attempt_log WHERE probe = 'openended-3'), sn AS (SELECT DISTINCT cell_key FROM parsed_probes) SELECT (SELECT count(*) FROM pl WHERE cell_key NOT IN (SELECT cell_key FROM sn)) AS missing, (SELECT count(*) FROM sn WHERE cell_key NOT IN (SELECT cell_key FROM pl)) AS unexpected"""
)
def coverage_gap(spark, d):
    planned = table(spark, d, "attempt_log").filter("probe = 'openended-3'")
    return design.set_difference(planned, table(spark, d, "parsed_probes"), ["cell_key"])


# ---- text ---------------------------------------------------------------------------------
@query(
    f"""WITH m AS (SELECT DISTINCT persona_type, persona_id, messages FROM personas), x AS (SELECT persona_type, persona_id, messages, list_filter(messages, lambda z: z.role = 'user' AND z.content IS NOT NULL) AS f FROM m) SELECT {p_('persona_type')} AS persona_type, {p_('persona_id')} AS persona_id, array_to_string(list_transform(f, lambda z: z.content), chr(10)) AS text FROM x"""
)
def persona_text(spark, d):
    return persona_texts(clean_keys(table(spark, d, "personas").select("persona_type", "persona_id", "messages").distinct()), "user")


@query(
    """WITH p AS (SELECT DISTINCT persona_type, persona_id, messages FROM personas), k AS (SELECT *, row_number() OVER () AS rid FROM p),
m AS (SELECT rid, i, lower(messages[i].role) AS role, trim(coalesce(messages[i].content, '')) AS content FROM k, (SELECT unnest(range(1, 200)) AS i) WHERE i <= len(messages)),
u AS (SELECT * FROM m WHERE role IN ('user', 'assistant') AND content <> ''), c AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY rid ORDER BY i) THEN 0 ELSE 1 END AS f FROM u),
g AS (SELECT *, sum(f) OVER (PARTITION BY rid ORDER BY i) AS t FROM c), r AS (SELECT rid, t, any_value(role) AS role, string_agg(content, chr(10) || chr(10) ORDER BY i) AS content FROM g GROUP BY rid, t),
o AS (SELECT * FROM r WHERE NOT (t = 1 AND role = 'assistant')), l AS (SELECT rid, count(*) AS n, string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'AI' END || ': ' || content, chr(10) ORDER BY t) AS text FROM o GROUP BY rid)
SELECT persona_type, persona_id, CAST(coalesce(n, 0) AS INT) AS n_turns, coalesce(text, '') AS text FROM k LEFT JOIN l USING (rid)"""
)
def transcript_text(spark, d):
    """Cleaned turns (merged roles, no opening assistant) and their "User / AI" lines."""
    p = table(spark, d, "personas").select("persona_type", "persona_id", "messages").distinct()
    turns = p.withColumn("turns", text.clean_turns(F.col("messages")))
    return turns.select("persona_type", "persona_id", F.size("turns").alias("n_turns"), text.transcript_text(F.col("turns")).alias("text"))


@query(
    """WITH x AS (SELECT DISTINCT persona_type, persona_id, messages FROM personas), y AS (SELECT persona_type, persona_id, md5(CAST(messages AS VARCHAR)) AS h, unnest(messages) AS m, generate_subscripts(messages, 1) - 1 AS turn FROM x),
z AS (SELECT persona_type, persona_id, h, CAST(turn AS INT) AS turn, m.role || ': ' || coalesce(m.content, '') AS line FROM y) SELECT persona_type, persona_id, turn, length(coalesce(string_agg(line, chr(10)) OVER (PARTITION BY persona_type, persona_id, h ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS history_chars FROM z"""
)
def history_window(spark, d):
    p = table(spark, d, "personas").select("persona_type", "persona_id", "messages").distinct().withColumn("h", F.xxhash64("messages"))
    turns = p.select("persona_type", "persona_id", F.struct("persona_type", "persona_id", "h").alias("c"), F.posexplode("messages").alias("turn", "m"))
    lines = turns.withColumn("line", F.concat(F.col("m.role"), F.lit(": "), F.coalesce(F.col("m.content"), F.lit(""))))
    out = design.history_windows(lines, "c", "turn", "line")
    return out.select("persona_type", "persona_id", "turn", F.length("history").cast("long").alias("history_chars"))


@query()
def stance_cues(spark, d):
    """Stance and validation features of the replies."""
    r = table(spark, d, "parsed_probes").select("response_id", cues.cues(F.coalesce("response", F.lit(""))).alias("c"))
    return rounded(r.select("response_id", *cues.stance_features(F.col("c"))))


@query()
def parse_open_log(spark, d):
    """Assumptions parsed from the raw log: one row per cell and rank."""
    log = attempts.latest_success(_log(spark, d).filter("probe = 'openended-3'").select("cell_key", "seq", "error", "raw", "n_assumptions_asked"), "cell_key", "seq", attempts.succeeded(F.col("error"), F.col("raw")))
    return parsing.parsed_assumptions(log, ["cell_key"])


@query()
def parse_structured_log(spark, d):
    """Beliefs parsed from the raw log: one row per cell and dimension."""
    log = attempts.latest_success(_log(spark, d).filter("probe = '4dims'").select("cell_key", "seq", "error", "raw"), "cell_key", "seq", attempts.succeeded(F.col("error"), F.col("raw")))
    return parsing.parsed_beliefs(log, ["cell_key"])


@query()
def strict_labels(spark, d):
    """Share of structured completions that are exactly as asked."""
    log = _log(spark, d).filter("probe = '4dims'").select("cell_key", "raw")
    return log.groupBy().agg(F.count("*").alias("n")).crossJoin(log.select(parsing.strict_parser(F.col("raw")).isNotNull().cast("double").alias("v")).agg(F.round(F.avg("v"), 6).alias("strict")))


@query(
    "SELECT prompt_id, prompt_type, left(sha256(prompt_id || '|' || text), 16) AS digest FROM prompts WHERE text IS NOT NULL"
)
def prompt_digests(spark, d):
    p = table(spark, d, "prompts").filter("text is not null")
    return p.select("prompt_id", "prompt_type", F.left(F.sha2(F.concat_ws("|", "prompt_id", "text"), 256), F.lit(16)).alias("digest"))


@query()
def generate_mock(spark, d):
    """Completions of the offline stand-in for every paired prompt, parsed again."""
    p = table(spark, d, "prompts").filter("text is not null").select("prompt_id", "prompt_type", prompts.open_prompt(F.col("text"), None, 3).alias("prompt")).distinct()
    done = prompts.generate(p, "prompt").withColumn("n_assumptions_asked", F.lit(3))
    return parsing.parsed_assumptions(done, ["prompt_id", "prompt_type"])


@query(
    "SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS F, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 4) AS O, round(avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 4) AS P FROM orders GROUP BY ALL"
)
def long_to_wide(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))


@query(
    "SELECT p_partkey, 'p_brand' AS response_column, p_brand AS response, unnest(['clarity', 'warmth']) AS dimension FROM part WHERE p_brand IS NOT NULL UNION ALL SELECT p_partkey, 'p_type', p_type, unnest(['clarity', 'warmth']) FROM part WHERE p_type IS NOT NULL"
)
def judge_fan_out(spark, d):
    return prompts.fan_out(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_partkey"], ["p_brand", "p_type"], ["clarity", "warmth"])


# ---- waves, status, frozen rows -----------------------------------------------------------
@query(
    f"""WITH {LOG}, t AS (SELECT run_id, count(*) AS attempts FROM l GROUP BY 1), c AS (SELECT run_id, ok FROM (SELECT *, row_number() OVER (PARTITION BY cell_key ORDER BY ok DESC, seq DESC) AS r FROM k) WHERE r = 1)
SELECT run_id, any_value(attempts) AS attempts, count(*) AS cells, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS errors, any_value(attempts) - count(*) AS superseded, count(*) FILTER (NOT ok) = 0 AS settled FROM c JOIN t USING (run_id) GROUP BY run_id"""
)
def run_status(spark, d):
    """Attempts, cells, successes and errors per run, and whether it is settled."""
    return waves.run_status(_log(spark, d).select("run_id", "cell_key", "seq", "error", "raw"))


CELLS = f"cc AS (SELECT DISTINCT run_id, {p_('persona_type')} AS persona_type, {p_('persona_id')} AS persona_id, prompt_type, {c_('prompt_id')} AS prompt_id, rep FROM attempt_log)"


@query(
    f"""WITH {CELLS}, g AS (SELECT run_id, count(*) AS observed, count(DISTINCT CASE WHEN persona_id <> 'none' THEN persona_id END) AS p, count(DISTINCT CASE WHEN persona_id <> 'none' THEN persona_type END) AS t,
 count(DISTINCT prompt_id) AS q, count(DISTINCT prompt_type) AS f, count(DISTINCT rep) AS r, max(CASE WHEN persona_id = 'none' THEN 1 ELSE 0 END) AS c FROM cc GROUP BY 1)
SELECT run_id, observed, q * f * r * (p * t + c) AS expected, q * f * r * (p * t + c) - observed AS missing FROM g"""
)
def self_consistency(spark, d):
    """How far each run's cells are from the grid of their own factors."""
    return waves.self_consistency(clean_keys(table(spark, d, "attempt_log")), ["run_id"])


@query(
    f"""WITH {PP}, ce AS (SELECT DISTINCT {p_('persona_type')} AS persona_type, {p_('persona_id')} AS persona_id, prompt_type, {c_('prompt_id')} AS prompt_id, rep FROM attempt_log),
a AS ({part_('persona_id', "(SELECT persona_id FROM ce WHERE persona_id <> 'none')", 'person')}), b AS ({part_('prompt_id', 'ce', 'prompt')}),
x AS (SELECT ce.*, CASE WHEN ce.persona_id = 'none' THEN b.part WHEN a.part = b.part THEN a.part ELSE 'cross' END AS split FROM ce LEFT JOIN a ON a.persona_id = ce.persona_id LEFT JOIN b ON b.prompt_id = ce.prompt_id)
SELECT persona_type, persona_id, prompt_type, prompt_id, rep, split, row_number() OVER (ORDER BY prompt_id, prompt_type, persona_id, persona_type, rep) - 1 AS row_index FROM x WHERE split <> 'cross'"""
)
def frozen_rows(spark, d):
    """Cells of the leakage-safe splits, numbered in a total order."""
    cells = clean_keys(table(spark, d, "attempt_log")).select("persona_type", "persona_id", "prompt_type", "prompt_id", "rep").distinct()
    a = design.hash_partitions(cells.filter(F.col("persona_id") != CONTROL), "persona_id", 7, "person", PARTS, "person_part")
    b = design.hash_partitions(cells, "prompt_id", 7, "prompt", PARTS, "prompt_part")
    rows = design.two_axis_splits(cells, a, b).filter(F.col("split").isin(*PARTS))
    out = waves.row_index(rows, ["prompt_id", "prompt_type", "persona_id", "persona_type", "rep"])
    return out.select("persona_type", "persona_id", "prompt_type", "prompt_id", "rep", "split", "row_index")


@query(f"WITH {PP} SELECT DISTINCT persona_id FROM pe ORDER BY sha256('7|person|' || persona_id), persona_id LIMIT 50")
def hash_sample(spark, d):
    """Fifty persons by hash (a sampling operator: the limit is its feature)."""
    return design.hash_sample(clean_keys(table(spark, d, "personas")), "persona_id", 50, 7, "person")


@query(
    f"""WITH {CELLS}, lv AS (SELECT persona_type, row_number() OVER (ORDER BY persona_type) - 1 AS code FROM (SELECT DISTINCT persona_type FROM cc)) SELECT persona_type, code, count(*) AS cells FROM cc JOIN lv USING (persona_type) GROUP BY ALL"""
)
def facet_codes(spark, d):
    """Facets numbered in their order, with their cells."""
    cells = clean_keys(table(spark, d, "attempt_log")).select("run_id", "persona_type", "persona_id", "prompt_type", "prompt_id", "rep").distinct()
    return level_codes(cells, "persona_type").groupBy("persona_type", "code").agg(F.count("*").alias("cells"))


@query("SELECT response_id, coalesce(lower(trim(CAST(has_response AS VARCHAR))) IN ('true', '1', 'yes', 't'), false) AS has_response FROM parsed_probes")
def response_flags(spark, d):
    """Flags as files write them, as booleans."""
    r = table(spark, d, "parsed_probes")
    return r.select("response_id", flag(F.col("has_response").cast("string")).alias("has_response"))


# ---- judging, strata, topics by unit ------------------------------------------------------
@query(
    f"""WITH {T} SELECT teacher, dimension, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, count(*) AS n FROM t WHERE score IS NOT NULL GROUP BY ALL"""
)
def judge_summary(spark, d):
    """Mean, deviation and count of the scores per teacher and dimension."""
    return rounded(judging.judge_summary(_labels(spark, d), "teacher", "dimension", F.col("score")))


@query(
    """WITH w AS (SELECT p_partkey AS k, p_name AS user_1, p_type AS user_2, p_brand AS response FROM part), t AS (SELECT k, 'user_1' AS turn, user_1 AS txt, response FROM w UNION ALL SELECT k, 'user_2', user_2, response FROM w),
x AS (SELECT k, turn, unnest(['clarity', 'warmth']) AS dimension FROM t WHERE trim(coalesce(txt, '')) <> '' AND trim(coalesce(response, '')) <> ''), dn AS (SELECT DISTINCT l_partkey AS k, 'user_1' AS turn, 'clarity' AS dimension FROM lineitem WHERE l_quantity > 45)
SELECT turn, dimension, count(*) AS tasks FROM x ANTI JOIN dn USING (k, turn, dimension) GROUP BY ALL"""
)
def judge_resume(spark, d):
    """Judging tasks left of every turn, response column and dimension."""
    wide = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("user_1"), F.col("p_type").alias("user_2"), F.col("p_brand").alias("response"))
    done = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k"), F.lit("user_1").alias("turn"), F.lit("response").alias("response_column"), F.lit("clarity").alias("dimension"))
    tasks = judging.judge_tasks(wide, ["k"], ["user_1", "user_2"], ["response"], ["clarity", "warmth"], done)
    return tasks.groupBy("turn", "dimension").agg(F.count("*").alias("tasks"))


@query(
    """WITH s AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS y, l_quantity * 1500.0 AS f FROM lineitem), u AS (SELECT 'l_returnflag' AS stratum, l_returnflag AS value, y, f FROM s UNION ALL SELECT 'l_linestatus', l_linestatus, y, f FROM s)
SELECT stratum, value, count(*) AS n, round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(y)), 6) AS r2, round(sqrt(avg((y - f) * (y - f))), 3) AS rmse, round(avg(abs(y - f)), 3) AS mae FROM u GROUP BY ALL"""
)
def stratum_metrics(spark, d):
    """Regression metrics for every value of several columns."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("f"))
    m = training.stratum_metrics(rows, ["l_returnflag", "l_linestatus"], "y", "f")
    return m.select("stratum", "value", "n", F.round("r2", 6).alias("r2"), F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"))


@query(
    f"""WITH {A}, s AS (SELECT run_id, prompt_type, prompt_id, count(probability_norm) AS n, stddev_samp(probability_norm) AS sd FROM a GROUP BY ALL HAVING count(probability_norm) > 0)
SELECT run_id, prompt_type, CAST(sum(n) AS BIGINT) AS scored, count(*) AS strata, count(sd) AS repeated, round(avg(sd), 6) AS within_sd FROM s GROUP BY ALL"""
)
def stratum_coverage(spark, d):
    """Scored rows and strata per model and framing, with the mean deviation within strata."""
    return rounded(outcome.stratum_coverage(_assumptions(spark, d), ["run_id", "prompt_type"], "prompt_id", F.col("probability_norm")))


@query(
    f"""WITH {TOP}, c AS (SELECT topic, label, count(*) AS c FROM tk GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY c DESC, label) AS r FROM c),
s AS (SELECT topic, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY ALL), e AS (SELECT topic, string_agg(label, ' | ' ORDER BY r) AS examples FROM r WHERE r <= 3 GROUP BY ALL),
pc AS (SELECT topic, prompt_id, CAST(count(*) AS DOUBLE) AS c FROM tk GROUP BY ALL), sp AS (SELECT topic, CASE WHEN count(*) > 1 THEN (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(count(*)) ELSE 0 END AS spread, count(*) AS items FROM pc GROUP BY ALL)
SELECT topic, n, round(n / sum(n) OVER (), 6) AS share, examples, round(spread, 6) AS spread, items FROM s LEFT JOIN e USING (topic) LEFT JOIN sp USING (topic)"""
)
def topic_table(spark, d):
    """Topics with size, share, examples and their spread over dilemmas."""
    return rounded(topics.topic_table(_topics(spark, d), "topic", "label", "prompt_id"))


@query(
    f"""WITH {TOP}, n AS (SELECT run_id, topic, count(*) AS n FROM tk WHERE topic <> 'the' GROUP BY ALL), s AS (SELECT count(DISTINCT topic) AS k, coalesce((SELECT max(t) / sum(t) FROM (SELECT topic, sum(n) AS t FROM n GROUP BY topic)), 0) AS top FROM n), o AS (SELECT coalesce(avg(CAST(topic = 'the' AS INT)), 0) AS out FROM tk)
SELECT warning, value FROM (SELECT 'few topics' AS warning, CAST(k AS DOUBLE) AS value FROM s WHERE k < 2 UNION ALL SELECT 'one topic', top FROM s WHERE k >= 2 AND top > 0.02 UNION ALL SELECT 'outliers', out FROM o WHERE out > 0.5)""".replace("SELECT warning, value", "SELECT warning, round(value, 6) AS value")
)
def topic_warnings(spark, d):
    """Ways in which the topics say little."""
    return rounded(topics.topic_warnings(_topics(spark, d), "topic", "the", 0.02))


@query(
    f"""WITH {TOP}, un AS (SELECT persona_type, persona_id, count(*) AS total FROM tk WHERE persona_type <> 'none' GROUP BY ALL), t5 AS (SELECT topic FROM tk GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 5), k AS (SELECT persona_type, persona_id, topic, count(*) AS k FROM tk SEMI JOIN t5 USING (topic) GROUP BY ALL),
pt AS (SELECT {p_('persona_type')} AS persona_type, {p_('persona_id')} AS persona_id, max(array_to_string(list_transform(list_filter(messages, lambda z: z.role = 'user' AND z.content IS NOT NULL), lambda z: z.content), chr(10))) AS txt FROM personas GROUP BY ALL),
u0 AS (SELECT un.persona_type, un.persona_id, total FROM un JOIN pt USING (persona_type, persona_id)), r AS (SELECT u0.persona_type, u0.persona_id, t5.topic, coalesce(k, 0) / total AS rate FROM u0 CROSS JOIN t5 LEFT JOIN k ON k.persona_type = u0.persona_type AND k.persona_id = u0.persona_id AND k.topic = t5.topic),
q AS (SELECT topic, quantile_cont(rate, 1 / 3.0) AS lo, quantile_cont(rate, 2 / 3.0) AS hi FROM r GROUP BY ALL), sd AS (SELECT persona_type, persona_id, topic, CASE WHEN rate <= lo THEN 'low' WHEN rate > hi THEN 'high' END AS side FROM r JOIN q USING (topic)),
ok AS (SELECT topic FROM sd WHERE side IS NOT NULL GROUP BY topic HAVING count(*) FILTER (side = 'high') >= 2 AND count(*) FILTER (side = 'low') >= 2),
w AS (SELECT persona_type, persona_id, unnest(regexp_extract_all(lower(txt), '[a-z]+')) AS term FROM pt SEMI JOIN u0 USING (persona_type, persona_id)), wc AS (SELECT persona_type, persona_id, term, count(*) AS n FROM w GROUP BY ALL),
pr AS (SELECT term, CAST(sum(n) AS DOUBLE) AS prior FROM wc GROUP BY ALL), al AS (SELECT sum(greatest(prior, 1)) AS mass FROM pr),
ct AS (SELECT topic, term, CAST(sum(CASE WHEN side = 'high' THEN n ELSE 0 END) AS DOUBLE) AS h, CAST(sum(CASE WHEN side = 'low' THEN n ELSE 0 END) AS DOUBLE) AS l FROM sd SEMI JOIN ok USING (topic) JOIN wc USING (persona_type, persona_id) WHERE side IS NOT NULL GROUP BY ALL),
sm AS (SELECT topic, sum(h) AS hs, sum(l) AS ls FROM ct GROUP BY ALL), z AS (SELECT topic, term, h + l AS n, prior, {word_z_('h', '(hs + mass)', 'l', '(ls + mass)', 'prior')} AS z FROM ct JOIN pr USING (term) JOIN sm USING (topic), al)
SELECT topic, term, CAST(n AS BIGINT) AS n, CAST(prior AS BIGINT) AS prior, round(z, 6) AS z FROM z WHERE abs(z) >= 0.5"""
)
def words_by_topic(spark, d):
    """Words of the persons whose answers give a topic often, against those who rarely do."""
    t = _topics(spark, d)
    unit = ["persona_type", "persona_id"]
    said = persona_texts(clean_keys(table(spark, d, "personas")), "user").groupBy(*unit).agg(F.max("text").alias("text"))
    units = t.filter(F.col("persona_type") != CONTROL).groupBy(*unit).agg(F.count("*").alias("total")).join(said.select(*unit), unit, "left_semi")
    top = t.groupBy("topic").count().orderBy(F.desc("count"), "topic").limit(5).select("topic")
    k = t.join(F.broadcast(top), "topic", "left_semi").groupBy(*unit, "topic").agg(F.count("*").alias("k"))
    rates = units.crossJoin(F.broadcast(top)).join(k, [*unit, "topic"], "left").withColumn("rate", F.coalesce("k", F.lit(0)) / F.col("total"))
    return rounded(terms.words_by_topic(rates, said.join(units.select(*unit), unit, "left_semi"), unit, "topic", "rate", "text", 2, 0.5))


@query(
    f"""WITH {A}, r AS (SELECT DISTINCT run_id, prompt_id, prompt_type, run_id || '|' || {label_('assumption')} AS label FROM a WHERE rank = 1 AND {label_('assumption')} <> ''),
pt AS (SELECT {c_('prompt_id')} AS prompt_id, prompt_type, max(text) AS txt FROM prompts WHERE text IS NOT NULL GROUP BY ALL), rl AS (SELECT DISTINCT prompt_id, prompt_type, label FROM r),
w AS (SELECT prompt_id, prompt_type, unnest(regexp_extract_all(lower(txt), '[a-z]+')) AS term FROM pt), wc AS (SELECT prompt_id, prompt_type, term, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY ALL),
tg AS (SELECT label, term, sum(n) AS n FROM rl JOIN wc USING (prompt_id, prompt_type) GROUP BY ALL), pr AS (SELECT term, sum(n) AS prior FROM wc GROUP BY ALL), ow AS (SELECT label, sum(n) AS own FROM tg GROUP BY ALL),
al AS (SELECT sum(prior) AS tokens, sum(greatest(prior, 1)) AS mass FROM pr), z AS (SELECT label, term, n, prior, {word_z_('n', '(own + mass)', '(prior - n)', '(tokens - own + mass)', 'prior')} AS z FROM tg JOIN pr USING (term) JOIN ow USING (label), al WHERE n >= 3)
SELECT label, term, CAST(n AS BIGINT) AS n, CAST(prior AS BIGINT) AS prior, round(z, 6) AS z FROM z WHERE z > 1.96"""
)
def marked_words_by_model(spark, d):
    """Words of the dilemmas under each model's first labels."""
    a = _assumptions(spark, d).filter("rank = 1").withColumn("l", normalize_label(F.col("assumption"))).filter("l <> ''").withColumn("label", F.concat_ws("|", "run_id", "l"))
    t = clean_keys(table(spark, d, "prompts")).filter("text is not null").groupBy("prompt_id", "prompt_type").agg(F.max("text").alias("text"))
    return rounded(terms.marked_words(a, t, ["prompt_id", "prompt_type"], "label", "text", 3))


@query(
    f"""WITH {A}, x AS (SELECT DISTINCT cell_key, rank, {label_('assumption')} AS label, probability_norm AS w, coalesce(description, '') AS t FROM a WHERE rank IS NOT NULL), y AS (SELECT DISTINCT cell_key, rank, label, t FROM x)
SELECT cell_key, count(*) AS n, round(max(w), 6) AS top_mass, (SELECT list(label ORDER BY rank, label, t) FROM y WHERE y.cell_key = x.cell_key)[1] AS first_label, (SELECT list(label ORDER BY rank, label, t) FROM y WHERE y.cell_key = x.cell_key) AS labels,
 list_sort(list_distinct(list(label) FILTER (label <> ''))) AS label_set, coalesce((SELECT string_agg(t, ' ' ORDER BY rank, label, t) FROM y WHERE y.cell_key = x.cell_key AND t <> ''), '') AS text FROM x GROUP BY cell_key"""
)
def response_table_full(spark, d):
    """One row per answer with its labels in order, their set, and all its texts."""
    a = _assumptions(spark, d).withColumn("label", normalize_label(F.col("assumption"))).select("cell_key", "rank", "label", "probability_norm", "description").distinct()
    out = describe.response_table(a, "cell_key", "rank", "label", "probability_norm", "description")
    return rounded(out.withColumn("label_set", F.when(F.size("label_set") > 0, F.col("label_set"))), "top_mass")


@query(
    f"""WITH {A}, w AS (SELECT persona_type, unnest(regexp_extract_all(lower(coalesce(description, '')), '[a-z]+')) AS term FROM a), c AS (SELECT persona_type, term, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY ALL),
pr AS (SELECT term, sum(n) AS prior FROM c GROUP BY ALL), ow AS (SELECT persona_type, sum(n) AS own FROM c GROUP BY ALL), al AS (SELECT sum(prior) AS tokens, sum(greatest(prior, 1)) AS mass FROM pr),
z AS (SELECT persona_type, term, n, prior, round({word_z_('n', '(own + mass)', '(prior - n)', '(tokens - own + mass)', 'prior')}, 6) AS z FROM c JOIN pr USING (term) JOIN ow USING (persona_type), al WHERE prior >= 10)
SELECT persona_type, term, z FROM z WHERE z > 0 QUALIFY row_number() OVER (PARTITION BY persona_type ORDER BY z DESC, term) <= 3"""
)
def top_contrasts(spark, d):
    """The three words that set each facet apart most (a top-k report)."""
    z = rounded(terms.group_contrasts(_assumptions(spark, d), "persona_type", "description", 10)).filter("z > 0")
    return terms.top_terms(z, ["persona_type"], "z", 3).select("persona_type", "term", "z")


@query(f"WITH {A}, x AS (SELECT cell_key, rank, {label_('assumption')} AS label FROM a WHERE assumption IS NOT NULL) SELECT DISTINCT label, length(label) <= 28 AS whole, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS plain FROM x")
def label_names(spark, d):
    """Labels as axis names, and as they are compared."""
    a = _assumptions(spark, d).filter("assumption is not null").select(normalize_label(F.col("assumption")).alias("label")).distinct()
    return a.select("label", (text.short_label(F.col("label")) == F.col("label")).alias("whole"), text.plain_name(F.col("label")).alias("plain"))


@query(
    """WITH p AS (SELECT DISTINCT persona_type, persona_id, messages FROM personas WHERE messages IS NOT NULL) SELECT persona_type, persona_id, CAST(len(messages) + CASE WHEN len(messages) > 0 AND messages[len(messages)].role = 'user' THEN 0 ELSE 1 END AS INT) AS turns,
 length(CASE WHEN len(messages) > 0 AND messages[len(messages)].role = 'user' THEN rtrim(messages[len(messages)].content, ' ') || chr(10) || chr(10) || 'Q?' ELSE 'Q?' END) AS last_chars FROM p"""
)
def deployment_chats(spark, d):
    """Each person's chat with a question as its last user turn."""
    p = table(spark, d, "personas").select("persona_type", "persona_id", "messages").filter("messages is not null").distinct()
    chat = p.withColumn("m", prompts.deployment_messages(F.col("messages"), F.lit(""), F.lit("Q?")))
    return chat.select("persona_type", "persona_id", F.size("m").alias("turns"), (F.length(F.element_at("m", -1)["content"]) - 2).alias("last_chars"))


@query(
    r"""WITH l AS (SELECT DISTINCT * FROM attempt_log), k AS (SELECT *, coalesce(error, '') = '' AND trim(coalesce(raw, '')) <> '' AS ok FROM l), c AS (SELECT cell_key, raw, regexp_extract(raw, '(?s)\{"mental_models": \[.*?\}\]\}') AS b FROM (SELECT *, row_number() OVER (PARTITION BY cell_key ORDER BY ok DESC, seq DESC) AS r FROM k WHERE probe = 'openended-3') WHERE r = 1),
v AS (SELECT cell_key, CAST(json_extract(b, '$.mental_models') AS JSON[]) AS m FROM c WHERE b <> '' AND json_valid(b)), e AS (SELECT cell_key, unnest(range(0, len(m))) AS i, m FROM v)
SELECT cell_key, CAST(i AS INT) AS rank, trim(json_extract_string(m[i + 1], '$.model_name'), ' ') AS assumption, round(CAST(json_extract_string(m[i + 1], '$.probability') AS DOUBLE), 6) AS probability FROM e"""
)
def parse_open_valid(spark, d):
    """The parsed assumptions of completions that hold a valid object, which any engine can read."""
    block = F.regexp_extract("raw", r'(?s)\{"mental_models": \[.*?\}\]\}', 0)
    log = attempts.latest_success(_log(spark, d).filter("probe = 'openended-3'").select("cell_key", "seq", "error", "raw", "n_assumptions_asked"), "cell_key", "seq", attempts.succeeded(F.col("error"), F.col("raw")))
    valid = log.filter((block != "") & F.try_parse_json(block).isNotNull())
    out = parsing.parsed_assumptions(valid, ["cell_key"]).filter("rank is not null")
    return rounded(out.select("cell_key", "rank", "assumption", "probability"))


@query()
def probe_training(spark, d):
    """Metrics of a probe over two layers (halves of the embeddings): selection, shuffled baseline, test."""
    e = table(spark, d, "embeddings").withColumn("score", F.col("label") / 9.0)
    h = F.pmod(F.xxhash64("vec_id"), F.lit(10))
    split = F.when(h < 7, "train").when(h < 8, "validation").otherwise("test")
    both = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.slice("embedding", 1 + 32 * b, 32).alias("vector")) for b in (0, 1)])).alias("x")
    out = training.train_probe(e.select("vec_id", "score", split.alias("split"), both).select("vec_id", "score", "split", "x.*"), "vec_id", "block", "vector", "score", "split")
    return spark.createDataFrame([(m["stage"], m["block"], m["n"], m["r2"], m["rmse"], m["auc"], out["passes_gate"]) for m in out["metrics"]], "stage string, block int, n long, r2 double, rmse double, auc double, passes_gate boolean")


@query()
def hashed_topics(spark, d):
    """Sizes of cluster topics over hashed word vectors of the documents, outliers moved to the closest topic."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    v = cut_lineage(topics.hashed_vectors(docs, "doc_id", "text", 64))
    placed = topics.fit_topics(v, "doc_id", "vector", 8, seed=3, far=0.3)
    return topics.reassign_outliers(cut_lineage(placed.join(v, "doc_id")), "doc_id", "topic", "vector", -1, 0.1).groupBy("topic").agg(F.count("*").alias("n"))
