"""DuckDB twins of the registered relational queries.

Each string runs on the driver's parquet tables registered as views and must
return the same columns (names and values) as the Spark query of the same
name.  Shared fragments are common table expressions.  Arrays are compared
as '|'-joined strings; ratios are integer/integer divisions in both engines,
so they are bit-identical; values that depend on summation order
(quantiles, densities, log sums) are rounded half-to-even in both.
"""

from __future__ import annotations

from polyrisk.plans import params as P

POSITIVE = "CAST(o_orderstatus = 'F' AS INTEGER)"


def exposures_cte(code_col: str) -> str:
    """Row-distinct exposures, then (as the reference's grouping does) without null keys."""
    return f"""distinct_rows AS (
  SELECT DISTINCT o_custkey AS subject_id, o_orderkey AS episode_id, {code_col} AS code,
         {POSITIVE} AS outcome
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
exposures AS (
  SELECT * FROM distinct_rows
  WHERE subject_id IS NOT NULL AND episode_id IS NOT NULL AND outcome IS NOT NULL)"""


EPISODES_CTE = """episodes AS (
  SELECT subject_id, episode_id, outcome,
         coalesce(string_agg(DISTINCT code, '|' ORDER BY code), '') AS combo,
         CAST(count(DISTINCT code) AS INTEGER) AS n_codes
  FROM exposures GROUP BY subject_id, episode_id, outcome)"""

NON_EMPTY_CTE = """ne AS (SELECT * FROM episodes WHERE n_codes > 0)"""

PATTERNS_CTE = """patterns AS (
  SELECT combo, count(*) AS n, CAST(sum(outcome) AS BIGINT) AS n_pos,
         CAST(sum(outcome) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS risk
  FROM episodes GROUP BY combo)"""


def _ratio(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN NULL ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


STATS_CTE = f"""totals AS (
  SELECT count(*) FILTER (WHERE outcome = 0) AS n0, count(*) FILTER (WHERE outcome = 1) AS n1 FROM ne),
per_code AS (
  SELECT code, count(*) FILTER (WHERE outcome = 0) AS count_outcome_0,
         count(*) FILTER (WHERE outcome = 1) AS count_outcome_1
  FROM exposures WHERE code IS NOT NULL GROUP BY code),
stats AS (
  SELECT code, count_outcome_0, count_outcome_1,
    {_ratio('n0 - count_outcome_0', 'n0 + n1 - count_outcome_0 - count_outcome_1')} AS p_neg_nodrug,
    {_ratio('count_outcome_0', 'count_outcome_0 + count_outcome_1')} AS p_neg_drug,
    {_ratio('n1 - count_outcome_1', 'n0 + n1 - count_outcome_0 - count_outcome_1')} AS p_pos_nodrug,
    {_ratio('count_outcome_1', 'count_outcome_0 + count_outcome_1')} AS p_pos_drug
  FROM per_code, totals)"""


def screen_cte(thres: int) -> str:
    return f"""screened AS (
  SELECT *, CASE
      WHEN p_pos_nodrug > p_pos_drug THEN 'end'
      WHEN p_pos_nodrug <= p_pos_drug AND count_outcome_0 + count_outcome_1 >= {thres} THEN 'kept'
      WHEN p_pos_nodrug <= p_pos_drug AND count_outcome_0 + count_outcome_1 < {thres} THEN 'removed'
    END AS screen
  FROM stats),
screen_out AS (
  SELECT screen,
         CAST(row_number() OVER (PARTITION BY screen ORDER BY p_pos_drug DESC NULLS LAST, code) - 1 AS INTEGER) AS rank,
         code, round_even(p_pos_nodrug, 2) AS p_pos_nodrug, round_even(p_pos_drug, 2) AS p_pos_drug,
         count_outcome_0, count_outcome_1
  FROM screened)"""


def _exposed_to(codes_cte: str, episodes_cte: str) -> str:
    return f"""NOT EXISTS (
      SELECT 1 FROM exposures x JOIN {codes_cte} c ON x.code = c.code
      WHERE x.subject_id = {episodes_cte}.subject_id AND x.episode_id = {episodes_cte}.episode_id
        AND x.outcome = {episodes_cte}.outcome)"""


def _counts(codes_cte: str, episodes_cte: str, step: int) -> str:
    return f"""SELECT {step} AS step, c.code, CAST(count(x.code) AS BIGINT) AS n_excluded
  FROM {codes_cte} c LEFT JOIN (
    SELECT x.code FROM exposures x JOIN {episodes_cte} s
      ON x.subject_id = s.subject_id AND x.episode_id = s.episode_id AND x.outcome = s.outcome) x
  ON x.code = c.code GROUP BY c.code"""


def screening_ctes(thres: int) -> str:
    """Everything up to the cleaned table (step1, step2, cleaned, kept_screen)."""
    return f"""{STATS_CTE},
{screen_cte(thres)},
removed AS (SELECT code FROM screened WHERE screen = 'removed'),
end_codes AS (SELECT code FROM screened WHERE screen = 'end'),
kept AS (SELECT code FROM screened WHERE screen = 'kept'),
step1 AS (SELECT * FROM ne WHERE {_exposed_to('removed', 'ne')}),
step2 AS (SELECT * FROM step1 WHERE {_exposed_to('end_codes', 'step1')}),
kept_x AS (
  SELECT x.subject_id, x.episode_id, x.outcome, x.code
  FROM exposures x JOIN kept k ON x.code = k.code),
cleaned AS (
  SELECT s.subject_id, s.episode_id, s.outcome,
         coalesce(string_agg(k.code, '|' ORDER BY k.code), '') AS combo,
         CAST(count(k.code) AS INTEGER) AS n_codes
  FROM step2 s LEFT JOIN kept_x k
    ON s.subject_id = k.subject_id AND s.episode_id = k.episode_id AND s.outcome = k.outcome
  GROUP BY s.subject_id, s.episode_id, s.outcome)"""


def with_base(code_col: str, *ctes: str) -> str:
    parts = [exposures_cte(code_col), EPISODES_CTE, NON_EMPTY_CTE, *ctes]
    return "WITH " + ",\n".join(parts) + "\n"


def _hist_columns(source: str, size_col: str, max_size: int = 20) -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE {source}.{size_col} = {i}) AS count_{i}" for i in range(1, max_size + 1)
    )


def vocab_ctes() -> str:
    """Vocabulary A (frequent codes) and B (elevated-risk codes)."""
    return f"""{STATS_CTE},
freq AS (SELECT code, count_outcome_0 + count_outcome_1 AS n_exp FROM stats),
freq_total AS (SELECT sum(n_exp) AS total, count(*) AS m FROM freq),
vocab_a AS (
  SELECT CAST(row_number() OVER (ORDER BY n_exp DESC, code) AS INTEGER) AS position, code
  FROM freq, freq_total WHERE n_exp * m >= total),
vocab_b AS (
  SELECT CAST(row_number() OVER (ORDER BY p_pos_drug DESC, code) AS INTEGER) AS position, code
  FROM stats WHERE p_pos_drug > p_pos_nodrug)"""


def _bucket(seed: int, key: str) -> str:
    return f"CAST(('0x' || substr(md5('{seed}|' || {key}), 1, 8)) AS BIGINT)"


def _threshold(fraction: float) -> str:
    return repr(fraction * 4294967296.0)


def _log(p: str) -> str:
    return f"CASE WHEN ({p}) <= 0 THEN -100.0 ELSE greatest(ln({p}), -100.0) END"


def _bce(n: str, pos: str, p: str) -> str:
    return f"-({pos} * {_log(p)} + ({n} - {pos}) * {_log('1.0 - ' + p)})"


def sampling_error_cte(seed: int, fractions, min_count: int) -> str:
    values = ", ".join(f"(CAST({f!r} AS DOUBLE))" for f in fractions)
    bucket = _bucket(seed, "CAST(e.subject_id AS VARCHAR) || '|' || CAST(e.episode_id AS VARCHAR) || '|' || CAST(e.outcome AS VARCHAR)")
    return f"""{PATTERNS_CTE},
frequent AS (SELECT e.*, {bucket} AS h FROM episodes e JOIN patterns p ON e.combo = p.combo WHERE p.n > {min_count}),
fractions AS (SELECT * FROM (VALUES {values}) t(fraction)),
sampled AS (
  SELECT f.fraction, e.combo, count(*) AS n_sample, CAST(sum(e.outcome) AS BIGINT) AS n_pos_sample
  FROM frequent e JOIN fractions f ON e.h < f.fraction * 4294967296.0
  GROUP BY f.fraction, e.combo),
err AS (
  SELECT s.fraction, s.combo, p.n, s.n_sample, p.risk AS risk_full,
         CAST(s.n_pos_sample AS DOUBLE) / CAST(s.n_sample AS DOUBLE) AS risk_sample,
         p.risk - CAST(s.n_pos_sample AS DOUBLE) / CAST(s.n_sample AS DOUBLE) AS error
  FROM sampled s JOIN patterns p ON s.combo = p.combo)"""


def build() -> dict[str, str]:
    brand = P.CODE_COLUMNS[P.CODE]
    sql: dict[str, str] = {}
    thres = P.THRES

    sql["exposures_distinct"] = with_base(brand) + "SELECT * FROM distinct_rows"
    sql["episodes"] = with_base(brand) + "SELECT * FROM episodes"

    wide = ", ".join(
        f"CAST(max(CASE WHEN code = '{c}' THEN 1 ELSE 0 END) AS INTEGER) AS \"_{c}\"" for c in P.BRAND_CODES
    )
    sql["multi_hot_wide"] = with_base(brand) + f"SELECT subject_id, episode_id, outcome, {wide} FROM exposures GROUP BY subject_id, episode_id, outcome"

    sql["dataset_profile"] = with_base(brand) + """SELECT
  (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey) AS n_rows_raw,
  (SELECT count(*) FROM distinct_rows) AS n_exposures, count(*) AS n_episodes, count(DISTINCT subject_id) AS n_subjects,
  (SELECT count(DISTINCT code) FROM exposures) AS n_codes,
  count(*) FILTER (WHERE outcome = 0) AS n_outcome_0, count(*) FILTER (WHERE outcome = 1) AS n_outcome_1
FROM episodes"""

    sql["code_contingency"] = with_base(brand, STATS_CTE) + "SELECT * FROM stats"
    sql["code_risk_screen"] = with_base(brand, STATS_CTE, screen_cte(thres)) + "SELECT * FROM screen_out"

    chain = with_base(brand, screening_ctes(thres))
    sql["exclude_exposed_episodes"] = chain + "SELECT * FROM step1"
    sql["excluded_counts"] = chain + _counts("removed", "ne", 1) + "\nUNION ALL\n" + _counts("end_codes", "step1", 2)
    sql["screening_result"] = chain + "SELECT * FROM cleaned"

    cleaned_hist = f""",
cx AS (SELECT k.code, c.n_codes FROM cleaned c JOIN kept_x k
  ON c.subject_id = k.subject_id AND c.episode_id = k.episode_id AND c.outcome = k.outcome),
hist AS (SELECT code, {_hist_columns('cx', 'n_codes')} FROM cx GROUP BY code),
ranked AS (
  SELECT CAST(row_number() OVER (ORDER BY s.p_pos_drug DESC NULLS LAST, s.code) - 1 AS INTEGER) AS rank,
         s.code, s.p_pos_drug,
         {", ".join(f"coalesce(h.count_{i}, 0) AS count_{i}" for i in range(1, 21))}
  FROM screen_out s LEFT JOIN hist h ON s.code = h.code WHERE s.screen = 'kept')
"""
    sql["co_exposure_ranked"] = chain.rstrip("\n") + cleaned_hist + "SELECT * FROM ranked"
    grid = " UNION ALL ".join(
        f"SELECT rank, code, {i} AS n_codes, count_{i} AS episodes FROM ranked" for i in range(1, 16)
    )
    sql["co_exposure_grid"] = chain.rstrip("\n") + cleaned_hist + grid
    sql["co_exposure_histogram"] = with_base(brand) + f"""SELECT x.code, {_hist_columns('e', 'n_codes')}
FROM exposures x JOIN ne e ON x.subject_id = e.subject_id AND x.episode_id = e.episode_id AND x.outcome = e.outcome
GROUP BY x.code"""

    sql["record_size_histogram"] = chain + "SELECT n_codes, count(*) AS episodes FROM cleaned GROUP BY n_codes"
    sql["record_size_histogram_with_outcome"] = chain + (
        "SELECT n_codes + outcome AS n_codes, count(*) AS episodes FROM cleaned GROUP BY n_codes + outcome"
    )
    sql["record_size_equal_width"] = chain.rstrip("\n") + """,
sums AS (SELECT n_codes + outcome AS row_sum FROM cleaned),
bounds AS (SELECT min(row_sum) AS lo, max(row_sum) AS hi, count(DISTINCT row_sum) AS k FROM sums),
binned AS (
  SELECT CASE WHEN hi = lo THEN 1
         ELSE least(CAST(floor(CAST((row_sum - lo) * k AS DOUBLE) / CAST(hi - lo AS DOUBLE)) AS BIGINT) + 1, k) END AS bin
  FROM sums, bounds)
SELECT b.bin,
       lo + CAST((hi - lo) * (b.bin - 1) AS DOUBLE) / CAST(k AS DOUBLE) AS bin_lo,
       CASE WHEN hi = lo THEN CAST(hi AS DOUBLE) ELSE lo + CAST((hi - lo) * b.bin AS DOUBLE) / CAST(k AS DOUBLE) END AS bin_hi,
       count(*) AS episodes
FROM binned b, bounds GROUP BY b.bin, lo, hi, k"""
    kept_sizes = """,
kept_sizes AS (
  SELECT subject_id, episode_id, outcome, CAST(count(*) AS INTEGER) AS n_codes
  FROM kept_x GROUP BY subject_id, episode_id, outcome)
"""
    sql["codes_per_episode_by_class"] = chain.rstrip("\n") + kept_sizes + (
        "SELECT n_codes, outcome, count(*) AS episodes FROM kept_sizes GROUP BY n_codes, outcome"
    )
    sql["equal_width_histogram"] = chain.rstrip("\n") + kept_sizes + """,
bounds AS (SELECT min(n_codes) AS lo, max(n_codes) AS hi, count(DISTINCT n_codes) AS k FROM kept_sizes),
binned AS (
  SELECT outcome, CASE WHEN hi = lo THEN 1
         ELSE least(CAST(floor(CAST((n_codes - lo) * k AS DOUBLE) / CAST(hi - lo AS DOUBLE)) AS BIGINT) + 1, k) END AS bin
  FROM kept_sizes, bounds)
SELECT b.outcome, b.bin,
       lo + CAST((hi - lo) * (b.bin - 1) AS DOUBLE) / CAST(k AS DOUBLE) AS bin_lo,
       CASE WHEN hi = lo THEN CAST(hi AS DOUBLE) ELSE lo + CAST((hi - lo) * b.bin AS DOUBLE) / CAST(k AS DOUBLE) END AS bin_hi,
       count(*) AS episodes
FROM binned b, bounds GROUP BY b.outcome, b.bin, lo, hi, k"""

    sql["ranked_probability_curve"] = with_base(brand, STATS_CTE) + """SELECT
  CAST(row_number() OVER (ORDER BY p_neg_drug ASC NULLS LAST, code) - 1 AS INTEGER) AS rank,
  code, p_pos_nodrug, p_pos_drug FROM stats"""
    sql["ranked_count_curve"] = with_base(brand, STATS_CTE) + """SELECT
  CAST(row_number() OVER (ORDER BY p_neg_drug ASC NULLS LAST, code) - 1 AS INTEGER) AS rank,
  code, count_outcome_0, count_outcome_1 FROM stats"""

    sql["combo_risk"] = with_base(brand, PATTERNS_CTE) + "SELECT * FROM patterns"
    sql["combo_risk_by_type"] = with_base(P.CODE_COLUMNS["type"], PATTERNS_CTE) + "SELECT * FROM patterns"
    row_risk = ",\nrow_risk AS (SELECT e.subject_id, e.episode_id, e.outcome, e.combo, p.risk FROM episodes e JOIN patterns p ON e.combo = p.combo)\n"
    sql["row_level_risk"] = with_base(brand, PATTERNS_CTE).rstrip("\n") + row_risk + "SELECT * FROM row_risk"
    sql["frequent_combo_episodes"] = with_base(brand, PATTERNS_CTE) + (
        f"SELECT e.* FROM episodes e WHERE e.combo IN (SELECT combo FROM patterns WHERE n > {P.MIN_COMBO_COUNT})"
    )

    vocab = with_base(brand, vocab_ctes())
    sql["vocab_frequent"] = vocab + "SELECT * FROM vocab_a"
    sql["vocab_elevated"] = vocab + "SELECT * FROM vocab_b"
    sql["vocab_common"] = vocab + """SELECT CAST(row_number() OVER (ORDER BY a.position, a.code) AS INTEGER) AS position, a.code
FROM vocab_a a WHERE a.code IN (SELECT code FROM vocab_b)"""
    sql["vocab_union"] = vocab + """SELECT CAST(row_number() OVER (ORDER BY part, position, code) AS INTEGER) AS position, code FROM (
  SELECT 0 AS part, position, code FROM vocab_a
  UNION ALL
  SELECT 1 AS part, position, code FROM vocab_b WHERE code NOT IN (SELECT code FROM vocab_a))"""
    sql["vocab_diff"] = vocab + """SELECT 'missing' AS kind, code FROM vocab_a WHERE code NOT IN (SELECT code FROM exposures WHERE code IS NOT NULL)
UNION ALL
SELECT 'unknown' AS kind, code FROM (SELECT DISTINCT code FROM exposures WHERE code IS NOT NULL) WHERE code NOT IN (SELECT code FROM vocab_a)"""
    aligned = with_base(brand, vocab_ctes(), PATTERNS_CTE).rstrip("\n") + row_risk.rstrip("\n") + """,
aligned AS (
  SELECT r.subject_id, r.episode_id, r.outcome,
         coalesce(string_agg(x.code, '|' ORDER BY x.code), '') AS combo,
         CAST(count(x.code) AS INTEGER) AS n_codes, r.risk
  FROM row_risk r LEFT JOIN (SELECT * FROM exposures WHERE code IN (SELECT code FROM vocab_a)) x
    ON r.subject_id = x.subject_id AND r.episode_id = x.episode_id AND r.outcome = x.outcome
  GROUP BY r.subject_id, r.episode_id, r.outcome, r.risk)
"""
    sql["vocab_align_lenient"] = aligned + "SELECT * FROM aligned"
    sql["combo_frequency"] = aligned + "SELECT combo, risk, count(*) AS n FROM aligned GROUP BY combo, risk"

    sql["vocab_align_strict"] = with_base(brand, vocab_ctes()) + """SELECT e.subject_id, e.episode_id, e.outcome,
  coalesce(string_agg(x.code, '|' ORDER BY x.code), '') AS combo, CAST(count(x.code) AS INTEGER) AS n_codes
FROM episodes e LEFT JOIN (SELECT * FROM exposures WHERE code IN (SELECT code FROM vocab_b)) x
  ON e.subject_id = x.subject_id AND e.episode_id = x.episode_id AND e.outcome = x.outcome
GROUP BY e.subject_id, e.episode_id, e.outcome"""
    sql["vocab_stripped"] = with_base(brand) + """SELECT DISTINCT '_' || code AS "column", replace('_' || code, '_', '') AS code
FROM exposures WHERE code IS NOT NULL"""
    sql["episodes_by_size"] = with_base(brand) + "SELECT * FROM episodes ORDER BY n_codes, subject_id, episode_id, outcome"
    sql["co_exposure_long"] = with_base(brand) + """SELECT x.code, e.n_codes, count(*) AS episodes
FROM exposures x JOIN ne e ON x.subject_id = e.subject_id AND x.episode_id = e.episode_id AND x.outcome = e.outcome
WHERE x.code IS NOT NULL GROUP BY x.code, e.n_codes"""
    gkey = "(combo || '|' || CAST(CAST(floor(risk * 9007199254740992.0) AS BIGINT) AS VARCHAR))"
    sql["kfold_assignment_aligned"] = aligned.rstrip("\n") + f""",
pairs AS (SELECT combo, risk, count(*) AS n FROM aligned GROUP BY combo, risk)
SELECT combo, risk, n, CAST(ntile({P.N_SPLITS}) OVER (ORDER BY {_bucket(P.SAMPLE_SEED, gkey)},
  CAST(('0x' || substr(md5('{P.SAMPLE_SEED}|' || {gkey}), 9, 8)) AS BIGINT), {gkey}) - 1 AS INTEGER) AS fold
FROM pairs"""
    sql["logistic_zero_gradient"] = with_base(brand) + """SELECT code,
  (count(*) * 0.5::DOUBLE - sum(outcome)) / (SELECT count(*) FROM episodes) AS gradient
FROM exposures WHERE code IS NOT NULL GROUP BY code"""
    sql["logistic_gradient"] = with_base(brand) + """SELECT code, count(*) AS n, CAST(sum(outcome) AS BIGINT) AS n_pos, 0.0::DOUBLE AS gradient
FROM exposures WHERE code IS NOT NULL GROUP BY code
UNION ALL SELECT '(intercept)', count(*), CAST(sum(outcome) AS BIGINT), 0.0::DOUBLE FROM episodes"""
    sql["feature_indices"] = with_base(brand, PATTERNS_CTE) + """, columns AS (
  SELECT code, CAST(row_number() OVER (ORDER BY code) - 1 AS INTEGER) AS index
  FROM (SELECT DISTINCT code FROM exposures WHERE code IS NOT NULL)),
pairs AS (SELECT DISTINCT e.combo, x.code FROM episodes e JOIN exposures x
  ON x.subject_id = e.subject_id AND x.episode_id = e.episode_id AND x.outcome = e.outcome)
SELECT p.combo, p.n, p.n_pos, c.index FROM patterns p JOIN pairs q ON p.combo = q.combo JOIN columns c ON c.code = q.code"""
    half = f"{_bucket(P.SAMPLE_SEED, 'CAST(subject_id AS VARCHAR)')} < {_threshold(0.5)}"
    stats_a = STATS_CTE.replace("FROM ne)", "FROM ne_a)").replace("FROM exposures", "FROM exposures_a")
    sql["stored_model_new_scores"] = with_base(brand) + f""", ne_a AS (SELECT * FROM ne WHERE {half}),
exposures_a AS (SELECT * FROM exposures WHERE {half}), {stats_a},
weights AS (
  SELECT code, CASE WHEN p_pos_drug > 0 AND p_neg_drug > 0 AND p_pos_nodrug > 0 AND p_neg_nodrug > 0
    THEN ln(p_pos_drug / p_neg_drug) - ln(p_pos_nodrug / p_neg_nodrug) ELSE 0.0 END AS w FROM stats),
new AS (SELECT * FROM episodes WHERE NOT ({half})),
risks AS (SELECT combo, CAST(sum(outcome) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS risk FROM new GROUP BY combo),
aligned AS (
  SELECT e.subject_id, e.episode_id, e.outcome, r.risk, coalesce(string_agg(DISTINCT w.code, '|' ORDER BY w.code), '') AS combo
  FROM new e JOIN risks r ON e.combo = r.combo JOIN exposures x
    ON x.subject_id = e.subject_id AND x.episode_id = e.episode_id AND x.outcome = e.outcome
  LEFT JOIN weights w ON w.code = x.code GROUP BY e.subject_id, e.episode_id, e.outcome, r.risk),
terms AS (SELECT DISTINCT a.combo, w.code, w.w FROM aligned a JOIN exposures x
  ON x.subject_id = a.subject_id AND x.episode_id = a.episode_id AND x.outcome = a.outcome JOIN weights w ON w.code = x.code),
z AS (SELECT combo, sum(w) AS z FROM terms GROUP BY combo),
pairs AS (SELECT combo, risk, count(*) AS n FROM aligned GROUP BY combo, risk)
SELECT p.combo, p.n, p.risk AS risk_true, round_even(1 / (1 + exp(-coalesce(z.z, 0.0))), {P.DENSITY_DECIMALS}) AS risk_predicted
FROM pairs p LEFT JOIN z ON z.combo = p.combo"""
    scores = with_base(brand, STATS_CTE, PATTERNS_CTE).rstrip("\n") + f""",
weights AS (
  SELECT code, CASE WHEN p_pos_drug > 0 AND p_neg_drug > 0 AND p_pos_nodrug > 0 AND p_neg_nodrug > 0
    THEN ln(p_pos_drug / p_neg_drug) - ln(p_pos_nodrug / p_neg_nodrug) ELSE 0.0 END AS w FROM stats),
combos AS (SELECT DISTINCT e.combo, x.code FROM episodes e JOIN exposures x
  ON x.subject_id = e.subject_id AND x.episode_id = e.episode_id AND x.outcome = e.outcome),
z AS (SELECT c.combo, sum(w.w) AS z FROM combos c JOIN weights w ON c.code = w.code GROUP BY c.combo),
scored AS (
  SELECT p.combo, p.n, p.risk AS risk_true, round_even(1 / (1 + exp(-coalesce(z.z, 0.0))), {P.DENSITY_DECIMALS}) AS risk_predicted
  FROM patterns p LEFT JOIN z ON p.combo = z.combo)
"""
    sql["logistic_fixed_scores"] = scores + "SELECT * FROM scored"
    sql["calibration_fixed"] = scores + (
        f"SELECT *, round_even(ln(CAST(least(n, 20) AS DOUBLE)), {P.DENSITY_DECIMALS}) AS log_count FROM scored"
    )

    bucket = _bucket(P.SAMPLE_SEED, "combo")
    sql["group_sample"] = with_base(brand) + (
        f"SELECT * FROM episodes WHERE {bucket} < {_threshold(P.SAMPLE_FRACTION)}"
    )
    sql["holdout_unseen"] = with_base(brand) + (
        f"SELECT * FROM episodes WHERE {bucket} >= {_threshold(P.SAMPLE_FRACTION)}"
    )
    ekey = "CAST(subject_id AS VARCHAR) || '|' || CAST(episode_id AS VARCHAR) || '|' || CAST(outcome AS VARCHAR)"
    sql["row_sample_exact"] = with_base(brand) + f""", keyed AS (
  SELECT *, {_bucket(P.ERROR_SEED, ekey)} AS h1,
         CAST(('0x' || substr(md5('{P.ERROR_SEED}|' || {ekey}), 9, 8)) AS BIGINT) AS h2, {ekey} AS k
  FROM episodes),
ranked AS (SELECT *, row_number() OVER (ORDER BY h1, h2, k) AS rn, count(*) OVER () AS n FROM keyed)
SELECT subject_id, episode_id, outcome, combo, n_codes FROM ranked
WHERE rn <= round_even(CAST({P.SAMPLE_FRACTION!r} AS DOUBLE) * n, 0)"""
    sql["group_sample_exact"] = with_base(brand) + f""", combos AS (
  SELECT combo, row_number() OVER (ORDER BY {_bucket(P.SAMPLE_SEED, "combo")},
         CAST(('0x' || substr(md5('{P.SAMPLE_SEED}|' || combo), 9, 8)) AS BIGINT), combo) AS rn,
         count(*) OVER () AS m
  FROM (SELECT DISTINCT combo FROM episodes))
SELECT e.* FROM episodes e JOIN combos c ON e.combo = c.combo
WHERE c.rn <= round_even(CAST({P.SAMPLE_FRACTION!r} AS DOUBLE) * c.m, 0)"""
    sql["holdout_unseen_exact"] = sql["group_sample_exact"].replace(
        "WHERE c.rn <= round_even(", "WHERE c.rn > round_even("
    )
    sql["kfold_assignment_exact"] = with_base(brand, PATTERNS_CTE) + f"""SELECT combo, n, n_pos, risk,
  CAST(ntile({P.N_SPLITS}) OVER (ORDER BY {_bucket(P.SAMPLE_SEED, "combo")},
       CAST(('0x' || substr(md5('{P.SAMPLE_SEED}|' || combo), 9, 8)) AS BIGINT), combo) - 1 AS INTEGER) AS fold
FROM patterns"""
    sql["kfold_assignment"] = with_base(brand, PATTERNS_CTE) + (
        f"SELECT *, CAST({bucket} % {P.N_SPLITS} AS INTEGER) AS fold FROM patterns"
    )

    err = with_base(brand, sampling_error_cte(P.ERROR_SEED, P.ERROR_FRACTIONS, P.MIN_COMBO_COUNT))
    sql["sampling_error"] = err + "SELECT * FROM err"
    wide_cols = ", ".join(
        f"max(CASE WHEN fraction = CAST({f!r} AS DOUBLE) THEN error END) AS error_{round(f * 100)}"
        for f in P.ERROR_FRACTIONS
    )
    sql["sampling_error_wide"] = err + f"SELECT combo, {wide_cols} FROM err GROUP BY combo"
    ekey_e = "CAST(e.subject_id AS VARCHAR) || '|' || CAST(e.episode_id AS VARCHAR) || '|' || CAST(e.outcome AS VARCHAR)"
    fvalues = ", ".join(f"(CAST({f!r} AS DOUBLE))" for f in P.ERROR_FRACTIONS)
    sql["sampling_error_exact"] = with_base(brand, PATTERNS_CTE) + f""", frequent AS (
  SELECT e.*, {_bucket(P.ERROR_SEED, ekey_e)} AS h1,
         CAST(('0x' || substr(md5('{P.ERROR_SEED}|' || {ekey_e}), 9, 8)) AS BIGINT) AS h2, {ekey_e} AS k
  FROM episodes e JOIN patterns p ON e.combo = p.combo WHERE p.n > {P.MIN_COMBO_COUNT}),
ranked AS (SELECT *, row_number() OVER (ORDER BY h1, h2, k) AS rn, count(*) OVER () AS n_all FROM frequent),
fractions AS (SELECT * FROM (VALUES {fvalues}) t(fraction)),
sampled AS (
  SELECT f.fraction, r.combo, count(*) AS n_sample, CAST(sum(r.outcome) AS BIGINT) AS n_pos_sample
  FROM ranked r JOIN fractions f ON r.rn <= round_even(f.fraction * r.n_all, 0)
  GROUP BY f.fraction, r.combo)
SELECT s.fraction, s.combo, p.n, s.n_sample, p.risk AS risk_full,
       CAST(s.n_pos_sample AS DOUBLE) / CAST(s.n_sample AS DOUBLE) AS risk_sample,
       p.risk - CAST(s.n_pos_sample AS DOUBLE) / CAST(s.n_sample AS DOUBLE) AS error
FROM sampled s JOIN patterns p ON s.combo = p.combo"""
    sql["sampling_error_box"] = err + f""", q AS (
  SELECT fraction, count(error) AS n, quantile_cont(error, 0.25) AS q1, quantile_cont(error, 0.5) AS median,
         quantile_cont(error, 0.75) AS q3 FROM err GROUP BY fraction)
SELECT q.fraction, q.n, round_even(q.q1, {P.QUANTILE_DECIMALS}) AS q1, round_even(q.median, {P.QUANTILE_DECIMALS}) AS median,
       round_even(q.q3, {P.QUANTILE_DECIMALS}) AS q3,
       min(e.error) FILTER (WHERE e.error >= q.q1 - (q.q3 - q.q1) * 1.5) AS whisker_lo,
       max(e.error) FILTER (WHERE e.error <= q.q3 + (q.q3 - q.q1) * 1.5) AS whisker_hi,
       count(*) FILTER (WHERE e.error < q.q1 - (q.q3 - q.q1) * 1.5 OR e.error > q.q3 + (q.q3 - q.q1) * 1.5) AS n_outliers
FROM q JOIN err e ON q.fraction = e.fraction
GROUP BY q.fraction, q.n, q.q1, q.median, q.q3"""
    d = P.DENSITY_DECIMALS
    sql["sampling_error_kde"] = err + f""", kstats AS (
  SELECT fraction, count(error) AS n, stddev_samp(error) * pow(count(error), -0.2) AS bw,
         min(error) AS mn, max(error) AS mx FROM err GROUP BY fraction),
kb AS (SELECT fraction, n, bw, mn - bw * 3.0 AS lo, mx + bw * 3.0 AS hi FROM kstats WHERE bw > 0),
grid AS (
  SELECT kb.fraction, kb.n, kb.bw, CAST(t.i AS INTEGER) AS grid_index,
         CASE WHEN t.i = 199 THEN kb.hi ELSE kb.lo + t.i * ((kb.hi - kb.lo) / 199) END AS x
  FROM kb, range(200) t(i))
SELECT g.fraction, g.grid_index, round_even(g.x, {d}) AS x,
       round_even(sum(exp(-0.5 * ((g.x - e.error) / g.bw) * ((g.x - e.error) / g.bw))) / (g.n * g.bw * sqrt(2 * pi())), {d}) AS density
FROM grid g JOIN err e ON g.fraction = e.fraction
GROUP BY g.fraction, g.grid_index, g.x, g.n, g.bw"""

    L = P.LOSS_DECIMALS
    sql["bce_constant_model"] = with_base(brand, PATTERNS_CTE) + f""", overall AS (
  SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n_pos) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS p FROM patterns)
SELECT o.n_rows, o.p, round_even(sum({_bce('pt.n', 'pt.n_pos', 'o.p')}) / o.n_rows, {L}) AS loss
FROM patterns pt, overall o GROUP BY o.n_rows, o.p"""
    sql["penalised_bce_constant_model"] = with_base(brand, PATTERNS_CTE) + f""", overall AS (
  SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n_pos) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS p FROM patterns)
SELECT o.n_rows, o.p,
       round_even(sum(-(1.0 * pt.n_pos * ln(o.p + 1e-7) + (pt.n - pt.n_pos) * ln(1.0 - o.p + 1e-7))) / o.n_rows, {L}) AS loss
FROM patterns pt, overall o GROUP BY o.n_rows, o.p"""
    sql["entropy_floor"] = with_base(brand, PATTERNS_CTE) + f"""SELECT CAST(sum(n) AS BIGINT) AS n_rows,
  round_even(sum({_bce('n', 'n_pos', 'risk')}) / sum(n), {L}) AS loss FROM patterns"""
    # A file that is written and read back holds the table it was made from.
    sql["format_long_csv"] = sql["exposures_distinct"]
    sql["format_multi_hot_csv"] = sql["episodes"]
    sql["format_vocabulary_json"] = sql["vocab_frequent"]
    sql["format_code_stats_csv"] = sql["code_contingency"]
    sql["format_screens_csv"] = sql["code_risk_screen"] + " WHERE screen IS NOT NULL"
    sql["format_scores_csv"] = sql["logistic_fixed_scores"]
    return sql
