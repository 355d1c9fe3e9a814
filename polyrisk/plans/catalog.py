"""Registered queries: name -> fn(spark, sf_dir) -> DataFrame.

Every query reads the driver's parquet tables in full -- episodes are built
from them once per session and read back (``params.MATERIALISE_EPISODES``)
-- and composes library operators; column names equal those of the DuckDB
twin in ``oracle_sql``.  Combinations are output as '|'-joined keys so both
engines compare strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyrisk.functions import bce_terms, combo_key, hash_unit, penalised_bce_terms, ratio, round_half_even, unit_threshold
from polyrisk.ml import weights as W
from polyrisk.operators import contingency as C
from polyrisk.operators import describe as D
from polyrisk.operators import episodes as E
from polyrisk.operators import histograms as H
from polyrisk.operators import patterns as PT
from polyrisk.operators import sampling as S
from polyrisk.operators import vocab as V
from polyrisk.plans import params as P
from polyrisk.plans.scoring import score_episodes
from polyrisk.plans.screening import run_screening
from polyrisk.session import cut_lineage, ensure_checkpoint_dir, materialise
from polyrisk.sinks import multi_hot
from polyrisk.sources import tables

Query = Callable[[SparkSession, str], DataFrame]


def _episodes(spark: SparkSession, sf_dir: str, code: str = P.CODE) -> DataFrame:
    if P.MATERIALISE_EPISODES:
        return tables.materialised_episodes(spark, sf_dir, code)
    return tables.episodes(spark, sf_dir, code)


def _show_combo(df: DataFrame, col: str = "combo") -> DataFrame:
    return df.withColumn(col, combo_key(col))


def _episode_out(df: DataFrame) -> DataFrame:
    return _show_combo(df.select("subject_id", "episode_id", "outcome", "combo", "n_codes"))


def q_exposures_distinct(spark, sf_dir):
    return tables.exposures(spark, sf_dir, P.CODE)


def q_episodes(spark, sf_dir):
    return _episode_out(_episodes(spark, sf_dir))


def q_multi_hot_wide(spark, sf_dir):
    ep = _episodes(spark, sf_dir)
    vocab = V.ordered_vocabulary(E.exposures_of(ep).select("code").distinct(), [])
    return multi_hot(ep, vocab)


def q_dataset_profile(spark, sf_dir):
    n_raw = tables.raw_row_count(spark, sf_dir).scalar()
    n_distinct = tables.distinct_row_count(spark, sf_dir, P.CODE).scalar()
    return E.dataset_profile(None, _episodes(spark, sf_dir), n_raw=n_raw, n_distinct=n_distinct)


def q_code_contingency(spark, sf_dir):
    return C.code_contingency(_episodes(spark, sf_dir))


def q_code_risk_screen(spark, sf_dir):
    return C.screen_codes(C.code_contingency(_episodes(spark, sf_dir)), P.THRES)


def _screening(spark, sf_dir):
    return run_screening(_episodes(spark, sf_dir), P.THRES)


def q_exclude_exposed_episodes(spark, sf_dir):
    return _episode_out(_screening(spark, sf_dir).after_removed)


def q_excluded_counts(spark, sf_dir):
    return _screening(spark, sf_dir).excluded_counts()


def q_screening_result(spark, sf_dir):
    return _episode_out(_screening(spark, sf_dir).cleaned)


def _co_exposure_ranked(spark, sf_dir):
    res = _screening(spark, sf_dir)
    hist = H.co_exposure_histogram(res.cleaned)
    kept = res.screen.where(F.col("screen") == C.SCREEN_KEPT).select("code", "p_pos_drug")
    joined = kept.join(hist, "code", "left").na.fill(0, [f"count_{i}" for i in range(1, 21)])
    ranked = D.rank_codes(joined, [F.desc_nulls_last("p_pos_drug")])
    return ranked.select("rank", "code", "p_pos_drug", *[f"count_{i}" for i in range(1, 21)])


def q_co_exposure_ranked(spark, sf_dir):
    return _co_exposure_ranked(spark, sf_dir)


def q_co_exposure_grid(spark, sf_dir):
    ranked = _co_exposure_ranked(spark, sf_dir)
    return H.co_exposure_grid(ranked, 15, keep=("rank", "code"))


def q_co_exposure_histogram(spark, sf_dir):
    return H.co_exposure_histogram(E.non_empty(_episodes(spark, sf_dir)))


def q_co_exposure_long(spark, sf_dir):
    return H.co_exposure_long(E.non_empty(_episodes(spark, sf_dir)))


def q_record_size_histogram(spark, sf_dir):
    return H.record_size_histogram(_screening(spark, sf_dir).cleaned)


def q_record_size_histogram_with_outcome(spark, sf_dir):
    return H.record_size_histogram(_screening(spark, sf_dir).cleaned, include_outcome=True)


def q_record_size_equal_width(spark, sf_dir):
    """E14 as the reference draws it: the row sum (codes + outcome) of the
    cleaned episodes in k equal-width bins, k = number of distinct sums."""
    cleaned = _screening(spark, sf_dir).cleaned
    sums = cleaned.select((F.col("n_codes") + F.col("outcome")).alias("row_sum"))
    return H.equal_width_histogram(sums, "row_sum")


def _kept_sizes(spark, sf_dir):
    ep = _episodes(spark, sf_dir)
    screen = C.screen_codes(C.code_contingency(ep), P.THRES)
    return H.codes_per_episode(ep, C.codes_in(screen, C.SCREEN_KEPT))


def q_codes_per_episode_by_class(spark, sf_dir):
    return H.size_by_class(_kept_sizes(spark, sf_dir))


def q_equal_width_histogram(spark, sf_dir):
    return H.equal_width_histogram(_kept_sizes(spark, sf_dir), "n_codes", "outcome")


def q_ranked_probability_curve(spark, sf_dir):
    return D.ranked_probability_curve(C.code_contingency(_episodes(spark, sf_dir)))


def q_ranked_count_curve(spark, sf_dir):
    return D.ranked_count_curve(C.code_contingency(_episodes(spark, sf_dir)))


def _patterns(spark, sf_dir, code=P.CODE):
    return PT.combo_patterns(_episodes(spark, sf_dir, code))


def q_combo_risk(spark, sf_dir):
    return _show_combo(_patterns(spark, sf_dir))


def q_combo_risk_by_type(spark, sf_dir):
    return _show_combo(_patterns(spark, sf_dir, "type"))


def _row_risk(spark, sf_dir):
    ep = _episodes(spark, sf_dir)
    return PT.attach_risk(ep, PT.combo_patterns(ep))


def q_row_level_risk(spark, sf_dir):
    return _show_combo(_row_risk(spark, sf_dir).select("subject_id", "episode_id", "outcome", "combo", "risk"))


def q_frequent_combo_episodes(spark, sf_dir):
    return _episode_out(PT.frequent_episodes(_episodes(spark, sf_dir), P.MIN_COMBO_COUNT))


def _vocabularies(ep: DataFrame, which: str = "ab"):
    """Vocabulary A: codes with at least average frequency, most frequent first.
    Vocabulary B: codes riskier with than without, by P(pos | code) descending.
    Those not named in ``which`` are None."""
    stats = C.code_contingency(ep)
    if which == "ab":
        stats = cut_lineage(stats)  # one row a code, counted once for both lists
    vocab_a = vocab_b = None
    if "a" in which:
        freq = stats.select("code", (F.col("count_outcome_0") + F.col("count_outcome_1")).alias("n_exp"))
        totals = freq.agg(F.struct(F.sum("n_exp").alias("total"), F.count(F.lit(1)).alias("m"))).scalar()
        frequent = freq.where(F.col("n_exp") * totals.getField("m") >= totals.getField("total"))
        vocab_a = V.ordered_vocabulary(frequent, [F.desc("n_exp")])
    if "b" in which:
        vocab_b = V.ordered_vocabulary(stats.where(F.col("p_pos_drug") > F.col("p_pos_nodrug")), [F.desc("p_pos_drug")])
    return vocab_a, vocab_b


def q_vocab_frequent(spark, sf_dir):
    return _vocabularies(_episodes(spark, sf_dir), "a")[0]


def q_vocab_elevated(spark, sf_dir):
    return _vocabularies(_episodes(spark, sf_dir), "b")[1]


def q_vocab_common(spark, sf_dir):
    a, b = _vocabularies(_episodes(spark, sf_dir))
    return V.vocab_common(a, b)


def q_vocab_union(spark, sf_dir):
    a, b = _vocabularies(_episodes(spark, sf_dir))
    return V.vocab_union(a, b)


def q_vocab_diff(spark, sf_dir):
    ep = _episodes(spark, sf_dir)
    a, _ = _vocabularies(ep, "a")
    return V.vocab_diff(E.exposures_of(ep), a)


def _aligned(spark, sf_dir):
    ep = _episodes(spark, sf_dir)
    a, _ = _vocabularies(ep, "a")
    risk_rows = PT.attach_risk(ep, PT.combo_patterns(ep))
    return V.align_lenient(risk_rows, a)


def q_vocab_align_lenient(spark, sf_dir):
    return _show_combo(_aligned(spark, sf_dir).select("subject_id", "episode_id", "outcome", "combo", "n_codes", "risk"))


def q_vocab_align_strict(spark, sf_dir):
    """Strict alignment to the elevated-risk vocabulary; fails if a listed code never occurs."""
    ep = _episodes(spark, sf_dir)
    return _episode_out(V.align_strict(ep, _vocabularies(ep, "b")[1]))


def q_vocab_stripped(spark, sf_dir):
    """Codes as named in the wide table and without that mark again."""
    codes = E.exposures_of(_episodes(spark, sf_dir)).select("code").distinct()
    marked = V.add_prefix(codes).select(F.col("code").alias("column"), "code")
    return V.strip_prefix(marked)


def q_episodes_by_size(spark, sf_dir):
    return _episode_out(E.sort_by_size(_episodes(spark, sf_dir)))


def q_kfold_assignment_aligned(spark, sf_dir):
    """Exact folds of the distinct (aligned combination, risk) pairs: S9."""
    pairs = PT.risk_frequency(_aligned(spark, sf_dir))
    return _show_combo(S.kfold_assign_exact(pairs, P.N_SPLITS, P.SAMPLE_SEED, risk_col="risk"))


def q_logistic_zero_gradient(spark, sf_dir):
    """Mean loss gradient of the logistic model at zero weights, by code."""
    pt = _patterns(spark, sf_dir)
    rows = pt.agg(F.sum("n")).scalar()
    per_code = pt.select(F.explode("combo").alias("code"), "n", "n_pos").groupBy("code")
    return per_code.agg((F.sum(F.col("n") * 0.5 - F.col("n_pos")) / rows).alias("gradient"))


def _fixed_scores(ep: DataFrame, patterns: DataFrame) -> DataFrame:
    """Risk by the closed-form model of the same episodes."""
    scores = W.score_patterns(patterns, W.log_odds_weights(C.code_contingency(ep)))
    return scores.withColumn("risk_predicted", round_half_even("risk_predicted", P.DENSITY_DECIMALS))


def q_logistic_gradient(spark, sf_dir):
    """Gradient of the fitted logistic model, by code: zero where the fit is the optimum (K1)."""
    pt = materialise(_patterns(spark, sf_dir), "patterns")
    gradient = W.loss_gradient(pt, W.fit_logistic_weights(pt))
    code = F.coalesce("code", F.lit("(intercept)"))
    return gradient.select(code.alias("code"), "n", "n_pos", (F.round("gradient", P.GRADIENT_DECIMALS) + F.lit(0.0)).alias("gradient"))


def q_feature_indices(spark, sf_dir):
    """Columns of each combination in the model's sparse rows."""
    pt = _patterns(spark, sf_dir)
    rows = W.feature_rows(pt, W.code_index(pt))
    return _show_combo(rows.select("combo", "n", "n_pos", F.explode("indices").alias("index")))


def _halves(ep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Episodes of either half of the subjects."""
    first = hash_unit(P.SAMPLE_SEED, "subject_id") < F.lit(unit_threshold(0.5))
    return ep.where(first), ep.where(~first)


def q_stored_model_new_scores(spark, sf_dir):
    """A model of one half of the subjects, stored, read and applied to the other half."""
    seen, new = _halves(_episodes(spark, sf_dir))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    W.write_weights(W.log_odds_weights(C.code_contingency(seen)), path)
    scores = score_episodes(new, W.read_weights(spark, path))
    return _show_combo(scores.withColumn("risk_predicted", round_half_even("risk_predicted", P.DENSITY_DECIMALS)))


def q_logistic_fixed_scores(spark, sf_dir):
    ep = _episodes(spark, sf_dir)
    return _show_combo(_fixed_scores(ep, PT.combo_patterns(ep)))


def q_calibration_fixed(spark, sf_dir):
    ep = _episodes(spark, sf_dir)
    table = D.calibration_table(_fixed_scores(ep, PT.combo_patterns(ep)))
    return _show_combo(table.withColumn("log_count", round_half_even("log_count", P.DENSITY_DECIMALS)))


def q_combo_frequency(spark, sf_dir):
    return _show_combo(PT.risk_frequency(_aligned(spark, sf_dir)))


def q_group_sample(spark, sf_dir):
    return _episode_out(S.group_sample(_episodes(spark, sf_dir), P.SAMPLE_FRACTION, P.SAMPLE_SEED))


def q_group_sample_exact(spark, sf_dir):
    return _episode_out(S.group_sample_exact(_episodes(spark, sf_dir), P.SAMPLE_FRACTION, P.SAMPLE_SEED))


def q_holdout_unseen_exact(spark, sf_dir):
    return _episode_out(S.holdout_unseen_exact(_episodes(spark, sf_dir), P.SAMPLE_FRACTION, P.SAMPLE_SEED))


def q_holdout_unseen(spark, sf_dir):
    return _episode_out(S.holdout_unseen(_episodes(spark, sf_dir), P.SAMPLE_FRACTION, P.SAMPLE_SEED))


def q_kfold_assignment_exact(spark, sf_dir):
    return _show_combo(S.kfold_assign_exact(_patterns(spark, sf_dir), P.N_SPLITS, P.SAMPLE_SEED))


def q_row_sample_exact(spark, sf_dir):
    return _episode_out(S.exact_row_sample(_episodes(spark, sf_dir), P.SAMPLE_FRACTION, P.ERROR_SEED))


def q_kfold_assignment(spark, sf_dir):
    return _show_combo(S.kfold_assign(_patterns(spark, sf_dir), P.N_SPLITS, P.SAMPLE_SEED))


def _errors(spark, sf_dir):
    return S.sampling_error(
        _episodes(spark, sf_dir), P.ERROR_FRACTIONS, P.ERROR_SEED, P.MIN_COMBO_COUNT
    )


def q_sampling_error_exact(spark, sf_dir):
    errors = S.sampling_error(
        _episodes(spark, sf_dir), P.ERROR_FRACTIONS, P.ERROR_SEED, P.MIN_COMBO_COUNT, exact=True
    )
    return _show_combo(errors)


def q_sampling_error(spark, sf_dir):
    return _show_combo(_errors(spark, sf_dir))


def q_sampling_error_wide(spark, sf_dir):
    return _show_combo(S.errors_wide(_errors(spark, sf_dir), P.ERROR_FRACTIONS))


def q_sampling_error_box(spark, sf_dir):
    box = D.box_stats(_errors(spark, sf_dir), "error", "fraction")
    d = P.QUANTILE_DECIMALS
    return box.select(
        "fraction",
        "n",
        round_half_even("q1", d).alias("q1"),
        round_half_even("median", d).alias("median"),
        round_half_even("q3", d).alias("q3"),
        "whisker_lo",
        "whisker_hi",
        "n_outliers",
    )


def q_sampling_error_kde(spark, sf_dir):
    return D.kernel_density(_errors(spark, sf_dir), "error", "fraction", decimals=P.DENSITY_DECIMALS)


def q_bce_constant_model(spark, sf_dir):
    pt = _patterns(spark, sf_dir)
    p = pt.agg(ratio(F.sum("n_pos"), F.sum("n"))).scalar()
    losses = pt.agg(F.sum(bce_terms("n", "n_pos", p)).alias("_s"), F.sum("n").alias("n_rows"))
    return losses.select(
        "n_rows", p.alias("p"), round_half_even(F.col("_s") / F.col("n_rows"), P.LOSS_DECIMALS).alias("loss")
    )


def q_penalised_bce_constant_model(spark, sf_dir):
    """Penalised loss (K6) of the constant model, penalty weights 1 as initialised."""
    pt = _patterns(spark, sf_dir)
    p = pt.agg(ratio(F.sum("n_pos"), F.sum("n"))).scalar()
    losses = pt.agg(F.sum(penalised_bce_terms("n", "n_pos", p, 1.0)).alias("_s"), F.sum("n").alias("n_rows"))
    return losses.select(
        "n_rows", p.alias("p"), round_half_even(F.col("_s") / F.col("n_rows"), P.LOSS_DECIMALS).alias("loss")
    )


def q_entropy_floor(spark, sf_dir):
    pt = _patterns(spark, sf_dir)
    agg = pt.agg(F.sum("n").alias("n_rows"), F.sum(bce_terms("n", "n_pos", "risk")).alias("_s"))
    return agg.select("n_rows", round_half_even(F.col("_s") / F.col("n_rows"), P.LOSS_DECIMALS).alias("loss"))


RELATIONAL: dict[str, Query] = {
    "exposures_distinct": q_exposures_distinct,
    "episodes": q_episodes,
    "multi_hot_wide": q_multi_hot_wide,
    "dataset_profile": q_dataset_profile,
    "code_contingency": q_code_contingency,
    "code_risk_screen": q_code_risk_screen,
    "exclude_exposed_episodes": q_exclude_exposed_episodes,
    "excluded_counts": q_excluded_counts,
    "screening_result": q_screening_result,
    "co_exposure_histogram": q_co_exposure_histogram,
    "co_exposure_ranked": q_co_exposure_ranked,
    "co_exposure_grid": q_co_exposure_grid,
    "record_size_histogram": q_record_size_histogram,
    "record_size_histogram_with_outcome": q_record_size_histogram_with_outcome,
    "record_size_equal_width": q_record_size_equal_width,
    "codes_per_episode_by_class": q_codes_per_episode_by_class,
    "equal_width_histogram": q_equal_width_histogram,
    "ranked_probability_curve": q_ranked_probability_curve,
    "ranked_count_curve": q_ranked_count_curve,
    "combo_risk": q_combo_risk,
    "combo_risk_by_type": q_combo_risk_by_type,
    "row_level_risk": q_row_level_risk,
    "frequent_combo_episodes": q_frequent_combo_episodes,
    "vocab_frequent": q_vocab_frequent,
    "vocab_elevated": q_vocab_elevated,
    "vocab_common": q_vocab_common,
    "vocab_union": q_vocab_union,
    "vocab_diff": q_vocab_diff,
    "vocab_align_lenient": q_vocab_align_lenient,
    "vocab_align_strict": q_vocab_align_strict,
    "vocab_stripped": q_vocab_stripped,
    "episodes_by_size": q_episodes_by_size,
    "co_exposure_long": q_co_exposure_long,
    "kfold_assignment_aligned": q_kfold_assignment_aligned,
    "logistic_zero_gradient": q_logistic_zero_gradient,
    "logistic_gradient": q_logistic_gradient,
    "feature_indices": q_feature_indices,
    "stored_model_new_scores": q_stored_model_new_scores,
    "logistic_fixed_scores": q_logistic_fixed_scores,
    "calibration_fixed": q_calibration_fixed,
    "combo_frequency": q_combo_frequency,
    "group_sample": q_group_sample,
    "group_sample_exact": q_group_sample_exact,
    "holdout_unseen": q_holdout_unseen,
    "holdout_unseen_exact": q_holdout_unseen_exact,
    "row_sample_exact": q_row_sample_exact,
    "kfold_assignment": q_kfold_assignment,
    "kfold_assignment_exact": q_kfold_assignment_exact,
    "sampling_error": q_sampling_error,
    "sampling_error_wide": q_sampling_error_wide,
    "sampling_error_exact": q_sampling_error_exact,
    "sampling_error_box": q_sampling_error_box,
    "sampling_error_kde": q_sampling_error_kde,
    "bce_constant_model": q_bce_constant_model,
    "entropy_floor": q_entropy_floor,
    "penalised_bce_constant_model": q_penalised_bce_constant_model,
}


def all_queries() -> dict[str, Query]:
    """Relational queries, format round trips and the model-fitting ones (which have no SQL twin)."""
    from polyrisk.plans.modeling import MODEL_QUERIES
    from polyrisk.plans.roundtrips import FORMAT_QUERIES

    return {**RELATIONAL, **FORMAT_QUERIES, **MODEL_QUERIES}
