import pytest
from pyspark.sql import functions as F

from polyrisk.operators import contingency as C
from polyrisk.operators.episodes import build_episodes
from polyrisk.plans.screening import run_screening


def test_golden_code_stats(golden_episodes):
    stats = {r.code: r for r in C.code_contingency(golden_episodes).collect()}
    assert (stats["A"].count_outcome_0, stats["A"].count_outcome_1) == (3, 2)
    assert stats["A"].p_pos_nodrug == pytest.approx(2 / 3)
    assert stats["A"].p_pos_drug == 0.4
    assert (stats["B"].count_outcome_0, stats["B"].count_outcome_1) == (1, 2)
    assert stats["B"].p_pos_nodrug == 0.4
    assert stats["C"].p_pos_nodrug == 4 / 7 and stats["C"].p_pos_drug == 0.0
    assert stats["D"].p_pos_nodrug == 3 / 7 and stats["D"].p_pos_drug == 1.0


def test_probabilities_complement(golden_episodes):
    """P(neg|x) + P(pos|x) = 1 where defined."""
    for r in C.code_contingency(golden_episodes).collect():
        assert r.p_neg_drug + r.p_pos_drug == pytest.approx(1.0)
        assert r.p_neg_nodrug + r.p_pos_nodrug == pytest.approx(1.0)


def test_golden_screen(golden_episodes):
    screen = {r.code: r for r in C.screen_codes(C.code_contingency(golden_episodes), thres=2).collect()}
    assert {c: r.screen for c, r in screen.items()} == {"A": "end", "B": "kept", "C": "end", "D": "removed"}
    assert (screen["A"].p_pos_nodrug, screen["A"].p_pos_drug) == (0.67, 0.40)
    assert (screen["B"].p_pos_nodrug, screen["B"].p_pos_drug) == (0.40, 0.67)
    assert (screen["C"].p_pos_nodrug, screen["C"].p_pos_drug) == (0.57, 0.00)
    assert (screen["D"].p_pos_nodrug, screen["D"].p_pos_drug) == (0.43, 1.00)
    # rank inside the 'end' screen: A (0.4) before C (0.0)
    assert (screen["A"].rank, screen["C"].rank) == (0, 1)


def test_screen_partition_is_disjoint_and_complete(spark, golden):
    """I3 with an undecidable code: present in every episode -> NULL screen."""
    rows = [(i, f"e{i}", "Z", i % 2) for i in range(6)] + [(i, f"e{i}", "Y", i % 2) for i in range(3)]
    eps = build_episodes(spark.createDataFrame(rows, "subject_id long, episode_id string, code string, outcome int"))
    screen = {r.code: r.screen for r in C.screen_codes(C.code_contingency(eps), 1).collect()}
    assert screen["Z"] is None
    assert screen["Y"] in {"kept", "removed", "end"}


def test_rounding_is_half_even(spark):
    from polyrisk.functions import round_half_even

    df = spark.createDataFrame([(0.125,), (0.375,), (0.145,), (0.005,)], "x double")
    got = [r[0] for r in df.select(round_half_even("x", 2)).collect()]
    assert got == [0.12, 0.38, 0.14, 0.0]


def test_golden_exclusion_chain(golden_episodes):
    res = run_screening(golden_episodes, thres=2)
    assert {r.code: r.n_excluded for r in res.removed_counts.collect()} == {"D": 1}
    assert res.after_removed.count() == 7
    assert {r.code: r.n_excluded for r in res.end_counts.collect()} == {"A": 5, "C": 1}
    left = res.after_end.collect()
    assert [(r.subject_id, tuple(r.combo), r.outcome) for r in left] == [(9, ("B",), 1)]
    cleaned = res.cleaned.collect()
    assert [tuple(r.combo) for r in cleaned] == [("B",)]
    steps = {(r.step, r.code): r.n_excluded for r in res.excluded_counts().collect()}
    assert steps == {(1, "D"): 1, (2, "A"): 5, (2, "C"): 1}


def test_exclusion_methods_agree(golden_episodes, spark):
    codes = spark.createDataFrame([("A",), ("D",)], "code string")
    inline = C.exclude_exposed(golden_episodes, codes, "inline")
    joined = C.exclude_exposed(golden_episodes, codes, "join")
    assert sorted(map(tuple, inline.collect())) == sorted(map(tuple, joined.collect()))
    assert inline.where(F.arrays_overlap("combo", F.array(F.lit("A"), F.lit("D")))).count() == 0


def test_exclusion_counts_include_unseen_codes(golden_episodes, spark):
    codes = spark.createDataFrame([("A",), ("Q",)], "code string")
    got = {r.code: r.n_excluded for r in C.exclusion_counts(golden_episodes, codes).collect()}
    assert got == {"A": 5, "Q": 0}


def test_long_code_lists_are_joined_with_the_same_result(spark, golden_episodes, monkeypatch):
    from polyrisk.operators import histograms as H
    from polyrisk.operators import vocab as V

    codes = spark.createDataFrame([("A",), ("B",), ("C",), ("A",), (None,)], "code string")

    def snapshot():
        rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
        screened = run_screening(golden_episodes, thres=2)
        return (
            rows(C.exclude_exposed(golden_episodes, codes)),
            rows(C.exclusion_counts(golden_episodes, codes)),
            rows(C.restrict_codes(golden_episodes, codes)),
            rows(V.align_lenient(golden_episodes, codes)),
            rows(H.codes_per_episode(golden_episodes, codes)),
            rows(screened.cleaned),
            rows(screened.excluded_counts()),
        )

    inlined = snapshot()
    monkeypatch.setattr(C, "INLINE_CODES", 1)
    assert snapshot() == inlined
    assert len(inlined[0]) == 2


def test_empty_code_list(spark, golden_episodes):
    codes = spark.createDataFrame([], "code string")
    n = golden_episodes.count()
    assert C.exclude_exposed(golden_episodes, codes).count() == n
    assert C.restrict_codes(golden_episodes, codes).where("n_codes = 0").count() == n
    assert C.exclusion_counts(golden_episodes, codes).count() == 0
