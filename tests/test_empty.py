"""Operators on empty inputs return empty results instead of failing."""

from polyrisk.operators import contingency as C
from polyrisk.operators import describe as D
from polyrisk.operators import histograms as H
from polyrisk.operators import patterns as PT
from polyrisk.operators import sampling as S
from polyrisk.operators.episodes import build_episodes
from polyrisk.plans.screening import run_screening
from tests.conftest import EXPOSURE_SCHEMA


def test_empty_inputs(spark):
    eps = build_episodes(spark.createDataFrame([], EXPOSURE_SCHEMA))
    assert PT.combo_patterns(eps).count() == 0
    assert C.code_contingency(eps).count() == 0
    res = run_screening(eps, 2)
    assert res.cleaned.count() == 0 and res.excluded_counts().count() == 0
    assert H.co_exposure_histogram(eps).count() == 0
    assert H.equal_width_histogram(eps, "n_codes").count() == 0
    err = S.sampling_error(eps)
    assert err.count() == 0
    assert D.box_stats(err, "error", "fraction").count() == 0
    assert D.kernel_density(err, "error", "fraction").count() == 0
