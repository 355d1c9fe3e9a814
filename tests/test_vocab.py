import pytest

from polyrisk.operators import vocab as V


@pytest.fixture()
def vocabs(spark):
    a = spark.createDataFrame([(1, "B"), (2, "A"), (3, "X")], "position int, code string")
    b = spark.createDataFrame([(1, "Y"), (2, "A"), (3, "B")], "position int, code string")
    return a, b


def test_common_keeps_first_order(vocabs):
    a, b = vocabs
    assert [(r.position, r.code) for r in V.vocab_common(a, b).orderBy("position").collect()] == [(1, "B"), (2, "A")]


def test_union_appends_new_codes(vocabs):
    a, b = vocabs
    got = [r.code for r in V.vocab_union(a, b).orderBy("position").collect()]
    assert got == ["B", "A", "X", "Y"]


def test_diff_and_alignment(spark, golden_episodes, vocabs):
    a, _ = vocabs
    from polyrisk.operators.episodes import exposures_of

    diff = {(r.kind, r.code) for r in V.vocab_diff(exposures_of(golden_episodes), a).collect()}
    assert diff == {("missing", "X"), ("unknown", "C"), ("unknown", "D")}
    aligned = {r.subject_id: tuple(r.combo) for r in V.align_lenient(golden_episodes, a).collect()}
    assert aligned[1] == ("A", "B") and aligned[5] == () and aligned[8] == ()


def test_strict_alignment_fails_on_missing(golden_episodes, vocabs):
    a, _ = vocabs
    with pytest.raises(V.VocabularyMismatch):
        V.align_strict(golden_episodes, a)


def test_prefix_roundtrip(spark):
    df = spark.createDataFrame([("N02_BE01",)], "code string")
    added = V.add_prefix(df).first().code
    assert added == "_N02_BE01"
    assert V.strip_prefix(V.add_prefix(df)).first().code == "N02BE01"  # every underscore goes
