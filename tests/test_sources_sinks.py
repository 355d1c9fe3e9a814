import json
import os

from pyspark.sql import functions as F

from polyrisk import sinks
from polyrisk.sources import files


def test_long_csv_reader(spark, tmp_path):
    p = tmp_path / "pharma.csv"
    p.write_text("ID,fin_grossesse,medicament,diagnosis,other\n1,2020-01-01,A,1,x\n1,2020-01-01,B,1,y\n2,2020-02-01,A,0,z\n")
    df = files.read_long_csv(spark, str(p))
    assert df.columns == ["subject_id", "episode_id", "code", "outcome"]
    assert df.count() == 3


def test_multi_hot_roundtrip(spark, tmp_path, golden_episodes):
    vocab = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D")], "position int, code string")
    out = str(tmp_path / "wide")
    sinks.write_multi_hot_csv(golden_episodes.withColumn("episode_id", golden_episodes.episode_id), vocab, out)
    back = files.read_multi_hot_csv(spark, out, key_columns=("subject_id", "episode_id"), outcome_column="outcome")
    got = {(r.subject_id, r.outcome, tuple(r.combo)) for r in back.collect()}
    want = {(r.subject_id, r.outcome, tuple(r.combo)) for r in golden_episodes.collect()}
    assert got == want


def test_multi_hot_wide_columns(spark, golden_episodes):
    vocab = spark.createDataFrame([(1, "B"), (2, "A"), (3, "X")], "position int, code string")
    wide = sinks.multi_hot(golden_episodes, vocab)
    assert wide.columns == ["subject_id", "episode_id", "outcome", "_B", "_A", "_X"]
    row = wide.where("subject_id = 1").first()
    assert (row["_A"], row["_B"], row["_X"]) == (1, 1, 0)


def test_vocabulary_json(spark, tmp_path):
    p = tmp_path / "cols.json"
    p.write_text(json.dumps({"columns": ["_N02BE01", "_A10", "risk", "diagnosis"]}))
    got = [(r.position, r.code) for r in files.read_vocabulary_json(spark, str(p)).collect()]
    assert got == [(1, "N02BE01"), (2, "A10")]


def test_loss_and_trial_readers(spark, tmp_path):
    loss = tmp_path / "loss.csv"
    loss.write_text('Epoch,Loss_train\n1,"(0.5,)"\n2,0.25\n')
    assert [(r.epoch, r.loss_train) for r in files.read_loss_csv(spark, str(loss)).collect()] == [(1, 0.5), (2, 0.25)]
    trials = tmp_path / "trials.csv"
    trials.write_text(
        "epoch,activation,layers,hidden_dim_1,hidden_dim_2,learning_rate,value\n"
        "500,RELU,1,200,,0.002,0.42\n1000,LRELU,2,300,100.0,0.0001,0.5\n"
    )
    rows = files.read_trials_csv(spark, str(trials)).collect()
    assert rows[0].hidden_dim_2 is None and rows[1].hidden_dim_2 == 100
    assert [r.rank for r in rows] == [1, 2]


def test_best_params_reader(spark, tmp_path):
    p = tmp_path / "params.txt"
    p.write_text("{'epoch': 500, 'activation': 'RELU', 'layers': 1, 'hidden_dim_1': 100, 'learning_rate': 0.0027}")
    assert files.read_best_params(spark, str(p))["hidden_dim_1"] == 100


def test_screen_sink_partitions(spark, tmp_path, golden_episodes):
    from polyrisk.operators.contingency import code_contingency, screen_codes

    out = str(tmp_path / "screens")
    sinks.write_screens(screen_codes(code_contingency(golden_episodes), 2), out)
    assert sorted(d for d in os.listdir(out) if d.startswith("screen=")) == ["screen=end", "screen=kept", "screen=removed"]


def test_vocabulary_of_any_size(spark):
    vocab = spark.range(12_000).selectExpr("cast(12000 - id as int) as position", "concat('C', id) as code")
    codes = sinks.vocabulary_codes(vocab)
    assert len(codes) == 12_000 and codes[0] == "C11999" and codes[-1] == "C0"


def test_multi_hot_reader_without_keys(spark, tmp_path):
    p = tmp_path / "wide.csv"
    p.write_text("_A,_B,_C,risk,diagnosis\n1,0,1,0.5,1\n0,0,0,1.0,0\n0,1,0,0.0,1\n")
    eps = files.read_multi_hot_csv(spark, str(p))
    rows = sorted((tuple(r.combo), r.outcome) for r in eps.collect())
    assert rows == [((), 0), (("A", "C"), 1), (("B",), 1)]
    assert eps.select("episode_id").distinct().count() == 3


def test_multi_hot_reader_ids_do_not_depend_on_files(spark, tmp_path):
    rows = ["1,0,1", "1,0,1", "0,1,0", "1,0,1"]
    one, two = tmp_path / "one", tmp_path / "two"
    for folder, parts in ((one, [rows]), (two, [rows[2:], rows[:1], rows[1:2]])):
        folder.mkdir()
        for i, part in enumerate(parts):
            (folder / f"part-{i}.csv").write_text("\n".join(["_A_1,_B,diagnosis", *part]) + "\n")
    a, b = (sorted(tuple(r) for r in files.read_multi_hot_csv(spark, str(p)).select("episode_id", "outcome", "n_codes").collect()) for p in (one, two))
    assert a == b and len({x[0] for x in a}) == 4
    assert {tuple(r.combo) for r in files.read_multi_hot_csv(spark, str(one)).collect()} == {("A1",), ("B",)}


def test_multi_hot_reader_string_subjects(spark, tmp_path):
    p = tmp_path / "wide.csv"
    p.write_text("ID,fin_grossesse,_A,diagnosis\nx-1,2020-01-01,1,1\n")
    assert files.read_multi_hot_csv(spark, str(p), subject_type="string").first().subject_id == "x-1"


def test_reference_names(spark, golden_episodes):
    from polyrisk.operators.contingency import code_contingency

    cols = sinks.with_reference_names(code_contingency(golden_episodes)).columns
    assert cols == ["medicament", "count_diagnosis_0", "count_diagnosis_1", "proba_healthy_nodrug",
                    "proba_healthy_drug", "proba_nothealthy_nodrug", "proba_nothealthy_drug"]


def test_combinations_survive_csv(spark, tmp_path):
    """Codes with bars, backslashes, quotes, commas, blanks and line ends, empty and null ones."""
    from polyrisk import sinks
    from polyrisk.functions import combo_from_text, combo_identity
    from polyrisk.sources import files

    combos = [[], [""], ["A", "B"], ["A|B"], ["|"], ["\\"], ["\\p"], ["\\\\p", "|\\"], ["\\e", "", "e"], ["a\nb", 'q"q', "x,y"], [" pad ", "\t"], [None, "n"], ["\\n"]]
    df = spark.createDataFrame([(i, c, 0.5) for i, c in enumerate(combos)], "id int, combo array<string>, risk double").repartition(3)
    texts = {tuple(r.c): r.t for r in df.select(F.col("combo").alias("c"), combo_identity("combo").alias("t")).collect()}
    assert len(set(texts.values())) == len(combos)
    back = {r.id: r.c for r in df.select("id", combo_from_text(combo_identity("combo")).alias("c")).collect()}
    assert back == dict(enumerate(combos))
    path = str(tmp_path / "scores")
    sinks.write_csv(df, path)
    assert {r.id: (r.combo, r.risk) for r in files.read_csv(spark, path, df.schema).collect()} == {i: (c, 0.5) for i, c in enumerate(combos)}
