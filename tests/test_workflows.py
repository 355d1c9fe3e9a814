import os

import pytest
from pyspark.sql import functions as F

from polyrisk.plans import workflows as W
from polyrisk.plans.modeling import observed_vocabulary
from polyrisk.sources import tables

SF = "/root/testdata/sf0.001"


def test_statistics_workflow(spark, tmp_path):
    out = str(tmp_path / "stats")
    paths = W.run_statistics(tables.exposure_rows(spark, SF, "brand"), out, thres=200)
    for name in ("episodes", "cleaned", "screens", "code_probabilities", "excluded_counts", "co_exposure", "profile"):
        assert os.path.exists(os.path.join(out, name)), name
    cleaned = spark.read.parquet(paths["cleaned"])
    screens = spark.read.option("header", True).csv(os.path.join(out, "screens"))
    kept = {r.code for r in screens.where("screen = 'kept'").collect()}
    assert all(set(r.combo) <= kept for r in cleaned.collect())


def test_training_scoring_and_sampling_workflows(spark, tmp_path):
    eps = tables.episodes(spark, SF, "brand")
    vocab = observed_vocabulary(eps)
    run = W.run_training(eps, vocab, str(tmp_path / "train"), n_trials=2, n_splits=2, epoch_choices=(2, 3))
    assert run.trials.count() == 2 and len(run.result.train_loss) == run.best["epoch"]
    seen = spark.read.option("header", True).csv(str(tmp_path / "train" / "seen_probabilities"))
    assert seen.count() > 0
    scores = W.run_scoring(tables.episodes(spark, SF, "type").union(eps), str(tmp_path / "train" / "model"),
                           run.result.spec.activation, vocab, str(tmp_path / "score"))
    assert scores.where(F.col("risk_predicted").isNull()).count() == 0
    W.run_sampling_study(tables.episodes(spark, SF, "type"), str(tmp_path / "errors"))
    box = spark.read.option("header", True).csv(str(tmp_path / "errors" / "box"))
    assert box.count() == 4


def test_training_samples_aligned_combinations(spark, tmp_path, monkeypatch):
    """The size of the sample follows the combinations that the vocabulary leaves."""
    eps = spark.createDataFrame(
        [(str(i), "1", [f"c{i % 4}", f"other{i}"], i % 2) for i in range(40)],
        "subject_id string, episode_id string, combo array<string>, outcome int",
    )
    seen = {}

    def stop(sampled, vocab, **_):
        seen["combos"] = {tuple(r.combo) for r in sampled.select("combo").collect()}
        raise StopIteration

    monkeypatch.setattr(W.TR, "prepare", stop)
    with pytest.raises(StopIteration):
        W.run_training(eps, [f"c{i}" for i in range(4)], str(tmp_path), fraction=0.5)
    assert len(seen["combos"]) == 2 and seen["combos"] < {(f"c{i}",) for i in range(4)}
