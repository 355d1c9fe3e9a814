import os
import sys
import tempfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if REPO not in sys.path:
    sys.path.insert(0, REPO)

from polyrisk.session import build_session, ensure_checkpoint_dir  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MEDIUM = "/root/testdata/sf0.01"

# Golden fixture (FIXTURES.md §4): subject, episode, code, outcome.
GOLDEN_ROWS = [
    (1, "2020-01-01", "A", 1),
    (1, "2020-01-01", "B", 1),
    (1, "2020-01-01", "B", 1),
    (2, "2020-02-01", "A", 0),
    (2, "2020-02-01", "B", 0),
    (3, "2020-03-01", "A", 0),
    (4, "2020-04-01", "A", 1),
    (5, "2020-05-01", "C", 0),
    (6, "2020-06-01", "A", 0),
    (7, "2020-07-01", None, 1),
    (None, "2020-08-01", "A", 1),
    (8, "2020-08-15", "D", 1),
    (9, "2020-09-01", "B", 1),
]
EXPOSURE_SCHEMA = "subject_id bigint, episode_id string, code string, outcome int"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", app_name="polyrisk-tests", shuffle_partitions=4)
    # Tests run on one machine with no cluster checkpoint folder configured.
    ensure_checkpoint_dir(session, tempfile.mkdtemp(prefix="polyrisk-test-ckpt-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def golden(spark):
    return spark.createDataFrame(GOLDEN_ROWS, EXPOSURE_SCHEMA)


@pytest.fixture(scope="session")
def golden_episodes(spark, golden):
    from polyrisk.operators.episodes import build_episodes

    return build_episodes(golden).cache()


def combos(df, col="combo"):
    return {tuple(r[col]) for r in df.select(col).collect()}
