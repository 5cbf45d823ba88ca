import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from codestrata.session import local_session, ship_package

    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    from compare import duck_connection

    return duck_connection(SF)


@pytest.fixture
def files(spark):
    """files(repo, path, size, mode, mtime, content) from (path, content[, mode]) tuples."""
    def make(*rows, repo="r"):
        data = [(repo, r[0], len(r[1].encode()), r[2] if len(r) > 2 else 0o644, None, r[1]) for r in rows]
        return spark.createDataFrame(
            data, "repo string, path string, size long, mode int, mtime timestamp, content string"
        )
    return make
