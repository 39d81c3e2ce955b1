import pytest

from viaduct.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", cores=4, shuffle_partitions=4)
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
