import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidewheel.session import local_session

    session = local_session("local[4]", shuffle_partitions=4, checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
