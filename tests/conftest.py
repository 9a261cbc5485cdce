import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from matchsmith.session import get_spark, ensure_checkpoint_dir
    s = get_spark(master="local[*]", shuffle_partitions=8)
    ensure_checkpoint_dir(s)
    yield s
