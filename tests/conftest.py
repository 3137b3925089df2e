import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = {s: f"/root/testdata/sf{s}" for s in ("0.001", "0.01", "0.1")}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from agora.session import get_spark
    s = get_spark("local[4]", 8, **{"spark__checkpoint__dir": str(tmp_path_factory.mktemp("checkpoint"))})
    yield s
