import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.engine.session import local_session  # noqa: E402

DATA = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, app="tidemark-tests", shuffle=4, memory="4g")
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Sorted tuples of a frame, with NaN spelled out so that it equals itself."""

    def get(df, *cols):
        fix = lambda v: "NaN" if isinstance(v, float) and v != v else v
        got = [tuple(fix(v) for v in r) for r in (df.select(*cols) if cols else df).collect()]
        return sorted(got, key=lambda t: tuple((v is None, str(type(v)), v) if not isinstance(v, (list, dict)) else (False, "", str(v)) for v in t))

    return get
