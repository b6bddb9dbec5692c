import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from papyra.session import build_session

    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="3g", spark__default__parallelism="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """rows(df) -> sorted tuples of its values."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
