import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lakeline.session import get_spark

    s = get_spark("local[*]", 8, app_name="lakeline-tests", extra={"spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir(spark):
    """A fresh folder under the shared checkpoint folder."""
    import uuid

    from lakeline.session import scratch_path

    return scratch_path(spark, f"tests/{uuid.uuid4().hex}")
