import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from gatherlens.session import get_session
    s = get_session("local[4]", 4, app_name="gatherlens-tests",
                    checkpoint=tempfile.mkdtemp(prefix="ckpt-", dir="/tmp"),
                    extra={"spark.ui.showConsoleProgress": "false",
                           "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="gl-test-", dir="/tmp")
