import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sheaf.session import ensure_checkpoint_dir, get_session
    s = get_session("local[4]", app_name="sheaf-tests", shuffle_partitions=4,
                    extra={"spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="sheaf-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="sheaf-test-")


SF = "/root/testdata/sf0.001"
