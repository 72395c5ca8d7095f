import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

DATA_SMALL = "/root/testdata/sf0.001"
DATA_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sessionscope.session import build_session, ensure_checkpoint_dir

    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    session = build_session(
        "local[*]",
        app_name="sessionscope-tests",
        shuffle_partitions=8,
        extra_conf={"spark.sql.warehouse.dir": warehouse},
    )
    # tests only: a local checkpoint folder when the session names none
    ensure_checkpoint_dir(session, str(tmp_path_factory.mktemp("ckpt")))
    yield session
    session.stop()
