import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallyspan.session import get_session

    s = get_session("tests", master="local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="4g", spark_ui_showConsoleProgress="false", spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")), spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
