import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidegauge.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", **{
        "spark__sql__shuffle__partitions": "2", "spark__ui__enabled": "false", "spark__driver__memory": "6g",
        "spark__sql__streaming__stateStore__providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("out"))
