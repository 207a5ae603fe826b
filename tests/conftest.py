import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from veilspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("shared")), spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
