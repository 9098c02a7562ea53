import pytest

from gradeloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "3g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.autoBroadcastJoinThreshold": "256k",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
