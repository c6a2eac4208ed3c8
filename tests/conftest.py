import pytest

from tessera.session import session, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": 4, "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return ship(s)
