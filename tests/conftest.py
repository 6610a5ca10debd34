import pytest

from skyloom.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    top = tmp_path_factory.mktemp("spark")
    s = session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.sql.warehouse.dir": str(top / "warehouse"),
            "spark.checkpoint.dir": str(top / "shared"),
        },
    )
    yield s
    s.stop()
