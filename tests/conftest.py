import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from paperloom.session import build_session

    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests",
        cores=4,
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.sql.codegen.wholeStage": "false",  # tiny tables: compiling code would take most of the time
            "spark.driver.memory": "4g",
            "spark.sql.warehouse.dir": f"file://{shared}/warehouse",
            "spark.checkpoint.dir": f"file://{shared}/checkpoints",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
