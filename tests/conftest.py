import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from scholia.session import session

    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--master local[4] --driver-memory 3g pyspark-shell")
    top = tmp_path_factory.mktemp("spark")
    s = session(
        "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(top / "checkpoints"), "spark.sql.warehouse.dir": str(top / "warehouse")}
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(top / "checkpoints"))
    yield s
    s.stop()
