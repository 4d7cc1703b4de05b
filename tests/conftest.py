import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import session

    made = session("local[4]", 4, "4g", **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    made.sparkContext.setLogLevel("ERROR")
    return made


#: The driver's tables, the smallest scale factor.
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
