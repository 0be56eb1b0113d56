from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from foliant.session import session

    found = session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.sql.files.openCostInBytes": "64k", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    found.sparkContext.setLogLevel("ERROR")
    return found
