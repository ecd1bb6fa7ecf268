import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from codeprism.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def files(spark):
    """A table of source files from a dict of path -> content."""
    from codeprism.functions.scalars import language_of

    def make(tree: dict[str, str | None]):
        return spark.createDataFrame(list(tree.items()), "path string, content string").withColumn("language", language_of("path"))

    return make
