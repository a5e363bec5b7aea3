import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
sys.path[:0] = [ROOT, str(Path(__file__).parent)]
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


from samples import ODD, SCHEMA  # noqa: E402


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture()
def clashing(odd):
    """The same rows with more columns, whose names the operators use inside."""
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit(c) for c in ("salt", "digest", "key", "n", "id", "component", "spans", "text_hash", "score", "kept", "path", "block", "label", "start")})


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
