from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from assayer.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield configure(session)
    session.stop()


FILES_SCHEMA = (
    "repo string, commit_sha string, ord long, path string, sha string, size long, "
    "content string, language string"
)


@pytest.fixture(scope="session")
def make_files(spark):
    """``[(path, content), …]`` of one repository to a files frame, in that order."""

    def make(entries, repo="r", commit="c"):
        rows = [
            (repo, commit, i, path, f"sha{i}", len(content), content, path.rsplit(".", 1)[-1])
            for i, (path, content) in enumerate(entries)
        ]
        return spark.createDataFrame(rows, FILES_SCHEMA)

    return make
