import glob
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from gridloom import runtime


class Elsewhere:
    """A session whose master is a cluster and that names no shared folder."""

    class conf:
        @staticmethod
        def get(name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        runtime.shared_dir(Elsewhere)


def test_stages_are_read_back_and_deleted(spark):
    first = runtime.materialize(spark.range(10).withColumn("x", F.rand(1)), "t")
    path = first._gridloom_stage.removeprefix("file://").removeprefix("file:")
    assert first.count() == 10 and glob.glob(path + "/*.parquet")
    second = runtime.materialize(first.where("id < 5"), "t", after=first)
    assert not os.path.exists(path) and second.count() == 5
    runtime.release(second)
    runtime.release(spark.range(1))  # no stage: nothing to do


def test_no_folder_is_left_by_a_process(tmp_path):
    code = "import sys; from pyspark.sql import SparkSession; from gridloom.runtime import materialize; s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://' + sys.argv[1]).getOrCreate(); materialize(s.range(3)); materialize(s.range(4)); s.stop()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code, str(tmp_path)], check=True, cwd=root, capture_output=True)
    assert (tmp_path / "gridloom").is_dir() and not list((tmp_path / "gridloom").glob("stage-*"))
