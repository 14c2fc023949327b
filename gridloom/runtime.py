"""Session helpers shared by all operators: table loading, lineage cuts, size checks."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast only if its row count was established to be at most this.
BROADCAST_ROWS = 200_000


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table `name` of the dataset directory `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; a cluster is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        where = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Stages of this process, each with what it takes to delete it, also once the session is stopped.
_written: dict[str, tuple] = {}


def materialize(df: DataFrame, label: str = "stage", after: DataFrame | None = None) -> DataFrame:
    """Write `df` once into the shared folder and read it back.

    Cuts lineage, survives the loss of executors, and evaluates the plan exactly once (a checkpoint() of an uncached plan may
    evaluate it twice). The files stay for as long as results may read them: until `release`, or the end of the process.
    after: a stage that nothing but `df` still reads, such as the step before in an iteration; its files go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}"
    _written[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    df.write.parquet(path)
    if after is not None:
        release(after)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_stage = path
    return out


def release(stage: DataFrame | None = None) -> None:
    """Delete the files of a stage made by `materialize`, or of all stages of this process. Call it when no result reads them any more."""
    path = getattr(stage, "_gridloom_stage", None)
    for p in [path] if path else list(_written) if stage is None else []:
        found = _written.pop(p, None)
        if found is not None:
            try:
                jvm, conf = found
                folder = jvm.org.apache.hadoop.fs.Path(p)
                folder.getFileSystem(conf).delete(folder, True)
            except Exception:  # the JVM is gone; a folder of our own goes by atexit, one of the cluster with the job
                pass


atexit.register(release)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names derived from `wanted` that do not clash with any column of `df` (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def parallelism(spark: SparkSession) -> int:
    """Tasks that should exist at least: shuffle partitions or cores, whichever is more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
