"""Intermediate tables in the shared folder.

They live under the folder the session names in ``spark.checkpoint.dir``, so any executor can read
them again after another one was lost. Only a session without executors of its own (local mode) gets a temporary
folder where that setting is absent. ``intermediates`` gives the tables a lifetime.
"""

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[str] = []


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where the session's own path does not hold it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}" if paths else root


def shared_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark._jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="bipath-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return "/".join([configured.rstrip("/"), *_SCOPES])


@contextlib.contextmanager
def intermediates(spark: SparkSession):
    """Everything written inside goes into one folder, which is deleted at the end.

    Consume or store the results before the block ends: they read these tables.
    """
    _SCOPES.append(f"scope-{uuid.uuid4().hex}")
    root = shared_root(spark)
    try:
        yield root
    finally:
        _SCOPES.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str = "stage") -> DataFrame:
    """``df`` as a parquet table in the shared folder, read back from then on.

    This cuts the lineage like a checkpoint. Being columnar and of known size, the table also lets
    later plans prune its columns and decide on broadcasts by its real size.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
