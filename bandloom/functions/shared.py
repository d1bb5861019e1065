"""Tables and paths in the folder that driver and executors share."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import require


PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once a session: kernels run in Python workers, which may start in another folder."""
    sc = spark.sparkContext
    if getattr(sc, "_bandloom_engine_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="bandloom-code-"), "bandloom_engine.zip")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in PACKAGE.rglob("*.py"):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    Path(target).write_bytes(buffer.getvalue())
    sc.addPyFile(target)
    sc._bandloom_engine_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and everything runs on this machine."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if given is None:
        require(spark.sparkContext.master.startswith("local"), "SHARED_DIR", "set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bandloom-shared-"))
        given = spark.sparkContext.getCheckpointDir()
    return given.rstrip("/")


def scratch(spark: SparkSession, name: str = "read") -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/bandloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read back: cuts the plan, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete tables that stored() wrote, when nothing reads them any more."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
