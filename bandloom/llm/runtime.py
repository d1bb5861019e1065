"""Session plumbing shared by the corpus operators: shared scratch tables and code shipping."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once a session (workers may start in another folder)."""
    sc = spark.sparkContext
    if getattr(sc, "_bandloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="bandloom-code-")
    target = os.path.join(folder, "bandloom_code.zip")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in PACKAGE.rglob("*.py"):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    Path(target).write_bytes(buffer.getvalue())
    sc.addPyFile(target)
    sc._bandloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bandloom-shared-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/bandloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets Spark remove shuffle files that only the written table needed
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables that stored() wrote, when nothing reads them any more."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until df has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column, modulus: int):
    """crc32 of a column as text, modulo modulus; null for null."""
    return F.crc32(column.cast("string")) % modulus


#: Strata of a labelled sample: labels, verdicts or languages.
MAX_STRATA = 1000


def bounded_rows(df: DataFrame, key: str, strata: str, bound: int, seed: int = 17) -> DataFrame:
    """About ``bound`` rows at most of each stratum, chosen by a hash of the key (the same rows at each run)."""
    counts = {r[strata]: r["n"] for r in df.groupBy(strata).agg(F.count(F.lit(1)).alias("n")).limit(MAX_STRATA + 1).collect()}
    if len(counts) > MAX_STRATA:
        raise ValueError(f"{strata} has over {MAX_STRATA} different values; a model of so many classes isn't meant")
    if not counts:
        return df
    space = 1 << 20
    limit = F.lit(space)
    for value, n in counts.items():
        if n > bound:
            limit = F.when(F.col(strata) == F.lit(value), F.lit(int(space * bound / n))).otherwise(limit)
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(space)) < limit)
