"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per context, so that Arrow functions find it wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_actlens_shipped", False):
        return
    here = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="actlens-")) / "actlens.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(str(out))
    context._actlens_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's, else (tests) a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="actlens-checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation of its history."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and the path as its kind of object."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(context._jsc.hadoopConfiguration()), folder


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there is removed when the driver ends."""
    path = f"{shared_dir(spark)}/actlens-{uuid.uuid4().hex}"
    system, folder = file_system(spark, path)
    system.deleteOnExit(folder)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, as a compressed table in the shared folder: for what is large, repetitive or read more than once; removed when the driver ends."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
