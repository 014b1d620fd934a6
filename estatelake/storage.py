"""Intermediate tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, or the folder that was given to
    the context for checkpoints. Where neither is set, a session in one process gets a temporary folder; a cluster, whose
    executors could not see that, gets an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = sc._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="estatelake-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet, read again: its lineage ends here, lost executors don't bring back the work before it, and what
    uses it twice doesn't compute it twice. ``forget`` removes it."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made, once nothing that is still to be computed reads them."""
    for t in tables:
        if path := getattr(t, "_written", None):
            spark = t.sparkSession
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            t._written = None
