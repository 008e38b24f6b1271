"""Tables in the folder the cluster shares, which cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this driver and not dropped yet.
_written: set[str] = set()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or one that was set on the context. Where none is set, a temporary folder serves a local
    master, as in tests; a cluster's executors couldn't read the driver's, so that is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spanloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder; what comes after doesn't run df's plan again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """The rows of df, written as Parquet below the shared folder and read again; drop() takes them away."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._table_path = path
    return found


def drop(*tables: DataFrame) -> None:
    """Deletes tables that nothing reads any more: what was made of them has been written itself."""
    for df in tables:
        path = getattr(df, "_table_path", None)
        if path in _written:
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes all tables of this driver; results that haven't been written yet can't be read afterwards."""
    for path in list(_written):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written.discard(path)
