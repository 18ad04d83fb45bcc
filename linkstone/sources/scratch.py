"""Intermediate tables in the shared folder that the cluster names (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    own = tempfile.mkdtemp(prefix="linkstone-")  # nothing is set, as in tests
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(own)
    return own


_paths: list[tuple[SparkSession, str]] = []


def _remove_all() -> None:
    for spark, path in _paths:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone by then
            return


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table and read it back: what is used several times is computed once and outlives executors.

    Tables that drop() doesn't remove go when the program ends, if its session still runs.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/linkstone/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    df.sparkSession._jvm.System.gc()  # the shuffles that led to the table are on disk until the driver's garbage is collected
    atexit.unregister(_remove_all)
    atexit.register(_remove_all)
    _paths.append((df.sparkSession, path))
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._shared_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Remove tables made by cut() that nothing reads any more."""
    for df in tables:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        _paths.remove((df.sparkSession, df._shared_path))


def large(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input, as does the other side: sorted and merged, never broadcast.

    Sizes of zstd files and compressed shuffles are far below what rows take in
    memory; by them the planner would send millions of rows through the driver.
    """
    return df.hint("merge")


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done)
