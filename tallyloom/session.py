"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written by :func:`workdir`, until :func:`scratch` deletes them.
_written: list[str] = []
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent a temporary folder serves a session on one machine (as in
    tests); on a cluster that is an error, since executors would not find each other's files.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, _local[sc.applicationId], ignore_errors=True)
    return _local[sc.applicationId]


def workdir(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share, for tables an operator writes and reads again."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: written to the shared folder as a table and read again.

    The data outlives any executor; what follows reads only the columns it needs, and the
    optimizer knows their size.
    """
    path = workdir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what operators wrote to the shared folder inside the block, when it ends.

    Results must have been written or collected by then.
    """
    before = len(_written)
    try:
        yield
    finally:
        paths = _written[before:]
        del _written[before:]
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = hadoop.Path(p)
            path.getFileSystem(conf).delete(path, True)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that must be small: collected only if at most ``limit`` rows.

    One job reads ``limit + 1`` rows at most; more than ``limit`` is an error, never
    a silent cut.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it can't be held on the driver")
    return rows
