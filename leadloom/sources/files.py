"""Files through Hadoop's file system, so that any store Spark reads will do."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _aside(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{p.getName()}.before")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there are data at ``path``; what a swap that broke off had moved aside is put back first."""
    fs, p = _at(spark, path)
    aside = _aside(spark, path)
    if not fs.exists(p) and fs.exists(aside):
        fs.rename(aside, p)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.getFileStatus(p).isDirectory()


def swap_in(spark: SparkSession, new: str, path: str) -> None:
    """Puts the complete ``new`` in the place of ``path``. At every moment the old or the new data are there: the old are renamed, and deleted only last."""
    fs, p = _at(spark, path)
    aside = _aside(spark, path)
    if exists(spark, path):
        fs.delete(aside, True)
        if not fs.rename(p, aside):
            raise OSError(f"{path} can't be moved aside")
    else:
        fs.mkdirs(p.getParent())
    if not fs.rename(_at(spark, new)[1], p):
        exists(spark, path)
        raise OSError(f"{new} can't be moved to {path}")
    fs.delete(aside, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, removed when the driver ends.

    Only on a local master may that be unset; a temporary folder serves then.
    """
    global _own_dir
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _own_dir is None:
            _own_dir = "file://" + tempfile.mkdtemp(prefix="leadloom-")
            _written.append((spark, _own_dir))
        folder = _own_dir
    path = f"{folder.rstrip('/')}/leadloom/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and nothing is computed twice."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            fs, p = _at(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended already; the folder is the cluster's to clean
            pass
