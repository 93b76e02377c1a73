"""What the corpus operators share: white space, the shared folder, and tables written to it."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that every contract of this subpackage names.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Hashes of file paths that are tried until no two files have the same.
SEEDS = 8

_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset, as in local tests, a temporary folder is made; on a
    cluster without the setting this raises instead of writing to one machine.
    """
    global _own_dir
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="leadloom-")
        _written.append((spark, _own_dir))
    return _own_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/leadloom/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    if open_scopes := getattr(_scopes, "open", None):
        open_scopes[-1].append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def dropped(table: DataFrame) -> None:
    """Deletes a table that ``written`` returned and that nothing reads any more."""
    spark, paths = table.sparkSession, {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    for entry in [e for e in _written if any(p.endswith(e[1].rsplit("/", 1)[1]) for p in paths)]:
        _forget(entry)


def _forget(entry: tuple[SparkSession, str]) -> None:
    if entry in _written:
        _delete(*entry)
        _written.remove(entry)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` as a written table; the tables that this thread wrote on the way to it are deleted then."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append(on_the_way := [])
    try:
        try:
            df = make()
        finally:
            _scopes.open.pop()
        return written(df, name)
    finally:
        for entry in on_the_way:
            _forget(entry)


def _plain_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` are columns of Parquet files as they lie there, so that each row has a file and a place of its own."""
    plan = docs._jdf.queryExecution().analyzed()
    fixed = plan.deterministic() and "_metadata" not in docs.columns
    while plan.nodeName() == "Project":
        plan = plan.children().head()
    return fixed and plan.nodeName().startswith("LogicalRelation") and plan.relation().toString().lower() == "parquet"


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """``docs`` with a number of its own for each row, the same in every reading, so that stages act on rows, whatever their ids.

    A row of Parquet files has its place in its file in the low bits and a hash of the file's path,
    one that no other file of these has, in the others; nothing is copied. Any other table is written.
    """
    if _plain_scan(docs):
        path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        files = written(docs.groupBy(path.alias("path")).agg(F.max(place).alias("last"), F.count(F.lit(1)).alias("n")), "files")
        n, last, whole = files.agg(F.count(F.lit(1)), F.max("last"), F.bool_and(F.col("n") == F.col("last") + 1)).head()
        bits = (last or 0).bit_length()
        for seed in range(SEEDS if n and whole else 0):  # a file listed twice has no places of its own
            high = lambda c: F.shiftleft(F.shiftrightunsigned(F.xxhash64(c, F.lit(seed)), bits + 1), bits)  # noqa: E731, B023
            if files.select(F.count_distinct(high("path"))).head()[0] == n:
                dropped(files)
                return docs.select("*", high(path).bitwiseOR(place).alias(name))
        dropped(files)
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def without(rows: DataFrame, gone: DataFrame, name: str = "_row") -> DataFrame:
    """The numbered rows but those whose number is in ``gone``, which is written first: Spark then knows its size, broadcasts it below its threshold and else joins by shuffle."""
    return rows.join(written(gone.select(name), "gone"), name, "left_anti").drop(name)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended already; the folder is the cluster's to clean
            pass


def without_white(text: Column) -> Column:
    """``text`` without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
