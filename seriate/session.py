"""Session helpers: the shared folder of the cluster and tables written to it to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors can reach.

    Only a local session (one JVM) without the setting gets a temporary folder of its own; a cluster without it is an error,
    since a machine-local folder would not survive the loss of that machine.
    """
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="seriate-")
    return _LOCAL[app]


def materialize(df: DataFrame, name: str, whole_files: int | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut and survives the loss of executors.

    The files go when the session's JVM ends, or with :func:`free`. ``whole_files``: at most so many rows a file, and each file in one row group, so that it is read by one
    task in the order in which it was written. ``by``: the same for the rows of each value of a column, which ``df`` has to hold in one partition, sorted by it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if whole_files or by:
        writer = writer.option("parquet.block.size", 1 << 30)
    if whole_files:
        writer = writer.option("maxRecordsPerFile", whole_files)
    if by:
        writer = writer.partitionBy(by)
    writer.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> int:
    """Delete the tables written so far to the shared folder; frames that still read them, not yet evaluated, can't be used any more. Returns their number."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    return len(paths)
