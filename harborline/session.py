"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_LOCAL_DIR = "spark.harborline.localDir"
_staged: dict[str, dict[str, None]] = {}


def build_session(app: str = "harborline", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the defaults the operators expect; keyword names use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULT_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder, because there the driver and the
    executors are one machine; on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="harborline-")
    spark.conf.set(_LOCAL_DIR, path)
    return path


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing folder name under the shared folder; :func:`clear_staged` deletes it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _own(spark)[path] = None
    return path


def _own(spark: SparkSession) -> dict[str, None]:
    """Folders this session made, in order."""
    return _staged.setdefault(spark.sparkContext.applicationId, {})


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Used where two branches of a plan must see the very same rows and partition numbers even if
    executors are lost between them.
    """
    path = new_folder(df.sparkSession, label)
    _own(df.sparkSession)[path] = None
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._staged_path = path
    return written


def unstage(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what :func:`stage` wrote for ``frames``, and shuffle files that nothing refers to.

    For steps of an operator that runs its jobs one by one; no lazy DataFrame may still need them.
    Spark drops the shuffle files of a collected plan, so a collection is asked for.
    """
    mine = _own(spark)
    for frame in frames:
        _delete(spark, frame._staged_path)
        mine.pop(frame._staged_path, None)
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_staged(spark: SparkSession) -> int:
    """Delete what this session wrote to folders of its own; call it when the results are used up.

    Staged tables and the folders of streams and maintenance must outlive the lazy DataFrames built on them, so nothing deletes them earlier.
    """
    paths = _staged.pop(spark.sparkContext.applicationId, {})
    for name in paths:
        _delete(spark, name)
    return len(paths)


def spread(scan: DataFrame) -> DataFrame:
    """A table's scan in at least as many tasks as there are cores, for work that is dear per row.

    A file of one row group is one task however many cores wait; a table of enough files is not shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the caller's own values.

    It becomes a local relation of known size, so that Spark can decide on a broadcast by itself.
    """
    struct = T.StructType.fromDDL(schema)
    records = [dict(zip(struct.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(struct)), struct)
