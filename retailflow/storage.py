"""Tables in the folder that all executors share: where lineage ends, and what may be broadcast."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a table that is broadcast at most, by small().
BROADCAST_BYTES = 24 << 20

_local: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    Read from spark.checkpoint.dir. Where it is unset, a temporary folder serves,
    but in local mode only: on a cluster that would be another disk for each machine.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="retailflow-shared-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return "file://" + _local[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def freed(spark: SparkSession):
    """What is written within leaves no shuffle files: a write's own are removed as it ends,
    not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder; the lineage ends there, and
    shuffle files go."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    schema = df.schema
    with freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def written_so_far(spark: SparkSession) -> int:
    """How many tables of written() there are, for drop_written()."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def drop_written(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Remove the tables that written() has made in this application, from the one numbered
    `since` to before `until`. Results that rest on them can't be computed after this."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    for path in paths[since:until]:
        drop_folder(spark, path)
    del paths[since:until]


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that is no longer needed, wherever Spark's file systems have it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a written table has so few bytes that it may be broadcast: measured, with 32
    bytes a row and 8 a column beside what texts and arrays hold."""
    width = F.lit(32 + 8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            own = F.size(f.name) * 8
            if isinstance(f.dataType.elementType, T.StringType):
                own = F.aggregate(f.name, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 8)
            width = width + F.coalesce(own, F.lit(0))
    return (df.agg(F.sum(width)).first()[0] or 0) <= most
