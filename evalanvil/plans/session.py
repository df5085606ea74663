"""Sessions, test tables and the shared folder for cut lineages."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this engine wants; a cluster may override any of them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Applications that have this package's code already.
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package (once per application), so nothing need be installed there.

    Only code travels, through Spark's own file server; the archive lies with the driver.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="evalanvil-code-"), "evalanvil.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def build_session(app: str = "evalanvil", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; `conf` takes keys with `__` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `<folder>/<name>.parquet`; the caller selects the columns it needs."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else (local tests only) one of our own."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = context._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    folder = tempfile.mkdtemp(prefix="evalanvil-")
    context.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables written by `stored` in this process and not yet deleted.
_stored: list[str] = []


def drop_stored(spark: SparkSession, keep: int = 0) -> int:
    """Deletes the tables that `stored` wrote (but the first `keep`), once no DataFrame that reads them is needed any more."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    n = 0
    while len(_stored) > keep:
        path = path_of(_stored.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was stored inside it: `with scratch(spark): query(spark, d).write.parquet(...)`."""
    before = len(_stored)
    try:
        yield
    finally:
        drop_stored(spark, before)


def _drop_at_exit() -> None:
    """What is still there when the driver ends, if its session is still alive."""
    spark = SparkSession.getActiveSession() if _stored else None
    if spark is not None:
        try:
            drop_stored(spark)
        except Exception:  # noqa: BLE001 - the JVM may be gone already; nothing else can be done about it here
            pass


atexit.register(_drop_at_exit)


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written to the shared folder (partitioned) and read again, for storage that later steps prune."""
    path = os.path.join(shared_dir(df.sparkSession), f"t-{uuid.uuid4().hex}")
    _stored.append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
