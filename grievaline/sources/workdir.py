"""The shared folder for written tables, checkpoints and stream state.

On a cluster the folder is the one named by ``spark.checkpoint.dir``. A folder of
our own is made only for a local master, where driver and tasks share a disk.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors can reach")
    app = context.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="grievaline-")
    return _local[app]


_owned: dict[str, list[str]] = {}
_owner: ContextVar[str | None] = ContextVar("owner", default=None)


def new_dir(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet, so that a rerun never meets old files.

    Inside ``owned`` the folder is noted for its owner; else it stays until the shared
    folder is cleared.
    """
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/grievaline/{app}/{label}-{uuid.uuid4().hex[:12]}"
    if _owner.get():
        _owned.setdefault(_owner.get(), []).append(path)
    return path


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Folders that ``new_dir`` and ``pinned`` give meanwhile belong to ``owner``, who releases them."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def release(spark: SparkSession, owner: str) -> int:
    """Delete the folders of ``owner``; no frame that reads them may be used any more."""
    paths = _owned.pop(owner, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


def pinned(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared folder and read back.

    It is computed once, and what is read again after a lost executor is the same.
    """
    spark = frame.sparkSession
    path = new_dir(spark, "pinned")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
