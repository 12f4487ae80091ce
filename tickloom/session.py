"""Session helpers shared by the operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Let the session's Python workers import this library, wherever they run; once per context."""
    context = spark.sparkContext
    if getattr(context, "_tickloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tickloom-")) / "tickloom.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for file in sorted(package.rglob("*.py")):
            target.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))  # the driver serves it to all executors
    context._tickloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written by this process, with the file system settings to delete them by.
_WRITTEN: dict[str, Any] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and the session is a local one, as in tests, a folder of this machine is
    used; on a cluster each executor would write to its own disk, so RuntimeError is raised.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tickloom-"))
    path = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    _WRITTEN[path] = context._jsc.hadoopConfiguration()
    return path


def clean(spark: SparkSession) -> int:
    """Delete what queries wrote to the shared folder, when their results are no longer needed; gives the number of folders.

    At the end of the process that happens by itself.
    """
    gone = 0
    for path, settings in list(_WRITTEN.items()):
        file = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(file.getFileSystem(settings).delete(file, True))
        del _WRITTEN[path]
    return gone


@atexit.register
def _clean_at_exit() -> None:
    session = SparkSession._instantiatedSession
    if session is not None and _WRITTEN:
        with contextlib.suppress(Exception):  # the session may have ended before
            clean(session)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there.

    The files survive the loss of an executor, and their size lets Spark decide on broadcasts.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
