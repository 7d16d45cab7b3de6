"""A fresh folder, reachable by every executor, for data that a job writes and reads back."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import time
import uuid
from functools import cache

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"
#: A label and 32 hexadecimal digits.
NAME = re.compile(r"[a-z-]+-[0-9a-f]{32}")


class NoSharedFolder(RuntimeError):
    """The session names no folder that all of its executors share."""


@cache
def _own_folder() -> str:
    folder = tempfile.gettempdir() + f"/ledgerloom-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def remove_scratch(spark: SparkSession, older_than: float = 7 * 24 * 3600.0) -> list[str]:
    """Remove what :func:`scratch_folder` has named in the session's ``spark.checkpoint.dir`` and that was last changed so many seconds ago.

    Folders of other names aren't touched. A job that still reads one must be younger than ``older_than``.
    """
    root = spark.conf.get(SETTING, None)
    if not root:
        return []
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    removed = []
    for status in files.listStatus(path) if files.exists(path) else []:
        name = status.getPath().getName()
        if NAME.fullmatch(name) and time.time() - status.getModificationTime() / 1000 >= older_than:
            files.delete(status.getPath(), True)
            removed.append(name)
    return removed


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove one folder that :func:`scratch_folder` has named."""
    if not NAME.fullmatch(folder.rsplit("/", 1)[-1]):
        raise ValueError(f"{folder} is no scratch folder")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``.

    Without that setting, a session whose tasks all run in the driver's own process sets one for
    itself, dropped when the process ends. On a cluster, where no executor would see such a folder,
    the job stops with NoSharedFolder.
    """
    root = spark.conf.get(SETTING, None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise NoSharedFolder(f"set {SETTING} to a folder that all executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
