"""Shared folder for tables that are written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Temporary folders of local sessions, by application; the session's options stay as they are.
_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    A session of one process, where nothing is shared between machines, may do
    without and gets a temporary folder; any other session without the option is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="tidewater-")
    return _LOCAL[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
