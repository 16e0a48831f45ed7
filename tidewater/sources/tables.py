"""Materialised summary tables, published beside their earlier versions.

A table is never overwritten.  Every write goes to a folder of its own below
``root/name``; a log of publications (``root/_published``, one small file each)
says which folder has the name.  One publication switches all tables of a batch
at once.  So a plan may read the very table that it replaces, readers keep the
files that they have opened, and a run that stops before its publication leaves
every name as it was.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PUBLISHED = "publish_date"
LOG = "_published"
# Publications count up; of two with one number (concurrent runs) the later batch label wins for all their names.
LOG_SCHEMA = "serial long, batch string, name string, folder string, n_rows long"


def stamped(df: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Publish date as a column; always an argument, never the clock."""
    return df.withColumn(PUBLISHED, F.lit(str(as_of)).cast("date"))


def write_tables(
    tables: dict[str, DataFrame],
    root: str,
    as_of: str | dt.date | None = None,
    partition_by: dict[str, list[str]] | None = None,
    switch: bool = True,
    cluster_by: dict[str, list[str]] | None = None,
) -> dict[str, str]:
    """Write each table as Parquet below ``root``, then publish them; returns name to path.

    A partitioned table is rebalanced by its partition columns first: adaptive
    execution then writes files of the advisory size, splitting a hot partition
    value over several tasks instead of one file per task and value.
    ``cluster_by`` writes a table in ranges of its look-up columns, so that a
    filter on them skips files and row groups by their statistics.
    ``switch=False`` leaves publishing to the caller (``publish``).
    """
    out, spark = {}, None
    for name, df in tables.items():
        spark = df.sparkSession
        path = f"{root.rstrip('/')}/{name}/v-{uuid.uuid4().hex[:12]}"
        df = stamped(df, as_of) if as_of else df
        by = (partition_by or {}).get(name, [])
        if by:
            df = df.hint("rebalance", *[F.col(c) for c in by])
        df = clustered(df, [*by, *(cluster_by or {}).get(name, [])]) if name in (cluster_by or {}) else df
        df.write.partitionBy(*by).parquet(path)
        if by and not readable(spark, path):  # no partition, no file: an empty one holds the columns
            df.limit(0).write.mode("append").parquet(path)
        out[name] = path
    if switch and spark is not None:
        publish(spark, root, out)
    return out


def clustered(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows in ranges of ``by``, sorted within; a value with many rows is split by a hash of the row."""
    order = [*[F.col(c).asc_nulls_first() for c in by], F.xxhash64(*df.columns)]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def readable(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return False
        raise
    return True


def log_of(spark: SparkSession, root: str) -> DataFrame | None:
    """All publications below ``root``; None before the first."""
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(f"{root.rstrip('/')}/{LOG}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def publish(spark: SparkSession, root: str, paths: dict[str, str]) -> None:
    """Give the written folders their names, all in one step.

    Each folder is read back for its count first, so that what cannot be read
    never takes a name.  The step is the commit of a single one-row-per-table file.
    """
    n_rows = {name: spark.read.parquet(path).count() for name, path in paths.items()}
    log = log_of(spark, root)
    serial = 1 + (0 if log is None else log.agg(F.max("serial")).first()[0] or 0)
    batch = uuid.uuid4().hex[:12]
    base = root.rstrip("/") + "/"
    rows = [(serial, batch, name, path.removeprefix(base), n_rows[name]) for name, path in paths.items()]
    entry = spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1)
    entry.write.mode("append").parquet(base + LOG)


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Every publication with its ``age``: 0 for the one that has the name, 1 for the one before."""
    log = log_of(spark, root)
    if log is None:
        return spark.createDataFrame([], f"{LOG_SCHEMA}, age int")
    newest = Window.partitionBy("name").orderBy(F.col("serial").desc(), F.col("batch").desc())
    return log.withColumn("age", F.row_number().over(newest) - 1)


def table_path(spark: SparkSession, root: str, name: str, age: int = 0) -> str:
    """Folder that has the name, or had it ``age`` publications ago.

    A table that something else wrote under its plain name is found there.
    """
    found = versions(spark, root).where((F.col("name") == name) & (F.col("age") == age)).select("folder").first()
    if found is None and age:
        raise ValueError(f"{root}: {name} has no version of age {age}")
    return f"{root.rstrip('/')}/{name if found is None else found['folder']}"


def load_table(spark: SparkSession, root: str, name: str, view: bool = False, age: int = 0) -> DataFrame:
    df = spark.read.parquet(table_path(spark, root, name, age))
    if view:
        df.createOrReplaceTempView(name)
    return df


def drop_old(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete the folders of versions older than the last ``keep`` of each name; returns them.

    Only folders that the log knows are touched, so a write in progress is safe;
    a plan that still reads a dropped version is not.
    """
    if keep < 1:
        raise ValueError("the published version stays")
    old = versions(spark, root).where(F.col("age") >= keep).select("folder").distinct().collect()
    hadoop, gone = spark.sparkContext._jvm.org.apache.hadoop.fs, []
    for row in old:
        path = hadoop.Path(f"{root.rstrip('/')}/{row['folder']}")
        if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True):
            gone.append(row["folder"])
    return sorted(gone)
