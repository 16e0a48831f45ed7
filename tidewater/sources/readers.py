"""Delimited and Parquet scans with selection by file name."""

from __future__ import annotations

import csv
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.semantics import choosing, null_safe_join
from tidewater.sources.scratch import scratch_path

FILE = "source_file"
SMALL_FILE = 16 << 20  # bytes up to which reading a file whole costs less than a task that stops


def wanted_path(path: Column, include=None, exclude=None, suffix: str | None = None) -> Column:
    """Path matches every ``include`` pattern, no ``exclude`` pattern and the suffix."""
    as_list = lambda p: [p] if isinstance(p, str) else list(p or [])
    ok = F.lit(True)
    for pattern in as_list(include):
        ok = ok & path.rlike(pattern)
    for pattern in as_list(exclude):
        ok = ok & ~path.rlike(pattern)
    return ok & path.endswith(suffix) if suffix else ok


def fixed_prefix(root: str) -> str:
    """Folder part of a root without scheme and host; of a glob, the folders before its first pattern."""
    path = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root)
    if not path.startswith("/"):
        path = posixpath.abspath(path)
    glob = re.search(r"[*?\[{]", path)
    return path[: path.rindex("/", 0, glob.start())] if glob else path.rstrip("/")


def below(path: Column, root: str) -> Column:
    """Part of a file path below ``root``, so that the root itself cannot match.

    Below a glob it is the part after the folders without a pattern; of a
    single file it is the file's name.
    """
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    prefix = fixed_prefix(root)
    inside = F.substring(bare, F.lit(len(prefix) + 2), F.length(bare))
    name = F.element_at(F.split(bare, "/"), -1)
    return F.when(F.startswith(bare, F.lit(prefix + "/")), inside).otherwise(name)


def scanned_path() -> Column:
    """Path of the scanned file; Spark gives it percent-encoded, a plus sign being itself."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def relative_path(root: str) -> Column:
    return below(scanned_path(), root)


def list_files(spark: SparkSession, root: str, include=None, exclude=None, suffix=None) -> DataFrame:
    """Files below ``root`` whose path fits, with size; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = below(F.col("path"), root)
    return files.select("path", rel.alias(FILE), "length").where(wanted_path(F.col(FILE), include, exclude, suffix))


def one_file_per_task(spark: SparkSession) -> SparkSession:
    """Session of its own in which a scan deals out whole files, one to a task, and hands few rows at a time to Python."""
    probe = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            probe.conf.set(name, value)
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        probe.conf.set(name, str(2**40))
    probe.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    return probe


def header_census(spark: SparkSession, root: str, include=None, exclude=None) -> DataFrame:
    """(path, header) of the files below ``root`` whose path fits: the first line that is not blank.

    As many jobs for any number of files.  Files up to SMALL_FILE bytes are
    scanned as lines, many to a task, of which the first is aggregated.  A larger
    file has a task that stops reading after its first line.  Files without such
    a line have no row.  The result is written to the shared folder.
    """

    def first_line(batches):
        import pyarrow as pa

        for batch in batches:
            for path, line, top in zip(*(c.to_pylist() for c in batch.columns)):
                if top and line.strip():
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([line])], names=["path", "header"])
                if not top or line.strip():
                    return

    def lines(session: SparkSession, large: bool) -> DataFrame:
        scan = session.read.option("recursiveFileLookup", True).text(root)
        size = F.col("_metadata.file_size")
        scan = scan.where(wanted_path(relative_path(root), include, exclude) & ((size > SMALL_FILE) if large else (size <= SMALL_FILE)))
        return scan.select(scanned_path().alias("path"), "value", (F.col("_metadata.file_block_start") == 0).alias("top"))

    path = scratch_path(spark, "headers")
    # Ids follow each other within a split.
    small = lines(spark, False).withColumn("id", F.monotonically_increasing_id()).where(F.col("top") & F.rlike("value", F.lit(r"[^\s]")))
    small = small.groupBy("path").agg(F.min_by("value", "id").alias("header"))
    mark = F.regexp_replace("header", "^\ufeff", "").alias("header")
    small.select("path", mark).write.parquet(path)
    large = lines(one_file_per_task(spark), True).mapInArrow(first_line, "path string, header string")
    large.select("path", mark).write.mode("append").parquet(path)
    return spark.read.schema("path string, header string").parquet(path)


def header_names(header: str, sep: str) -> list[str]:
    """Column names of a header line; nameless ones go by their place."""
    cells = next(csv.reader([header], delimiter=sep)) if len(sep) == 1 else header.split(sep)
    return [c or f"_c{i}" for i, c in enumerate(cells)]


def read_delim(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = "|",
    null: str | None = "NULL",
    include=None,
    exclude=None,
    with_file: bool = False,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Header-named delimited scan over a file, a folder or a glob.

    The files are chosen by name; unwanted ones are never opened.  One job reads
    the headers of all of them (``header_census``), of which the driver sees the
    distinct ones.  Files of one header are one scan: of a single layout by the
    condition on the path, of several by the list of each layout's files.
    Columns are taken by header name and only those of ``schema`` are parsed;
    further file columns are ignored.  A column that some layouts lack is null
    there, one that all lack is an error.
    """
    options = {"header": True, "sep": sep, "mode": mode, "recursiveFileLookup": True}
    if null is not None:
        options["nullValue"] = null
    types = {f.name: f.dataType for f in schema}
    census = header_census(spark, path, include, exclude)
    heads = sorted(r["header"] for r in census.select("header").distinct().collect())
    layouts = {h: header_names(h, sep) for h in heads}
    missing = [n for n in types if layouts and not any(n in names for names in layouts.values())]
    if missing:
        raise ValueError(f"{path}: no column {missing}; the headers have {sorted(map(tuple, layouts.values()))}")
    file = relative_path(path)
    wanted = wanted_path(file, include, exclude)
    out = None
    for head, names in layouts.items():
        layout = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
        files = [path]
        if len(layouts) > 1:
            files = sorted(literal_path(r["path"]) for r in census.where(F.col("header") == head).select("path").collect())
        named = not any(f"_c{i}" == n for i, n in enumerate(names))  # only then names can be checked against the files
        df = spark.read.schema(layout).options(enforceSchema=not named, **options).csv(files).where(wanted)
        cols = [F.col(f"`{n}`") if n in names else F.lit(None).cast(t).alias(n) for n, t in types.items()]
        df = df.select(*cols, file.alias(FILE)) if with_file else df.select(*cols)
        out = df if out is None else out.unionByName(df)
    if out is None:
        full = T.StructType([*schema, *([T.StructField(FILE, T.StringType())] if with_file else [])])
        return spark.createDataFrame([], full)
    return out


def literal_path(path: str) -> str:
    """A listed path as one that names itself where globs are read."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def read_tables(
    spark: SparkSession,
    paths: list[str],
    on_duplicate: str = "union",
    keys: list[str] | None = None,
    source_pattern: str = r"[^/]+$",
) -> DataFrame:
    """One scan over many Parquet tables; a column that some lack is null there.

    ``on_duplicate='last'`` keeps, for each value of ``keys``, only the rows of
    the source that sorts last; ``source_pattern`` names the part of the file
    path that identifies a source.  The choice reads the key columns only and is
    a small aggregate of (keys, source), joined back as a semi join.
    """
    df = spark.read.option("mergeSchema", True).parquet(*paths)
    if on_duplicate == "union":
        return df
    if on_duplicate != "last" or not keys:
        raise ValueError("on_duplicate is 'union', or 'last' with keys")
    df = df.select("*", F.regexp_extract(scanned_path(), source_pattern, 0).alias(FILE))
    last = df.groupBy(*keys).agg(F.max(FILE).alias(FILE))
    return null_safe_join(df, last, [*keys, FILE], "left_semi").drop(FILE)


def select_inputs(
    files: DataFrame,
    rules: DataFrame,
    filetype: str | None = None,
    keys: tuple[str, str, str] = ("param", "activity", "depth"),
) -> DataFrame:
    """Rows of ``files`` that the rules ask for.

    A rule fixes activity and depth per parameter; inputs of type ``data`` hold
    everything for a parameter and are chosen by the parameter alone.  Of files
    partitioned by the keys, Spark opens at run time only the folders that the
    rules name, if these come from a table.
    """
    on = [keys[0]] if filetype == "data" else list(keys)
    # One equality over all keys, unlike null-safe comparisons, prunes exactly the partitions that
    # have a rule; a missing key is a value of its own.
    known = lambda df, names: F.concat_ws(
        "\u0001", *[F.coalesce(df[n].cast("string"), F.lit("\u0000")) for n in names]
    )
    named = choosing(rules.select(*on), on[0]).withColumnsRenamed({k: f"__{k}" for k in on})
    same = known(files, on) == known(named, [f"__{k}" for k in on])
    return files.join(named, same, "left_semi")
