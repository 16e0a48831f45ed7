"""Small dimension tables from rows held by the caller, or from delimited text."""

from __future__ import annotations

import csv

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewater.sources import constants as C

TEXT = T.StringType()


def columns(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, TEXT) for n in names])


def dimension(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Table from literal rows.

    Goes through Arrow so that Spark plans a local relation with known size
    (joins to it become broadcasts on their own) instead of an RDD scan of
    unknown size.
    """
    arrow = to_arrow_schema(schema)
    table = pa.Table.from_arrays(
        [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)], schema=arrow
    )
    return spark.createDataFrame(table, schema=schema)


def records(spark: SparkSession, items: dict[str, dict[str, str]], id_col: str) -> DataFrame:
    """Named records to rows, the name going into ``id_col``."""
    fields = list(next(iter(items.values())))
    rows = [(name, *(rec.get(f) for f in fields)) for name, rec in items.items()]
    return dimension(spark, rows, columns(id_col, *fields))


def habitats(spark):
    return dimension(spark, C.HABITATS, columns("code", "habitat"))


def parameter_units(spark):
    return dimension(spark, C.PARAMETER_UNITS, columns("ParameterName", "unit"))


def input_rules(spark):
    return dimension(spark, C.INPUT_RULES, columns("param", "activity", "depth"))


def plots(spark):
    return dimension(spark, C.PLOTS, columns("plot_type", "title", "alt", "label", "habitat"))


def read_dimension(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    skip_rows: int = 0,
    sep: str = "|",
    null: str | None = None,
) -> DataFrame:
    """Delimited table whose header comes after ``skip_rows`` preamble lines in each file.

    Columns are picked by header name, so the files may hold more of them and in
    any order.  Files are scanned in splits like any text; only the lines of a
    file's first split are numbered, to find its preamble and header.
    """
    scan = spark.read.text(path).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("file"),
        (F.col("_metadata.file_block_start") == 0).alias("top"),
        F.monotonically_increasing_id().alias("id"),
    )
    # Ids follow each other within a split, so the line number is the distance to the file's first line.
    first = scan.where("top").groupBy("file").agg(F.min("id").alias("first"))
    lines = scan.join(first, "file").withColumn("line", F.when(F.col("top"), F.col("id") - F.col("first")))
    bare = F.regexp_replace("value", "^\ufeff", "")
    heads = lines.where(F.col("line") == skip_rows).groupBy(bare.alias("head")).agg(F.collect_list("file").alias("files"))
    body = lines.where(F.col("line").isNull() | (F.col("line") > skip_rows)).where(F.trim("value") != "")
    out = None
    for row in heads.collect():  # as many as the files have different headers
        head = row["head"]
        names = [c.strip().strip('"') for c in next(csv.reader([head], delimiter=sep))]
        slots = T.StructType([T.StructField(f"c{i}", TEXT) for i in range(len(names))])
        missing = [f.name for f in schema if f.name not in names]
        if missing:
            raise ValueError(f"{path}: no column {missing}; the header has {names}")
        parsed = F.from_csv("value", slots.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": sep})
        own = body.join(heads.where(F.col("head") == head).select(F.explode("files").alias("file")), "file", "left_semi")
        cells = own.select(parsed.alias("cells"))
        cols = []
        for f in schema:
            raw = F.trim(F.col(f"cells.c{names.index(f.name)}"))
            empty = raw.isin([""] if null is None else ["", null])
            cols.append(F.when(~empty, raw).cast(f.dataType).alias(f.name))
        cells = cells.select(*cols)
        out = cells if out is None else out.unionByName(cells)
    return out if out is not None else spark.createDataFrame([], schema)
