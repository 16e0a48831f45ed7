"""Partial aggregates kept per export and merged when they are read.

Counts per station and year, and cells of the habitat input, add up: a new or
replaced export is reduced on its own and leaves the other exports' partials as
they are.  A store is one folder partitioned into units: what one write of an
export holds for one value of the keys by which exports replace each other.  A
manifest (``_manifest``, one small file per write) lists the units.  Which
version of an export is read, and which export has a key where the last one wins,
is decided on the manifest; the join with it prunes the units' folders at run
time, so no losing file is opened.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewater.operators import clean
from tidewater.plans import continuous, habitat

EXPORT, VERSION, UNIT = "export", "version", "unit"
TEXT = T.StringType()


@dataclass(frozen=True)
class PartialStore:
    """Partials with the columns of ``schema`` below ``root``; ``keys`` are those by which exports replace each other."""

    spark: SparkSession
    root: str
    schema: T.StructType
    keys: tuple[str, ...]

    def _scan(self) -> DataFrame:
        fields = [*self.schema, T.StructField(EXPORT, TEXT), T.StructField(UNIT, TEXT)]
        return self.spark.read.schema(T.StructType(fields)).parquet(self.root)

    def _manifest_schema(self) -> T.StructType:
        keys = [T.StructField(k, self.schema[k].dataType) for k in self.keys]
        text = [T.StructField(n, TEXT) for n in (EXPORT, VERSION, UNIT)]
        return T.StructType([T.StructField("serial", T.LongType()), *text, *keys, T.StructField("n_rows", T.LongType())])

    def manifest(self) -> DataFrame:
        """(serial, export, version, unit, keys, n_rows) of everything ever written; an export
        without rows has one entry without unit and keys."""
        try:
            return self.spark.read.schema(self._manifest_schema()).parquet(f"{self.root}/_manifest")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], self._manifest_schema())
            raise

    def put(self, export: str, partials: DataFrame) -> None:
        """Write the partials of one export; from then on they replace those it had."""
        version = uuid.uuid4().hex[:12]
        rows = partials.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        unit = F.concat(F.lit(f"{version}-"), F.hex(F.xxhash64(*self.keys)))
        rows = rows.withColumns({EXPORT: F.lit(export), UNIT: unit}).hint("rebalance", F.col(UNIT))
        rows.write.mode("append").partitionBy(UNIT).parquet(self.root)
        serial = 1 + (self.manifest().agg(F.max("serial")).first()[0] or 0)
        entry = self.spark.createDataFrame([(serial, export, version, None, *[None] * len(self.keys), 0)], self._manifest_schema())
        written = self._scan().where(F.startswith(F.col(UNIT), F.lit(f"{version}-")))
        held = written.groupBy(UNIT, *self.keys).agg(F.count(F.lit(1)).alias("n_rows"))
        if not held.isEmpty():
            named = {"serial": F.lit(serial).cast("long"), EXPORT: F.lit(export), VERSION: F.lit(version)}
            entry = held.withColumns(named).select(*entry.columns)
        entry.coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")

    def chosen(self, on_duplicate: str = "union") -> DataFrame:
        """(unit, keys) to be read: those of the newest version of every export; with ``last``
        each value of the keys from the export that sorts last among those that hold it."""
        if on_duplicate not in ("union", "last"):
            raise ValueError("on_duplicate is 'union' or 'last'")
        newest = F.max(F.struct("serial", VERSION)).over(Window.partitionBy(EXPORT))
        rows = self.manifest().withColumn("newest", newest)
        rows = rows.where((F.col(VERSION) == F.col("newest")[VERSION]) & (F.col("n_rows") > 0))
        if on_duplicate == "last":
            winner = F.max(EXPORT).over(Window.partitionBy(*self.keys))
            rows = rows.withColumn("winner", winner).where(F.col(EXPORT) == F.col("winner"))
        return rows.select(UNIT, *self.keys)

    def read(self, on_duplicate: str = "union") -> DataFrame:
        """The chosen partials, with their export."""
        chosen = self.chosen(on_duplicate)
        if chosen.isEmpty():
            return self.spark.createDataFrame([], T.StructType([*self.schema, T.StructField(EXPORT, TEXT)]))
        # Plain equality of the units lets Spark prune their folders; the keys are compared as
        # well, a missing one with a missing one.
        chosen = chosen.withColumnsRenamed({n: f"__{n}" for n in chosen.columns})
        scan = self._scan()
        same = scan[UNIT] == chosen[f"__{UNIT}"]
        for k in self.keys:
            same = same & scan[k].eqNullSafe(chosen[f"__{k}"])
        return scan.join(chosen, same, "left_semi").select(*self.schema.names, EXPORT)


STATION_KEYS = [*continuous.KEYS, *continuous.ATTRS]


def station_partials(obs: DataFrame) -> DataFrame:
    """Observations per station, year, parameter, region and attribute combination."""
    return clean.view(obs, continuous.STATION_COLUMNS).groupBy(*STATION_KEYS).agg(F.count(F.lit(1)).alias("n"))


def station_years(partials: DataFrame) -> DataFrame:
    """``continuous.station_years`` of all exports whose partials these are."""
    rows = partials.groupBy(*STATION_KEYS).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*continuous.KEYS))
    return rows.withColumn("Data_N", total).drop("n")


def merged_cells(partials: DataFrame) -> DataFrame:
    """Cells of all exports whose cells these are, without units (``joins.attach_units`` comes after)."""
    added: list[Column] = [F.sum(c).alias(c) for c in ("n_rows", "n_known", "total")]
    return partials.groupBy(*habitat.CELL_KEYS).agg(*added, F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))
