"""Layered tables in the session catalog, each rebuilt as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

LAYERS = ["bronze", "silver", "gold"]
VERSION = "version-"


def create_layers(spark: SparkSession, location: str | None = None, layers: Sequence[str] = LAYERS) -> None:
    """Create the namespaces; ``location`` puts them below a folder of one's own choice."""
    for layer in layers:
        place = f" LOCATION '{location}/{layer}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}{place}")


def rebuild_table(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    path: str | None = None,
    sort_by: Sequence[str] = (),
) -> DataFrame:
    """Replace table ``name`` by ``df`` and return it as read back, columns in the order of ``df``.

    Every build is a version of its own below ``path`` (or the layer's folder). Only when its files are written does the name
    pass on to it; a write that fails leaves the table as it was, and ``df`` may read the table that it replaces.
    ``sort_by`` orders the rows of each file, so that a filter on those columns can pass over most of it.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    version = f"{path or _folder(spark, name)}/{VERSION}{mark}"
    staged, former = f"{name}_{mark}", f"{name}_before_{mark}"
    rows = df.sortWithinPartitions(*partition_by, *sort_by) if sort_by else df
    writer = rows.write.format("parquet").option("path", version)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.saveAsTable(staged)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        _remove(spark, version)
        raise
    there = spark.catalog.tableExists(name)
    if there:
        spark.sql(f"ALTER TABLE {name} RENAME TO {former}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
    if there:
        location = _location(spark, former)
        spark.sql(f"DROP TABLE {former}")
        if location and location.rstrip("/").rsplit("/", 1)[-1].startswith(VERSION):
            _remove(spark, location)
    return spark.table(name).select(*df.columns)


def _folder(spark: SparkSession, name: str) -> str:
    layer, _, table = name.rpartition(".")
    place = spark.catalog.getDatabase(layer or spark.catalog.currentDatabase()).locationUri
    return f"{place.rstrip('/')}/{table}"


def _location(spark: SparkSession, name: str) -> str | None:
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()
    return found["data_type"] if found else None


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
