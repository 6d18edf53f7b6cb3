"""Text exports: one declared text schema, many files, file lineage kept."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid import schemas

ANY_CASE_CSV = "*.[cC][sS][vV]"
FILE_NAME = r"([^/]+)$"
MALFORMED = "malformed"
# Up to so many headers and sources, files are also read by source.
READERS = 64


def read_csv_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV files with a header, read as declared; columns are pruned by the reader.

    A header that does not name the declared columns in their order is an error, not a silent shift.
    """
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_staged_loads(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_text(spark, path, schemas.STAGED_LOADS)


def read_raw_weather(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_text(spark, path, schemas.RAW_WEATHER)


def read_clean_loads(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_text(spark, path, schemas.CLEAN_LOADS)


def read_exports(
    spark: SparkSession,
    folder: str,
    schema: T.StructType = schemas.RAW_LOADS,
    pattern: str = ANY_CASE_CSV,
) -> DataFrame:
    """Every export of one format in a folder as one table, each row tagged with its file.

    Formats that differ in their columns are read apart, by pattern, and stacked by name.
    """
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    rows = reader.option("pathGlobFilter", pattern).csv(folder)
    return rows.withColumn("source_file", F.col("_metadata.file_name"))


def read_mixed_exports(
    spark: SparkSession, folder: str, pattern: str = ANY_CASE_CSV, file_pattern: str = FILE_NAME
) -> DataFrame:
    """Every export below a folder, whatever columns each has and however its header spells them.

    Names are stripped and lower-cased, all values stay text, and a column that a file lacks is NULL there.
    ``malformed`` is the line of a row with more or fewer values than its header, else NULL; ``source_file``
    is the first group of ``file_pattern`` in the path, looked for once a file while there are few sources, else in
    each row. Files are read by header, which costs one more pass over the text; empty ones have no rows.
    """
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    lines = reader.text(folder).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
    )
    first = lines.where("start = 0 AND trim(value) <> ''").groupBy("file").agg(F.min_by("value", "place").alias("header"))
    # One row a file.
    source = _source(F.col("file"), file_pattern)
    files = F.sort_array(F.collect_list("file")).alias("files")
    groups = first.groupBy("header", source.alias("source")).agg(files).orderBy("header", "source").collect()
    if not groups:
        raise ValueError(f"no export with a header below {folder}")
    if len(groups) <= READERS:
        return stack_by_name([_read_by_header(spark, g.header, g.files, F.lit(g.source)) for g in groups])
    by_header: dict[str, list[str]] = {}
    for group in groups:
        by_header.setdefault(group.header, []).extend(group.files)
    source = _source(F.col("_metadata.file_path"), file_pattern)
    return stack_by_name([_read_by_header(spark, header, names, source) for header, names in by_header.items()])


def _source(path: Column, file_pattern: str) -> Column:
    # The usual pattern would be tried from every character of the path.
    return F.substring_index(path, "/", -1) if file_pattern == FILE_NAME else F.regexp_extract(path, file_pattern, 1)


def _read_by_header(spark: SparkSession, header: str, files: Sequence[str], source: Column) -> DataFrame:
    spelled = next(csv.reader([header.removeprefix("\ufeff")]))
    names = [name.strip().lower() or f"unnamed_{i}" for i, name in enumerate(spelled)]
    if len(set(names)) < len(names):
        raise ValueError(f"a header names a column twice: {header}")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, MALFORMED]])
    reader = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", MALFORMED)
    # Paths are listed encoded, and read as patterns.
    paths = [re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(file)) for file in files]
    return reader.csv(paths).withColumn("source_file", source)


def stack_by_name(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables; a column that one table lacks is NULL there."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), tables)


def write_csv(df: DataFrame, path: str) -> None:
    """Header, no index, blanks inside values kept, one file per task."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
