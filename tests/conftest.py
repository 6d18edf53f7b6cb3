from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hourgrid.session import build_session  # noqa: E402

LOAD_SCHEMA = """source_stage string, load_date date, hour_ending int, pge_mw decimal(12,3), sce_mw decimal(12,3),
  sdge_mw decimal(12,3), vea_mw decimal(12,3), caiso_mw decimal(12,3), source_file string"""


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        spark__master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__log__level="ERROR",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("scratch")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    yield session
    session.stop()


@pytest.fixture
def load_rows(spark):
    """Rows from (day, hour, system load) with optional stage and file."""

    def build(rows):
        full = []
        for row in rows:
            day, hour, load, stage, file = (*row, *("historical", "a.csv")[len(row) - 3 :])
            parts = [Decimal(load) / 4] * 4
            full.append((stage, dt.date.fromisoformat(day), hour, *parts, Decimal(load), file))
        return spark.createDataFrame(full, LOAD_SCHEMA)

    return build


@pytest.fixture
def random_loads(spark):
    """Silver-like rows over 20 days; a third of all rows share one label, and some rows are copies."""
    from pyspark.sql import functions as F

    rows = spark.range(6000).select(
        F.lit("historical").alias("source_stage"),
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-05").cast("date"))
        .otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (F.hash("id") % 10 + 10).cast("int")))
        .alias("load_date"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.abs(F.hash(F.col("id") + 1)) % 24 + 1).cast("int").alias("hour_ending"),
        *[(F.abs(F.hash(F.col("id") % 900, F.lit(n))) % 50).cast("decimal(12,3)").alias(f"{n}_mw") for n in ("pge", "sce", "sdge", "vea")],
        F.concat(F.lit("f"), F.col("id") % 2).alias("source_file"),
    )
    total = F.col("pge_mw") + F.col("sce_mw") + F.col("sdge_mw") + F.col("vea_mw")
    return rows.withColumn("caiso_mw", total.cast("decimal(12,3)"))
