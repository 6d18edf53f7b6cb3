"""Tables are swapped only when they are written, and laid out so that filters pass over files."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from hourgrid.operators import features
from hourgrid.sources import tables


@pytest.fixture
def gold(spark, tmp_path):
    tables.create_layers(spark, str(tmp_path), ["gold"])
    yield str(tmp_path)
    spark.sql("DROP DATABASE IF EXISTS gold CASCADE")


def rows(spark, n=4):
    day = F.date_add(F.lit("2020-12-30").cast("date"), (F.col("id") % 800).cast("int"))
    return spark.range(n).select("id", F.lit("historical").alias("source_stage"), day.alias("load_date"), F.year(day).alias("load_year"))


def test_failed_write_leaves_the_old_table(spark, gold):
    path = f"{gold}/t"
    tables.rebuild_table(rows(spark), "gold.t", ["source_stage"], path)
    broken = rows(spark, 9).withColumn("id", F.raise_error(F.lit("broken row")).cast("long"))
    with pytest.raises(Exception, match="broken row"):
        tables.rebuild_table(broken, "gold.t", ["source_stage"], path)
    assert spark.table("gold.t").count() == 4
    assert [t.name for t in spark.catalog.listTables("gold")] == ["t"]
    assert len([f for f in os.listdir(path) if f.startswith(tables.VERSION)]) == 1


def test_table_may_be_rebuilt_from_itself(spark, gold):
    tables.rebuild_table(rows(spark), "gold.t")
    again = tables.rebuild_table(spark.table("gold.t").where("id > 0"), "gold.t")
    assert again.count() == 3 and again.columns == rows(spark).columns
    spark.catalog.refreshTable("gold.t")
    assert spark.table("gold.t").count() == 3


def test_year_filter_lists_only_that_year(spark, gold):
    table = tables.rebuild_table(rows(spark, 800), "gold.t", ["source_stage", "load_year"], f"{gold}/t", ["load_date"])
    files = features.in_years(table, 2021, 2021).inputFiles()
    assert files and all("load_year=2021" in f for f in files)
    assert features.in_years(table, 2021, 2021).count() == 365
    assert len(table.inputFiles()) > len(files)
