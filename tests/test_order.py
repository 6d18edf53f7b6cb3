from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourgrid.fixed import TIME_ORDER
from hourgrid.operators import clean, order

NUMBERED = ["load_date", "hour_ending", "hour_instance", "records_at_hour_label", "source_file", "caiso_mw", "pge_mw"]


def rows_of(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_range_numbering_equals_the_window(random_loads):
    windowed = order.number_repeated_hours(random_loads)
    split = order.number_repeated_hours(random_loads, group_rows=10)
    assert rows_of(windowed, NUMBERED) == rows_of(split, NUMBERED)


def test_range_positions_split_copies(spark):
    """All rows are copies of one another: no partition takes them all, no row is lost."""
    copies = spark.range(4000).select(F.lit(1).alias("k"))
    placed = order.range_positions(copies, ["k"])
    assert sorted(r.row_ix for r in placed.collect()) == list(range(4000))
    assert copies.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(4, "k", "_copy").groupBy(
        F.spark_partition_id().alias("p")
    ).count().agg(F.max("count")).first()[0] < 2500


def test_positions_are_a_permutation_in_time_order(random_loads):
    placed = order.add_position(order.number_repeated_hours(random_loads))
    expected = placed.withColumn("expected", F.row_number().over(W.orderBy(*TIME_ORDER)) - 1)
    assert expected.where("expected <> row_ix").count() == 0
    sizes = random_loads.groupBy("load_date").count()
    wrong = placed.join(sizes, "load_date").where("hours_in_load_date <> count")
    assert placed.count() == 6000 and wrong.count() == 0


def test_lags_equal_a_global_window(random_loads):
    placed = order.add_position(order.number_repeated_hours(random_loads))
    lags = {"one": ("caiso_mw", 1), "day": ("caiso_mw", 24), "week": ("pge_mw", 168)}
    everywhere = W.orderBy("row_ix")
    for span in (1, 8192):
        lagged = order.add_lags(placed, lags, span=span)
        checked = lagged.withColumns({f"{n}_x": F.lag(c, k).over(everywhere) for n, (c, k) in lags.items()})
        wrong = checked.where(" or ".join(f"not ({n} <=> {n}_x)" for n in lags))
        assert checked.count() == 6000 and wrong.count() == 0


def test_lag_crosses_the_stage_boundary(load_rows):
    rows = [("2024-01-01", h, h) for h in range(1, 25)] + [("2024-01-02", 1, 99, "validation", "b.csv")]
    numbered = order.number_repeated_hours(load_rows(rows))
    lagged = order.add_lags(order.add_position(numbered), order.load_lags(hours=[24]))
    assert float(lagged.where("source_stage = 'validation'").first().caiso_lag_24_mw) == 1.0


def test_days_of_23_and_25_rows(load_rows):
    spring = [("2024-03-10", h, h) for h in range(1, 25) if h != 2]
    autumn = [("2024-11-03", h, h) for h in range(1, 25)] + [("2024-11-03", 1, 50)]
    days = order.add_hours_in_day(load_rows(spring + autumn)).select("load_date", "hours_in_load_date").distinct()
    assert sorted(r.hours_in_load_date for r in days.collect()) == [23, 25]


def test_duplicate_rows_lists_all_of_them(random_loads):
    labelled = clean.add_hour_label(random_loads)
    counts = labelled.groupBy("local_timestamp_label").count().where("count > 1")
    found = order.duplicate_rows(labelled, ["local_timestamp_label"])
    assert found.count() == counts.agg(F.sum("count")).first()[0]


def test_lags_take_one_exchange_of_the_rows(random_loads):
    stored = order.store(order.add_position(order.number_repeated_hours(random_loads)), "placed")
    plan = order.add_lags(stored, order.load_lags(["pge", "sce"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SinglePartition" not in plan


def test_scratch_of_this_application_can_be_dropped(spark):
    from hourgrid.sources import scratch

    stored = scratch.store(spark.range(3), "three")
    folder = stored.inputFiles()[0]
    assert scratch.scratch_root(spark) in folder and stored.count() == 3
