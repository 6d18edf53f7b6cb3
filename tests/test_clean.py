from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourgrid import schemas
from hourgrid.functions import parsing
from hourgrid.operators import clean
from hourgrid.plans import medallion
from hourgrid.sources import payload, text

GOOD = ("2024-01-05", "3", "1.5", "2", "3", "4", "11", "a.csv")


def raw(spark, rows):
    return spark.createDataFrame(rows, schemas.STAGED_LOADS)


@pytest.mark.parametrize("date", ["CAISO Public", " CAISO Public ", "", "  ", None])
def test_footers_and_blanks_are_dropped(spark, date):
    rows = raw(spark, [GOOD, (date, *[None] * 6, "a.csv")])
    assert clean.drop_footer_rows(rows).count() == 1


@pytest.mark.parametrize("place,value", [(1, "x"), (1, "0"), (1, "25"), (1, "5.0"), (2, "n/a"), (6, None), (0, "soon")])
def test_rows_that_do_not_parse_are_dropped(spark, place, value):
    bad = list(GOOD)
    bad[place] = value
    empty = raw(spark, [])
    assert medallion.typed_loads(raw(spark, [GOOD, tuple(bad)]), empty).count() == 1


def test_reject_counts_name_the_first_rule(spark):
    rows = [GOOD, (None, *[None] * 6, "a"), ("soon", *GOOD[1:]), ("2024-01-05", "25", *GOOD[2:]), (*GOOD[:6], "", "a")]
    counts = {r.rule: r.row_count for r in clean.reject_counts(raw(spark, rows)).collect()}
    assert counts == {"kept": 1, "blank or footer": 1, "date": 1, "hour": 1, "load": 1}


def test_both_autumn_rows_stay_and_are_numbered_by_load(spark):
    twice = [("2024-11-03", "1", "1", "1", "1", "1", load, "a.csv") for load in ("20", "10")]
    silver = medallion.silver_loads(raw(spark, twice), raw(spark, []))
    found = [(r.hour_instance, r.records_at_hour_label, float(r.caiso_mw)) for r in silver.orderBy("hour_instance").collect()]
    assert found == [(1, 2, 10.0), (2, 2, 20.0)]


def test_numbering_does_not_restart_with_a_stage(spark):
    silver = medallion.silver_loads(raw(spark, [GOOD]), raw(spark, [(*GOOD[:7], "b.csv")]))
    assert sorted((r.source_stage, r.hour_instance) for r in silver.collect()) == [("historical", 1), ("validation", 2)]


def test_labels_keep_the_skipped_spring_hour_in_any_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        rows = spark.createDataFrame([("2021-03-14", 3, "2021-03-14 02:00:00.6")], "d string, h int, t string")
        row = rows.select(
            clean.calendar.hour_label(F.col("d").cast("date"), F.col("h")).cast("string").alias("label"),
            parsing.to_label(F.col("t")).cast("string").alias("parsed"),
            parsing.to_label_of_any(F.lit("3/14/2021 2:00"), [(r"^\d+/", "M/d/yyyy H:mm")]).cast("string").alias("any"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert tuple(row) == ("2021-03-14 02:00:00", "2021-03-14 02:00:01", "2021-03-14 02:00:00")


@pytest.mark.parametrize("spelled,hour", [("2025-01-01", 0), ("2025-01-01 05:00:00", 5), ("2025-01-01T05:00", 5), ("soon", None)])
def test_mixed_timestamps(spark, spelled, hour):
    found = spark.range(1).select(parsing.to_label_of_any(F.lit(spelled))).first()[0]
    assert found == (None if hour is None else dt.datetime(2025, 1, 1, hour))


def test_exports_of_any_case_with_their_file(spark, tmp_path):
    header = "Date,HR,PGE,SCE,SDGE,VEA,CAISO\n"
    for name in ("jan.csv", "FEB.CSV", "notes.txt"):
        (tmp_path / name).write_text(header + "2024-01-01,1,1,2,3,4,10\n")
    rows = text.read_exports(spark, str(tmp_path)).collect()
    assert sorted(r.source_file for r in rows) == ["FEB.CSV", "jan.csv"]


def test_a_header_in_another_order_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("HR,Date,PGE,SCE,SDGE,VEA,CAISO\n1,2024-01-01,1,2,3,4,10\n")
    with pytest.raises(Exception, match="CSV header"):
        text.read_exports(spark, str(tmp_path)).collect()


def test_payload_arrays_become_rows(spark, tmp_path):
    body = '{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [50.1, 51.2]}}'
    (tmp_path / "san_jose_2024.json").write_text(body)
    rows = payload.read_hourly_payloads(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [(r.city, r.timestamp.hour, r.temperature) for r in rows] == [("san_jose", 0, 50.1), ("san_jose", 1, 51.2)]


def test_columns_are_normalised_and_stacked_by_name(spark):
    left = clean.normalise_columns(spark.createDataFrame([(1, 2)], " PGE int, `Hr ` int"))
    right = spark.createDataFrame([(3,)], "hr int")
    rows = text.stack_by_name([left, right]).orderBy("hr").collect()
    assert [(r.pge, r.hr) for r in rows] == [(1, 2), (None, 3)]
