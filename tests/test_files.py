from __future__ import annotations

import datetime as dt

import pytest

from hourgrid.operators import joins
from hourgrid.operators.forest import ForestSettings
from hourgrid.plans import files
from hourgrid.sources import text


def folder_of(tmp_path, **contents):
    for name, content in contents.items():
        (tmp_path / f"{name}.csv").write_bytes(content.encode())
    return str(tmp_path)


def test_headers_of_any_spelling_and_columns(spark, tmp_path):
    folder = folder_of(
        tmp_path,
        a="﻿ Date,HR ,PGE\n2024-01-05,1,2\n",
        b='vea,"hr",DATE\n7,2,2024-01-06\n',
        c="",
    )
    (tmp_path / "deep er").mkdir()
    (tmp_path / "deep er" / "d [1].CSV").write_text("\nDate,HR\n2024-01-07,3\n")
    rows = text.read_mixed_exports(spark, folder).select("date", "hr", "pge", "vea", "malformed").collect()
    assert sorted(map(tuple, rows)) == [
        ("2024-01-05", "1", "2", None, None),
        ("2024-01-06", "2", None, "7", None),
        ("2024-01-07", "3", None, None, None),
    ]


@pytest.mark.parametrize("header", ["Date, date", "HR,hr,Date"])
def test_a_column_named_twice_stops_the_read(spark, tmp_path, header):
    with pytest.raises(ValueError, match="twice"):
        text.read_mixed_exports(spark, folder_of(tmp_path, a=f"{header}\n1,2\n"))


def test_a_folder_without_header_stops_the_read(spark, tmp_path):
    with pytest.raises(ValueError, match="no export"):
        text.read_mixed_exports(spark, folder_of(tmp_path, a="\n"))


def test_clean_exports_count_what_they_leave_out(spark, tmp_path):
    raw, target = tmp_path / "raw", str(tmp_path / "clean")
    raw.mkdir()
    header = "Date,HR,PGE,SCE,SDGE,VEA,CAISO"
    good = "2024-01-05,3,1,2,3,4,10.5"
    lines = [header, good, "2024-01-05,2,1,2,3,4,x", "soon,3,1,2,3,4,5", f"{good},9", "2024-01-05,3", "CAISO Public", "  ,,,,,,"]
    folder = folder_of(raw, a="\n".join(lines), b="hr,date,caiso\n1,2024-01-05,5\n")
    cleaned, counts = files.clean_exports(spark, folder, target)
    assert {r.rule: r.row_count for r in counts.collect()} == {"kept": 3, "ragged": 2, "date": 1, "blank or footer": 2}
    rows = [tuple(r) for r in cleaned.orderBy("timestamp").select("hr", "pge", "caiso", "source_file", "timestamp").collect()]
    assert rows == [
        (1, None, 5.0, "b.csv", dt.datetime(2024, 1, 5, 0)),
        (2, 1.0, None, "a.csv", dt.datetime(2024, 1, 5, 1)),
        (3, 1.0, 10.5, "a.csv", dt.datetime(2024, 1, 5, 2)),
    ]


def test_outer_join_keeps_repeated_readings(spark):
    hour = dt.datetime(2024, 1, 5, 1)
    later = dt.datetime(2024, 1, 5, 2)
    rows = [("a", hour, 1.0), ("a", hour, 2.0), ("b", hour, 3.0), ("b", later, 4.0)]
    readings = spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, temperature double")
    wide = joins.cities_outer_joined(readings, ["a", "b"])
    assert sorted(tuple(r)[1:] for r in wide.where("temp_a is not null").collect()) == [(1.0, 3.0), (2.0, 3.0)]
    assert [tuple(r) for r in wide.where("temp_a is null").collect()] == [(later, None, 4.0)]


def test_indented_payloads_to_one_file(spark, tmp_path):
    payloads = tmp_path / "payloads"
    payloads.mkdir()
    for city, start in (("fresno", 50), ("poway", 60)):
        times = ", ".join(f'"2024-01-05T{h:02d}:00"' for h in (0, 1, 1))
        (payloads / f"{city}.json").write_text(
            f'{{\n "hourly": {{\n  "time": [{times}],\n  "temperature_2m": [{start}.0, {start + 1}.0, {start + 2}.0]\n }}\n}}\n'
        )
    written, repeated = files.weather_file(spark, str(payloads), str(tmp_path / "weather"), ["fresno", "poway"])
    assert written.count() == 5 and repeated.count() == 4
    assert {r.timestamp.hour for r in repeated.collect()} == {1}


def test_validation_from_files_of_two_spellings(spark, tmp_path):
    """Two years of loads that follow the hour; the last year is forecast."""
    days = [dt.date(2023, 11, 1) + dt.timedelta(d) for d in range(90)]
    loads, weather = {}, []
    for stage, year in (("historical", 2023), ("validation", 2024)):
        spelled = "{0:%Y-%m-%d %H}:00" if year == 2023 else "{0.month}/{0.day}/{0.year} {0.hour}:00"
        lines, warm = ["date,hr,pge,sce,sdge,vea,caiso,source_file,timestamp"], []
        for day in (d for d in days if d.year == year):
            for hour in range(24):
                moment = dt.datetime.combine(day, dt.time(hour))
                parts = [100 + 5 * hour + day.toordinal() % 7, 80 + hour % 6, 50 + day.day % 5, 10 + hour % 3 + day.toordinal() % 4]
                lines.append(",".join(map(str, [day, hour + 1, *parts, sum(parts), "f.csv", spelled.format(moment)])))
                warm.append([spelled.format(moment), *[40 + (hour * (i + 3) + day.toordinal() * (i + 1)) % 37 for i in range(7)]])
        loads[stage] = folder_of(tmp_path, **{f"loads{year}": "\n".join(lines)}) + f"/loads{year}.csv"
        head = "timestamp," + ",".join(f"temp_{c}" for c in files.CITIES)
        content = "\n".join([head, *[",".join(map(str, w)) for w in warm]])
        weather.append(folder_of(tmp_path, **{f"weather{year}": content}) + f"/weather{year}.csv")
    frame = files.frame_of_files(spark, loads, weather)
    assert frame.count() == 90 * 24
    assert frame.where("timestamp is null or temp_poway_f is null").count() == 0
    assert frame.where("caiso_lag_168_mw is null").count() == 168
    results = files.validate_files(spark, loads, weather, 2023, ForestSettings(trees=5, depth=4))
    assert results.count() == 24 * sum(d.year == 2024 for d in days)
    assert {"forecast_regional", "forecast_rf"} <= set(results.columns)


def test_file_names_take_no_pattern_search(spark, tmp_path, capsys):
    """The name is the end of the path, encoded as there; only other patterns are searched for in it."""
    folder = tmp_path / "in put" / "export=b"
    folder.mkdir(parents=True)
    for name in ("first one.csv", "second.CSV"):
        (folder / name).write_text("Date,HR\n2024-01-01,1\n")
    rows = text.read_mixed_exports(spark, str(tmp_path))
    assert sorted(r.source_file for r in rows.collect()) == ["first%20one.csv", "second.CSV"]
    rows.explain()
    assert "regexp_extract" not in capsys.readouterr().out
    other = text.read_mixed_exports(spark, str(tmp_path), file_pattern=r"export=([^/]+)/")
    assert {r.source_file for r in other.collect()} == {"b"}
