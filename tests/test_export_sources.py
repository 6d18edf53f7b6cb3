"""Sources of exports are looked for once a file, and what is stored of exports is typed."""

from __future__ import annotations

import pytest

from hourgrid.plans import files
from hourgrid.sources import text

PATTERN = r"export=([^/]+)/"


@pytest.fixture
def folder(tmp_path):
    for i, (export, header) in enumerate([("a b", "Date,HR,CAISO"), ("a b", "HR , Date"), ("c%41", "Date,HR,CAISO"), ("d", "Date,HR,CAISO")]):
        path = tmp_path / "in" / str(i) / f"export={export}"
        path.mkdir(parents=True)
        values = "2024-01-0{0},{1},5.5" if header.startswith("Date") else "{1},2024-01-0{0}"
        lines = [values.format(day, i + 1) for day in (1, 2)]
        (path / "x.csv").write_text("\n".join([header, *lines, "CAISO Public"]))
    return str(tmp_path / "in")


def rows(df):
    return sorted((tuple(r) for r in df.select("date", "hr", "caiso", "source_file").collect()), key=str)


def test_sources_by_file_and_by_row_are_equal(spark, folder, monkeypatch, capsys):
    once = text.read_mixed_exports(spark, folder, file_pattern=PATTERN)
    once.explain()
    assert "regexp_extract" not in capsys.readouterr().out
    monkeypatch.setattr(text, "READERS", 2)
    each = text.read_mixed_exports(spark, folder, file_pattern=PATTERN)
    each.explain()
    assert "regexp_extract" in capsys.readouterr().out
    assert rows(once) == rows(each) and len(rows(once)) == 12
    assert len({r[3] for r in rows(once)}) == 3


def test_stored_exports_are_typed(spark, folder, tmp_path, monkeypatch):
    kept = {}
    monkeypatch.setattr(files, "store", lambda df, label: kept.setdefault(label, df.cache()))
    found, rules = files.clean_exports(spark, folder, str(tmp_path / "clean"), PATTERN)
    types = dict(kept["exports"].dtypes)
    assert types["load_date"] == "date" and types["caiso"] == "double" and "malformed" not in types
    assert found.count() == 8
    assert {r.rule: r.row_count for r in rules.collect()}["kept"] == 8
