"""The joint matrix of the regressions."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest

from hourgrid.operators import regression


def matrices(layout, columns):
    batch = pa.RecordBatch.from_pydict(columns)
    found = list(layout.products(iter([batch.slice(0, 7), batch.slice(7)])))
    rows = [row for part in found for row in zip(part.column("gap").to_pylist(), part.column("matrix").to_pylist())]
    return {gap: np.frombuffer(raw).reshape(layout.width, layout.width) for gap, raw in rows}


def drawn(classes, numeric, n, holes):
    draw = np.random.default_rng(n)
    columns = {f"_c_{c}": draw.integers(0, regression.CLASSES[c][0], n).tolist() for c in classes}
    columns |= {f"_x_{x}": draw.normal(5, 3, n).tolist() for x in numeric}
    for values in columns.values():
        for i in draw.choice(n, holes, replace=False) if holes else ():
            values[i] = None
    return columns


@pytest.mark.parametrize("holes", [0, 30])
def test_products_are_those_of_the_written_out_columns(holes, monkeypatch):
    monkeypatch.setattr(regression, "TOGETHER", 64)
    layout = regression._Layout(("hour", "weekday", "hour_in_month"), ("a", "b"))
    columns = drawn(layout.classes, layout.numeric, 500, holes)
    expected: dict[int, np.ndarray] = {}
    for values in zip(*columns.values()):
        row, gap = np.zeros(layout.width), 0
        row[0] = 1
        for i, (name, value) in enumerate(zip((*layout.classes, *layout.numeric), values)):
            if value is None:
                gap |= 1 << i
            elif i < len(layout.classes):
                row[layout.starts[name] + value] = 1
            else:
                row[layout.starts[name]] = value
        expected[gap] = expected.get(gap, 0) + np.outer(row, row)
    found = matrices(layout, columns)
    assert found.keys() == expected.keys()
    assert all(np.allclose(found[gap], expected[gap], rtol=1e-12) for gap in expected)


def test_work_of_a_row_does_not_grow_with_the_codes(monkeypatch):
    """Written out, these rows would take 10^12 multiplications."""
    monkeypatch.setitem(regression.CLASSES, "many", (4_000, None))
    layout = regression._Layout(("many",), ("a", "b"))
    columns = drawn(layout.classes, layout.numeric, 60_000, 0)
    start = time.process_time()
    found = matrices(layout, columns)
    assert time.process_time() - start < 5
    assert found[0][0, 0] == 60_000


def test_a_stored_frame_has_the_named_columns_alone(spark):
    from hourgrid.operators import order
    from hourgrid.plans import forecasts
    from standins import inputs

    small = "/root/testdata/sf0.001"
    columns = ["caiso_mw", *regression.columns_read(regression.TERRITORY_SPECS)]
    silver, weather = inputs.readings_silver(spark, small), inputs.readings_weather(spark, small)
    stored = forecasts.stored_frame(silver, weather, columns)
    assert stored.columns == columns and len(columns) == 29
    whole = forecasts.modelling_frame(silver, weather).select(*columns)
    assert stored.exceptAll(whole).count() == whole.exceptAll(stored).count() == 0
    assert order.load_lags(["pge"]).keys() <= set(columns)
