"""Linear models on calendar classes, lags and temperatures, all fitted from one matrix of products."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.fixed import FOUR_CITIES, TERRITORY_CITIES

# Rows multiplied together, tasks in which matrices meet, and the share of its own below which a column counts as dependent.
TOGETHER = 16_384
ADDERS = 16
DEPENDENT = 1e-11

# Calendar classes: number of codes, and the code of a row counted from 0.
CLASSES = {
    "hour": (24, lambda: F.col("hour_ending") - 1),
    "weekday": (7, lambda: F.weekday("load_date")),
    "month": (12, lambda: F.month("load_date") - 1),
    "hour_in_month": (288, lambda: (F.month("load_date") - 1) * 24 + F.col("hour_ending") - 1),
}


@dataclass(frozen=True)
class OlsSpec:
    """What to explain, the calendar classes and the numeric columns that explain it.

    ``hour_in_month`` spans the same space as hour, month and their interaction, without
    redundant columns.
    """

    actual: str
    classes: tuple[str, ...]
    numeric: tuple[str, ...]


def _lags(load: str) -> tuple[str, ...]:
    return f"{load}_lag_24_mw", f"{load}_lag_168_mw"


BASIC = OlsSpec("caiso_mw", ("hour", "weekday", "month"), _lags("caiso"))
INTERACTION = OlsSpec("caiso_mw", ("hour_in_month", "weekday"), _lags("caiso"))
WEATHER = OlsSpec(
    "caiso_mw",
    ("hour_in_month", "weekday"),
    (*_lags("caiso"), *[f"temp_{city}_f" for city in FOUR_CITIES]),
)
TERRITORY_SPECS = {
    territory: OlsSpec(
        f"{territory}_mw",
        ("hour_in_month", "weekday"),
        (*_lags(territory), *[f"temp_{city}_f{power}" for city in cities for power in ("", "_sq")]),
    )
    for territory, cities in TERRITORY_CITIES.items()
}


def columns_read(specs: Mapping[str, OlsSpec]) -> list[str]:
    """What fits and forecasts of the specs read, each column once."""
    days = ["load_date", "hour_ending"]
    return list(dict.fromkeys([*days, *(c for spec in specs.values() for c in (spec.actual, *spec.numeric))]))


def _lookup(name: str, values: dict[int, float]) -> Column:
    """The value of the row's code; NULL for a code that has none."""
    size, code = CLASSES[name]
    cells = [f"{values[level]!r}D" if level in values else "CAST(NULL AS DOUBLE)" for level in range(size)]
    return F.get(F.expr(f"array({', '.join(cells)})"), code())


@dataclass
class FittedOls:
    """Intercept, an effect per trained code of each class, a slope per numeric column."""

    spec: OlsSpec
    intercept: float
    effects: dict[str, dict[int, float]]
    slopes: dict[str, float]

    def forecast(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with its forecast; NULL where a predictor is missing or a class was never trained.

        The forecast is one column expression, looked up and summed: no vector, no join.
        """
        total = F.lit(self.intercept)
        for class_name, effects in self.effects.items():
            total = total + _lookup(class_name, effects)
        for column, slope in self.slopes.items():
            total = total + F.col(column).cast("double") * slope
        return df.withColumn(name, total)


@dataclass(frozen=True)
class _Layout:
    """Columns of the joint matrix: a one, every code of every class, every number; and the bit that says a class or number is missing."""

    classes: tuple[str, ...]
    numeric: tuple[str, ...]

    @staticmethod
    def of(specs: Sequence[OlsSpec]) -> _Layout:
        classes = dict.fromkeys(c for spec in specs for c in spec.classes)
        numeric = dict.fromkeys(n for spec in specs for n in (*spec.numeric, spec.actual))
        return _Layout(tuple(classes), tuple(numeric))

    @property
    def starts(self) -> dict[str, int]:
        """Where the codes of a class begin, or where a number is."""
        found, at = {}, 1
        for name in self.classes:
            found[name] = at
            at += CLASSES[name][0]
        return found | {name: at + i for i, name in enumerate(self.numeric)}

    @property
    def width(self) -> int:
        return 1 + sum(CLASSES[c][0] for c in self.classes) + len(self.numeric)

    def missing(self, names: Sequence[str]) -> int:
        places = {name: i for i, name in enumerate((*self.classes, *self.numeric))}
        return sum(1 << places[name] for name in names)

    def rows(self, df: DataFrame) -> DataFrame:
        codes = [CLASSES[c][1]().cast("int").alias(f"_c_{c}") for c in self.classes]
        return df.select(*codes, *[F.col(n).cast("double").alias(f"_x_{n}") for n in self.numeric])

    def products(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task's rows the products of all columns, apart for each set of missing values; a row a set."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                gaps = np.zeros(part.num_rows, np.int64)
                codes, numbers = [], np.ones((1 + len(self.numeric), part.num_rows))
                for place, (kind, name) in enumerate([*(("_c_", c) for c in self.classes), *(("_x_", n) for n in self.numeric)]):
                    values = part.column(kind + name).to_numpy(zero_copy_only=False).astype(np.float64)
                    missing = np.isnan(values)
                    if missing.any():
                        gaps |= missing * np.int64(1 << place)
                        values = np.where(missing, 0, values)
                    if kind == "_x_":
                        numbers[1 + place - len(self.classes)] = values
                    else:
                        codes.append(values.astype(np.int64))
                for gap in np.unique(gaps).tolist():
                    own = gaps == gap
                    rows = slice(None) if own.all() else own
                    present = {c: code[rows] for i, (c, code) in enumerate(zip(self.classes, codes)) if not gap >> i & 1}
                    self._add(sums.setdefault(gap, np.zeros((self.width, self.width))), present, numbers[:, rows])
        yield from _as_rows(sums)

    def _add(self, matrix: np.ndarray, codes: Mapping[str, np.ndarray], numbers: np.ndarray) -> None:
        """Add the products of rows without gaps in ``codes``. A row has one code of a class, so what meets a class is
        summed by code; the work of a row does not grow with the number of codes.
        """
        starts = self.starts
        own = np.array([0, *(starts[n] for n in self.numeric)])
        matrix[np.ix_(own, own)] += numbers @ numbers.T
        for i, (name, code) in enumerate(codes.items()):
            size = CLASSES[name][0]
            its = slice(starts[name], starts[name] + size)
            met = np.array([np.bincount(code, number, size) for number in numbers]).T
            matrix[its, own] += met
            matrix[own, its] += met.T
            np.einsum("ii->i", matrix[its, its])[:] += met[:, 0]
            for other, second in list(codes.items())[:i]:
                wide = CLASSES[other][0]
                both = np.bincount(code * wide + second, minlength=size * wide).reshape(size, wide)
                there = slice(starts[other], starts[other] + wide)
                matrix[its, there] += both
                matrix[there, its] += both.T


def _as_rows(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for gap, matrix in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([gap], pa.int64()), pa.array([matrix.tobytes()], pa.binary())], names=["gap", "matrix"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for gap, matrix in zip(batch.column("gap").to_pylist(), batch.column("matrix")):
            sums[gap] = sums.get(gap, 0) + np.frombuffer(matrix.as_buffer(), np.float64)
    yield from _as_rows(sums)


def _solved(spec: OlsSpec, layout: _Layout, sums: dict[int, np.ndarray]) -> FittedOls:
    """Least squares on the rows that have all the spec's columns, from their part of the matrix.

    Codes that occur in them are known, the last one of a class is the reference. Columns are centred by the products with the
    one and scaled; those that depend on others get the share that makes the solution shortest.
    """
    wanted = layout.missing([*spec.classes, *spec.numeric, spec.actual])
    total = sum((m for gap, m in sums.items() if not gap & wanted), np.zeros((layout.width, layout.width)))
    starts, n = layout.starts, total[0, 0]
    known = {c: [k for k in range(CLASSES[c][0]) if total[starts[c] + k, starts[c] + k] > 0] for c in spec.classes}
    places = [starts[c] + k for c in spec.classes for k in known[c][:-1]] + [starts[x] for x in spec.numeric]
    both = [*places, starts[spec.actual]]
    means = total[0, both] / max(n, 1)
    centred = total[np.ix_(both, both)] - n * np.outer(means, means)
    scale = np.sqrt(np.maximum(np.diag(centred), 0))
    scale[scale == 0] = 1.0
    scaled = centred / np.outer(scale, scale)
    weights = np.linalg.pinv(scaled[:-1, :-1], rcond=DEPENDENT, hermitian=True) @ scaled[:-1, -1] * scale[-1] / scale[:-1]
    left, effects = iter(weights.tolist()), {}
    for c in spec.classes:
        effects[c] = {k: next(left) for k in known[c][:-1]} | dict.fromkeys(known[c][-1:], 0.0)
    return FittedOls(spec, float(means[-1] - weights @ means[:-1]), effects, dict(zip(spec.numeric, left)))


def fit_specs(train: DataFrame, specs: Mapping[str, OlsSpec]) -> dict[str, FittedOls]:
    """Ordinary least squares of several specs, each on the rows without gaps in its own columns, in one pass over ``train``.

    Tasks return a matrix for each set of missing values they meet; these meet in ADDERS tasks, of which the driver gets one
    each. A matrix has a row for every code and number, some hundred, whatever the number of rows.
    """
    layout = _Layout.of(list(specs.values()))
    schema = "gap long, matrix binary"
    parts = layout.rows(train).mapInArrow(layout.products, schema).repartition(ADDERS).mapInArrow(_added, schema).collect()
    sums: dict[int, np.ndarray] = {}
    for part in parts:
        own = np.frombuffer(part["matrix"], np.float64).reshape(layout.width, layout.width)
        sums[part["gap"]] = sums.get(part["gap"], 0) + own
    return {name: _solved(spec, layout, sums) for name, spec in specs.items()}


def fit_ols(train: DataFrame, spec: OlsSpec) -> FittedOls:
    return fit_specs(train, {"one": spec})["one"]


def fit_territories(train: DataFrame, specs: dict[str, OlsSpec] = TERRITORY_SPECS) -> dict[str, FittedOls]:
    """One model per territory."""
    return fit_specs(train, specs)


def forecast_territories(df: DataFrame, fitted: dict[str, FittedOls]) -> DataFrame:
    """``forecast_<territory>`` for each, and ``forecast_regional`` as their sum."""
    for territory, model in fitted.items():
        df = model.forecast(df, f"forecast_{territory}")
    total = None
    for territory in fitted:
        part = F.col(f"forecast_{territory}")
        total = part if total is None else total + part
    return df.withColumn("forecast_regional", total)


def territory_rows(df: DataFrame, territories: Sequence[str]) -> DataFrame:
    """One row per territory and hour, for scoring all territories in one aggregate."""
    parts = [
        F.struct(
            F.lit(t).alias("territory"),
            F.col(f"{t}_mw").cast("double").alias("actual"),
            F.col(f"forecast_{t}").alias("forecast"),
        )
        for t in territories
    ]
    return df.select(F.inline(F.array(*parts)))
