"""Declared schemas; nothing in this library infers a type from data."""

from __future__ import annotations

from pyspark.sql import types as T

from hourgrid.fixed import CITIES, LOADS


def _text(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


RAW_LOADS = _text(["Date", "HR", "PGE", "SCE", "SDGE", "VEA", "CAISO"])
STAGED_LOADS = _text(["Date", "HR", "PGE", "SCE", "SDGE", "VEA", "CAISO", "source_file"])
RAW_WEATHER = _text(["timestamp", *[f"temp_{city}" for city in CITIES]])

CLEAN_LOADS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("hr", T.IntegerType()),
        *[T.StructField(name, T.DoubleType()) for name in LOADS],
        T.StructField("source_file", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
    ]
)

CLEAN_LOADS_TEXT = _text(CLEAN_LOADS.fieldNames())

HOURLY_PAYLOAD = T.StructType(
    [
        T.StructField(
            "hourly",
            T.StructType(
                [
                    T.StructField("time", T.ArrayType(T.StringType())),
                    T.StructField("temperature_2m", T.ArrayType(T.DoubleType())),
                ]
            ),
        )
    ]
)

LOAD_TYPE = T.DecimalType(12, 3)
TEMPERATURE_TYPE = T.DecimalType(5, 1)
