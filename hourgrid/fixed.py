"""Column names, labels and limits shared by the whole library."""

from __future__ import annotations

# Fixed values of the data model: territories, cities, stages and labels.
TERRITORIES = ["pge", "sce", "sdge", "vea"]
LOADS = ["pge", "sce", "sdge", "vea", "caiso"]
CITIES = [
    "sacramento",
    "san_jose",
    "fresno",
    "los_angeles",
    "riverside",
    "san_diego",
    "poway",
]
FOUR_CITIES = ["sacramento", "san_jose", "los_angeles", "san_diego"]
TERRITORY_CITIES = {
    "pge": ["sacramento", "san_jose", "fresno"],
    "sce": ["los_angeles", "riverside"],
    "sdge": ["san_diego", "poway"],
    "vea": [],
}
HISTORICAL = "historical"
VALIDATION = "validation"
FOOTER = "CAISO Public"
ON_PEAK = "On-Peak"
OFF_PEAK = "Off-Peak"
SUPER_OFF_PEAK = "Super Off-Peak"
MATCHED = "matched"
MISSING_WEATHER = "missing weather"
NOT_JOINED = "not joined: DST transition"
TEMPERATURE_BANDS = [
    (55, "Below 55 F"),
    (70, "55 to under 70 F"),
    (85, "70 to under 85 F"),
    (None, "85 F and above"),
]
DAY_NAMES = [
    "Monday",
    "Tuesday",
    "Wednesday",
    "Thursday",
    "Friday",
    "Saturday",
    "Sunday",
]

# The order of load rows: hour label first, then the numbering of repeated labels.
HOUR_KEY = ["load_date", "hour_ending"]
TIME_ORDER = ["load_date", "hour_ending", "hour_instance"]
LOAD_COLUMNS = [f"{name}_mw" for name in LOADS]
TEMPERATURE_COLUMNS = [f"temp_{city}_f" for city in CITIES]

# Limits of this library, not of the data: rows one task may hold at once.
GROUP_ROWS = 5_000_000
LAG_SPAN = 8_192
SERIES_SPAN = 65_536
