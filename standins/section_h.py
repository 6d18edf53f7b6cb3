"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.functions import calendar, parsing
from standins import inputs
from standins.registry import register


def _items(spark, sf):
    return inputs.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate", "l_quantity", "l_discount"
    )


KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
KEYS = ", ".join(KEY)


@register("h01_trim", f"SELECT {KEYS}, TRIM('  ' || l_returnflag || ' ') AS v FROM lineitem")
def trim(spark, sf):
    padded = F.concat(F.lit("  "), "l_returnflag", F.lit(" "))
    return _items(spark, sf).select(*KEY, F.trim(padded).alias("v"))


@register("h02_nullif", f"SELECT {KEYS}, NULLIF(CASE WHEN l_returnflag = 'A' THEN '  ' ELSE l_returnflag END, '  ') AS v FROM lineitem")
def nullif(spark, sf):
    blanked = F.when(F.col("l_returnflag") == "A", "  ").otherwise(F.col("l_returnflag"))
    return _items(spark, sf).select(*KEY, parsing.stripped(blanked).alias("v"))


@register(
    "h03_try_cast",
    f"""SELECT {KEYS}, TRY_CAST(t AS INT) AS i, TRY_CAST(t AS DECIMAL(12,3)) AS x FROM (
  SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey AS VARCHAR) ELSE l_returnflag END AS t FROM lineitem)""",
)
def try_cast(spark, sf):
    text = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey").cast("string")).otherwise(F.col("l_returnflag"))
    return _items(spark, sf).select(*KEY, text.try_cast("int").alias("i"), parsing.to_load(text).alias("x"))


@register("h04_cast", f"SELECT {KEYS}, CAST(l_shipdate AS DATE) AS d, CAST(l_quantity AS DECIMAL(18,3)) AS x FROM lineitem")
def cast(spark, sf):
    return _items(spark, sf).select(
        *KEY, F.col("l_shipdate").cast("date").alias("d"), F.col("l_quantity").cast("decimal(18,3)").alias("x")
    )


@register("h05_convert_date", f"SELECT {KEYS}, CAST(l_shipdate AS DATE) AS d FROM lineitem")
def convert_date(spark, sf):
    """Through the eight-digit spelling and back."""
    digits = F.translate(F.to_date("l_shipdate").cast("string"), "-", "")
    return _items(spark, sf).select(*KEY, F.to_date(digits, "yyyyMMdd").alias("d"))


@register("h06_dateadd_hours", f"SELECT {KEYS}, l_shipdate + to_hours(CAST(l_orderkey % 24 AS INT)) AS ts FROM lineitem")
def dateadd_hours(spark, sf):
    label = calendar.hour_label(F.to_date("l_shipdate"), (F.col("l_orderkey") % 24).cast("int") + 1)
    return _items(spark, sf).select(*KEY, label.alias("ts"))


@register(
    "h07_datediff_days",
    f"SELECT {KEYS}, CAST(date_diff('day', DATE '1900-01-01', CAST(l_shipdate AS DATE)) AS INT) AS days FROM lineitem",
)
def datediff_days(spark, sf):
    since = F.datediff(F.to_date("l_shipdate"), F.lit("1900-01-01").cast("date"))
    return _items(spark, sf).select(*KEY, since.alias("days"))


@register("h08_datepart_hour", "SELECT event_id, CAST(EXTRACT(HOUR FROM ts) AS INT) AS h FROM events")
def datepart_hour(spark, sf):
    return inputs.table(spark, sf, "events").select("event_id", F.hour("ts").alias("h"))


@register("h09_year_month", f"SELECT {KEYS}, CAST(YEAR(l_shipdate) AS INT) AS y, CAST(MONTH(l_shipdate) AS INT) AS m FROM lineitem")
def year_month(spark, sf):
    return _items(spark, sf).select(*KEY, F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"))


@register("h10_modulo", f"SELECT {KEYS}, l_orderkey % 7 AS r FROM lineitem")
def modulo(spark, sf):
    return _items(spark, sf).select(*KEY, (F.col("l_orderkey") % 7).alias("r"))


@register("h11_case_when", f"SELECT {KEYS}, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS c FROM lineitem")
def case_when(spark, sf):
    size = F.when(F.col("l_quantity") < 10, "low").when(F.col("l_quantity") < 30, "mid").otherwise("high")
    return _items(spark, sf).select(*KEY, size.alias("c"))


@register(
    "h12_predicates",
    f"""SELECT {KEYS} FROM lineitem WHERE l_quantity BETWEEN 5 AND 40 AND l_returnflag IN ('A', 'R')
AND l_shipdate IS NOT NULL AND (l_linenumber <> 3 OR l_discount > 0.05)""",
)
def predicates(spark, sf):
    return (
        _items(spark, sf)
        .where(F.col("l_quantity").between(5, 40) & F.col("l_returnflag").isin("A", "R"))
        .where(F.col("l_shipdate").isNotNull())
        .where((F.col("l_linenumber") != 3) | (F.col("l_discount") > 0.05))
        .select(*KEY)
    )


@register(
    "h13_arithmetic",
    f"SELECT {KEYS}, (l_quantity + 1) * l_quantity - l_quantity / 2 AS v, l_quantity * l_quantity AS sq FROM lineitem",
)
def arithmetic(spark, sf):
    q = F.col("l_quantity")
    return _items(spark, sf).select(*KEY, ((q + 1) * q - q / 2).alias("v"), F.pow(q, F.lit(2)).alias("sq"))


@register("h14_abs_sqrt", f"SELECT {KEYS}, ABS(l_quantity - 25) AS a, SQRT(l_quantity) AS s FROM lineitem")
def abs_sqrt(spark, sf):
    q = F.col("l_quantity")
    return _items(spark, sf).select(*KEY, F.abs(q - 25).alias("a"), F.sqrt(q).alias("s"))


@register(
    "h15_day_names",
    f"SELECT {KEYS}, DAYNAME(l_shipdate) AS n, CAST(ISODOW(l_shipdate) - 1 AS INT) AS i FROM lineitem",
)
def day_names(spark, sf):
    day = F.to_date("l_shipdate")
    return _items(spark, sf).select(
        *KEY, calendar.day_name(day).alias("n"), calendar.weekday_index(day).alias("i")
    )


@register(
    "h16_strip_lower",
    f"SELECT {KEYS}, LOWER(TRIM(' ' || l_returnflag || '.CSV ')) AS v, l_returnflag = 'A' AS e FROM lineitem",
)
def strip_lower(spark, sf):
    name = F.lower(F.trim(F.concat(F.lit(" "), "l_returnflag", F.lit(".CSV "))))
    return _items(spark, sf).select(*KEY, name.alias("v"), name.endswith("a.csv").alias("e"))


@register(
    "h17_days_around",
    f"""SELECT {KEYS}, CAST(CAST(l_shipdate AS DATE) - 3 AS DATE) AS before_day,
  CAST(CAST(l_shipdate AS DATE) + 3 AS DATE) AS after_day FROM lineitem""",
)
def days_around(spark, sf):
    day = F.to_date("l_shipdate")
    return _items(spark, sf).select(
        *KEY, F.date_sub(day, 3).alias("before_day"), F.date_add(day, 3).alias("after_day")
    )
