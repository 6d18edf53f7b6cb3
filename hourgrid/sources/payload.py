"""Weather payloads: one JSON object per city with two parallel arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid import schemas

CITY_IN_PATH = r"/([a-z]+(?:_[a-z]+)*)[^/]*\.json$"


def read_hourly_payloads(spark: SparkSession, folder: str, city_pattern: str = CITY_IN_PATH) -> DataFrame:
    """One row per city and hour; the city is the first group of ``city_pattern`` in the path.

    A file holds one object a line, or one object over several lines. What is neither stops the read, as do lists of
    hours and of temperatures that differ in length.
    """
    files = spark.read.text(folder, wholetext=True)
    tagged = files.withColumn("city", F.regexp_extract(F.col("_metadata.file_path"), city_pattern, 1))
    parse = lambda text: F.from_json(text, schemas.HOURLY_PAYLOAD)
    lines = F.filter(F.split("value", "\n"), lambda line: F.trim(line) != "")
    each = F.forall(lines, lambda line: parse(line)["hourly"]["time"].isNotNull())
    objects = tagged.select("city", F.explode(F.when(each, lines).otherwise(F.array("value"))).alias("object"))
    payload = objects.withColumn("hourly", parse(F.col("object"))["hourly"])
    kind = payload.schema["hourly"].dataType
    problem = lambda said: F.raise_error(F.concat(F.lit(said), "city")).cast(kind)
    paired = F.size("hourly.time").eqNullSafe(F.size("hourly.temperature_2m"))
    checked = F.when(F.col("hourly.time").isNull(), problem("no hourly payload of city "))
    tagged = payload.withColumn("hourly", checked.when(~paired, problem("hours without temperatures of city ")).otherwise(F.col("hourly")))
    pairs = F.arrays_zip(F.col("hourly.time"), F.col("hourly.temperature_2m"))
    return tagged.select("city", F.inline(pairs)).select(
        "city",
        F.col("time").cast("timestamp_ntz").alias("timestamp"),
        F.col("temperature_2m").alias("temperature"),
    )
