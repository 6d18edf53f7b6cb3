"""Text to typed values; text that does not parse becomes NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourgrid import schemas
from hourgrid.fixed import FOOTER


def stripped(text: Column) -> Column:
    """Blanks cut at both ends, nothing left becomes NULL."""
    return F.nullif(F.trim(text), F.lit(""))


def is_data_row(date_text: Column, footer: str = FOOTER) -> Column:
    """Neither blank nor the footer line of an export."""
    kept = stripped(date_text)
    return kept.isNotNull() & (kept != footer)


def to_load(text: Column) -> Column:
    return text.try_cast(schemas.LOAD_TYPE)


def to_temperature(text: Column) -> Column:
    return text.try_cast(schemas.TEMPERATURE_TYPE)


def to_label(text: Column) -> Column:
    """A zone-less timestamp rounded to the second.

    ``date_trunc`` would pass through a zoned timestamp and move the skipped spring hour, so the
    rounding is done with an interval.
    """
    moment = text.try_cast("timestamp_ntz")
    second = F.extract(F.lit("SECOND"), moment)
    nothing = F.lit(0)
    return moment + F.make_dt_interval(nothing, nothing, nothing, F.round(second, 0) - second)


def to_label_of_any(text: Column, formats: Sequence[tuple[str, str]] = ()) -> Column:
    """Date only, blank or ``T`` separated; further formats as (regular expression, pattern) pairs."""
    tries = [text.try_cast("timestamp_ntz")]
    for shape, pattern in formats:
        tries.append(F.when(text.rlike(shape), F.to_timestamp_ntz(text, F.lit(pattern))))
    return F.coalesce(*tries)
