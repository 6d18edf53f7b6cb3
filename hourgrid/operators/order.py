"""Numbering, positions and lags without sending the whole series to one task.

Three facts carry this module:

* rows of one hour label are numbered 1..n, so the position of a row in the whole series is the
  number of rows in earlier labels plus its own number. The label counts form a calendar table
  (24 rows per day), which is the only thing that is ever summed up in order;
* a lag of k rows needs no join: spans of consecutive positions are shuffled together, each with
  the last k rows of the span before it;
* a label that holds more rows than one task should sort is numbered by a range sort instead,
  which splits it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourgrid.fixed import GROUP_ROWS, HOUR_KEY, LAG_SPAN
from hourgrid.sources.scratch import store

FILE_AND_LOAD = ["source_file", "caiso_mw", "pge_mw", "sce_mw", "sdge_mw", "vea_mw"]


def range_positions(df: DataFrame, order: Sequence[str], name: str = "row_ix") -> DataFrame:
    """0-based position in the order of ``order``, by a range sort.

    The sorted rows are written once: range bounds are sampled, so a second evaluation could cut
    elsewhere. Copies that agree in all of ``order`` are split by a running number, so no key, not
    even one full of copies, has to fit into a task. The input is stored first: sampling then costs
    no second evaluation, and the running number is the same when a lost task is repeated.
    """
    keys = [F.col(column) for column in order] + [F.col("_copy")]
    ranged = (
        store(df, "unordered")
        .withColumn("_copy", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
    )
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = store(
        ranged.withColumns({"_part": F.spark_partition_id(), "_within": within}).drop("_copy"), "ranged"
    )
    parts = stored.groupBy("_part").agg(F.count("*").alias("_rows"))
    # One row per task of the sort: this is the only ordered sum, and it is that small.
    before = F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return (
        stored.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_within"))
        .drop("_part", "_within", "_start")
    )


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which a NULL key equals a NULL key, as it does in a window's partition."""
    named = right.select(*[F.col(c).alias(f"_key_{c}") if c in keys else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys]
    return left.join(named, same, how).drop(*[f"_key_{c}" for c in keys])


def number_repeated_hours(
    df: DataFrame,
    key: Sequence[str] = HOUR_KEY,
    order: Sequence[str] = FILE_AND_LOAD,
    group_rows: int = GROUP_ROWS,
    labels: DataFrame | None = None,
) -> DataFrame:
    """``hour_instance`` and ``records_at_hour_label`` of rows that share an hour label.

    The territory loads behind the system load make the order total up to exact copies, and the stage comes
    last where there is one. One exchange serves both columns of all labels that fit into a task, which a
    count per label checks first; only larger labels are numbered by a range sort. A NULL in a key is a
    label like any other. ``labels`` may name a cheaper source for that count with at least the labels of ``df``.
    """
    if "source_stage" in df.columns and "source_stage" not in order:
        order = [*order, "source_stage"]
    counts = (df if labels is None else labels).groupBy(*key).count()
    hot = store(counts.where(F.col("count") > group_rows).select(*key), "hot-labels")
    if hot.isEmpty():
        return _numbered_by_window(df, key, order)
    plain = _numbered_by_window(join_on_keys(df, hot, key, "left_anti"), key, order)
    return plain.unionByName(_numbered_by_sort(join_on_keys(df, hot, key, "left_semi"), key, order))


def _numbered_by_window(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    label = W.partitionBy(*key)
    return df.withColumns(
        {
            "hour_instance": F.row_number().over(label.orderBy(*order)),
            "records_at_hour_label": F.count("*").over(label),
        }
    )


def _numbered_by_sort(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    placed = range_positions(df, [*key, *order], "_position")
    firsts = placed.groupBy(*key).agg(
        F.min("_position").alias("_first"), F.count("*").alias("records_at_hour_label")
    )
    instance = (F.col("_position") - F.col("_first") + 1).cast("int")
    numbered = join_on_keys(placed, store(firsts, "firsts"), key).withColumn("hour_instance", instance)
    return numbered.select(*df.columns, "hour_instance", "records_at_hour_label")


def label_offsets(df: DataFrame, key: Sequence[str] = HOUR_KEY) -> DataFrame:
    """One row per hour label: rows before it, rows of its day.

    Day totals are summed up first, so the only unpartitioned window has one row per calendar day.
    The table is stored, so that later joins know its size.
    """
    day, hour = key
    labels = df.groupBy(*key).agg(F.count("*").alias("_rows"))
    days = labels.groupBy(day).agg(F.sum("_rows").alias("hours_in_load_date"))
    earlier = W.orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    days = days.withColumn("_before_day", F.coalesce(F.sum("hours_in_load_date").over(earlier), F.lit(0)))
    in_day = W.partitionBy(day).orderBy(hour).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_before_day") + F.coalesce(F.sum("_rows").over(in_day), F.lit(0))
    offsets = join_on_keys(labels, days, [day]).select(day, hour, before.alias("_offset"), "hours_in_load_date")
    return store(offsets, "label_offsets")


def add_position(df: DataFrame, name: str = "row_ix") -> DataFrame:
    """``row_ix`` (0-based, order of TIME_ORDER) and ``hours_in_load_date``, without a sort.

    ``df`` carries ``hour_instance`` as numbered over all of its rows.
    """
    placed = join_on_keys(df, label_offsets(df), HOUR_KEY)
    position = F.col("_offset") + F.col("hour_instance") - 1
    return placed.select(*df.columns, position.alias(name), "hours_in_load_date")


def add_hours_in_day(df: DataFrame, day: str = "load_date") -> DataFrame:
    """Rows per day, joined on rather than windowed, so a large day is not gathered."""
    sizes = store(df.groupBy(day).agg(F.count("*").alias("hours_in_load_date")), "day_sizes")
    return join_on_keys(df, sizes, [day]).select(*df.columns, "hours_in_load_date")


def with_halo(df: DataFrame, reach: int, span: int, position: str) -> DataFrame:
    """Copy the last ``reach`` rows of every span into the next one as well (``_span``)."""
    home = F.floor(F.col(position) / span)
    near_end = F.col(position) % span >= span - reach
    spans = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_span", F.explode(spans))


def is_home(span: int, position: str) -> Column:
    return F.col("_span") == F.floor(F.col(position) / span)


def add_lags(
    df: DataFrame,
    lags: Mapping[str, tuple[str, int]],
    position: str = "row_ix",
    span: int = LAG_SPAN,
) -> DataFrame:
    """Columns ``{name: (source, k)}``: the value ``k`` positions earlier, NULL before the start.

    Positions must run without gaps. Every lag of every column shares one exchange of spans with
    equally many rows, whatever the dates look like.
    """
    reach = max(k for _, k in lags.values())
    span = max(span, 16 * reach)
    window = W.partitionBy("_span").orderBy(position)
    shifted = {name: F.lag(source, k).over(window) for name, (source, k) in lags.items()}
    spread = with_halo(df, reach, span, position).withColumns(shifted)
    return spread.where(is_home(span, position)).drop("_span")


def load_lags(loads: Sequence[str] = ("caiso",), hours: Sequence[int] = (24, 168)) -> dict[str, tuple[str, int]]:
    """Names of the usual lag columns, ready for ``add_lags``."""
    return {f"{load}_lag_{k}_mw": (f"{load}_mw", k) for load in loads for k in hours}


def add_seasonal_differences(df: DataFrame, column: str, hours: Sequence[int] = (24, 168)) -> DataFrame:
    """``diff_k``: the value minus the one ``k`` rows earlier."""
    lagged = add_lags(df, {f"_lag_{k}": (column, k) for k in hours})
    gaps = {f"diff_{k}": F.col(column) - F.col(f"_lag_{k}") for k in hours}
    return lagged.withColumns(gaps).drop(*[f"_lag_{k}" for k in hours])


def duplicate_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once, by key; NULL counts as a value."""
    repeated = df.groupBy(*key).agg(F.count("*").alias("_rows")).where("_rows > 1").select(*key)
    return join_on_keys(df, repeated, key, "left_semi").orderBy(*key)
