"""How five document filters interact, in every order, kept up to date as files and smaller ids of the same text arrive."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hourgrid.llm.common import WORD, Batches, as_batch, map_rows, strings

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
# Texts of one partition that are put together before they are sent to their state.
HELD_TEXTS = 50_000
# Bytes of files a micro-batch reads for each core of the cluster.
BATCH_BYTES = 32 << 20
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Texts that share a state: a call of its function costs much more than a text, and a changed state is written as a whole.
STATE_TEXTS = 16
# Up to so many texts for each core their states are kept in memory, beyond that in RocksDB.
MEMORY_TEXTS = 500_000
_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@dataclass(frozen=True)
class Limits:
    """When a text fails: A under ``least_words``; B fewer distinct words than ``distinct_percent``; C more capitals than
    ``capitals_percent`` of the code points; D any of ``marks``.
    """

    least_words: int = 200
    distinct_percent: int = 50
    capitals_percent: int = 2
    marks: str = "#$%&*|"


def failed(text: str, limits: Limits = Limits()) -> int:
    """The filters A to D that a text fails, as bits from A on."""
    data = text.encode("utf-8", "surrogatepass")
    words = WORD.findall(data)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    checks = (
        len(words) < limits.least_words,
        100 * len(set(words)) < limits.distinct_percent * len(words),
        100 * capitals > limits.capitals_percent * len(text),
        any(mark in text for mark in limits.marks),
    )
    return sum(1 << i for i, hit in enumerate(checks) if hit)


def _marks(limits: Limits):
    def run(batch: pa.RecordBatch) -> dict:
        texts = strings(batch)
        keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        return {
            "doc_id": batch.column("doc_id"),
            "part": batch.column("part"),
            "key": pa.array(keys, pa.binary()),
            "mask": pa.array([failed(t, limits) for t in texts], pa.int32()),
        }

    return run


_MARK = "doc_id long, part string, key binary, mask int"
_CANDIDATE = "bucket long, key binary, doc_id long, part string, mask int, n long"
_CHANGE = "doc_id long, part string, mask int, n long"
_HOLDERS = "keys array<binary>, doc_ids array<long>, masks array<int>, parts array<string>, counts array<long>"


def _least_of_each_text(buckets: int):
    """Of each text in a partition only the rows with its smallest id go on, counted by part; so a text that a
    third of all rows have sends one row a partition.
    """

    def candidates(held: dict) -> pa.RecordBatch:
        flat = [(key, doc_id, part, mask, n) for key, (doc_id, mask, parts) in held.items() for part, n in parts.items()]
        keys, doc_ids, parts, masks, counts = zip(*flat)
        return as_batch(
            {
                "bucket": pa.array([int.from_bytes(key[:8]) % buckets for key in keys], pa.int64()),
                "key": pa.array(keys, pa.binary()),
                "doc_id": pa.array(doc_ids, pa.int64()),
                "part": pa.array(parts, pa.string()),
                "mask": pa.array(masks, pa.int32()),
                "n": pa.array(counts, pa.int64()),
            }
        )

    def run(batches: Batches) -> Batches:
        held: dict = {}
        for batch in batches:
            for key, doc_id, part, mask in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "part", "mask"))):
                best = held.get(key)
                if best is None or doc_id < best[0]:
                    held[key] = (doc_id, mask, {part: 1})
                elif doc_id == best[0]:
                    best[2][part] = best[2].get(part, 0) + 1
            if len(held) >= HELD_TEXTS:
                yield candidates(held)
                held = {}
        if held:
            yield candidates(held)

    return run


def _retracting(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state of a few texts: of each the smallest id so far and who has it. Rows with that id are added to the part
    counters as not repeated; when a smaller id arrives the earlier rows are taken back.
    """
    known: dict = {}
    if state.exists:
        for text, doc_id, mask, part, n in zip(*state.get):
            known.setdefault(text, (doc_id, mask, {}))[2][part] = n
    changes = []
    for frame in frames:
        for text, doc_id, part, mask, n in zip(*(frame[c].tolist() for c in ("key", "doc_id", "part", "mask", "n"))):
            best = known.get(text)
            if best is None or doc_id < best[0]:
                if best is not None:
                    changes += [(best[0], p, mask, -c) for p, c in best[2].items()]
                known[text] = best = (doc_id, mask, {})
            if doc_id == best[0]:
                best[2][part] = best[2].get(part, 0) + n
                changes.append((doc_id, part, mask, n))
    flat = [(text, doc_id, mask, part, n) for text, (doc_id, mask, parts) in known.items() for part, n in parts.items()]
    if changes:
        state.update(tuple(list(column) for column in zip(*flat)))
    yield pd.DataFrame(changes, columns=["doc_id", "part", "mask", "n"])


@contextmanager
def _stream_settings(spark: SparkSession, settings: dict[str, str]):
    """A stream takes the settings over when it starts, and keeps them when it goes on later."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _new_rows(spark: SparkSession, path: str, schema, batch_bytes: int) -> DataFrame:
    # Files differ in age; none is to be passed over as too old.
    reader = spark.readStream.schema(schema).option("maxFileAge", "36500d").option("maxBytesPerTrigger", batch_bytes)
    # A pattern may name one file as well as a folder; a stream takes a plain path for a folder.
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def _run(spark: SparkSession, rows: DataFrame, folder: str, name: str, settings: dict[str, str]) -> None:
    """All files that are there, in micro-batches; what is already in the folder's log is not read again."""
    writer = rows.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    with _stream_settings(spark, settings):
        query = writer.option("checkpointLocation", f"{folder}/{name}-log").start(f"{folder}/{name}")
    query.awaitTermination()


def _buckets(spark: SparkSession, folder: str) -> tuple[int, int]:
    """(number of states, texts expected), decided once for a folder: later files find their texts in the same states."""
    path, texts = f"{folder}/buckets", spark.read.schema(_MARK).parquet(f"{folder}/marks").count()
    try:
        return tuple(spark.read.parquet(path).first())
    except AnalysisException:
        decided = max(1, texts // STATE_TEXTS), texts
        spark.createDataFrame([decided], "buckets long, texts long").coalesce(1).write.parquet(path)
        return decided


def update_audit(spark: SparkSession, documents: str, folder: str, limits: Limits = Limits(), batch_bytes: int | None = None) -> None:
    """Bring the audit in ``folder`` up to date with the Parquet files at ``documents`` (doc_id, text, source).

    A first stream turns texts into marks: the text's digest and the filters A to D that it fails. A second one sends the
    marks to keyed states, a few texts each, which know the smallest id of a text, and writes changes: rows of that id
    count as not repeated until a smaller id takes the text over. Call it again when files were added; a run that
    broke off goes on where it was. Null texts are empty texts; a null source is the empty part. Rows without id don't
    repeat any text and are not repeated. Rows with the same id and text are none's repetition. Other columns are not read.
    """
    cores = spark.sparkContext.defaultParallelism
    batch_bytes = batch_bytes or BATCH_BYTES * cores
    schema = spark.read.parquet(documents).select("doc_id", "text", "source").schema
    rows = _new_rows(spark, documents, schema, batch_bytes)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), "text")
    _run(spark, map_rows(rows, _marks(limits), _MARK), folder, "marks", {})
    buckets, texts = _buckets(spark, folder)
    marks = _new_rows(spark, f"{folder}/marks", _schema(spark, _MARK), batch_bytes).where("doc_id IS NOT NULL")
    least = marks.mapInArrow(_least_of_each_text(buckets), _CANDIDATE)
    changes = least.groupBy("bucket").applyInPandasWithState(_retracting, _CHANGE, _HOLDERS, "append", GroupStateTimeout.NoTimeout)
    _run(spark, changes, folder, "changes", _ON_DISK if texts > MEMORY_TEXTS * cores else {})


def _schema(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def part_counters(spark: SparkSession, folder: str, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the filters that they fail, of them with a label quality = 1, toxic = 1.

    Each row counts as repeated at first; the changes move rows to the mask without that bit, and back. Of several
    labels of an id one that says 1 is enough. Rows are put together before they meet the labels.
    """
    marks = spark.read.schema(_MARK).parquet(f"{folder}/marks")
    changes = spark.read.schema(_CHANGE).parquet(f"{folder}/changes")
    repeated = F.col("mask").bitwiseOR(F.lit(REPEATED))
    first = F.when(F.col("doc_id").isNull(), F.col("mask")).otherwise(repeated)
    moves = (
        marks.select("doc_id", "part", first.alias("mask"), F.lit(1).cast("long").alias("n"))
        .unionByName(changes)
        .unionByName(changes.select("doc_id", "part", repeated.alias("mask"), (-F.col("n")).alias("n")))
    )
    rows = moves.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).where("n <> 0")
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    flags = labels.select("doc_id", "quality", "toxic").groupBy("doc_id").agg(flag("quality").alias("is_good"), flag("toxic").alias("is_toxic"))
    joined = rows.join(flags.where("is_good + is_toxic > 0"), "doc_id", "left")
    return joined.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("is_good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("is_toxic", F.lit(0))).alias("toxic"),
    )


def filter_orders(counters: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counters by mask.

    ``passed`` maps each set of filters to the rows that fail none of it; every figure but the Shapley sum is a
    difference of two of its entries. In all orders together a filter removes a row that fails k filters in 1 / k of them.
    """
    whole, orders = (1 << len(FILTERS)) - 1, ["".join(p) for p in permutations(FILTERS)]
    free = counters.withColumn("filters", F.explode(F.expr(f"filter(sequence(0, {whole}), s -> (s & mask) = 0)")))
    sums = free.groupBy("part", "filters").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    passed = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("filters", F.struct("n", "good", "toxic")))).alias("passed"))
    share = [f"sum(if((mask & {1 << i}) > 0, n * ({len(orders)} div bit_count(mask)), 0))" for i in range(len(FILTERS))]
    shares = counters.groupBy("part").agg(F.expr(f"array({', '.join(share)})").alias("shares"))
    steps = passed.join(shares, "part").withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ",")))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = "shiftleft(1, ascii(substr(filter_order, i, 1)) - ascii('A'))"
    steps = steps.withColumns(
        {
            "before": F.expr(f"aggregate(sequence(0, step - 1), 0, (s, i) -> if(i = 0, 0, s | {bit}))"),
            "own": F.expr(f"transform(array(step), i -> {bit})[0]"),
        }
    )
    count = lambda filters, c: f"coalesce(try_element_at(passed, {filters}).{c}, 0L)"
    lost = lambda c: f"{count('before', c)} - {count('before | own', c)}"
    return steps.selectExpr(
        "part",
        "filter_order",
        "step",
        f"{count('before | own', 'n')} AS kept",
        f"{lost('n')} AS removed",
        f"({count('0', 'n')} - {count('own', 'n')}) - ({lost('n')}) AS redundant",
        f"{count(f'{whole} - own', 'n')} - {count(str(whole), 'n')} AS unique_fails",
        f"{lost('good')} AS good_lost",
        f"{lost('toxic')} AS toxic_lost",
        "shares[ascii(substr(filter_order, step, 1)) - ascii('A')] AS shapley",
    )


def audit_filters(spark: SparkSession, documents: str, labels: DataFrame, folder: str, limits: Limits = Limits()) -> DataFrame:
    """The report on all files at ``documents``; a table without rows has no parts and no report."""
    update_audit(spark, documents, folder, limits)
    return filter_orders(part_counters(spark, folder, labels))
