"""Near-duplicate documents by bottom-k sketches of one hash function."""

from __future__ import annotations

import hashlib
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import Batches, WordHashes, as_batch, bitmap_of, map_rows, may_be_in, shingles, sliced, strings
from hourgrid.llm.components import components
from hourgrid.sources.scratch import store

WIDTH = 5
SKETCH = 32
# A pair at the threshold shares fewer of the union's SKETCH lowest values than is asked for with a chance of MISSED at most.
MISSED = 1.1e-8
# Lists up to this length are paired off; longer ones are compared with what their members share, at most so many times over.
SHORT_LIST = 64
ROUNDS = 6
LINKS_FROM = Fraction(85, 100)

_WORDS = WordHashes()


def shared_at(level: Fraction) -> int:
    """The most values that a pair at the threshold ``level`` shares but for a chance of MISSED: 14 at 0.85, fewer below."""
    chance, shared = 0.0, 0
    while (chance := chance + comb(SKETCH, shared) * float(level) ** shared * float(1 - level) ** (SKETCH - shared)) <= MISSED:
        shared += 1
    return shared


def shingle_set(text: str) -> np.ndarray:
    """The document's distinct shingles as sorted 64-bit hashes."""
    return np.unique(shingles(_WORDS.of(text), WIDTH))


def _sketch(batch: pa.RecordBatch) -> dict:
    nodes, sizes, sketches = [], [], []
    for text in strings(batch):
        values = shingle_set(text)
        nodes.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
        sizes.append(len(values))
        sketches.append(values[:SKETCH].view(np.int64))
    return {
        "doc_id": batch.column("doc_id"),
        "text_key": batch.column("text_key"),
        "node": pa.array(nodes, pa.binary()),
        "n": pa.array(sizes, pa.int64()),
        "sketch": pa.array(sketches, pa.list_(pa.int64())),
    }


def _sets(shared):
    def run(batches: Batches) -> Batches:
        """The sets of the texts that may be wanted."""
        for batch in sliced(batches):
            keys = np.asarray(batch.column("text_key")).view(np.uint64)
            kept = batch.filter(pa.array(may_be_in(shared.value, keys)))
            if kept.num_rows:
                found = [shingle_set(t).view(np.int64) for t in strings(kept)]
                columns = {c: kept.column(c) for c in ("doc_id", "text_key")}
                yield as_batch({**columns, "values": pa.array(found, pa.list_(pa.int64()))})

    return run


def _unsigned(value: Column) -> Column:
    """Order of the unsigned hash."""
    return value.bitwiseXOR(F.lit(-(2**63)))


def _exact_room(n: Column, level: Fraction) -> Column:
    """How many of a set's values two linked sets of this size can differ in: n - ceil(n * threshold)."""
    return n - F.ceil(n * level.numerator / F.lit(level.denominator) - 1e-9)


def _cut_off(n: Column, level: Fraction) -> Column:
    """How many values the sketch of the largest set linked to one of this size lacks; such a set holds all of the smaller."""
    return F.floor(n * level.denominator / F.lit(level.numerator) + 1e-9) - SKETCH


def inverted_lists(classes: DataFrame, level: Fraction = LINKS_FROM) -> DataFrame:
    """(key, node, n, rare): under which retained values a class is listed.

    The values of a sketch are taken from the rarest on, so many that two linked classes, which share ``shared_at``
    retained values (or, when the sketch is the whole set, what the threshold demands, less what the sketch of
    a larger partner lacks), have a listed one in common. Frequent passages are thus listed only by documents that hold little else. ``rare`` counts
    the values that no other sketch has.
    """
    values = classes.select("node", "n", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("owners")).where("owners > 1")
    taken = F.when(F.col("n") <= SKETCH, F.greatest(_exact_room(F.col("n"), level), _cut_off(F.col("n"), level)) + 1).otherwise(SKETCH - shared_at(level) + 1)
    grouped = values.join(shared, "value").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("owners", "value"))).alias("found"))
    grouped = grouped.withColumn("rare", F.least("n", F.lit(SKETCH)) - F.size("found"))
    keep = F.greatest(taken - F.col("rare"), F.lit(0)).cast("int")
    listed = grouped.withColumn("entry", F.explode(F.slice("found", F.lit(1), keep)))
    return listed.select(F.col("entry.value").alias("key"), "node", "n", "rare")


def _similar_size(a: Column, b: Column, level: Fraction) -> Column:
    return F.least(a, b) * level.denominator >= F.greatest(a, b) * level.numerator


def _estimated(pairs: DataFrame, classes: DataFrame, level: Fraction) -> DataFrame:
    """Pairs whose union sketch shares enough values; the sketch of a union is the lowest values of both sketches."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    key = lambda c: F.transform(c, _unsigned)
    union = F.slice(F.array_sort(F.array_union(key("sa"), key("sb"))), 1, SKETCH)
    common = F.size(F.array_intersect(union, F.array_intersect(key("sa"), key("sb"))))
    return both.where((F.greatest("na", "nb") <= SKETCH) | (common >= shared_at(level))).select("a", "b")


def _full_sets(nodes: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, values): the whole sets of the given classes, from one text of each. Texts are read again and stay where they are; a
    filter of fixed size passes over most of those that aren't wanted.
    """
    rows = store(classes.join(nodes, "node", "left_semi").select("node", "doc_id", "text_key"), "near-wanted")
    shared = texts.sparkSession.sparkContext.broadcast(bitmap_of(rows, "text_key"))
    found = texts.mapInArrow(_sets(shared), "doc_id long, text_key long, values array<long>")
    same = found["doc_id"].eqNullSafe(rows["doc_id"]) & (found["text_key"] == rows["text_key"])
    # Repeated rows have the same set.
    return store(found.join(rows, same).groupBy("node").agg(F.first("values").alias("values")), "near-sets")


def _with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    side = lambda x: sets.select(F.col("node").alias(x), F.col("values").alias(f"v_{x}"))
    return pairs.join(side(a), a).join(side(b), b)


def _linked(size_a: Column, size_b: Column, common: Column, level: Fraction) -> Column:
    return common * level.denominator >= (size_a + size_b - common) * level.numerator


def _paired(lists: DataFrame, level: Fraction) -> DataFrame:
    """Pairs within lists of (key, node, n, settled), but for those that are settled both."""
    x, y = lists.alias("x"), lists.alias("y")
    open_ = ~(F.col("x.settled") & F.col("y.settled")) & (F.col("x.node") < F.col("y.node"))
    joined = x.join(y, (F.col("x.key") == F.col("y.key")) & open_ & _similar_size(F.col("x.n"), F.col("y.n"), level))
    return joined.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _by_length(lists: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows of lists that are paired off, and of long ones."""
    sizes = store(lists.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), label)
    short = lists.join(sizes.where(F.col("size") <= SHORT_LIST).select("key"), "key")
    return short, lists.join(sizes.where(F.col("size") > SHORT_LIST).select("key"), "key")


def _groups(long: DataFrame, sets: DataFrame) -> DataFrame:
    """(mark, node, n, rare, values): the members of long lists, once for all lists with the same leading class."""
    leading = long.groupBy("key").agg(F.min(F.struct("rare", "n", "node"))["node"].alias("leading"))
    members = long.join(leading, "key").select(F.xxhash64("leading").alias("mark"), "node", "n", "rare").distinct()
    return members.join(sets, "node")


def _cores(groups: DataFrame) -> DataFrame:
    """(mark, reference): the values that more than half of a group's members have."""
    sizes = groups.groupBy("mark").agg(F.count("*").alias("size"))
    values = groups.select("mark", F.explode("values").alias("value")).groupBy("mark", "value").agg(F.count("*").alias("owners"))
    # Of a set of values each owned by half of the members there are at most twice as many as an average member has.
    core = values.join(F.broadcast(sizes), "mark").where("2 * owners > size").groupBy("mark").agg(F.collect_list("value").alias("reference"))
    empty = F.array().cast("array<long>")
    return sizes.join(core, "mark", "left").select("mark", F.coalesce("reference", empty).alias("reference"))


def _compared(groups: DataFrame, references: DataFrame, level: Fraction) -> DataFrame:
    """Every member with its group's reference set: what it has gained and lost, and if it is settled, that is similar to it."""
    both = groups.join(references, "mark")
    common = F.size(F.array_intersect("values", "reference"))
    return both.select(
        "mark",
        "node",
        "n",
        "rare",
        _linked(F.size("values"), F.size("reference"), common, level).alias("settled"),
        F.size("reference").alias("reference_n"),
        F.array_except("values", "reference").alias("gained"),
        F.array_except("reference", "values").alias("lost"),
    )


def _pivots(compared: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members similar to their group's core, and of each group the closest one with its set: (mark, pivot, reference)."""
    distance = F.size("gained") + F.size("lost")
    near = compared.where("settled").select("mark", "node", distance.alias("distance"))
    closest = near.groupBy("mark").agg(F.min(F.struct("distance", "node"))["node"].alias("pivot"))
    members = groups.join(near.select("mark", "node"), ["mark", "node"])
    sets = members.select("mark", F.col("node").alias("pivot"), F.col("values").alias("reference"))
    return members, closest.join(sets, ["mark", "pivot"])


def _gained_lists(compared: DataFrame, level: Fraction) -> DataFrame:
    """Lists of values that members have and their reference hasn't, rarest first.

    With t the threshold and g, h values gained and lost against a reference of r values, a class that isn't similar to it shares at
    least (t g + h - (1 - t) r) / (1 + t) gained values with any linked class that has not lost more than it has
    gained, and with any that shares no lost value with it. So it is listed under its rarest gained
    values, up to one more than the others. For a similar class that number is not positive, and all count.
    """
    gained = F.size("gained")
    whole = _spread(compared.where("NOT settled")).select(*_MEMBER, (gained - _needed(level) + 1).alias("take"), gained.alias("all"), F.explode("gained").alias("value"))
    # Read several times.
    whole = store(whole, "near-open-values")
    settled = _open_to(compared.where("settled").select(*_MEMBER, "gained"), whole.select("mark", "value").distinct())
    return _rarest(whole.unionByName(settled)).select("key", "node", "n", "rare", "settled")


def _open_to(settled: DataFrame, values: DataFrame) -> DataFrame:
    """Of the similar classes the gained values that some class of their group that isn't similar has too: two similar ones are
    never paired. Groups that have none but similar classes are left out before arrays become rows.
    """
    values = store(values, "near-wanted-values")
    among = settled.join(values.select("mark").distinct(), "mark", "left_semi")
    # All of them count: as many as there are is no fewer than the member's rows.
    rows = among.select(*_MEMBER, F.size("gained").alias("take"), F.size("gained").alias("all"), F.explode("gained").alias("value"))
    return rows.join(values, ["mark", "value"], "left_semi")


_MEMBER = ["mark", "node", "n", "rare", "settled"]


def _spread(members: DataFrame) -> DataFrame:
    """Members dealt evenly before their arrays become rows; comparing them has left each group in one task."""
    return members.repartition("mark", "node")


def _needed(level: Fraction) -> Column:
    """How many values gained or lost a class that isn't similar to the reference shares with a linked one at least."""
    top, whole = level.numerator, level.denominator
    least = top * F.size("gained") + whole * F.size("lost") - (whole - top) * F.col("reference_n")
    return F.greatest(F.ceil(least / F.lit(top + whole) - 1e-9), F.lit(1))


def _rarest(rows: DataFrame) -> DataFrame:
    """Of each member's ``all`` values, the list keys of the ``take`` ones that the fewest members of its group have."""
    owners = rows.groupBy("mark", "value").agg(F.count("*").alias("owners")).where("owners > 1")
    member = [c for c in rows.columns if c != "value"]
    grouped = rows.join(owners, ["mark", "value"]).groupBy(*member).agg(F.sort_array(F.collect_list(F.struct("owners", "value"))).alias("found"))
    alone = F.col("all") - F.size("found")
    keep = F.greatest(F.col("take") - alone, F.lit(0)).cast("int")
    entry = grouped.withColumn("alone", alone).select(*member, "alone", F.posexplode(F.slice("found", F.lit(1), keep)).alias("at", "entry"))
    # How many of the member's values may be shared if this is the first that is: it and all more frequent ones.
    left = F.col("all") - F.col("alone") - F.col("at")
    return entry.withColumns({"key": F.xxhash64("mark", "entry.value"), "left": left})


def _lost_pairs(compared: DataFrame, level: Fraction) -> DataFrame:
    """Pairs of which one has lost more than it has gained and the other isn't similar to the reference.

    Together they share at least as many values gained or lost as the larger need of both, so they are listed under
    their rarest of either kind; a pair counts where what both still have behind the shared value is enough
    for it. A core keeps what most members have, so few have lost more, and in many groups none has.
    """
    top, whole = level.numerator, level.denominator
    lost = F.transform("lost", lambda v: F.xxhash64(v, F.lit("lost")))
    g, h = F.size("gained"), F.size("lost")
    rows = _spread(_may_lose(compared, level)).select(
        *_MEMBER,
        g.alias("g"),
        h.alias("h"),
        F.col("reference_n").alias("r"),
        (g + h - _needed(level) + 1).alias("take"),
        (g + h).alias("all"),
        F.explode(F.concat("gained", lost)).alias("value"),
    )
    # Read twice.
    listed = _rarest(store(rows, "near-lost-values"))
    x, y = listed.where("h > g").alias("x"), listed.where("NOT settled").alias("y")
    both = lambda c: F.col(f"x.{c}") + F.col(f"y.{c}")
    need = top * (F.col("x.r") + both("g")) - whole * (F.col("x.r") - both("h"))
    enough = (top + whole) * F.least("x.left", "y.left") >= need
    close = (F.col("x.node") != F.col("y.node")) & _similar_size(F.col("x.n"), F.col("y.n"), level)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & close & enough)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _may_lose(compared: DataFrame, level: Fraction) -> DataFrame:
    """Members that can be either side of a pair of ``_lost_pairs``, by the sizes of their group's members on the other side.

    What a class shares with one that has gained g values is at most what it kept of the reference and g of its own gain. So much
    has to be the threshold's part of its size.
    """
    top, whole = level.numerator, level.denominator
    g, h = F.size("gained"), F.size("lost")
    sides = compared.where("size(lost) > size(gained) OR NOT settled")
    losing, open_ = h > g, ~F.col("settled")
    bounds = sides.groupBy("mark").agg(
        F.min(F.when(losing, F.col("n"))).alias("least_losing"),
        F.max(F.when(losing, F.col("n"))).alias("most_losing"),
        F.max(F.when(losing, g)).alias("losing_gain"),
        F.min(F.when(open_, F.col("n"))).alias("least_open"),
        F.max(F.when(open_, F.col("n"))).alias("most_open"),
        F.max(F.when(open_, g)).alias("open_gain"),
    )

    def meets(least: str, most: str, gain: str) -> Column:
        near = (F.col(least) * top <= F.col("n") * whole) & (F.col("n") * top <= F.col(most) * whole)
        return near & (whole * (F.col("reference_n") - h + F.least(g, F.col(gain))) >= top * F.col("n"))

    either = (losing & meets("least_open", "most_open", "open_gain")) | (open_ & meets("least_losing", "most_losing", "losing_gain"))
    # A group without one side has null bounds.
    return sides.join(bounds, "mark").where(either).select(*compared.columns)


def find_links(texts: DataFrame, classes: DataFrame, level: Fraction = LINKS_FROM) -> DataFrame:
    """Links (a, b) that hold together what is linked: each pair of linked classes is in one component of the result.

    Classes of a short list are paired off. Those of a long list are compared with the list's core, the values that
    most of them have. A linked pair that isn't similar to the core on both sides must share a value that the
    core lacks, or both lack a value of the core, and is found by lists of such values. Classes similar to the core are
    compared with the one closest to it, the pivot: what is linked to the pivot is connected by it, and
    other pairs are found by such lists again. Lists that are still long are handled the same way. Pairs
    are then checked by the union's sketch and by the full sets.
    """
    lists = store(inverted_lists(classes, level).withColumn("settled", F.lit(False)), "near-lists")
    short, long = _by_length(lists, "near-sizes")
    pairs = store(_estimated(_paired(short, level), classes, level), "near-pairs")
    long = store(long, "near-long")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    sets = _full_sets(ends.unionByName(long.select("node")).distinct(), classes, texts)
    links, rounds = pairs.limit(0), 0
    while rounds < ROUNDS and not long.isEmpty():
        rounds += 1
        groups = store(_groups(long, sets), "near-groups")
        to_core = store(_compared(groups, _cores(groups), level), "near-core")
        members, pivots = _pivots(to_core, groups)
        pivots = store(pivots, "near-pivots")
        to_pivot = _compared(members, pivots.select("mark", "reference"), level).join(pivots.select("mark", "pivot"), "mark")
        to_pivot = store(to_pivot.withColumn("mark", F.xxhash64("mark", F.lit("pivot"))), "near-pivot")
        links = links.unionByName(to_pivot.where("settled AND node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        both = to_core.unionByName(to_pivot.drop("pivot"))
        short, long = _by_length(store(_gained_lists(both, level), "near-gained"), "near-sizes")
        more = _paired(short, level).unionByName(_lost_pairs(both, level)).distinct()
        pairs = pairs.unionByName(store(_estimated(more, classes, level), "near-pairs"))
        long = store(long, "near-long")
    if not long.isEmpty():
        # What so many rounds have not thinned is paired off in full.
        pairs = pairs.unionByName(store(_estimated(_paired(long, level), classes, level), "near-pairs"))
    checked = _with_sets(pairs.distinct(), sets, "a", "b")
    common = F.size(F.array_intersect("v_a", "v_b"))
    return checked.where(_linked(F.size("v_a"), F.size("v_b"), common, level)).select("a", "b").unionByName(links)


def near_duplicates(docs: DataFrame, level: Fraction = LINKS_FROM) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) of every row.

    Documents are linked when their sets of five-word shingles have a Jaccard similarity of ``level`` (0.85) or more;
    component_id is the smallest doc_id that links reach, kept says whether it is the row's own. Texts without
    words (or null) have no shingles, no links and their own id. Equal sets are one class, so copies are
    never paired. A null id takes part; its component_id is the smallest id of its component, null if there is none, and it is
    kept only then. Rows with the same id are separate texts of one document: all or none of those in a
    component are kept. Extra columns are not read; an empty table gives an empty one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    schema = "doc_id long, text_key long, node binary, n long, sketch array<long>"
    sketched = store(map_rows(texts, _sketch, schema), "near-sketches")
    classes = store(
        sketched.where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("_first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least_id"))
        .select("node", "n", "sketch", "least_id", "_first.doc_id", "_first.text_key"),
        "near-classes",
    )
    low = store(components(find_links(texts, classes, level)), "near-components")
    grouped = classes.select("node", "least_id").join(low, "node", "left").withColumn("low", F.coalesce("low", "node"))
    ids = grouped.groupBy("low").agg(F.min("least_id").alias("component_id"))
    named = grouped.join(ids, "low").select("node", "component_id")
    joined = sketched.drop("sketch").join(named, "node", "left")
    found = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        found.alias("component_id"),
        found.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def keep_representatives(docs: DataFrame, level: Fraction = LINKS_FROM) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    decided = store(near_duplicates(docs, level).where("NOT kept").select("doc_id", "text_key").distinct(), "near-dropped")
    same = docs["doc_id"].cast("long").eqNullSafe(decided["doc_id"]) & (F.xxhash64(docs["text"]) == decided["text_key"])
    return docs.join(decided, same, "left_anti")


