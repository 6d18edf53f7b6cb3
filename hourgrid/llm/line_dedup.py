"""Near-duplicate lines by deletion neighbourhoods of words; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.sources.scratch import store

# Lines of fewer words are duplicates only if equal; longer ones also at an edit distance of one word.
FUZZY_WORDS = 8
_SPACE = r"[\x20\x09-\x0D]"
_NO_SPACE = r"[^\x20\x09-\x0D]"
_PLACE = ["no_id", "doc_id", "text_key", "line_no"]


def words_of(line: Column) -> Column:
    """The lower-cased words of a line; none for a blank one."""
    return F.array_remove(F.split(F.lower(line), _SPACE), "")


def _lines(docs: DataFrame) -> DataFrame:
    """Every line that isn't blank with its place, a 128-bit hash of its words (h, g) and their number."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "raw"),
    )
    # Asked of the line itself: a condition on its words would split every line once more.
    full = rows.where(F.col("raw").rlike(_NO_SPACE))
    words = full.select(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "line_no", words_of(F.col("raw")).alias("words"))
    return words.withColumns({"h": F.xxhash64("words"), "g": F.xxhash64(F.lit("second"), "words"), "n": F.size("words")})


def _halves() -> dict[str, Column]:
    """Keys of a line's first and last k words, for the k of two lines that an edit tells apart; NULL for short lines.

    Lines of n words, or of n and n + 1, have k = n / 2, rounded down, in common. Neither line's first k words
    overlap its last k, so one edit leaves the first or the last k words of both equal. The keys are plain
    columns: as an array of rows they would be several times as wide in files and shuffles.
    """
    k, shorter = _half_sizes()
    long = F.col("n") >= FUZZY_WORDS
    first = lambda k: F.xxhash64(F.lit("first"), F.slice("words", F.lit(1), k))
    last = lambda k: F.xxhash64(F.lit("last"), F.slice("words", F.col("n") - k + 1, k))
    two = long & (k != shorter)
    return {"first_half": F.when(long, first(k)), "last_half": F.when(long, last(k)), "first_shorter": F.when(two, first(shorter)), "last_shorter": F.when(two, last(shorter))}


_HALVES = ["first_half", "last_half", "first_shorter", "last_shorter"]


def _half_sizes() -> tuple[Column, Column]:
    return F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")


def _suspects(firsts: DataFrame) -> DataFrame:
    """Distinct lines that share a half with another one; first_k and last_k say behind and before which words an edit may lie."""
    sizes, none = [size for size in _half_sizes() for _ in range(2)], F.lit(None).cast("int")
    keys = [
        F.struct(F.col(c).alias("half"), (k if c.startswith("first") else none).alias("first_k"), (none if c.startswith("first") else k).alias("last_k"))
        for c, k in zip(_HALVES, sizes)
    ]
    halves = firsts.select(*_PLACE, "h", "g", F.inline(F.array(*keys))).where("half IS NOT NULL")
    shared = halves.groupBy("half").agg(F.count("*").alias("owners")).where("owners > 1").select("half")
    found = halves.join(shared, "half", "left_semi")
    return found.groupBy(*_PLACE, "h", "g").agg(F.min("first_k").alias("first_k"), F.min("last_k").alias("last_k"))


def _with_words(suspects: DataFrame, docs: DataFrame) -> DataFrame:
    """The suspects' words, read again from the documents of their first occurrence."""
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("k"), "text")
    wanted = suspects.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("line_no", "h", "g", "first_k", "last_k")).alias("lines"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key"))
    # Repeated rows have the same lines.
    joined = texts.join(wanted, same).select("doc_id", "text_key", F.split("text", "\n").alias("raw"), F.explode("lines").alias("l"))
    words = joined.select("doc_id", "text_key", "l.*", words_of(F.element_at("raw", F.col("l.line_no") + 1)).alias("words"))
    return words.dropDuplicates(["h", "g"]).withColumn("no_id", F.col("doc_id").isNull())


def _variants(lines: DataFrame) -> DataFrame:
    """(key, place, h, g): the variants of each line with one word left out, and the line with a gap at each place.

    A key covers the words before the place, those after it, and their number. Hashes tagged by the distance
    from the start and from the end are combined by exclusive or along the line. Lines with a common key
    differ by one word replaced there, or one of them has a word more there.
    """
    line = Window.partitionBy("h", "g")
    before = line.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # A closing place after the last word has a gap, but no word.
    placed = lines.select(
        *_PLACE, "h", "g", "first_k", "last_k", F.size("words").alias("n"), F.posexplode(F.concat("words", F.array(F.lit("")))).alias("at", "word")
    )
    tagged = placed.select(
        "*",
        F.xxhash64("word", "at").alias("forth"),
        F.when(F.col("at") < F.col("n"), F.xxhash64("word", F.col("n") - F.col("at"))).otherwise(0).alias("back"),
    )
    summed = tagged.select(
        "*",
        F.coalesce(F.bit_xor("forth").over(before), F.lit(0)).alias("left"),
        F.coalesce(F.bit_xor("back").over(before), F.lit(0)).alias("earlier"),
        F.bit_xor("back").over(line).alias("whole"),
    )
    # What comes after is the whole without what comes before and the word itself.
    summed = summed.withColumn("right", F.col("whole").bitwiseXOR(F.col("earlier")).bitwiseXOR(F.col("back")))
    likely = (F.col("at") >= F.col("first_k")) | (F.col("at") <= F.col("n") - F.col("last_k"))
    key = lambda right, n: F.xxhash64("left", right, n, "at")
    gap = key(F.col("right").bitwiseXOR(F.col("back")), F.col("n"))
    without = F.when(F.col("at") < F.col("n"), key(F.col("right"), F.col("n") - 1))
    keys = F.filter(F.array(gap, without), lambda k: k.isNotNull())
    return summed.where(likely).select(F.explode(keys).alias("key"), *_PLACE, "h", "g")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at an edit distance of one or less."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    n, m = F.size(short), F.size(long)
    pairs = F.zip_with(short, F.slice(long, F.lit(1), n), lambda x, y: x != y)
    at = F.coalesce(F.nullif(F.array_position(pairs, True), F.lit(0)), n + 1).cast("int")
    tail = lambda c, from_: F.slice(c, from_, F.greatest(F.size(c) - from_ + 1, F.lit(0)))
    inserted = (m - n == 1) & (tail(long, at + 1) == tail(short, at))
    changed = (m == n) & (tail(long, at + 1) == tail(short, at + 1))
    return (a == b) | inserted | changed


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, first_doc_id, first_text_key, first_line_no, edits): lines that an earlier line makes superfluous.

    A line is dropped if an earlier one (by doc_id, then line number; null ids last, equal ids by a hash of the
    text) has the same lower-cased words, or, where both have FUZZY_WORDS words at least, differs by one word
    put in, left out or replaced. The earlier line need not be kept itself.
    Lines without words are never dropped. Repeated rows count as one document and lose the same lines. Extra
    columns are not read; an empty table and null texts give no rows.

    Equal lines meet by hash. Distinct lines that share their first or last half with another one list the
    variants of a one-word edit under hashed keys; each key keeps its earliest line by a grouped minimum, so
    no pairs are made and a frequent key costs one row a task. The earliest line found is checked word by word.
    """
    halves = [c.alias(name) for name, c in _halves().items()]
    places = store(_lines(docs).select(*_PLACE, "h", "g", "n", *halves), "line-places")
    place = F.struct(*_PLACE)
    # Equal lines have equal halves.
    earliest = places.groupBy("h", "g").agg(F.min(place).alias("first"), *[F.first(c).alias(c) for c in ("n", *_HALVES)])
    firsts = store(earliest.select("h", "g", "first.*", "n", *_HALVES), "line-firsts")
    suspects = store(_suspects(firsts.where("first_half IS NOT NULL")), "line-suspects")
    lines = store(_with_words(suspects, docs), "line-words")
    variants = store(_variants(lines), "line-variants")
    least = variants.groupBy("key").agg(F.min(place).alias("best"), F.count("*").alias("size")).where("size > 1")
    near = (
        variants.join(least, "key")
        .where(place != F.col("best"))
        .groupBy(*_PLACE)
        .agg(F.min("best").alias("best"))
        .select(*_PLACE, "best")
    )
    checked = store(_checked(near, lines), "line-near")
    again = places.join(firsts.select("h", "g", F.struct(*_PLACE).alias("first")), ["h", "g"]).where(place != F.col("first"))
    equal = again.select("doc_id", "text_key", "line_no", "first", F.lit(0).alias("edits")).distinct()
    found = equal.unionByName(checked)
    return found.select(
        "doc_id",
        "text_key",
        "line_no",
        F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.text_key").alias("first_text_key"),
        F.col("first.line_no").alias("first_line_no"),
        "edits",
    )


def _checked(near: DataFrame, lines: DataFrame) -> DataFrame:
    own = near.withColumn("at", F.struct(*_PLACE)).select("at", "best")
    words = lines.select(F.struct(*_PLACE).alias("at"), "words")
    other = lines.select(F.struct(*_PLACE).alias("best"), F.col("words").alias("earlier"))
    # Structs compare null-safe.
    both = own.join(words, "at").join(other, "best")
    real = both.where(within_one_edit(F.col("words"), F.col("earlier")))
    return real.select("at.doc_id", "at.text_key", "at.line_no", F.col("best").alias("first"), F.lit(1).alias("edits"))


def drop_duplicate_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the superfluous lines, with all their columns.

    A document that loses every line with words is dropped; one that loses none keeps its text as it is, null
    and blank ones included. Where there is a column n_chars, it follows a changed text.
    """
    dropped = store(
        duplicate_lines(docs).groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("lost")).select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), F.col("lost").alias("__lost")),
        "line-dropped",
    )
    same = docs["doc_id"].cast("long").eqNullSafe(dropped["__d"]) & (F.xxhash64(docs["text"]) == dropped["__k"])
    joined = docs.join(dropped, same, "left")
    raw = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), F.col("__lost"))
    kept = F.transform(stay, lambda i: F.element_at(raw, i + 1))
    some = joined.withColumn("__kept", F.when(F.col("__lost").isNotNull(), kept))
    full = some.where(F.col("__kept").isNull() | F.exists("__kept", lambda x: F.size(words_of(x)) > 0))
    text = F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n"))
    out = full.withColumn("text", text)
    if "n_chars" in docs.columns:
        same_type = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(same_type)))
    return out.select(*docs.columns)
