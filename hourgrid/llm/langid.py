"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import Batches, as_batch, mix, strings
from hourgrid.sources.scratch import store

WIDTH = 4
# A filter has 2^SLOT_BITS slots, or as many more as keep three quarters of them free of a language's n-grams.
SLOT_BITS = 20
MOST_FILLED = 0.25
HASHES = 3
_CHUNK = 1 << 16
# An n-gram belongs to a language if its rate there is at least this part of its highest rate.
RATE_PART = 0.25
UNDETERMINED = "und"

_EDGE, _SPACE = 1, 32


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, the text each belongs to, and which texts have a letter.

    Texts are lower-cased; runs of other characters than letters become one space, and each text is closed
    by edge marks, so that a single letter has n-grams too.
    """
    lowered = [f"\x01 {t.lower()} \x01" for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    is_letter = _letters()[codes]
    edge = np.zeros(len(codes), bool)
    ends = np.cumsum(sizes)
    edge[ends - 1] = edge[ends - sizes] = True
    codes = np.where(is_letter, codes, np.where(edge, _EDGE, _SPACE)).astype(np.uint64)
    has_letter = np.zeros(len(texts), bool)
    has_letter[owner[is_letter]] = True
    kept = np.ones(len(codes), bool)
    kept[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
    codes, owner = codes[kept], owner[kept]
    n = len(codes) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has_letter
    with np.errstate(over="ignore"):
        hashed = np.zeros(n, np.uint64)
        for i in range(WIDTH):
            hashed = hashed * np.uint64(0x100000001B3) + codes[i : i + n]
    inside = (owner[:n] == owner[WIDTH - 1 :]) & has_letter[owner[:n]]
    return mix(hashed[inside]), owner[:n][inside], has_letter


def _count(batches: Batches) -> Batches:
    """(lang, gram, n) of a partition, pre-aggregated."""
    held: dict[str, list] = {}
    size = 0

    def flush() -> Batches:
        for lang, parts in held.items():
            grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            n = np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)
            yield as_batch({"lang": [lang] * len(grams), "gram": grams.view(np.int64), "n": n})
        held.clear()

    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), strings(batch)
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(langs, texts):
            by_lang.setdefault(lang, []).append(text)
        for lang, own in by_lang.items():
            for part in _portions(own):
                grams, n = np.unique(ngrams(part)[0], return_counts=True)
                held.setdefault(lang, []).append((grams, n))
                size += len(grams)
        if size > 2_000_000:
            yield from flush()
            size = 0
    yield from flush()


def _portions(texts: list[str], chars: int = 1_000_000):
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


@dataclass
class Part:
    """``masks[slot]`` has a bit for each of the languages at ``places``, of 2^bits slots; the n-gram's slots are and-ed."""

    places: list[int]
    bits: int
    masks: np.ndarray
    false_rate: np.ndarray


@dataclass
class Filters:
    """Languages whose filters have the same size share parts, as many as a mask has bits for."""

    languages: list[str]
    parts: list[Part]
    fallback: str | None

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the languages' n-gram counts less the expected false hits."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        grams, owner, has_letter = ngrams(texts)
        total = np.bincount(owner, minlength=len(texts)).astype(np.float64)
        hits = np.empty((len(texts), len(self.languages)))
        for part in self.parts:
            found = part.masks[slots_of(grams, 0, part.bits)]
            for i in range(1, HASHES):
                found &= part.masks[slots_of(grams, i, part.bits)]
            for i, (place, rate) in enumerate(zip(part.places, part.false_rate)):
                own = (found >> found.dtype.type(i)) & found.dtype.type(1)
                hits[:, place] = np.bincount(owner, own.astype(np.float64), len(texts))
                hits[:, place] = np.maximum(hits[:, place] - rate * total, 0) / max(1e-9, 1 - rate)
        best, sums = hits.argmax(1), hits.sum(1)
        score = np.divide(hits[np.arange(len(texts)), best], sums, out=np.zeros(len(texts)), where=sums > 0)
        names = [
            UNDETERMINED if not letter else self.languages[b] if s > 0 else self.fallback
            for letter, b, s in zip(has_letter, best, sums)
        ]
        return names, np.where(has_letter, score, 0.0)


def _step(bits: int) -> int:
    """From one slot's part of the 64-bit hash to the next one's; the parts of large filters overlap."""
    return min(bits, (64 - bits) // (HASHES - 1))


def slots_of(grams: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th slot: another part of the 64-bit hash."""
    return (grams >> np.uint64(i * _step(bits))) & np.uint64((1 << bits) - 1)


def _bits_for(grams: int) -> int:
    return max(SLOT_BITS, int(np.ceil(np.log2(max(1, grams) * HASHES / MOST_FILLED))))


def _mask_type(languages: int) -> type:
    return next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= languages)


def _packed(kinds: list[type]):
    def run(batches: Batches) -> Batches:
        """The masks of each run of _CHUNK slots as bytes."""
        for batch in batches:
            numbers, packed = batch.column("part").to_pylist(), []
            for number, entries in zip(numbers, batch.column("entries")):
                masks = np.zeros(_CHUNK, np.uint64)
                slots, found = (np.asarray(entries.values.field(c), np.int64) for c in ("slot", "mask"))
                masks[slots % _CHUNK] = found.view(np.uint64)
                packed.append(masks.astype(kinds[number]).tobytes())
            yield as_batch({"part": batch.column("part"), "chunk": batch.column("chunk"), "masks": pa.array(packed, pa.binary())})

    return run


def learn(training: DataFrame) -> Filters:
    """Filters from (text, lang) rows; rows with a null text or language teach nothing.

    Counts cover all rows, and every language is learned. The driver gets one row a language, and the filters: 2^SLOT_BITS
    slots, or for a language of more n-grams HASHES / MOST_FILLED slots an n-gram, up to the next power of two.
    """
    rows = training.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInArrow(_count, "lang string, gram long, n long")
    grams = store(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("grams")).orderBy(F.desc("total"), "lang")
    found = totals.collect()
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return Filters([], [], None)
    place = {lang: i for i, lang in enumerate(languages)}
    sized: dict[int, list[int]] = {}
    for r in sorted(found, key=lambda r: r["lang"]):
        sized.setdefault(_bits_for(r["grams"]), []).append(place[r["lang"]])
    parts = [(bits, own[i : i + 64]) for bits, own in sorted(sized.items()) for i in range(0, len(own), 64)]
    at = {p: (number, bits, i) for number, (bits, own) in enumerate(parts) for i, p in enumerate(own)}
    named = [(r["lang"], float(r["total"]), *at[place[r["lang"]]], _step(at[place[r["lang"]]][1])) for r in found]
    # One row a language.
    known = F.broadcast(grams.sparkSession.createDataFrame(named, "lang string, size double, part int, bits int, bit int, step int"))
    entry = F.struct((F.col("n") / F.col("size")).alias("rate"), "part", "bits", "bit", "step")
    # A gram has a row a language at most, so its group is bounded.
    rated = grams.join(known, "lang").withColumn("entry", entry).groupBy("gram").agg(F.max("entry.rate").alias("top"), F.collect_list("entry").alias("rates"))
    owners = F.filter("rates", lambda r: r["rate"] >= F.col("top") * RATE_PART)
    owned = rated.select("gram", F.explode(owners).alias("owner")).select("gram", "owner.*")
    one = F.lit(1).cast("long")
    low = F.call_function("shiftleft", one, F.col("bits")) - 1
    slot = F.explode(F.array(*[F.call_function("shiftrightunsigned", F.col("gram"), F.col("step") * i).bitwiseAND(low) for i in range(HASHES)]))
    mask = F.bit_or(F.call_function("shiftleft", one, F.col("bit"))).alias("mask")
    sliced = owned.select("part", "bit", slot.alias("slot")).groupBy("part", "slot").agg(mask)
    # A chunk has an entry a slot at most.
    chunks = sliced.groupBy("part", F.shiftright("slot", 16).alias("chunk")).agg(F.collect_list(F.struct("slot", "mask")).alias("entries"))
    kinds = [_mask_type(len(own)) for _, own in parts]
    tables = [np.zeros(1 << max(bits, 16), kind) for (bits, _), kind in zip(parts, kinds)]
    for row in chunks.mapInArrow(_packed(kinds), "part int, chunk long, masks binary").toLocalIterator():
        tables[row["part"]][row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = np.frombuffer(row["masks"], kinds[row["part"]])
    built = []
    for (bits, own), table in zip(parts, tables):
        filled = [float(((table[: 1 << bits] >> table.dtype.type(i)) & table.dtype.type(1)).mean()) for i in range(len(own))]
        built.append(Part(own, bits, table, np.array(filled) ** HASHES))
    return Filters(languages, built, found[0]["lang"])


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text.

    A null text and one without a letter are ``und`` with score 0; a text none of whose n-grams is known gets
    the language with most n-grams, with score 0; equal counts: the first language by name. Without learned
    languages all is ``und``. Rows are independent: null and repeated ids and copies stay as they are; extra
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Batches) -> Batches:
        model = shared.value
        for batch in batches:
            texts, names, scores = strings(batch), [], []
            for part in _portions(texts):
                own, score = model.decide(part)
                names += own
                scores.append(score)
            if texts:
                yield as_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": np.concatenate(scores)})

    return docs.selectExpr("CAST(doc_id AS bigint) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
