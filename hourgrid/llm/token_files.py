"""Token-id files: blocks coded by a range asymmetric numeral system with one shared frequency table.

A file set is a folder: ``blocks`` (Parquet rows, one self-contained block each) and ``table`` (id, frequency).
A block's payload is, little-endian::

    magic "RANS" | u32 ids | u32 lanes | u32 steps between checkpoints | u32 checkpoints | u32 words | u32 crc32 of the ids
    per checkpoint: u32 words read before it, then one u64 state a lane
    words: u32 each, in the order in which the decoder reads them

Id ``i`` of a block belongs to lane ``i % lanes`` and step ``i // lanes``. All lanes share one stream of words.
A checkpoint holds the decoder's states before its step, so decoding can start there.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import string
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import KEPT_WORD, LOWER, Batches, as_batch, sliced
from hourgrid.sources.scratch import store

BITS = 20
LOWEST = np.uint64(1 << 31)
LANES = 1024
CHECKPOINT_STEPS = 128
BLOCK_IDS = 1 << 18
_HEAD = struct.Struct("<4sIIIIII")
_32 = np.uint64(32)


def shares(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whole frequencies that add up to 2^bits; every id that occurs gets one at least."""
    total, used = int(counts.sum()), np.flatnonzero(counts)
    if not len(used):
        return np.zeros(len(counts), np.uint32)
    if len(used) > 1 << bits:
        raise ValueError("more ids than slots")
    free = (1 << bits) - len(used)
    exact = counts[used].astype(np.float64) * free / total
    whole = np.floor(exact).astype(np.int64)
    rest = free - int(whole.sum())
    whole[np.argsort(-(exact - whole), kind="stable")[:rest]] += 1
    found = np.zeros(len(counts), np.uint32)
    found[used] = whole + 1
    return found


def encode_block(ids: np.ndarray, frequency: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    n = len(ids)
    first = np.r_[0, np.cumsum(frequency, dtype=np.uint64)[:-1]].astype(np.uint64)
    wide = frequency.astype(np.uint64)
    most, gaps = wide << np.uint64(63 - BITS), np.uint64(1 << BITS) - wide
    state = np.full(lanes, LOWEST)
    steps = -(-n // lanes)
    chunks, marks, written = [], [], 0
    for step in range(steps - 1, -1, -1):
        part = ids[step * lanes : (step + 1) * lanes]
        x = state[: len(part)]
        full = np.flatnonzero(x >= most.take(part))
        if len(full):
            out = x[full]
            chunks.append(out.astype(np.uint32))
            written += len(out)
            x[full] = out >> _32
        # Quotient << BITS, remainder and beginning of the id's slots in one.
        x += x // wide.take(part) * gaps.take(part) + first.take(part)
        if step % every == 0:
            marks.append((written, state.copy()))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    marks.reverse()
    head = _HEAD.pack(b"RANS", n, lanes, every, len(marks), len(words), zlib.crc32(ids.astype("<u4").tobytes()))
    saved = b"".join(struct.pack("<I", written - w) + s.astype("<u8").tobytes() for w, s in marks)
    return head + saved + words.astype("<u4").tobytes()


@lru_cache(2)
def _slots(frequency: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f = np.frombuffer(frequency, "<u4")
    first = np.r_[0, np.cumsum(f, dtype=np.uint64)[:-1]].astype(np.uint64)
    return np.repeat(np.arange(len(f), dtype=np.uint32), f), f.astype(np.uint64), first


def decode_block(payload: bytes, frequency: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids from ``start`` to ``stop``, from the last checkpoint before ``start`` on; a whole block is
    checked against its checksum.
    """
    magic, n, lanes, every, marks, words, crc = _HEAD.unpack_from(payload)
    mark = 4 + 8 * lanes
    base = _HEAD.size + marks * mark
    if magic != b"RANS" or len(payload) != base + 4 * words:
        raise ValueError("not a block, or cut short")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    symbol, wide, first = _slots(frequency.astype("<u4").tobytes())
    stream = np.frombuffer(payload, "<u4", words, base)
    step = start // lanes // every * every
    place = _HEAD.size + step // every * mark
    (read,) = struct.unpack_from("<I", payload, place)
    state = np.frombuffer(payload, "<u8", lanes, place + 4).copy()
    begin, mask, bits = step * lanes, np.uint64((1 << BITS) - 1), np.uint64(BITS)
    out = np.empty(min(n, -(-stop // lanes) * lanes) - begin, np.uint32)
    for at in range(begin, begin + len(out), lanes):
        x = state[: min(lanes, n - at)]
        slot = x & mask
        ids = symbol.take(slot.astype(np.int64))
        out[at - begin : at - begin + len(x)] = ids
        x = wide.take(ids) * (x >> bits) + slot - first.take(ids)
        low = np.flatnonzero(x < LOWEST)
        if len(low):
            x[low] = x[low] << _32 | stream[read : read + len(low)]
            read += len(low)
        state[: len(x)] = x
    if not start and stop == n and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a block differs")
    return out[start - begin : stop - begin]


_JOINED = 50
# Texts that the tokenizer gets at a time: what it returns is far larger than the ids.
_AT_A_TIME = 200
# Units kept in both halves, which age by turns.
CACHE_ENTRIES = 600_000
# Bytes of text whose words are told apart together.
TEXT_BYTES = 3 << 20
# Code points of a text that help to divide the rows of one id.
BEGINNING = 64
# Composed lower-case letters, which a normalizer of these steps leaves as they are.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def _pick(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``sizes`` items from ``starts`` on, one after another."""
    before = np.cumsum(sizes) - sizes
    return flat[np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)]


class _Kept:
    """Distinct words and the ids of each."""

    def __init__(self):
        self.words = pa.array([], pa.string())
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.words)

    def add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(sizes) - sizes]
        self.words, self.ids, self.sizes = pa.concat_arrays([self.words, words]), np.r_[self.ids, ids], np.r_[self.sizes, sizes]

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each word is, -1 for others."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _pick(self.ids, self.starts[places], self.sizes[places]), self.sizes[places]

    def without_long(self) -> None:
        short = pc.utf8_length(self.words).to_numpy() <= KEPT_WORD
        if not short.all():
            words, (ids, sizes) = self.words.filter(pa.array(short)), self.of(np.flatnonzero(short))
            self.__init__()
            self.add(words, ids, sizes)


def _encode(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, and how many each has."""
    ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for at in range(0, len(texts), _AT_A_TIME):
        found = [e.ids for e in tokenizer.encode_batch_fast(texts[at : at + _AT_A_TIME], add_special_tokens=False)]
        ids.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32))
        sizes.append(np.array([len(f) for f in found], np.int64))
    return np.concatenate(ids), np.concatenate(sizes)


class _WordIds:
    """Ids of white-space words, whose parts are kept if seen lately. No match of the tokenizer's splitting pattern,
    no composition and no special token spans white space, so the ids of a text are those of its words, one after
    another. Marks that close a word after a letter or digit are one match by themselves. Arrow finds the distinct
    words of many texts and looks them up. Words of letters are one match each; the tokenizer marks the last id
    of a match, so new ones are encoded many at a time and told apart by that mark.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.added = [t.content.encode().translate(LOWER).decode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.plain = self.tokenizer
        with open(path, encoding="utf-8") as file:
            normalizer = json.load(file)["normalizer"] or {}
        if normalizer.get("normalizers") == _STEPS and not any(map(_PLAIN.fullmatch, self.added)):
            # Plain words need neither these steps nor a pattern. The model is shared.
            self.plain = Tokenizer(self.tokenizer.model)
            split = [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            self.plain.pre_tokenizer = pre_tokenizers.Sequence(split)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kept, self.earlier = _Kept(), _Kept()

    def __len__(self) -> int:
        return len(self.kept)

    def __iter__(self):
        return iter(self.kept.words.to_pylist())

    def _of_letters(self, tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that consist of letters, and how many each has."""
        ids, _ = _encode(tokenizer, [" ".join(words[i : i + _JOINED]) for i in range(0, len(words), _JOINED)])
        ends = np.flatnonzero(self.last[ids]) + 1
        # Letters that case or composition turns into something else are encoded one by one.
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else _encode(self.tokenizer, words)

    def _learn(self, new: pa.Array) -> None:
        plain, letters, others = [], [], []
        for word in new.to_pylist():
            # Lower case can add a mark that is no letter.
            (plain if _PLAIN.fullmatch(word) else letters if word.lower().isalpha() else others).append(word)
        self.kept.add(pa.array(plain, pa.string()), *self._of_letters(self.plain, plain))
        self.kept.add(pa.array(letters, pa.string()), *self._of_letters(self.tokenizer, letters))
        self.kept.add(pa.array(others, pa.string()), *_encode(self.tokenizer, others))

    def _places(self, units: pa.Array) -> np.ndarray:
        """Where distinct units are kept; new ones are encoded."""
        if 2 * len(self.kept) > CACHE_ENTRIES:
            # What has not been met since the last time goes.
            self.earlier, self.kept = self.kept, _Kept()
        places = self.kept.places(units).copy()
        unmet = np.flatnonzero(places < 0)
        new = units.take(pa.array(unmet))
        before, own = self.earlier.places(new), len(self.kept)
        known = before >= 0
        self.kept.add(new.filter(pa.array(known)), *self.earlier.of(before[known]))
        self._learn(new.filter(pa.array(~known)))
        places[unmet] = own + pc.index_in(new, value_set=self.kept.words.slice(own)).to_numpy()
        return places

    def _holds_added(self, texts: pa.Array) -> pa.Array:
        """Which of the lower-cased texts hold an added token in any case."""
        held = pa.array(np.zeros(len(texts), bool))
        for token in self.added:
            held = pc.or_(held, pc.match_substring(texts, token))
        return held

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Where each text's words begin and end, and the words, A-Z lower-cased, but for those that hold an added
        token in any case: such tokens are looked for in the text as it is.
        """
        lower = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(lower)
        words, offsets = lists.flatten(), lists.offsets.to_numpy()
        if pc.any(self._holds_added(lower)).as_py():
            words = pc.if_else(self._holds_added(words), pc.ascii_split_whitespace(texts).flatten(), words)
        return offsets - offsets[:1], words

    def _divided(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """Words without the marks that close them, which words had some, and these marks."""
        stems = pc.ascii_rtrim(words, characters=string.punctuation)
        _, offsets, data = stems.buffers()
        ends = np.frombuffer(offsets, np.int32, len(stems) + 1, 4 * stems.offset)[1:].astype(np.int64)
        raw = np.r_[np.zeros(2, np.uint8), np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)]
        last, second = raw[ends + 1], raw[ends]
        is_ascii = ((last >= 97) & (last <= 122)) | ((last >= 48) & (last <= 57))
        size = pc.binary_length(stems).to_numpy()
        after = is_ascii | ((size > 1) & (second == 0xC3) & (last >= 0x9F) & (last != 0xB7))
        closed = (size > 0) & (size < pc.binary_length(words).to_numpy()) & after & ~self._holds_added(pc.ascii_lower(words)).to_numpy(zero_copy_only=False)
        some = pa.array(closed)
        marks = [w[len(s) :] for w, s in zip(words.filter(some).to_pylist(), stems.filter(some).to_pylist())]
        return pc.if_else(some, stems, words), closed, pa.array(marks, pa.string())

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and before which of them each text begins; then their number."""
        offsets, words = self._words(texts)
        coded = words.dictionary_encode()
        stems, closed, marks = self._divided(coded.dictionary)
        units = pa.concat_arrays([stems, marks]).dictionary_encode()
        places = self._places(units.dictionary)[units.indices.to_numpy()]
        # Each distinct word's one or two units, then what their ids are.
        parts = np.insert(places[: len(stems)], np.flatnonzero(closed) + 1, places[len(stems) :])
        ids, sizes = self.kept.of(parts)
        ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(1 + closed)]]
        index = coded.indices.to_numpy()
        each = np.diff(ends)[index]
        whole = _pick(ids, ends[:-1][index], each)
        self.kept.without_long()
        # Arrow would hold on to what the tables of distinct words took.
        pa.default_memory_pool().release_unused()
        return whole, np.r_[0, np.cumsum(each)][offsets]

    def of(self, texts: list[str]) -> list[bytes]:
        ids, starts = self.flat(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


@lru_cache(2)
def _word_ids(path: str) -> _WordIds:
    return _WordIds(path)


def _tokenize(path: str, end_id: int):
    def run(batches: Batches) -> Batches:
        """Along one range of documents: each with its place among the range's ids."""
        context, start = TaskContext.get(), 0
        bucket = context.partitionId() if context else 0
        end = np.array([end_id], np.uint32)
        for part in sliced(batches, size=TEXT_BYTES):
            flat, starts = _word_ids(path).flat(pc.fill_null(part.column("text"), ""))
            sizes = np.diff(starts) + 1
            found = [np.concatenate([flat[a:b], end]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            places = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            yield as_batch(
                {
                    "bucket": pa.array([bucket] * len(found), pa.int32()),
                    "place": places,
                    "doc_id": part.column("doc_id"),
                    "n": sizes,
                    "ids": pa.array([_pack(i) for i in found], pa.binary()),
                }
            )

    return run


def _pack(ids: np.ndarray) -> bytes:
    """Ids below 2^16 take two bytes here."""
    return b"\2" + ids.astype("<u2").tobytes() if int(ids.max()) < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if packed[0] == 2 else "<u4", offset=1).astype(np.uint32)


def _count(batches: Batches) -> Batches:
    counts = np.zeros(0, np.int64)
    for batch in batches:
        packed = batch.column("ids").to_pylist()
        for at in range(0, len(packed), 1000):
            more = np.bincount(np.concatenate([_unpack(p) for p in packed[at : at + 1000]]))
            if len(more) > len(counts):
                more[: len(counts)] += counts
                counts = more
            else:
                counts[: len(more)] += more
    used = np.flatnonzero(counts)
    if len(used):
        yield as_batch({"id": used.astype(np.int32), "n": counts[used]})


_BLOCK = """bucket int, place long, n_ids int, payload binary, doc_ids array<long>, offsets array<int>, parts array<int>, befores array<long>"""


def _blocks(frequency: np.ndarray):
    def run(batches: Batches) -> Batches:
        """Blocks of consecutive ids of one range. ``offsets`` and ``parts``: where the block holds ids of a
        document, and how many; ``befores``: how many ids of that document earlier blocks hold.
        """
        bucket, place, held, ids, rows = -1, 0, 0, [], []

        def block() -> pa.RecordBatch:
            whole = np.concatenate(ids)
            doc_ids, offsets, parts, befores = (list(x) for x in zip(*rows))
            return as_batch(
                {
                    "bucket": pa.array([bucket], pa.int32()),
                    "place": pa.array([place], pa.int64()),
                    "n_ids": pa.array([len(whole)], pa.int32()),
                    "payload": pa.array([encode_block(whole, frequency)], pa.binary()),
                    "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                    "offsets": pa.array([offsets], pa.list_(pa.int32())),
                    "parts": pa.array([parts], pa.list_(pa.int32())),
                    "befores": pa.array([befores], pa.list_(pa.int64())),
                }
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "place", "doc_id", "ids")]
            for its_bucket, its_place, doc_id, packed in zip(*columns):
                if held and (its_bucket != bucket or its_place != place + held):
                    yield block()
                    held, ids, rows = 0, [], []
                new, done = _unpack(packed), 0
                while done < len(new):
                    if not held:
                        bucket, place = its_bucket, its_place + done
                    take = min(len(new) - done, BLOCK_IDS - held)
                    ids.append(new[done : done + take])
                    rows.append((doc_id, held, take, done))
                    held, done = held + take, done + take
                    if held == BLOCK_IDS:
                        yield block()
                        held, ids, rows = 0, [], []
        if held:
            yield block()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encode every whole text and write its ids, in ascending doc_id order, below ``path``.

    A null text counts as empty and has the end id only. Null ids come last; equal ids are ordered by text.
    Extra columns are not read; an empty table gives a file set without blocks. The frequency table covers
    all ids of all documents; its size is bounded by the vocabulary.
    """
    spark = docs.sparkSession
    order = [F.asc_nulls_last("doc_id"), F.asc_nulls_last("text")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The texts' beginnings divide the rows of one id too, in the same order.
    ranged = texts.repartitionByRange(order[0], F.asc(F.substring("text", 1, BEGINNING))).sortWithinPartitions(*order)
    schema = "bucket int, place long, doc_id long, n long, ids binary"
    tokens = store(ranged.mapInArrow(_tokenize(tokenizer_path, end_id), schema), "token-ids")
    counts = tokens.select("ids").mapInArrow(_count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # One row an id of the vocabulary.
    found = counts.toPandas()
    full = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    full[found["id"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    frequency = shares(full)
    table = [(int(i), int(frequency[i])) for i in np.flatnonzero(frequency)]
    spark.createDataFrame(table, "id int, frequency long").coalesce(1).write.parquet(f"{path}/table")
    tokens.mapInArrow(_blocks(frequency), _BLOCK).write.parquet(f"{path}/blocks")


def _parts(frequency: np.ndarray):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                raw = decode_block(get("payload"), frequency).astype("<u4").tobytes()
                offsets, parts, befores = get("offsets"), get("parts"), get("befores")
                crcs = [zlib.crc32(raw[4 * o : 4 * (o + n)]) for o, n in zip(offsets, parts)]
                size = len(parts)
                starts = [get("place") + o - b for o, b in zip(offsets, befores)]
                yield as_batch(
                    {
                        "bucket": pa.array([get("bucket")] * size, pa.int32()),
                        "place": pa.array(starts, pa.int64()),
                        "doc_id": pa.array(get("doc_ids"), pa.int64()),
                        "before": pa.array(befores, pa.int64()),
                        "n": pa.array(parts, pa.int64()),
                        "crc": pa.array(crcs, pa.int64()),
                    }
                )

    return run


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """crc32 of joined parts from each part's (bytes, crc32): a checksum is affine in where it starts."""
    whole = 0
    for size, crc in parts:
        zeros = bytes(min(size, 1 << 20))
        moved, plain, left = whole, 0, size
        while left:
            step = zeros[:left]
            moved, plain, left = zlib.crc32(step, moved), zlib.crc32(step, plain), left - len(step)
        whole = moved ^ plain ^ crc
    return whole


def _whole(batches: Batches) -> Batches:
    for batch in batches:
        joined = [joined_crc([(4 * p["n"], p["crc"]) for p in parts]) for parts in batch.column("parts").to_pylist()]
        yield as_batch({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": batch.column("n_tokens"), "ids_crc32": pa.array(joined, pa.int64())})


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the decoded blocks.

    Blocks are decoded independently and checked; a document over several blocks is put together from its
    parts' lengths and checksums.
    """
    table = spark.read.parquet(f"{path}/table").toPandas()
    frequency = np.zeros(int(table["id"].max()) + 1 if len(table) else 0, np.uint32)
    frequency[table["id"].to_numpy(dtype=np.int64)] = table["frequency"].to_numpy(dtype=np.int64)
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    schema = "bucket int, place long, doc_id long, before long, n long, crc long"
    parts = blocks.mapInArrow(_parts(frequency), schema)
    # One row a range: the ids of earlier ranges come before.
    totals = blocks.groupBy("bucket").agg(F.sum("n_ids").alias("size"))
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead"))
    documents = (
        parts.groupBy("bucket", "place")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.sum("n").alias("n_tokens"),
            F.sort_array(F.collect_list(F.struct("before", "n", "crc"))).alias("parts"),
        )
        .join(F.broadcast(earlier), "bucket")
        .withColumn("start", F.col("place") + F.col("ahead"))
    )
    shown = documents.select("doc_id", "start", "n_tokens", "parts")
    return shown.mapInArrow(_whole, "doc_id long, start long, n_tokens long, ids_crc32 long")
