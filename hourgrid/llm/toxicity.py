"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import CACHE_ENTRIES, KEPT_WORD, Batches, as_batch, remainder, remember_in, sliced, strings
from hourgrid.sources.scratch import store

# Features of which the fit takes note: the most telling ones of the sample, each in so many documents at least.
MAX_FEATURES = 4096
LEAST_DOCUMENTS = 4
LEAST_Z = 4.0
# The fit's bound: labelled documents that it sees at most, drawn by a hash of their id.
SAMPLE_DOCUMENTS = 30_000
SAMPLE_FILES = 16
ROUNDS = 30
STEP = 0.4
PENALTY = 1e-4
THRESHOLD = 0.3

_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?\n]+|$)")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences, which cover the text; an empty text has one empty sentence."""
    return [m.span() for m in _SENTENCE.finditer(text) if m.end() > m.start()] or [(0, 0)]


def features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: itself and its first four and five letters."""
    parts = (f"w{word}", f"4{word[:4]}", f"5{word[:5]}")
    hashed = (hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8).digest() for p in parts)
    return tuple(int.from_bytes(h, "little", signed=True) for h in hashed)


class _Features(dict):
    def __missing__(self, word: str) -> tuple[int, ...]:
        found = features(word)
        if len(word) <= KEPT_WORD:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = found
        return found


_KNOWN = _Features()


def _count(batches: Batches) -> Batches:
    """(feature, docs, toxic): in how many documents a feature is, and in how many toxic ones."""
    remember_in(_KNOWN)
    held: list[tuple] = []
    size = 0
    for batch in batches:
        # Some hundred documents at a time bound the memory.
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            own = [np.fromiter({f for w in set(_WORD.findall(t.lower())) for f in _KNOWN[w]}, np.int64) for t in strings(part)]
            marks = np.repeat(part.column("label").to_numpy().astype(np.int64), [len(o) for o in own])
            held.append(_added([(np.concatenate(own), np.ones(len(marks), np.int64), marks)]))
            size += len(held[-1][0])
            if size > 500_000:
                held = [_added(held)]
                size = len(held[0][0])
                if size > 250_000:
                    yield as_batch(dict(zip(("feature", "docs", "toxic"), held.pop())))
                    size = 0
    if held:
        yield as_batch(dict(zip(("feature", "docs", "toxic"), _added(held))))


def _added(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = (np.bincount(where, np.concatenate([p[i] for p in parts]), len(found)).astype(np.int64) for i in (1, 2))
    return (found, *sums)


def _select(sample: DataFrame, n: int, positive: int) -> list[int]:
    """The features that toxic documents have more often, by the normal statistic of two shares."""
    counts = sample.mapInArrow(_count, "feature long, docs long, toxic long").groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    share = F.col("docs") / n
    gap = F.col("toxic") / positive - (F.col("docs") - F.col("toxic")) / (n - positive)
    z = gap / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / positive + 1 / (n - positive)))
    telling = counts.where(F.col("docs") >= LEAST_DOCUMENTS).withColumn("z", z).where(F.col("z") >= LEAST_Z)
    return [r["feature"] for r in telling.orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()]


def _bags(chosen: list[int]):
    place = {f: i for i, f in enumerate(chosen)}

    def run(batches: Batches) -> Batches:
        """(label, ids, ends): the chosen features of a document and where each sentence's end."""
        known: dict[str, list[int]] = {}
        remember_in(known)
        for batch in sliced(batches):
            bags, ends = [], []
            for text in strings(batch):
                ids, own = [], []
                for start, end in sentences(text):
                    for word in set(_WORD.findall(text[start:end].lower())):
                        found = known.get(word)
                        if found is None:
                            found = [place[f] for f in features(word) if f in place]
                            if len(word) <= KEPT_WORD:
                                if len(known) >= CACHE_ENTRIES:
                                    known.clear()
                                known[word] = found
                        ids.extend(found)
                    own.append(len(ids))
                bags.append(ids)
                ends.append(own)
            if bags:
                yield as_batch({"label": batch.column("label"), "ids": pa.array(bags, pa.list_(pa.int32())), "ends": pa.array(ends, pa.list_(pa.int32()))})

    return run


@dataclass
class Model:
    """The weight of each chosen feature, and the bias of a sentence."""

    weights: dict[int, float]
    bias: float


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, feature ids, the sentence of each id, the document of each sentence."""
    ids, ends = batch.column("ids"), batch.column("ends")
    id_starts = np.asarray(ids.offsets)
    per_doc = np.diff(np.asarray(ends.offsets))
    owner = np.repeat(np.arange(len(per_doc)), per_doc)
    flat_ends = np.asarray(ends.values)[ends.offsets[0].as_py() : ends.offsets[-1].as_py()]
    global_ends = flat_ends + (id_starts[:-1] - id_starts[0])[owner]
    lengths = np.diff(np.r_[0, global_ends])
    sentence = np.repeat(np.arange(len(global_ends)), lengths)
    flat_ids = np.asarray(ids.values)[id_starts[0] : id_starts[-1]]
    return np.asarray(batch.column("label")), flat_ids, sentence, owner


def loss_and_gradient(label, ids, sentence, owner, weights, bias) -> tuple[float, np.ndarray, float]:
    """Negative log likelihood of the documents, where P(document) = 1 - product of (1 - P(sentence))."""
    z = bias + np.bincount(sentence, weights[ids], minlength=len(owner))
    clean = np.bincount(owner, -np.logaddexp(0, z), minlength=len(label))  # log of 1 - P(document)
    toxic = np.maximum(-np.expm1(clean), 1e-12)
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = -np.where(label == 1, np.log(toxic), clean).sum()
    slope = np.where(label == 1, -np.exp(clean) / toxic, 1.0)[owner] * p
    return float(loss), np.bincount(ids, slope[sentence], minlength=len(weights)), float(slope.sum())


def _step(weights: np.ndarray, bias: float):
    def run(batches: Batches) -> Batches:
        total, slope, shift, n = 0.0, np.zeros(len(weights)), 0.0, 0
        for batch in batches:
            loss, more, more_shift = loss_and_gradient(*_flat(batch), weights, bias)
            total, slope, shift, n = total + loss, slope + more, shift + more_shift, n + batch.num_rows
        if n:
            yield as_batch({"n": [n], "loss": [total], "shift": [shift], "slope": pa.array([slope.astype(np.float32).tobytes()], pa.binary())})

    return run


def labels_to_learn(labels: DataFrame) -> DataFrame:
    """(doc_id, label) without the held-out quarter; a document labelled twice is toxic if one label says so."""
    marks = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    return marks.where("label IS NOT NULL").where(remainder() != 2)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit to documents (doc_id, text) with the labels (doc_id, label); a null text is empty.

    At most SAMPLE_DOCUMENTS labels are drawn; so few rows are sent to the documents, which stay where they are.
    The sample is stored as SAMPLE_FILES files. Features are counted over it, and the
    most telling MAX_FEATURES kept. Each round is a Spark job over the documents' bags of features that returns one
    gradient a file; the driver takes the (Adam) step. Without a toxic or without a clean row the score is
    the label's share for all texts.
    """
    drawn = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    picked = store(drawn.select("doc_id", "label"), "toxicity-sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "label")
    sample = store(texts.repartition(SAMPLE_FILES), "toxicity-texts")
    n, positive = sample.agg(F.count("*"), F.sum("label")).first()
    if not positive or positive == n:
        share = ((positive or 0) + 0.5) / (n + 1)
        return Model({}, float(np.log(share / (1 - share))))
    chosen = _select(sample, n, positive)
    bags = store(sample.mapInArrow(_bags(chosen), "label int, ids array<int>, ends array<int>"), "toxicity-bags")
    weights, bias = np.zeros(len(chosen)), -5.0
    mean, square = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    schema = "n long, loss double, shift double, slope binary"
    for round_ in range(1, ROUNDS + 1):
        # SAMPLE_FILES rows at most, one vector each.
        parts = bags.mapInArrow(_step(weights, bias), schema).collect()
        slope = np.r_[sum(np.frombuffer(p["slope"], np.float32).astype(np.float64) for p in parts), sum(p["shift"] for p in parts)] / n
        slope[:-1] += PENALTY * weights
        mean += 0.1 * (slope - mean)
        square += 0.01 * (slope * slope - square)
        move = STEP * (mean / (1 - 0.9**round_)) / (np.sqrt(square / (1 - 0.99**round_)) + 1e-6)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return Model(dict(zip(chosen, weights.tolist())), bias)


class _Scores(dict):
    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        found = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(word) <= KEPT_WORD:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = found
        return found


def judge(text: str, scores: dict, bias: float) -> tuple[float, int, int, float, int]:
    """Score of the text; span and probability of its worst sentence (the first of equals); sentences at or over
    the threshold.
    """
    spans = sentences(text)
    z = np.array([bias + sum(map(scores.__getitem__, set(_WORD.findall(text[a:b].lower())))) for a, b in spans])
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    score = -np.expm1(-np.logaddexp(0, z).sum())
    worst = int(z.argmax())
    return float(np.clip(score, 0, 1)), *spans[worst], float(p[worst]), int((p >= THRESHOLD).sum())


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, worst_start, worst_end, worst_score, n_toxic_sentences) of every whole text.

    A null or empty text is one empty sentence, so it has the score of a sentence without words. Rows are
    independent: null and repeated ids and copies stay as they are; extra columns are not read; an empty
    table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        scores = _Scores(shared.value.weights)
        remember_in(scores)
        for batch in sliced(batches):
            found = [judge(t, scores, shared.value.bias) for t in strings(batch)]
            score, start, end, worst, count = zip(*found)
            yield as_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "score": pa.array(score, pa.float64()),
                    "predicted": pa.array([int(s >= THRESHOLD) for s in score], pa.int32()),
                    "worst_start": pa.array(start, pa.int64()),
                    "worst_end": pa.array(end, pa.int64()),
                    "worst_score": pa.array(worst, pa.float64()),
                    "n_toxic_sentences": pa.array(count, pa.int64()),
                }
            )

    schema = "doc_id long, score double, predicted int, worst_start long, worst_end long, worst_score double, n_toxic_sentences long"
    return docs.selectExpr("CAST(doc_id AS bigint) doc_id", "text").mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        scores = _Scores(shared.value.weights)
        remember_in(scores)
        for batch in sliced(batches):
            kept = [judge(t, scores, shared.value.bias)[0] < THRESHOLD for t in strings(batch)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
