"""Toxicity by multiple-instance learning (operator 11).

Only documents are labelled, but sentences offend. A document is a bag of its
distinct sentences; a logistic model over a sentence's words gives each a
probability, and the document's is their noisy-or: one minus the probability
that none offends. Training fits the sentence model to the documents' labels
through the noisy-or; the same sentence probabilities then say which sentences
offend.

A word counts by itself and by its beginnings, so that inflected and compound
forms share evidence; a sentence's logit is the sum over its distinct words.

Training takes a bounded sample to the driver: :data:`SAMPLE` documents of
each label, and of a document the :data:`SENTENCES` distinct sentences first
in the order of their hashes. Scoring runs over every whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.llm.common import cut, id_and_text, packed, slices

#: Labelled documents of each label, and distinct sentences of each, used for training.
SAMPLE, SENTENCES = 4000, 1000
#: Hashed features, lengths of the beginnings of a word, evidence (likelihood
#: ratio, G squared, over the sample's documents) that a feature needs to be learned.
FEATURES, BEGINNINGS, EVIDENCE = 1 << 18, (3, 4, 5, 6, 7), 20.0
#: A sentence's logit before training; strength of the penalty on weights.
START, PENALTY = -4.0, 0.3
#: Weight of the toxic documents as a part of the whole.
TOXIC_WEIGHT = 0.5
ROUNDS, RATE = 150, 0.15
#: Documents from this score on are toxic.
TOXIC = 0.7
#: Tasks that count the sample's features.
TASKS = 8
#: Words whose scores a task remembers.
TABLE = 1 << 19

_SENTENCE = re.compile(r"[^.!?…。！？\n\r]+[.!?…。！？]*")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans (code points, end exclusive) and lower-cased texts of sentences:
    trimmed stretches up to a full stop, question or exclamation
    mark or line end."""
    for m in _SENTENCE.finditer(text):
        raw = m.group()
        if found := raw.strip():
            start = m.start() + len(raw) - len(raw.lstrip())
            yield start, start + len(found), found.lower()


def parts_of(word: str) -> list[str]:
    """A word's features: itself and its beginnings."""
    return [word, *("^" + word[:n] for n in BEGINNINGS if n < len(word))]


def hashed(part: str) -> int:
    return xxhash.xxh32_intdigest(part.encode("utf-8", "surrogatepass")) % FEATURES


class _Remembered(dict):
    """Values of keys, worked out once; forgotten when there are too many."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, key):
        if len(self) >= TABLE:
            self.clear()
        value = self[key] = self.work(key)
        return value


@dataclass
class Model:
    """Sentence model: weights of the features learned; ``prior`` is the score
    of every text if there is none."""

    prior: float = 0.5
    bias: float = 0.0
    weights: dict[int, float] | None = None

    def __post_init__(self):
        self.parts = _Remembered(lambda part: self.weights.get(hashed(part), 0.0))
        self.words = _Remembered(lambda word: sum(map(self.parts.__getitem__, parts_of(word))))

    def __reduce__(self):
        return Model, (self.prior, self.bias, self.weights)

    def sentence(self, text: str) -> float:
        """The logit of a lower-cased sentence."""
        return self.bias + math.fsum(map(self.words.__getitem__, set(_WORD.findall(text))))

    def judge(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The score of a whole text, and the sentences that offend with their
        probabilities. A sentence that repeats counts once."""
        if self.weights is None:
            return self.prior, []
        known: dict[str, float] = {}
        offending, none = [], 0.0
        for start, end, sentence in sentences(text):
            z = known.get(sentence)
            if z is None:
                z = known[sentence] = self.sentence(sentence)
                none -= _softplus(z)
            if z >= 0:  # a probability of a half and more
                offending.append((start, end, 1 / (1 + math.exp(-min(z, 700.0)))))
        if not known:
            none = -_softplus(self.bias)
        return -math.expm1(none), offending


def _softplus(z: float) -> float:
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


def bag(text: str, most: int = SENTENCES) -> tuple[np.ndarray, np.ndarray]:
    """Features of a document's distinct sentences, and how many each has; no
    more sentences than ``most``, those first by hash."""
    found = {s for _, _, s in sentences(text)}
    if len(found) > most:
        found = sorted(found, key=lambda s: (xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")), s))[:most]
    rows = [[hashed(p) for w in sorted(set(_WORD.findall(s))) for p in parts_of(w)] for s in sorted(found)] or [[]]
    return np.array([f for r in rows for f in r], dtype=np.uint32), np.array([len(r) for r in rows], dtype=np.uint32)


def evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """G squared of each feature's documents, toxic and clean, against no relation."""
    total, n = toxic + clean, n_toxic + n_clean
    out = np.zeros(len(total))
    for have, of in ((toxic, n_toxic), (clean, n_clean)):
        for seen, share in ((have, total / n), (of - have, 1 - total / n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(seen > 0, 2 * seen * np.log(seen / (of * share)), 0.0)
    return out


def presence(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Numbers of clean and of toxic documents that hold each feature."""
    out = np.zeros((2, FEATURES), np.int64)
    for (found, _), label in zip(bags, labels.tolist(), strict=True):
        out[label, np.unique(found)] += 1
    return out


def evident(held: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """The features whose evidence is enough, ascending."""
    return np.flatnonzero(evidence(held[1], held[0], n_toxic, n_clean) >= EVIDENCE)


def reduced(found: tuple[np.ndarray, np.ndarray], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bag with the places of the given features only."""
    flat, lengths = found[0].astype(np.int64), found[1].astype(np.int64)
    place = np.searchsorted(features, flat)
    use = np.append(features, -1)[np.minimum(place, len(features))] == flat
    sentence = np.repeat(np.arange(len(lengths)), lengths)
    return place[use].astype(np.uint32), np.bincount(sentence[use], minlength=len(lengths)).astype(np.uint32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, features: np.ndarray) -> Model:
    """Gradient descent (Adam) on the logistic loss of noisy-or documents, whose
    bags hold places in ``features``."""
    per_doc = np.array([len(n) for _, n in bags])
    lengths = np.concatenate([n for _, n in bags]).astype(np.int64)
    column = np.concatenate([f for f, _ in bags]).astype(np.int64)
    sentence = np.repeat(np.arange(len(lengths)), lengths)
    doc_of = np.repeat(np.arange(len(bags)), per_doc)
    positive, count = labels == 1, len(features)
    part = np.where(positive, TOXIC_WEIGHT / positive.sum(), (1 - TOXIC_WEIGHT) / (~positive).sum())
    w = np.zeros(count + 1)  # the bias comes last
    w[-1] = START
    first, second = np.zeros_like(w), np.zeros_like(w)
    penalty = PENALTY / len(labels)
    for step in range(1, ROUNDS + 1):
        z = np.bincount(sentence, w[column], len(lengths)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        none = np.bincount(doc_of, -np.logaddexp(0, z), len(bags))
        some = np.maximum(-np.expm1(none), 1e-12)
        slope = np.where(positive, -np.exp(none) / some, 1.0) * part
        d_z = slope[doc_of] * p
        g = np.append(np.bincount(column, d_z[sentence], count) + penalty * w[:-1], d_z.sum())
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        rate = RATE * (1 - (step - 1) / ROUNDS)
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return Model(bias=float(w[-1]), weights=dict(zip(features.tolist(), w[:-1].tolist(), strict=True)))


def held_out(doc_id: Column) -> Column:
    """A third of the documents, whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 100):
        made = [bag(text.as_py()) for text in batch.column(batch.schema.get_field_index("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("toxic")),
             *_packed_bags(made)], names=["doc_id", "toxic", "features", "lengths"])


def _packed_bags(bags: list) -> list[pa.Array]:
    return [pa.array([packed(x[i], "<u4") for x in bags], pa.binary()) for i in (0, 1)]


def _unpacked_bags(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    return [tuple(np.frombuffer(x.as_py(), "<u4") for x in row) for row in zip(batch.column(2), batch.column(3), strict=True)]


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's documents by feature, one row."""
    held, count = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
    for batch in slices(batches, 100):
        labels = np.asarray(batch.column(1))
        held += presence(_unpacked_bags(batch), labels)
        count += np.bincount(labels, minlength=2)
    yield pa.RecordBatch.from_arrays([pa.array([packed(held, "<i4")], pa.binary()), pa.array([packed(count, "<i8")], pa.binary())],
                                     names=["held", "count"])


def _reducer(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *_packed_bags([reduced(x, features) for x in _unpacked_bags(batch)])],
                names=["doc_id", "toxic", "features", "lengths"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from labelled documents outside the held-out third.

    Of labels that repeat an id the toxic one counts, of documents that do the
    one with the least hash of its text. Without examples of both labels there
    are no weights, and every text scores the share of toxic labels (0.5
    without any label).
    """
    spark = docs.sparkSession
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(counts) < 2:
        return Model(prior=prior)
    texts = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    present = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    # At most ``sample`` ids of each label.
    chosen = [tuple(r) for y in (0, 1)
              for r in present.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    schema = "doc_id long, toxic int, features binary, lengths binary"
    bags = cut(texts.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic int")), "doc_id")
               .groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
               .mapInArrow(_bags, schema))
    # A few rows of counts by feature; then what the features with evidence leave of the bags.
    shares = bags.coalesce(TASKS).mapInArrow(_presence, "held binary, count binary").collect()
    held = sum((np.frombuffer(r.held, "<i4").reshape(2, -1) for r in shares), np.zeros((2, FEATURES), np.int64))
    clean, toxic = sum((np.frombuffer(r["count"], "<i8") for r in shares), np.zeros(2, np.int64)).tolist()
    if not clean or not toxic:
        return Model(prior=prior)
    features = evident(held, clean, toxic)
    rows = sorted(bags.mapInArrow(_reducer(features), schema).collect(), key=lambda r: r.doc_id)
    model = train([(np.frombuffer(r.features, "<u4"), np.frombuffer(r.lengths, "<u4")) for r in rows],
                  np.array([r.toxic for r in rows]), features)
    model.prior = prior
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", toxic: float = TOXIC) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and ``offending``
    (spans in code points, end exclusive, with their probabilities) of every row.

    Null, empty and blank texts score like one sentence without words. A null
    id is not held out; repeated rows are scored alike. Other columns are not
    read.
    """
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [model.judge(text.as_py()) for text in batch.column(1)]
            found = [[{"start": s, "end": e, "score": p} for s, e, p in offending] for _, offending in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in made], pa.float64()), pa.array(found, spans)],
                                             names=["doc_id", "score", "offending"])

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, offending array<struct<start:int,end:int,score:double>>").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxic).cast("int").alias("predicted"),
        "offending")
