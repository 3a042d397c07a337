"""Quality classifier over bytes (operator 6).

A small convolutional network in numpy. Each byte has a learned vector;
learned filters slide over the whole document in steps; a chunk keeps each
filter's largest response, chunks overlap by half and cover the document; a
hidden layer turns a chunk's responses into a score, and the mean of the
chunks' scores through a logistic function is the document's probability.

Training takes a bounded sample of labelled documents (:data:`SAMPLE` of each
label, a few excerpts of each) to the driver; scoring runs over every whole
text, in stretches, so memory does not grow with a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.llm.common import column_of, give_back, id_and_text, slices

#: Labelled documents of each label, and excerpts of each, used for training.
SAMPLE, EXCERPTS = 1000, 4
#: Bytes of a half chunk (a chunk is two), and of a filter's half (a filter is
#: two, and moves by one half).
HALF, STEP = 256, 8
VECTOR, FILTERS, HIDDEN = 4, 24, 12
EPOCHS, RATE, BATCH, SEED = 40, 0.01, 64, 7
JUNK_WEIGHT, SHORTENED = 0.3, 0.25
#: Documents below this score are rejected.
ACCEPT = 0.3
#: Half chunks scored at a time.
STRETCH = 512
PAD = 256  # the symbol beyond a text's end


@dataclass
class Network:
    """Weights; ``prior`` is the score of texts without bytes."""

    prior: float = 0.5
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self) -> None:
        rng = np.random.default_rng(SEED)
        shapes = {"bytes": (257, VECTOR), "left": (STEP * VECTOR, FILTERS), "right": (STEP * VECTOR, FILTERS), "bias": (FILTERS,),
                  "hidden": (FILTERS, HIDDEN), "hidden_bias": (HIDDEN,), "out": (HIDDEN,), "out_bias": (1,)}
        self.weights = {}
        for name, shape in shapes.items():
            scale = 0.0 if "bias" in name else 0.5 if name == "bytes" else 1 / np.sqrt(shape[0])
            self.weights[name] = (rng.standard_normal(shape) * scale).astype(np.float32)

    def responses(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of symbols (a multiple of STEP long): the steps' vectors and
        the filters' responses at every step but the last."""
        w = self.weights
        x = w["bytes"][symbols].reshape(len(symbols), -1, STEP * VECTOR)
        return x, x[:, :-1] @ w["left"] + x[:, 1:] @ w["right"] + w["bias"]

    def chunk_scores(self, pooled: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.maximum(np.maximum(pooled, 0) @ w["hidden"] + w["hidden_bias"], 0) @ w["out"] + w["out_bias"][0]

    def train(self, symbols: np.ndarray, labels: np.ndarray) -> None:
        """Adam on the logistic loss of chunks. Label 0 weighs :data:`JUNK_WEIGHT`
        of the whole; some chunks are shortened, as many texts are short."""
        self.start()
        rng = np.random.default_rng(SEED)
        weight = np.where(labels == 1, 1 - JUNK_WEIGHT, JUNK_WEIGHT)
        part = weight / np.where(labels == 1, (labels == 1).sum(), (labels == 0).sum()) * len(labels)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        steps, total = 0, EPOCHS * -(-len(symbols) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(symbols))
            for s in range(0, len(order), BATCH):
                pick = order[s:s + BATCH]
                seen = symbols[pick]
                for i in np.flatnonzero(rng.random(len(pick)) < SHORTENED):
                    seen[i, rng.integers(24, HALF):] = PAD
                slopes = self.slopes(seen, labels[pick], part[pick])
                steps += 1
                rate = RATE * (1 - steps / (total + 1))
                for k, g in slopes.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.weights[k] -= (rate * first[k] / (1 - 0.9**steps)
                                        / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)

    def slopes(self, symbols: np.ndarray, labels: np.ndarray, part: np.ndarray) -> dict[str, np.ndarray]:
        """Derivatives of the mean loss by each weight."""
        w, n = self.weights, len(symbols)
        x, z = self.responses(symbols)
        at = z.argmax(axis=1)  # where each filter responds most
        pooled = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0]
        lively = np.maximum(pooled, 0)
        h = lively @ w["hidden"] + w["hidden_bias"]
        r = np.maximum(h, 0)
        score = r @ w["out"] + w["out_bias"][0]
        d_score = ((1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels) * part / n).astype(np.float32)
        d_h = d_score[:, None] * w["out"] * (h > 0)
        d_z = (d_h @ w["hidden"].T) * (pooled > 0)
        rows = np.arange(n)[:, None]
        left, right = x[rows, at], x[rows, at + 1]  # n x filters x (STEP * VECTOR)
        d_left = np.einsum("nf,nfk->kf", d_z, left)
        d_right = np.einsum("nf,nfk->kf", d_z, right)
        d_bytes = np.zeros_like(w["bytes"])
        steps = symbols.reshape(n, -1, STEP)
        for half, name in ((at, "left"), (at + 1, "right")):
            d_x = (d_z[:, :, None] * w[name].T[None]).reshape(n, FILTERS, STEP, VECTOR)
            np.add.at(d_bytes, steps[rows, half].ravel(), d_x.reshape(-1, VECTOR))
        return {"bytes": d_bytes, "left": d_left, "right": d_right, "bias": d_z.sum(axis=0), "hidden": lively.T @ d_h,
                "hidden_bias": d_h.sum(axis=0), "out": r.T @ d_score, "out_bias": d_score.sum(keepdims=True)}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of label 1 for each whole text."""
        out = np.full(len(texts), self.prior)
        if not self.weights:
            return out
        owner, peaks, rows, held = [], [], [], 0
        for n, text in enumerate(texts):
            halves = max(2, -(-len(text) // HALF)) if text else 0
            for s in range(0, halves, STRETCH):
                count = min(STRETCH, halves - s)
                rows.append(halves_of(text, s, count))
                owner.append(np.full(count, n))
                held += count
                if held >= STRETCH:
                    peaks.append(self.peaks(np.concatenate(rows)))
                    rows, held = [], 0
        if rows:
            peaks.append(self.peaks(np.concatenate(rows)))
        if peaks:
            who, top = np.concatenate(owner), np.concatenate(peaks)
            whole = who[1:] == who[:-1]  # a chunk is two halves of one text
            score = self.chunk_scores(np.maximum(top[:-1], top[1:])[whole])
            chunks = np.bincount(who[1:][whole], minlength=len(texts))
            mean = np.bincount(who[1:][whole], score, len(texts)) / np.maximum(chunks, 1)
            out = np.where(chunks > 0, 1 / (1 + np.exp(-np.clip(mean, -60, 60))), out)
        return out

    def peaks(self, symbols: np.ndarray) -> np.ndarray:
        return self.responses(symbols)[1].max(axis=1)


def halves_of(text: bytes, first: int, count: int) -> np.ndarray:
    """Half chunks of a text as rows of symbols, each with the step after it,
    which filters reach over."""
    flat = np.full(count * HALF + STEP, PAD, np.int16)
    piece = np.frombuffer(text, np.uint8, min(len(flat), len(text) - first * HALF) if len(text) > first * HALF else 0,
                          min(first * HALF, len(text)))
    flat[:len(piece)] = piece
    return np.lib.stride_tricks.sliding_window_view(flat, HALF + STEP)[::HALF]


def symbols_of(excerpt: bytes) -> np.ndarray:
    """A chunk of training input, padded, with the step that filters reach over."""
    out = np.full(2 * HALF + STEP, PAD, np.int16)
    data = np.frombuffer(excerpt[:len(out)], np.uint8)
    out[:len(data)] = data
    return out


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Train on labelled documents outside the held-out fifth.

    Of labels that repeat an id the lowest counts, of documents that do the one
    with the least hash of its text. Without examples of both labels the
    network has no weights, and every text scores the share of label 1 (0.5
    without any label).
    """
    known = (labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality"))
             .filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    network = Network(prior=counts.get(1, 0) / sum(counts.values()) if counts else 0.5)
    if len(counts) < 2:
        return network
    order = [F.xxhash64("doc_id"), "doc_id"]
    present = known.join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
    picked = [r for q in (0, 1) for r in present.filter(F.col("quality") == q).orderBy(*order).limit(SAMPLE).collect()]
    if len({r.quality for r in picked}) < 2:
        return network
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id, r.quality) for r in picked], "doc_id long, quality int"))
    size = 2 * HALF + STEP
    room = F.greatest(F.octet_length("data") - size, F.lit(0))
    excerpts = F.transform(F.sequence(F.lit(0), F.lit(EXCERPTS - 1)), lambda i: F.substring(
        "data", F.floor(room * i / (EXCERPTS - 1)).cast("int") + 1, F.lit(size)))
    first = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    rows = (id_and_text(docs, id_col, text_col).join(chosen, "doc_id").groupBy("doc_id", "quality").agg(first)
            .withColumn("data", F.col("text").cast("binary"))
            .filter(F.octet_length("data") > 0).select("doc_id", "quality", F.array_distinct(excerpts).alias("x")).collect())
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.x))
    symbols = np.stack([symbols_of(bytes(e)) for r in rows for e in r.x]) if rows else np.zeros((0, size), np.int16)
    answers = np.array([r.quality for r in rows for _ in r.x], dtype=np.float32)
    if len(set(answers.tolist())) == 2:
        network.train(symbols, answers)
    return network


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row.

    Null and empty texts score the share of label 1 in the training labels; a
    null id is not held out; repeated rows are scored alike. Other columns are
    not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = network.scores(column_of(batch, "data"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("data"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(text: Column, network: Network, accept: float = ACCEPT) -> Column:
    """Whether texts (null: empty) score high enough to stay."""
    def decide(texts: pd.Series) -> pd.Series:
        scores = [network.scores(texts[s:s + 500].tolist()) for s in range(0, len(texts), 500)]
        give_back()
        return pd.Series(np.concatenate([np.zeros(0), *scores]) >= accept, index=texts.index)

    return F.pandas_udf(decide, "boolean")(F.coalesce(text, F.lit("")).cast("binary"))
