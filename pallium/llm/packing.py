"""Packing of tokenised documents into sequences (operator 10).

Cutting stock by column generation: a document's tokens are cut into whole
sequences and one rest; the histogram of the rests' lengths (at most one entry
per length, whatever the number of documents) is the demand of a linear
program whose columns are patterns, ways to fill a sequence. A knapsack
dynamic program prices columns: it finds the pattern worth most at the current
dual prices, until none improves the plan noticeably. The solution is rounded;
what rounding leaves is filled up by exact subset sums.

Pieces of equal length are interchangeable, so a plan says for every length
which ranks go to which pattern. Ranks come from counters per task and the sums
of the counts before it, without a global sort; every piece then finds its
sequence and offset from its length and rank alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pallium.llm.common import column_of, cut, give_back, id_and_text, read_shipped, slices
from pallium.llm.encoding import byte_bpe

CAPACITY = 1024
#: Ends every document.
END = 0
#: Column generation stops when the plan is within this part of the optimum,
#: or after so many columns; a plan is complete either way.
GAP, MAX_COLUMNS = 0.001, 200


class Tokens:
    """Ids of texts, each text's followed by :data:`END`."""

    def __init__(self, content: bytes):
        self.bpe = byte_bpe(content)

    def ids(self, text: str) -> np.ndarray:
        return np.append(self.bpe.ids(text).astype("<u4", copy=False), np.array([END], dtype="<u4"))


def _cutter(content, keep_ids: bool):
    """Pieces of every document, with a counter per length in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, task = Tokens(content.value), TaskContext.get().partitionId()
        counter = np.zeros(CAPACITY + 1, np.int64)
        for batch in slices(batches):
            out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place", "ids")}
            for doc_id, text in zip(column_of(batch, "doc_id"), column_of(batch, "text"), strict=True):
                ids = tokens.ids(text)
                for start in range(0, len(ids), CAPACITY):
                    piece = ids[start:start + CAPACITY]
                    values = (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), task, int(counter[len(piece)]),
                              piece.tobytes() if keep_ids else None)
                    counter[len(piece)] += 1
                    for c, v in zip(out.values(), values, strict=True):
                        c.append(v)
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.binary()]
            arrays = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
            n = len(out) if keep_ids else len(out) - 1
            yield pa.RecordBatch.from_arrays(arrays[:n], names=list(out)[:n])
        give_back()

    return run


def best_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The pattern worth most at the prices (unbounded knapsack)."""
    worth = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    by_size = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        n = by_size[c]
        if n:
            v = prices[:n] + worth[c - lengths[:n]]
            k = int(v.argmax())
            if v[k] > worth[c - 1] + 1e-12:
                worth[c], took[c] = v[k], k
                continue
        worth[c] = worth[c - 1]
    pattern, c = np.zeros(len(lengths)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= lengths[took[c]]
    return pattern, float(worth[capacity])


def columns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one per row) and how often the linear program uses each.

    The first basis is greedy: the longest piece and the best fill for it,
    as often as the demand allows, so that each pattern uses up a length and
    occurs in no later one; that makes the patterns a triangular basis.
    """
    m = len(lengths)
    index = {int(k): i for i, k in enumerate(lengths)}
    basis, x, left = np.zeros((m, m)), np.zeros(m), dict(zip(lengths.tolist(), demand.tolist(), strict=True))
    for column in range(m):
        held = fill(sorted(left, reverse=True), {k: math.ceil(n) for k, n in left.items()}, capacity)
        spent = min(held, key=lambda k: left[k] / held[k])
        x[column] = left[spent] / held[spent]
        for k, n in held.items():
            basis[index[k], column] = n
            left[k] = max(left[k] - n * x[column], 1e-9)
        del left[spent]
    inverse = np.linalg.inv(basis)
    least = float(lengths @ demand) / capacity
    for step in range(MAX_COLUMNS):
        if x.sum() <= least * (1 + GAP):
            break
        prices = inverse.sum(axis=0)
        pattern, value = best_pattern(lengths, np.maximum(prices, 0), capacity)
        if value <= 1 + GAP:  # the optimum is no less than the plan's sequences / value
            break
        d = inverse @ pattern
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        amount = ratio[leave]
        x = np.maximum(x - amount * d, 0)
        x[leave] = amount
        basis[:, leave] = pattern
        row = inverse[leave] / d[leave]
        inverse -= np.outer(d, row)
        inverse[leave] = row
    return np.rint(basis.T).astype(np.int64), x


def fill(lengths: list[int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """Of the pieces left, the longest and those that fill up its sequence best."""
    first = max(left)
    steps, reach, size = [], 1, capacity - first
    mask = (1 << (size + 1)) - 1
    for length in lengths:
        n = min(left.get(length, 0) - (length == first), size // length)
        unit = 1
        while n > 0:
            take = min(unit, n)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & mask
            n, unit = n - take, unit * 2
    total = reach.bit_length() - 1
    used = {first: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


@dataclass
class Plan:
    """For each length, the ranks at which its slots in each pattern begin,
    pieces per sequence, first sequence and first offset of the pattern."""

    slots: dict[int, np.ndarray]
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length).tolist():
            which = np.flatnonzero(length == size)
            t = self.slots[size]
            row = np.searchsorted(t[:, 0], rank[which], side="right") - 1
            inside = rank[which] - t[row, 0]
            sequence[which] = t[row, 2] + inside // t[row, 1]
            offset[which] = t[row, 3] + inside % t[row, 1] * size
        return sequence, offset


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A plan that holds every piece of the histogram exactly once."""
    left = {k: n for k, n in sorted(histogram.items()) if k < capacity and n}
    uses: list[tuple[dict[int, int], int]] = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    if left:
        lengths = np.array(list(left), dtype=np.int64)
        patterns, x = columns(lengths, np.array(list(left.values()), dtype=float), capacity)
        for i in np.argsort(-x, kind="stable"):
            held = {int(k): int(n) for k, n in zip(lengths, patterns[i], strict=True) if n}
            times = min([int(x[i]), *(left.get(k, 0) // n for k, n in held.items())])
            if times > 0:
                uses.append((held, times))
                left = {k: n - times * held.get(k, 0) for k, n in left.items()}
    left = {k: n for k, n in left.items() if n}
    while left:
        held = fill(sorted(left, reverse=True), left, capacity)
        times = min(left[k] // n for k, n in held.items())
        uses.append((held, times))
        left = {k: m for k, n in left.items() if (m := n - times * held.get(k, 0))}
    slots: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequences = 0
    for held, times in uses:
        offset = 0
        for size in sorted(held, reverse=True):
            slots.setdefault(size, []).append((ranks.get(size, 0), held[size], sequences, offset))
            ranks[size] = ranks.get(size, 0) + held[size] * times
            offset += size * held[size]
        sequences += times
    return Plan({k: np.array(v, dtype=np.int64) for k, v in slots.items()}, sequences)


def _placer(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column(batch.schema.get_field_index("length")))
            rank = np.asarray(batch.column(batch.schema.get_field_index("rank")))
            keep = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), *map(pa.array, plan.place(length, rank))],
                names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (ids of its document before
    it), ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset`` and, with ``keep_ids``, ``ids`` (binary, little-endian unsigned
    32-bit).

    Null and empty texts are the closing id alone. Null ids and repeated rows
    are packed like others. Other columns are not read.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_shipped(tokenizer_path))
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    ids = ", ids binary" if keep_ids else ""
    pieces = cut(rows.mapInArrow(_cutter(content, keep_ids), f"doc_id {kind}, start long, length long, ids_crc32 long, "
                                 f"doc_tokens long, task int, place long{ids}"))
    counts = cut(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    # One row per length.
    plan = make_plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()})
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    ranked = (pieces.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("place"))
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else []), "rank"))
    return ranked.mapInArrow(_placer(plan), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long{ids}, "
                             "sequence_id long, offset long")
