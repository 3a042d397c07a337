"""Whitening of embeddings (operator 12).

Every entry c of a vector becomes the integer ``floor(64 c) + 1000000``. Rows
with the same integers are one class with a multiplicity, so sums, covariance
and projection are worked out once per distinct vector: weighted by the
multiplicity (``weights="count"``, the fit list is every row) or by one
(``weights="one"``, every distinct vector counts once).

Sums are exact integers. Centred entries are exact as well, as ``n x - S``,
before they become doubles and enter the product; tasks add up their share of
the covariance, whose rows are then added over the tasks. The driver sees
sums and covariance alone (their size is that of a dimension, not of the
data) and finds the eigenvectors. Each distinct vector is whitened once and
joined back to its rows, those of a very frequent vector in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.common import column_of, cut, packed, slices, streamed_groups

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Components whose variance is a smaller part of the largest one's are none.
RANK = 1e-12
#: Longer vectors are refused: the covariance (dimensions squared) is held by
#: every task and by the driver.
MAX_DIMENSIONS = 4096
#: A vector with more than one in so many rows is joined in parts; there are
#: fewer such vectors than this, which bounds what is broadcast.
MOST_HOT = 2000
#: Rows of a part, at least.
PART_ROWS = 64
#: Integers are kept within this, far inside a long.
_FAR = 2.0**62
_ROWS = 4096


@dataclass
class Fit:
    """Rows fitted, exact sums and the components by falling variance."""

    n: int
    sums: list[int]
    trace: float = 0.0
    variances: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # a column each


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes: ``floor(64 c)`` without trailing zeros, in the
    narrowest integers that hold them, whose width comes first. Equal vectors
    have equal bytes."""
    kinds = [(b"\x02", "<i2", 2**15), (b"\x04", "<i4", 2**31), (b"\x08", "<i8", 2**63)]
    for batch in slices(batches, _ROWS):
        column = batch.column(batch.schema.get_field_index("e"))
        ends = np.asarray(column.offsets)
        flat = np.asarray(column.values[ends[0]:ends[-1]], dtype=np.float64)
        ends = ends - ends[0]
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(flat * SCALE), -_FAR, _FAR).astype(np.int64)
        out = []
        for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            x = whole[s:e]
            used = np.flatnonzero(x)
            x = x[:used[-1] + 1] if len(used) else x[:0]
            most = max(int(x.max()), -int(x.min()) - 1) if len(x) else 0
            mark, kind, _ = next(k for k in kinds if most < k[2])
            out.append(mark + packed(x, kind))
        others = [i for i, name in enumerate(batch.schema.names) if name != "e"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), pa.array(out, pa.binary())],
                                         names=[*(batch.schema.names[i] for i in others), "x"])


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as integers ``floor(64 c) + 1000000``, one per row;
    shorter ones end in entries of c = 0."""
    out = np.full((len(rows), dim), SHIFT, dtype=np.int64)
    for i, b in enumerate(rows):
        x = np.frombuffer(b, f"<i{b[0]}", offset=1)
        out[i, :len(x)] += x
    return out


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    for batch in slices(batches, _ROWS):
        if batch.num_rows:
            rows = column_of(batch, "x")
            yield unpack(rows, dim), np.asarray(batch.column(batch.schema.get_field_index("weight"))), rows


def _summer(dim: int):
    """Exact sums of a task, one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        total = [0] * dim
        for x, weight, _ in _blocks(batches, dim):
            off = x - SHIFT
            most = int(np.abs(off).max(initial=0)) * int(weight.sum())
            kind = np.int64 if most < 2**62 else object
            part = (off.astype(kind) * weight.astype(kind)[:, None]).sum(axis=0)
            count = int(weight.sum())
            total = [t + int(p) + SHIFT * count for t, p in zip(total, part, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()),
                                          pa.array(map(Decimal, total), pa.decimal128(38, 0))], names=["i", "s"])

    return run


def deviations(x: np.ndarray, fit: Fit) -> np.ndarray:
    """``n x - S``, exact: longs where they fit, else Python's integers."""
    sums = np.array(fit.sums, dtype=object)
    most = max(int(np.abs(x).max(initial=0)) * fit.n, max(map(abs, fit.sums), default=0))
    if most < 2**62:
        return x * fit.n - sums.astype(np.int64)
    return x.astype(object) * fit.n - sums


def square_sums(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; None beyond a long."""
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2**63:
        return (d * d).sum(axis=1).tolist()
    made = (d.astype(object) ** 2).sum(axis=1) if d.shape[1] else np.zeros(len(d), dtype=object)
    return [int(v) if v < 2**63 else None for v in made]


def _product_rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(total), 256):
        part = total[s:s + 256]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(s, s + len(part)), pa.int32()), pa.array([packed(r, "<f8") for r in part], pa.binary())],
            names=["i", "row"])


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tasks' shares of a covariance row, added up."""
    for key, group in streamed_groups(batches, ["i"]):
        total = sum(np.frombuffer(b, "<f8") for b in group["row"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([packed(total, "<f8")], pa.binary())],
                                         names=["i", "row"])


def _added(shares: DataFrame, dim: int) -> np.ndarray:
    """A symmetric matrix from the tasks' shares of it: dim x dim doubles."""
    rows = shares.repartition("i").sortWithinPartitions("i", "row").mapInArrow(_add_rows, "i int, row binary").collect()
    out = np.zeros((dim, dim))
    for r in rows:
        out[r.i] = np.frombuffer(r.row, "<f8")
    return (out + out.T) / 2


def covariance(classes: DataFrame, fit: Fit) -> np.ndarray:
    """Covariance of the fit list (divisor n), centred before multiplying."""
    dim = len(fit.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for x, weight, _ in _blocks(batches, dim):
            centred = (deviations(x, fit) / fit.n).astype(np.float64)
            total += (centred * weight[:, None]).T @ centred
        yield from _product_rows(total / fit.n)

    return _added(classes.mapInArrow(run, "i int, row binary"), dim)


def components(fit: Fit, matrix: np.ndarray, most: int) -> Fit:
    """Unit eigenvectors by falling eigenvalue, the largest entry of each
    positive; those without variance are left out."""
    fit.trace = float(np.trace(matrix))
    if not len(matrix) or not fit.trace > 0:
        fit.vectors = np.zeros((len(matrix), 0))
        return fit
    scale = np.abs(matrix).max()
    values, vectors = np.linalg.eigh(matrix / scale)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > RANK * values[order[0]]]
    chosen = vectors[:, order]
    chosen = chosen * np.where(chosen[np.abs(chosen).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    fit.variances, fit.vectors = values[order] * scale, chosen
    return fit


def _whitener(fit: Fit):
    """To each distinct vector its exact deviation and its projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, weight, rows in _blocks(batches, len(fit.sums)):
            d = deviations(x, fit)
            made = (d / fit.n).astype(np.float64) @ fit.vectors / np.sqrt(fit.variances)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.binary()), pa.array(weight, pa.int64()), pa.array(square_sums(d), pa.int64()),
                 pa.array(list(made), pa.list_(pa.float64()))], names=["x", "weight", "deviation", "whitened"])

    return run


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest entry, by size, of the covariance of the whitened vectors minus
    the identity; centred at their own mean."""
    means = np.zeros(k)
    for r in (whitened.select("weight", F.posexplode("whitened").alias("i", "v")).groupBy("i")
              .agg((F.sum(F.col("v") * F.col("weight")) / n).alias("m")).collect()):  # k rows
        means[r.i] = r.m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in slices(batches, _ROWS):
            if batch.num_rows:
                centred = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) - means
                total += (centred * np.asarray(batch.column(0))[:, None]).T @ centred
        yield from _product_rows(total / n)

    found = _added(whitened.select("weight", "whitened").mapInArrow(run, "i int, row binary"), k)
    return float(np.abs(found - np.eye(k)).max(initial=0.0))


def whiten(rows: DataFrame, weights: str = "count", most: int = COMPONENTS, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``component`` (from 1, by falling variance), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``: one row
    for each row that takes part and each component, ``most`` at the most.

    Rows whose vector is null or holds null or non-finite entries are left
    out. A null id and repeated rows are rows like others. Shorter vectors
    count as if they ended in entries of 0. Integers beyond 2**62 are held at
    it; a deviation that no long holds is null. Components without variance
    (equal vectors, fewer distinct vectors than dimensions) are none, so a
    table of equal vectors, or an empty one, gives no rows. Of eigenvectors
    with equal variances any basis may come out, the same for all rows. Only
    the two columns named are read.
    """
    if weights not in ("count", "one"):
        raise ValueError("weights are 'count' or 'one'")
    spark = rows.sparkSession
    key = "id"
    given = rows.select(F.col(id_col).alias(key), F.col(vec_col).cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = given.filter(F.coalesce(F.col("e").isNotNull() & ~bad, F.lit(False)))
    kind = given.schema[key].dataType.simpleString()
    sized = good.select(key, "e", F.size("e").alias("size")).mapInArrow(_pack, f"{key} {kind}, size int, x binary")

    distinct = cut(sized.groupBy("x").agg(F.count(F.lit(1)).alias("copies"), F.max("size").alias("size")))
    classes = distinct.select("x", (F.col("copies") if weights == "count" else F.lit(1).cast("long")).alias("weight"))
    total, n, dim = distinct.agg(F.sum("copies"), F.sum("copies") if weights == "count" else F.count(F.lit(1)), F.max("size")).first()
    schema = (f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    if not total or not dim:
        return spark.createDataFrame([], schema)
    if dim > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {dim} entries; {MAX_DIMENSIONS} are the most")
    sums = {r.i: int(r.s) for r in classes.mapInArrow(_summer(dim), "i int, s decimal(38,0)").groupBy("i").agg(
        F.sum("s").alias("s")).collect()}  # a row per dimension
    fit = Fit(int(n), [sums[i] for i in range(dim)])
    fit = components(fit, covariance(classes, fit), most)
    k = len(fit.variances)
    if not k:
        return spark.createDataFrame([], schema)
    whitened = cut(classes.mapInArrow(_whitener(fit), "x binary, weight long, deviation long, whitened array<double>"))
    error = identity_error(whitened, fit.n, k)

    # The rows of a frequent vector are dealt out in parts, each with a copy of its class.
    most_rows = max(PART_ROWS, total // MOST_HOT)
    hot = F.broadcast(distinct.filter(F.col("copies") > most_rows)
                      .select("x", F.ceil(F.col("copies") / most_rows).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = (sized.select(key, "x").join(hot, "x", "left")
             .withColumn("part", F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), parts).cast("int")))
    copies = whitened.join(hot, "x", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    back = dealt.select(key, "x", "part").join(copies.select("x", "part", "deviation", "whitened"), ["x", "part"])
    explained = F.array(*[F.lit(float(v) / fit.trace) for v in fit.variances])
    return back.select(key, "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col(key).alias(id_col), (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
