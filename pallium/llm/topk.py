"""Exact top-k search by inner product (operator 5).

Vectors become integers and are given one more coordinate that makes all their
norms equal; then the nearest vectors are those of the largest inner product,
and distance obeys the triangle inequality. Every vector is keyed by its
nearest pivot and its distance to it: a cell is an annulus around a pivot. For
a query at distance d from the pivot, no vector of an annulus [lo, hi] is
nearer than max(0, d - hi, lo - d), which bounds its score from above.

A query first searches the annuli with the best bounds, until they hold enough
vectors. Its k-th score so far then excludes every annulus whose bound is
lower; the rest are searched. Cells are split into blocks, each a group that
holds one block while its queries stream past. Pivots are fitted on a bounded
sample; all rows are indexed and results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pallium.llm.common import column_of, cut, packed

SCALE = 1024
#: Rows on which pivots and annuli are fitted.
SAMPLE = 4096
#: Vectors aimed at in a cell, most pivots, most annuli of a pivot.
CELL, MAX_PIVOTS, MAX_ANNULI = 1024, 128, 64
#: Vectors in a block of a large cell.
BLOCK = 2048
#: The first search stops when its cells hold so many times k vectors.
AHEAD = 4
#: Integers up to this are exact in double precision; sums of products below
#: this in a long; components are held within this.
EXACT, FITS, FAR = 2**53, 2**63, 2**62


@dataclass
class Index:
    """Fitted pivots and, once all rows are in, what each cell holds."""

    dim: int
    kind: str
    exact: bool
    top: float  # the common squared norm
    pivots: np.ndarray  # with the added coordinate
    edges: np.ndarray  # inner edges of each pivot's annuli
    cells: np.ndarray | None = None  # cell, rows, least and greatest distance

    def added(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        rest = np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))
        return np.column_stack([x, rest])

    def distances(self, x: np.ndarray) -> np.ndarray:
        square = (x * x).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def key(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(self.added(x))
        pivot = d.argmin(axis=1)
        r = d[np.arange(len(x)), pivot]
        annulus = (self.edges[pivot] < r[:, None]).sum(axis=1)
        return pivot * (self.edges.shape[1] + 1) + annulus, r

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The highest score that each query can have in each cell, with room
        for the rounding of the distances."""
        x = np.column_stack([q.astype(np.float64), np.zeros(len(q))])
        cell, low, high = self.cells[:, 0].astype(int), self.cells[:, 2], self.cells[:, 3]
        d = self.distances(x)[:, cell // (self.edges.shape[1] + 1)]
        square = (x * x).sum(axis=1)[:, None] + self.top
        slack = 1e-6 * np.sqrt(square)
        least = np.maximum(np.maximum(d - high, low - d) - slack, 0)
        return np.maximum((square - least**2) / 2 + 1e-9 * square, -float(FITS))


def scores(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of all rows of q and x: by doubles where those are exact,
    by longs where they fit, else by Python's integers, held within a long."""
    if exact:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    peaks = [max(int(v.max(initial=0)), -int(v.min(initial=0))) for v in (q, x)]
    if peaks[0] * peaks[1] * max(q.shape[1], 1) < FITS:
        return q.astype(np.int64) @ x.astype(np.int64).T
    made = q.astype(object) @ x.astype(object).T
    return np.clip(made, -FITS, FITS - 1).astype(np.int64)


def integers(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vec`` (array<long>) of the rows that take part: id and
    vector given, all components finite."""
    e = F.col(vec_col).cast("array<double>")
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (rows.select(F.col(id_col).cast("long").alias("vec_id"), e.alias("e"))
            .filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~bad)
            .select("vec_id", F.transform("e", lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-float(FAR))), F.lit(float(FAR))))
                                          .cast("long")).alias("vec")))


def _padded(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def fit(vectors: DataFrame) -> tuple[Index, int] | None:
    """Pivots and annuli, and the number of rows; None for an empty table."""
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    largest = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: F.greatest(s, F.abs(x)))
    n, dim, top, peak = vectors.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(square), F.max(largest)).first()
    if not n:
        return None
    dim = max(dim, 1)
    kind = next(k for k, most in (("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**64)) if (peak or 0) < most)
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    index = Index(dim, kind, float(peak or 0) ** 2 * dim < EXACT, top or 0.0, np.zeros((1, dim + 1)), np.zeros((1, 0)))
    x = index.added(_padded([r.vec for r in rows], dim))
    cells = max(1, n // CELL)
    pivots = max(1, min(MAX_PIVOTS, round(math.sqrt(cells)), len(x)))
    annuli = max(1, min(MAX_ANNULI, math.ceil(cells / pivots)))
    index.pivots = x[np.linspace(0, len(x) - 1, pivots).astype(int)]
    for _ in range(8):  # k-means
        near = index.distances(x).argmin(axis=1)
        index.pivots = np.stack([x[near == p].mean(axis=0) if (near == p).any() else index.pivots[p] for p in range(pivots)])
    d = index.distances(x)
    near, r = d.argmin(axis=1), d.min(axis=1)
    places = np.arange(1, annuli) / annuli
    index.edges = np.stack([np.quantile(r[near == p] if (near == p).any() else r, places) for p in range(pivots)])
    return index, n


def _keyer(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _padded(column_of(batch, "vec"), index.dim)
            cell, r = index.key(x) if len(x) else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cell.astype(np.int32)), pa.array(r),
                 pa.array([packed(v, index.kind) for v in x], pa.binary())], names=["vec_id", "cell", "r", "vec"])

    return run


def _router(index: Index, k: int, first: bool):
    """Queries to the cells they have to search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held = index.cells[:, 0].astype(np.int32), index.cells[:, 1]
        for batch in batches:
            ids, vecs, least = (column_of(batch, c) for c in ("vec_id", "vec", "least"))
            for s in range(0, len(ids), 256):
                q = np.frombuffer(b"".join(vecs[s:s + 256]), dtype=index.kind).reshape(-1, index.dim)
                bounds = index.bounds(q)
                best = np.argsort(-bounds, axis=1, kind="stable")
                before = np.cumsum(held[best], axis=1) - held[best]
                ahead = np.zeros(bounds.shape, dtype=bool)
                np.put_along_axis(ahead, best, before < AHEAD * k + 1, axis=1)
                low = np.array([-np.inf if v is None else v for v in least[s:s + 256]], dtype=np.float64)
                asked = ahead if first else ~ahead & (bounds >= low[:, None])
                a, b = np.nonzero(asked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells[b]), pa.array([ids[s + i] for i in a], pa.int64()),
                     pa.array([vecs[s + i] for i in a], pa.binary()),
                     pa.array([least[s + i] for i in a], pa.int64())], names=["cell", "vec_id", "vec", "least"])

    return run


def _searcher(index: Index, k: int):
    """Best k of each block for each query that streams past it. A block's
    rows (asks = 0) come before its queries (asks = 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, data = None, np.zeros(0, np.int64), np.zeros((0, index.dim), np.int64)
        for batch in batches:
            cell, part, asks = (np.asarray(batch.column(i)) for i in range(3))
            ends = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(asks) != 0)) + 1
            for s, e in zip([0, *ends], [*ends, len(cell)], strict=True):
                if s == e:
                    continue
                run_ids = np.asarray(batch.column(3)[s:e])
                x = np.frombuffer(b"".join(batch.column(4)[s:e].to_pylist()), dtype=index.kind).reshape(-1, index.dim)
                if not asks[s]:
                    fresh = block != (cell[s], part[s])
                    ids = run_ids if fresh else np.concatenate([ids, run_ids])
                    data = x if fresh else np.concatenate([data, x])
                    block = (cell[s], part[s])
                    continue
                if block != (cell[s], part[s]):
                    continue  # this block holds no rows
                least = [-(2**63) if v is None else v for v in batch.column(5)[s:e].to_pylist()]
                for at in range(0, len(x), 256):
                    score = scores(x[at:at + 256], data, index.exact)
                    out_q, out_v, out_s = [], [], []
                    for row in range(len(score)):
                        own = run_ids[at + row]
                        may = np.flatnonzero((ids != own) & (score[row] >= least[at + row]))
                        if len(may) > k:
                            floor = np.partition(score[row][may], len(may) - k)[len(may) - k]
                            may = may[score[row][may] >= floor]
                        may = may[np.lexsort((ids[may], ~score[row][may]))[:k]]
                        out_q.append(np.full(len(may), own))
                        out_v.append(ids[may])
                        out_s.append(score[row][may])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c).astype(np.int64)) for c in (out_q, out_v, out_s)],
                        names=["query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: for every row
    that fulfils ``is_query`` (an expression over vec_id) the ``k`` best other
    rows by integer inner product, ties to the smaller vec_id.

    Rows with a null id, or a vector that is null or holds null or non-finite
    components, take no part. Shorter vectors score as if they ended in zeros.
    A repeated row is a further candidate; a query id that repeats is asked
    once, and no row with the query's id answers it. Scores are exact; one that
    no long holds is held at the long's end. Components whose integer would be
    beyond 2**62 are held there.
    """
    spark = rows.sparkSession
    vectors = integers(rows, id_col, vec_col)
    fitted = fit(vectors)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index, _ = fitted
    keyed = cut(vectors.mapInArrow(_keyer(index), "vec_id long, cell int, r double, vec binary"))
    # At most MAX_PIVOTS x MAX_ANNULI rows.
    cells = keyed.groupBy("cell").agg(F.count(F.lit(1)), F.min("r"), F.max("r")).orderBy("cell").collect()
    index.cells = np.array([tuple(c) for c in cells], dtype=np.float64)
    parts = spark.createDataFrame([(c[0], -(-c[1] // BLOCK)) for c in cells], "cell int, parts int")
    data = (keyed.join(F.broadcast(parts), "cell")
            .select("cell", F.pmod(F.xxhash64("vec_id", "vec"), "parts").cast("int").alias("part"), F.lit(0).alias("asks"),
                    "vec_id", "vec", F.lit(None).cast("long").alias("least")))
    queries = keyed.filter(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"))

    def answers(asked: DataFrame, first: bool) -> DataFrame:
        routed = (asked.mapInArrow(_router(index, k, first), "cell int, vec_id long, vec binary, least long")
                  .join(F.broadcast(parts), "cell")
                  .select("cell", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(1).alias("asks"),
                          "vec_id", "vec", "least"))
        group = ["cell", "part"]
        return (data.unionByName(routed).repartition(*group).sortWithinPartitions(*group, "asks", "vec_id")
                .mapInArrow(_searcher(index, k), "query_id long, vec_id long, score long"))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ahead = cut(answers(queries.withColumn("least", F.lit(None).cast("long")), True)
                .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    kth = ahead.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    rest = answers(queries.join(kth, "vec_id", "left").select("vec_id", "vec", "least"), False)
    return (ahead.drop("rank").unionByName(rest).withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
