"""Near-duplicate embeddings (operator 3).

Random hyperplanes give each vector a bit per plane; several tables of bits
put vectors in buckets, and vectors that share a bucket and a label are
compared by exact cosine in double precision. Links make a graph whose
connected components are found by a distributed algorithm.

Exact copies count as one vector with a weight before anything is compared.
Large buckets are split into blocks and every pair of blocks is a group of its
own, so no task holds more than two blocks. A group reports, for each vector,
how many others it links to and one of them to hang on; never its pairs. A
pair that shares buckets in several tables counts in the first only.

Bits and tables follow from the number of vectors, so that buckets of
unrelated vectors keep their size at any scale and a pair at the threshold
is found with probability :data:`RECALL`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.llm.common import column_of, cut, packed, streamed_groups
from pallium.llm.components import connected_components

THRESHOLD = 0.93
RECALL = 0.995
#: Vectors in a bucket if directions were uniform.
BUCKET = 64
#: Vectors in a block of a split bucket.
BLOCK = 512
SEED = 20_231


def tables_for(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a table and number of tables for ``n`` vectors of a label."""
    bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / BUCKET)) if n > BUCKET else 4))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, 1 if same >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def usable(embedding: Column, label: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return label.isNotNull() & embedding.isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0)


def _signer(bits: int, tables: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            vectors = [np.array(v, dtype="<f8") for v in column_of(batch, "embedding")]
            rows, signs = [None] * len(vectors), [None] * len(vectors)
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes).tolist():
                if size not in planes:
                    planes[size] = np.random.default_rng([SEED, size]).standard_normal((size, bits * tables))
                which = np.flatnonzero(sizes == size)
                x = np.stack([vectors[i] for i in which])
                x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow below
                keys = (x @ planes[size] >= 0).reshape(len(which), tables, bits) @ weights
                for i, k in zip(which, keys, strict=True):
                    rows[i], signs[i] = packed(vectors[i], kind), k.astype(np.int32).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int32()), pa.array(rows, pa.binary()),
                 pa.array(signs, pa.list_(pa.int32()))], names=["label", "rep", "copies", "dim", "vector", "keys"])

    return run


def _comparer(threshold: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in streamed_groups(batches, ["label", "dim", "t", "bucket", "i", "j"]):
            if group.num_rows < 2:
                continue
            t, i, j = key[2], key[4], key[5]
            ids = group["rep"].to_numpy()
            copies = group["copies"].to_numpy()
            x = np.frombuffer(b"".join(group["vector"].to_pylist()), dtype=kind).reshape(len(ids), -1).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            norms = np.sqrt((x * x).sum(axis=1))
            near = (x @ x.T) / np.outer(norms, norms) >= threshold
            if i != j:
                mine = group["mine"].to_numpy()
                near &= mine[:, None] != mine[None, :]
            a, b = np.nonzero(np.triu(near, 1))
            if t and len(a):
                keys = np.array(group["keys"].to_pylist(), dtype=np.int32)[:, :t]
                new = np.concatenate([~(keys[a[s:s + 65536]] == keys[b[s:s + 65536]]).any(axis=1)
                                      for s in range(0, len(a), 65536)])
                a, b = a[new], b[new]
            if not len(a):
                continue
            links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
            root = np.arange(len(ids))
            while True:  # smallest row reachable within the group
                lower = root.copy()
                np.minimum.at(lower, a, root[b])
                np.minimum.at(lower, b, root[a])
                lower = lower[lower]
                if (lower == root).all():
                    break
                root = lower
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(ids[root[hit]])],
                names=["rep", "links", "root"])

    return run


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``vec_id``, ``n_links`` (other rows linked directly), ``component_id``
    (the smallest vec_id reachable) and ``kept`` of every row.

    Rows with a null label, id or vector, or a vector that is zero, empty or holds null
    or non-finite components, link with nothing. Only vectors of equal length
    are compared. Repeated rows count as further vectors. Only vec_id, label
    and embedding are read.
    """
    base = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.coalesce(usable(F.col("embedding"), F.col("label")) & F.col("vec_id").isNotNull(), F.lit(False))
    kind = "<f4" if "float" in rows.schema["embedding"].dataType.simpleString() else "<f8"
    alone = base.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linkable = base.filter(good)
    classes = cut(linkable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))

    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, threshold, recall)
    label_type = classes.schema["label"].dataType.simpleString()
    signed = cut(classes.select("label", "rep", "copies", "embedding").mapInArrow(
        _signer(bits, tables, kind),
        f"label {label_type}, rep long, copies long, dim int, vector binary, keys array<int>"))
    bucket = ["label", "dim", "t", "bucket"]
    spread = signed.select("*", F.posexplode("keys").alias("t", "bucket"))
    large = (signed.select("label", "dim", F.posexplode("keys").alias("t", "bucket")).groupBy(*bucket).count()
             .filter(F.col("count") > BLOCK)
             .select(*bucket, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    dealt = (spread.join(large, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("mine", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))))
    cells = dealt.select(*bucket, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine",
                         "rep", "copies", "vector", "keys")
    cell = [*bucket, "i", "j"]
    found = cut(cells.repartition(*cell).sortWithinPartitions(*cell, "rep").mapInArrow(
        _comparer(threshold, kind), "rep long, links long, root long"))

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    judged = (classes.join(links, "rep", "left").join(parts, classes["rep"] == parts["id"], "left")
              .select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                      F.coalesce("component", "rep").alias("component_id")))
    linked = linkable.join(cut(judged), ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
