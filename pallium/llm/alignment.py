"""Cross-tokenizer alignment (operator 13).

A text with a space before it is encoded by two tokenizers, A (byte-level BPE)
and B (sentence pieces). Byte offsets where tokens of both end cut the tokens
into groups; tokens of the two sides whose byte ranges overlap are linked, and
a pair of ids counts in how many documents it is linked.

Counting is external. Tasks align documents by the chunk, whose pair-document
records are sorted by pair (side A first) and kept compressed. What travels is
the chunk's distinct pairs with their numbers of documents: they are dealt out
by the radix of (mixed) A ids into zstd runs, so that all pairs of an A id meet
in one partition, a pair at most once a chunk however many documents hold it.
A k-way merge over a heap of the runs' frames counts each pair and streams the
counts back to the chunks, run by run, in the order in which they came; as
pairs come in the order of A, the largest count of each A id is known as the
id passes. Those maxima, one number per id of A's vocabulary, are broadcast,
and each chunk adds up its documents' shares.

Memory: a chunk, a window of frames and the compressed frames of a partition;
partitions are as many as keep the pairs of one below :data:`PARTITION`.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.common import cut, id_and_text, read_shipped, slices, streamed_groups
from pallium.llm.encoding import byte_bpe, is_plain

#: Tokens (of both sides) of a chunk of documents; a longer document is one of its own.
CHUNK = 1 << 21
#: Pairs of a radix partition, on average; pairs of a frame; of a merge's window.
PARTITION, FRAME, WINDOW = 1 << 22, 1 << 16, 1 << 20
#: Counts held before a merge writes them out.
HELD = 1 << 22

_LOW = np.uint64(0xFFFFFFFF)
#: Mixes A ids, whose order follows frequency, over the radix; odd, so it can be undone.
_MIX = 0x9E3779B1
_BACK = np.uint64(pow(_MIX, -1, 1 << 32))


def mixed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) * np.uint64(_MIX) & _LOW


def side_a(keys: np.ndarray) -> np.ndarray:
    """The A ids of pair keys."""
    return ((keys >> np.uint64(32)) * _BACK & _LOW).astype(np.int64)


def squeezed(values: np.ndarray, kind: str) -> bytes:
    """An array of integers as compressed byte planes; small values have empty upper planes."""
    flat = np.ascontiguousarray(values, dtype=kind)
    return zstandard.ZstdCompressor(level=3).compress(flat.view(np.uint8).reshape(len(flat), flat.itemsize).T.tobytes())


def unsqueezed(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def steps(values: np.ndarray) -> np.ndarray:
    """Differences to the value before, modulo the type's range."""
    out = values.copy()
    out[1:] -= values[:-1]
    return out


class Sides:
    """The two tokenizers with the bytes of their tokens."""

    def __init__(self, content_a: bytes, content_b: bytes):
        from sentencepiece import SentencePieceProcessor

        self.a = byte_bpe(content_a, special=False)
        self.b = SentencePieceProcessor(model_proto=content_b)
        size_a, size_b = max(self.a.strings) + 1, self.b.vocab_size()
        self.bytes_a = [self.a.strings.get(i, b"") for i in range(size_a)]
        pieces = [self.b.id_to_piece(i) for i in range(size_b)]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        #: written ids: of A inside and at the end of its part of a group, then of B
        self.written = ([b"%d%c" % (i, c) for i in range(size_a) for c in b",|"]
                        + [b"%d%c" % (i, c) for i in range(size_b) for c in b",;"])
        self.written_b = 2 * size_a

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of texts on both sides; None for the empty text and where the
        tokens' bytes are not the text's."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            if not text:
                out.append(None)
                continue
            data = b" " + text.encode()
            a, b = self.a.ids(" " + text), np.array(b, np.int64)
            same = b"".join(map(self.bytes_b.__getitem__, b.tolist())) == data and self.length_b[b].all()
            # The faster encoder cuts a text's bytes and so keeps them.
            if same and not is_plain(text):
                same = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == data
            out.append((a.astype(np.int64), b) if same else None)
        return out


@lru_cache(maxsize=1)
def sides_of(content_a: bytes, content_b: bytes) -> Sides:
    return Sides(content_a, content_b)


@dataclass
class Aligned:
    """Documents aligned at once; arrays hold one entry a document, links one a link."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    link_doc: np.ndarray
    link_key: np.ndarray


def align(sides: Sides, encoded: list[tuple[np.ndarray, np.ndarray] | None]) -> Aligned:
    """Groups and links of documents, all in one go: their bytes follow each
    other, and a document's end is an end on both sides."""
    n_a = np.array([len(x[0]) if x else 0 for x in encoded], np.int64)
    n_b = np.array([len(x[1]) if x else 0 for x in encoded], np.int64)
    none = np.zeros(0, np.int64)
    a = np.concatenate([none, *(x[0] for x in encoded if x)])
    b = np.concatenate([none, *(x[1] for x in encoded if x)])
    end_a, end_b = np.cumsum(sides.length_a[a]), np.cumsum(sides.length_b[b])
    ends = np.concatenate([end_a, end_b])
    ends.sort(kind="stable")
    again = np.zeros(len(ends), bool)
    again[1:] = ends[1:] == ends[:-1]
    common, parts = ends[again], ends[~again]
    doc_end = np.concatenate([[0], end_a])[np.cumsum(n_a)]
    with_tokens = np.flatnonzero(n_a)

    def per_doc(at: np.ndarray) -> np.ndarray:
        return with_tokens[np.searchsorted(doc_end[with_tokens], at)]

    # Between two neighbouring ends lies one token of each side: one link.
    link_doc = per_doc(parts)
    keys = mixed(a[np.searchsorted(end_a, parts)]) << np.uint64(32) | b[np.searchsorted(end_b, parts)].astype(np.uint64)
    docs = len(encoded)

    group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    count_a, count_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
    items = np.zeros(len(a) + len(b), np.int64)
    if len(common):
        before_b, upto_a = np.cumsum(count_b) - count_b, np.cumsum(count_a)
        items[np.arange(len(a)) + before_b[group_a]] = 2 * a + (common[group_a] == end_a)
        items[np.arange(len(b)) + upto_a[group_b]] = sides.written_b + 2 * b + (common[group_b] == end_b)
    digests, at, write = [], 0, sides.written.__getitem__
    for n in (n_a + n_b).tolist():
        if n:
            digests.append(hashlib.sha256(b"".join(map(write, items[at:at + n].tolist()))[:-1]).hexdigest())
            at += n
        else:
            digests.append("")
    return Aligned(n_a, n_b, np.bincount(per_doc(common), minlength=docs), np.bincount(link_doc, minlength=docs), digests,
                   link_doc, keys)


_DOC_FIELDS = "ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>"
#: Distinct pairs of a chunk as differences of their keys, with their numbers
#: of documents; records by document: how many, places of their pairs, links.
_PAIR_FIELDS = "n_pairs long, pairs binary, held binary, n_records array<long>, places binary, links binary"


def _aligner(content_a, content_b, kind: pa.DataType, chunk_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sides = sides_of(content_a.value, content_b.value)
        task, made = TaskContext.get().partitionId(), 0
        ids, encoded, held = [], [], 0

        def flush() -> pa.RecordBatch:
            found = align(sides, encoded)
            pairs, place = np.unique(found.link_key, return_inverse=True)
            size = max(len(pairs), 1)
            record, links = np.unique(found.link_doc * size + place, return_counts=True)
            place, doc = record % size, record // size
            values = [
                ([(task << 32) + made], pa.int64()), ([ids], pa.list_(kind)),
                *(([list(x)], pa.list_(pa.int64())) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)),
                ([found.digests], pa.list_(pa.string())), ([len(pairs)], pa.int64()), ([squeezed(steps(pairs), "<u8")], pa.binary()),
                ([squeezed(np.bincount(place, minlength=len(pairs)), "<u4")], pa.binary()),
                ([list(np.bincount(doc, minlength=len(ids)))], pa.list_(pa.int64())),
                ([squeezed(steps(place.astype(np.uint32)), "<u4")], pa.binary()), ([squeezed(links, "<u4")], pa.binary())]
            names = ["chunk", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "n_pairs", "pairs", "held", "n_records",
                     "places", "links"]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in values], names=names)

        for batch in slices(batches, 100):
            for doc_id, x in zip(batch.column(0), sides.encode(batch.column(1).to_pylist()), strict=True):
                size = len(x[0]) + len(x[1]) + 16 if x else 16
                if encoded and held + size > chunk_size:
                    yield flush()
                    made, ids, encoded, held = made + 1, [], [], 0
                ids.append(doc_id.as_py())
                encoded.append(x)
                held += size
        if encoded:
            yield flush()

    return run


def _dealer(bits: int):
    """A chunk's pairs as runs, one for each radix of A, in frames."""
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, held in zip(*(batch.column(i) for i in range(3)), strict=True):
                keys = np.cumsum(unsqueezed(pairs.as_py(), "<u8"), dtype=np.uint64)
                counts = unsqueezed(held.as_py(), "<u4")
                edges = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                frames = [(part, at, min(at + FRAME, e)) for part, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True))
                          for at in range(s, e, FRAME)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in frames], pa.int32()), pa.array([chunk.as_py()] * len(frames), pa.int64()),
                     pa.array([f[1] for f in frames], pa.int64()),
                     pa.array([keys[f[1]] for f in frames], pa.uint64()).view(pa.int64()),
                     pa.array([squeezed(steps(keys[s:e]), "<u8") for _, s, e in frames], pa.binary()),
                     pa.array([squeezed(counts[s:e], "<u4") for _, s, e in frames], pa.binary())],
                    names=["part", "chunk", "at", "first", "pairs", "held"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs of a radix partition's runs, back in the runs'
    order (chunk >= 0), and the largest of each A id (chunk = -1)."""
    def rows(chunk: list, part: list, at: list, data: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(part, pa.int32()), pa.array(at, pa.int64()),
                                           pa.array(data, pa.binary())], names=["chunk", "part", "at", "data"])

    for (part,), group in streamed_groups(batches, ["part"]):
        chunk, at = group["chunk"].to_numpy(), group["at"].to_numpy()
        first = group["first"].to_numpy().view(np.uint64)
        # A run's frames follow each other; the heap holds the next one of each run.
        new = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        last = np.concatenate([new[1:], [len(chunk)]])
        heap = [(int(first[f]), r, f) for r, f in enumerate(new.tolist())]
        heapq.heapify(heap)
        pending = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        out: list[list] = [[] for _ in new]
        sent = at[new].copy()
        kept = 0
        top_a, top, maxima = -1, 0, []

        def flush() -> pa.RecordBatch:
            full = [r for r, x in enumerate(out) if x]
            data = [np.concatenate(out[r]) for r in full]
            made = rows([int(chunk[new[r]]) for r in full], [part] * len(full), [int(sent[r]) for r in full],
                        [squeezed(x, "<u8") for x in data])
            for r, x in zip(full, data, strict=True):
                sent[r] += len(x)
                out[r] = []
            return made

        while heap or len(pending[0]):
            taken, size, aim = [pending], 0, max(WINDOW, len(pending[0]))
            while heap and size < aim:
                _, r, f = heapq.heappop(heap)
                keys = np.cumsum(unsqueezed(group["pairs"][f].as_py(), "<u8"), dtype=np.uint64)
                taken.append((keys, unsqueezed(group["held"][f].as_py(), "<u4").astype(np.int64), np.full(len(keys), r)))
                size += len(keys)
                if f + 1 < last[r]:
                    heapq.heappush(heap, (int(first[f + 1]), r, f + 1))
            keys, counts, run = (np.concatenate(x) for x in zip(*taken, strict=True))
            # No run has a pair below the least that is still to come.
            done = keys < np.uint64(heap[0][0]) if heap else np.ones(len(keys), bool)
            pending = keys[~done], counts[~done], run[~done]
            keys, counts, run = keys[done], counts[done], run[done]
            if not len(keys):
                continue
            order = np.argsort(keys, kind="stable")
            begins = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
            total = np.add.reduceat(counts[order], begins)
            a = side_a(keys[order][begins])
            whole = np.empty(len(keys), np.int64)
            whole[order] = np.repeat(total, np.diff(np.concatenate([begins, [len(keys)]])))
            by_run = np.argsort(run, kind="stable")
            cuts = np.flatnonzero(np.diff(run[by_run])) + 1
            for x in np.split(by_run, cuts):
                out[run[x[0]]].append(whole[x])
            kept += len(keys)
            begin_a = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            best, ids = np.maximum.reduceat(total, begin_a), a[begin_a]
            if ids[0] == top_a:
                best[0] = max(best[0], top)
            elif top_a >= 0:
                maxima.append((top_a, top))
            maxima += zip(ids[:-1].tolist(), best[:-1].tolist(), strict=True)
            top_a, top = int(ids[-1]), int(best[-1])
            if kept >= HELD:
                yield flush()
                kept = 0
        yield flush()
        maxima.append((top_a, top))
        yield rows([-1], [part], [0], [np.array(maxima, "<i8").tobytes()])


def _adder(maxima, kind: pa.DataType):
    """Documents' sums from the counts of their chunk's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = maxima.value
        for _, group in streamed_groups(batches, ["chunk"]):
            which = group["what"].to_pylist()
            if which[0] != 0:
                continue  # its chunk holds no document
            row = {name: group[name][0] for name in group.column_names}
            keys = np.cumsum(unsqueezed(row["pairs"].as_py(), "<u8"), dtype=np.uint64)
            counts = np.concatenate([np.zeros(0, np.int64), *(unsqueezed(x.as_py(), "<u8").astype(np.int64) for x in group["data"][1:])])
            if len(counts) != len(keys):
                raise RuntimeError(f"{len(counts)} counts for {len(keys)} pairs of a chunk")
            best = counts == top[side_a(keys)]
            place = np.cumsum(unsqueezed(row["places"].as_py(), "<u4"), dtype=np.uint32)
            links = unsqueezed(row["links"].as_py(), "<u4").astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(row["n_records"].as_py())]).astype(np.int64)

            def by_doc(values: np.ndarray, ends: np.ndarray = ends) -> pa.Array:
                sums = np.concatenate([[0], np.cumsum(values)])
                return pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())

            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"].as_py(), kind), *(pa.array(row[c].as_py(), pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                 by_doc(links * best[place]), by_doc(links * counts[place]), pa.array(row["digests"].as_py(), pa.string())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                    chunk: int = CHUNK, partition: int = PARTITION) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum`` and ``groups_sha256`` of every row.

    Null and empty texts, and texts whose tokens' bytes are not the text's on
    either side, have no tokens: zeros and an empty digest. Every row is a
    document, also one that repeats an id or a text or has a null id. Other
    columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    content_a, content_b = (spark.sparkContext.broadcast(read_shipped(p)) for p in (path_a, path_b))
    rows = id_and_text(docs, id_col, text_col)
    field = rows.schema["doc_id"].dataType
    kind, name = to_arrow_type(field), field.simpleString()
    chunks = cut(rows.mapInArrow(_aligner(content_a, content_b, kind, chunk),
                                 f"chunk long, {_DOC_FIELDS.format(kind=name)}, {_PAIR_FIELDS}"))

    pairs = chunks.agg(F.sum("n_pairs")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(0, (max(least, -(-int(pairs) // partition)) - 1).bit_length())
    runs = (chunks.filter("n_pairs > 0").select("chunk", "pairs", "held")
            .mapInArrow(_dealer(bits), "part int, chunk long, at long, first long, pairs binary, held binary"))
    counted = cut(runs.repartition(1 << bits, "part").sortWithinPartitions("part", "chunk", "at")
                  .mapInArrow(_merge, "chunk long, part int, at long, data binary"))

    # A number for each id of A's vocabulary.
    found = [np.frombuffer(r.data, "<i8").reshape(-1, 2) for r in counted.filter("chunk < 0").select("data").collect()]
    found = np.concatenate([np.zeros((1, 2), np.int64), *found])
    top = np.zeros(found[:, 0].max() + 1, np.int64)
    np.maximum.at(top, found[:, 0], found[:, 1])
    maxima = spark.sparkContext.broadcast(top)

    kept = [c for c in chunks.columns if c not in ("n_pairs", "held")]
    own = chunks.select(F.lit(0).alias("what"), *kept, F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"),
                        F.lit(None).cast("binary").alias("data"))
    back = counted.filter("chunk >= 0").select(F.lit(1).alias("what"), "chunk", "part", "at", "data")
    return (own.unionByName(back, allowMissingColumns=True).repartition("chunk")
            .sortWithinPartitions("chunk", "what", "part", "at")
            .mapInArrow(_adder(maxima, kind), f"doc_id {name}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                        "count_sum long, groups_sha256 string"))
