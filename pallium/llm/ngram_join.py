"""N-gram Jaccard join of documents (operator 9).

Adaptive multi-match prefixes: shingles have one global order, rare ones
first. If two documents are similar, the l-prefixes of both (the first
``n - ceil(0.75 n) + l`` shingles) share at least l shingles, for any l. A
document chooses the l whose estimated cost, from the frequencies of the
shingles in its prefix, is least: a longer prefix means more list entries to
read but demands more shared shingles before a pair is verified. How many a
pair must share follows from both sizes and both l (:func:`demanded`).

How the work is kept small and even:

* Documents with equal shingle sets are one class, and its carrier stands for it.
* Only shingles in the lowest part of the hash space, which come first in the
  global order, are counted and sorted by frequency; the others follow by
  hash, and only as many as a prefix can reach are kept. Any consistent order
  gives exact results.
* Shingles travel in packed blocks, each block's own once per chunk of
  documents, so a shingle that a third of the documents hold adds no more rows
  than there are chunks.
* Shingles of a single document can match nothing and are dropped.
* Documents are first verified against leaders of their lists, those with the
  most shared shingles in their prefix. What is then linked needs no further
  pairs; only pairs across components remain, and those are met in the first
  list that they share, filtered and verified all. Long lists are dealt out in
  pairs of blocks, and a leader's many followers in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pallium.llm.common import column_of, cut, packed, slices, streamed_groups
from pallium.llm.components import connected_components

WORDS = 5
#: Similar: PERCENT * union <= 100 * intersection.
PERCENT = 75
#: The values of l that a document chooses from.
MATCHES = (1, 2, 4, 8, 16)
#: Part of the hash space whose shingles are ordered by frequency.
COUNTED = 0.45
#: Cost of verifying a candidate, per shingle, in list entries read.
VERIFY_COST = 0.05
#: Shingles of a chunk of documents, of a bucket of the hash space, entries of
#: a block of a long list, followers in a part.
CHUNK, BUCKET, BLOCK, PART = 1 << 18, 1 << 18, 256, 256
#: Bits of a document's mark, a hashed bitmap of its whole set.
MARK = 2048
#: Entries of a document by which its pairs are known from earlier lists.
FIRST = 3
#: Pairs up to this many are joined to the texts by broadcast, more by shuffle.
BROADCAST_ROWS = 1_000_000
#: Rounds in which documents are verified against leaders before all pairs are:
#: leaders of a list, and leaders that a document tries.
LEADER_ROUNDS = ((1, 1), (4, 2), (8, 2))

_LIMIT = np.uint64(int(COUNTED * 2**64))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def shingles(text: bytes) -> np.ndarray:
    """Distinct 64-bit shingle hashes of a UTF-8 text, ascending.

    Words are separated by space and the characters 9 to 13, A-Z lower-cased;
    a text of one to four words is one shingle, one without words has none.
    """
    words = text.lower().split()  # of bytes: ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out *= _BASE
        out += h[k:len(h) - size + 1 + k]
    for m in _MIX:
        out ^= out >> np.uint64(33)
        out *= m
    return np.unique(out ^ (out >> np.uint64(33)))


def needed(n: np.ndarray | int):
    """The least overlap of a set of n shingles with a similar one."""
    return -(-n * PERCENT // 100)


def demanded(n, l, n2, l2, least):
    """Prefix shingles that two documents must share to be similar; for
    columns and arrays alike.

    Let the first one's prefix end first in the global order. Then what it
    shares beyond its prefix is no more than its rest, needed(n) - l, and what
    it shares in its prefix is in the other's prefix too.
    """
    both = 0 - (0 - PERCENT * (n + n2)) // (100 + PERCENT) if least is np.minimum else F.ceil(
        PERCENT * (n + n2) / (100 + PERCENT))
    rest, rest2 = (needed(n) - l, needed(n2) - l2) if least is np.minimum else (
        F.ceil(n * PERCENT / 100) - l, F.ceil(n2 * PERCENT / 100) - l2)
    return least(both - rest, both - rest2)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def marked(shingles: np.ndarray) -> bytes:
    """A bitmap of a set; the upper bits of the hashes are not used, as only
    the lowest hashes of a set are listed."""
    bits = np.zeros(MARK, np.uint8)
    bits[(shingles & np.uint64(MARK - 1)).astype(np.intp)] = 1
    return np.packbits(bits).tobytes()


_CHUNK_TYPE = ("chunk long, ids array<long>, sizes array<int>, kept array<int>, s1 array<long>, s2 array<long>, "
               "tokens binary, marks array<binary>")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to chunks: sizes, signatures and the leading shingles in hash
    order (of equal sets in a chunk only the first keeps its shingles)."""
    from pyspark import TaskContext

    task, made = TaskContext.get().partitionId(), 0
    ids, sizes, kept, sigs, tokens, marks, seen, held = [], [], [], [], [], [], set(), 0

    def flush():
        sig = np.frombuffer(b"".join(sigs), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array([(task << 32) + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
             pa.array([sizes], pa.list_(pa.int32())), pa.array([kept], pa.list_(pa.int32())),
             pa.array([sig[:, 0].tolist()], pa.list_(pa.int64())), pa.array([sig[:, 1].tolist()], pa.list_(pa.int64())),
             pa.array([b"".join(tokens)], pa.binary()), pa.array([marks], pa.list_(pa.binary()))],
            names=["chunk", "ids", "sizes", "kept", "s1", "s2", "tokens", "marks"])

    for batch in batches:
        for doc_id, text in zip(column_of(batch, "doc_id"), batch.column(1), strict=True):
            s = shingles(text.as_py())
            n = len(s)
            sig = xxhash.xxh3_128_digest(s.tobytes())
            first = min(n, max(int(np.searchsorted(s, _LIMIT)), n - needed(n) + MATCHES[-1]))
            if doc_id is None or sig in seen:
                first = 0
            else:
                seen.add(sig)
            ids.append(doc_id)
            sizes.append(n)
            kept.append(first)
            sigs.append(sig)
            tokens.append(packed(s[:first], "<u8"))
            marks.append(marked(s) if first else None)
            held += first + 16
            if held >= CHUNK:
                yield flush()
                made += 1
                ids, sizes, kept, sigs, tokens, marks, seen, held = [], [], [], [], [], [], set(), 0
    if ids:
        yield flush()


def _bucketer(buckets: int):
    """A chunk's distinct shingles and their counts, packed by bucket of the hash space."""
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, tokens in zip(column_of(batch, "chunk"), column_of(batch, "tokens"), strict=True):
                t, n = np.unique(np.frombuffer(tokens, "<u8"), return_counts=True)
                at = [0, *np.searchsorted(t, bounds).tolist(), len(t)]
                parts = [(b, s, e) for b, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)) if e > s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in parts], pa.int32()), pa.array([chunk] * len(parts), pa.int64()),
                     pa.array([packed(t[s:e], "<u8") for _, s, e in parts], pa.binary()),
                     pa.array([packed(n[s:e], "<u4") for _, s, e in parts], pa.binary())],
                    names=["bucket", "chunk", "hashes", "counts"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each chunk, the frequencies over all chunks of its shingles that are not unique."""
    for _, group in streamed_groups(batches, ["bucket"]):
        hashes = [np.frombuffer(x, "<u8") for x in group["hashes"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in group["counts"].to_pylist()])
        t, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, counts, len(t)).astype(np.int64)
        at = 0
        for chunk, h in zip(group["chunk"].to_pylist(), hashes, strict=True):
            mine = total[place[at:at + len(h)]]
            at += len(h)
            shared = mine > 1
            if shared.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([packed(h[shared], "<u8")], pa.binary()),
                     pa.array([packed(np.minimum(mine[shared], 2**32 - 1), "<u4")], pa.binary())],
                    names=["chunk", "hashes", "counts"])


_ENTRY_TYPE = "hash long, doc long, n int, l int, df long, m int"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk's carriers, the shared shingles of the cheapest prefix."""
    for _, group in streamed_groups(batches, ["chunk"]):
        rows = group.to_pydict()
        main = next((i for i, kind in enumerate(rows["kind"]) if kind == 0), None)
        answers = [i for i, kind in enumerate(rows["kind"]) if kind == 1]
        if main is None or not answers:
            continue
        kept = np.array(rows["kept"][main])
        n = np.array(rows["sizes"][main], dtype=np.int64)
        carries = kept > 0
        for i, kind in enumerate(rows["kind"]):
            if kind == 2:
                carries[np.array(rows["kept"][i], dtype=int)] = False
        tokens = np.frombuffer(rows["tokens"][main], "<u8")
        doc = np.repeat(np.arange(len(kept)), kept)
        known = np.concatenate([np.frombuffer(rows["tokens"][i], "<u8") for i in answers])
        count = np.concatenate([np.frombuffer(rows["counts"][i], "<u4") for i in answers]).astype(np.int64)
        by = np.argsort(known)
        known, count = known[by], count[by]
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        df = np.where(known[at] == tokens, count[at], 1)
        counted = tokens < _LIMIT
        order = np.lexsort((tokens, np.where(counted, df, 0), ~counted, doc))
        tokens, doc, df = tokens[order], doc[order], df[order]
        place = np.arange(len(doc)) - (np.cumsum(kept) - kept)[doc]
        best, cost = np.ones(len(kept), np.int64), None
        for matches in MATCHES:
            inside = place < (n - needed(n) + matches)[doc]
            read = np.bincount(doc, (df - 1) * inside, len(kept))
            now = np.where(needed(n) >= matches, read + read / matches * n * VERIFY_COST, np.inf)
            if cost is None:
                cost = now
            else:
                best, cost = np.where(now < cost, matches, best), np.minimum(now, cost)
        use = carries[doc] & (df > 1) & (place < (n - needed(n) + best)[doc])
        ids = np.array([x if x is not None else 0 for x in rows["ids"][main]], dtype=np.int64)
        d = doc[use]
        met = np.bincount(d, minlength=len(kept)).astype(np.int32)
        for s in range(0, len(d), 65536):
            e = slice(s, s + 65536)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[use][e].view("<i8")), pa.array(ids[d[e]]), pa.array(n[d[e]].astype(np.int32)),
                 pa.array(best[d[e]].astype(np.int32)), pa.array(df[use][e]), pa.array(met[d[e]])],
                names=["hash", "doc", "n", "l", "df", "m"])


def _may_link(a: str, b: str) -> Column:
    """Sizes and numbers of prefix entries allow a link; a and b are structs."""
    n, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
    enough = F.least(F.col(f"{a}.m"), F.col(f"{b}.m")) >= demanded(n, F.col(f"{a}.l"), n2, F.col(f"{b}.l"), F.least)
    return (F.least(n, n2) * 100 >= F.greatest(n, n2) * PERCENT) & enough


def _leader_pairs(entries: DataFrame, tried: DataFrame | None, leaders: int, tries: int) -> DataFrame:
    """Candidate pairs of documents and leaders of their lists in another
    component, the ones that a document meets most often. A list's leaders
    are the documents with the most entries of each of its random parts."""
    parts = F.ceil(F.col("df") / PART).cast("int")
    mine = F.struct("doc", "comp", "n", "l", "m")
    heads = (entries.groupBy("hash", F.pmod(F.xxhash64("doc", F.lit(leaders)), F.lit(leaders)).alias("seat"))
             .agg(F.max(F.struct("m", (-F.col("doc")).alias("order"), mine.alias("lead"))).alias("h"), F.max("df").alias("df"))
             .select("hash", "h.lead", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")))
    dealt = entries.select("hash", mine.alias("mine"), F.pmod(F.xxhash64("doc"), parts).cast("int").alias("part"))
    met = (dealt.join(heads, ["hash", "part"]).filter(F.col("mine.comp") != F.col("lead.comp"))
           .filter(_may_link("mine", "lead")))
    counted = met.groupBy(F.col("lead.doc").alias("a"), F.col("mine.doc").alias("b")).count()
    if tried is not None:
        counted = counted.join(tried, ["a", "b"], "left_anti")
    choice = Window.partitionBy("b").orderBy(F.desc("count"), "a")
    return counted.withColumn("place", F.row_number().over(choice)).filter(F.col("place") <= tries).select("a", "b")


def reachable(bits: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the marks of documents x and y allow a link: every bit that one
    has alone stands for a shingle, at least, that the other lacks."""
    out = np.empty(len(x), bool)
    filled = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    for s in range(0, len(x), 1 << 15):
        a, b = x[s:s + (1 << 15)], y[s:s + (1 << 15)]
        common = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64)
        most = np.minimum(n[a] - filled[a], n[b] - filled[b]) + common
        out[s:s + len(a)] = most * (100 + PERCENT) >= PERCENT * (n[a] + n[b])
    return out


def _met_before(first: np.ndarray, rank: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether documents x and y share an entry among their first ones that
    comes before this one."""
    out = np.empty(len(x), bool)
    place = np.arange(first.shape[1])
    for s in range(0, len(x), 1 << 14):
        a, b = x[s:s + (1 << 14)], y[s:s + (1 << 14)]
        same = first[a][:, :, None] == first[b][:, None, :]
        same &= (place < rank[a][:, None])[:, :, None]
        same &= (place < rank[b][:, None])[:, None, :]
        out[s:s + len(a)] = same.any(axis=(1, 2))
    return out


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs across components, each in the first list that both are in."""
    held, rows = [], 0

    def flush():
        pairs = np.unique(np.concatenate(held), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for key, group in streamed_groups(batches, ["hash", "i", "j"]):
        doc, comp, n, l, left, rank, mine = (group[c].to_numpy().astype(np.int64)
                                             for c in ("doc", "comp", "n", "l", "left", "rank", "mine"))
        may = np.triu(comp[:, None] != comp[None, :], 1)
        if key[1] != key[2]:
            may &= mine[:, None] != mine[None, :]
        may &= np.minimum(n[:, None], n[None, :]) * 100 >= np.maximum(n[:, None], n[None, :]) * PERCENT
        x, y = np.nonzero(may)
        # In the first list that a pair shares, all it shares is still left.
        able = np.minimum(left[x], left[y]) >= demanded(n[x], l[x], n[y], l[y], np.minimum)
        x, y = x[able], y[able]
        if len(x):
            bits = np.frombuffer(b"".join(group["mark"].to_pylist()), np.uint64).reshape(len(doc), -1)
            close = reachable(bits, n, x, y)
            x, y = x[close], y[close]
        if len(x):
            first = np.zeros((len(doc), FIRST), np.int64)
            for row, found in zip(first, group["first"].to_pylist(), strict=True):
                row[:len(found)] = found
            new = ~_met_before(first, rank, x, y)
            x, y = x[new], y[new]
        if len(x):
            held.append(np.column_stack([np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])]))
            rows += len(x)
        if rows > 500_000:
            yield flush()
            held, rows = [], 0
    if held:
        yield flush()


def _crossing_pairs(entries: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs across components that may share as many prefix shingles as is
    demanded and whose marks allow a link, once each but for those that share
    none of their first entries.

    A document's entries in lists of several components are ranked, rare ones
    first, the same way in all documents. A pair's first common entry has all
    that it shares at its rank or after, so lists where less is left than is
    demanded pass it over, and later lists do if one of the first entries is common.
    """
    lists = (entries.groupBy("hash").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("rows"))
             .filter("c0 <> c1").select("hash", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")))
    # By version: those of one id differ in size and entries.
    ranked = (entries.join(lists, "hash").repartition("doc").groupBy("doc", "comp", "n", "l", "m")
              .agg(F.sort_array(F.collect_list(F.struct("df", "hash", "blocks"))).alias("all")))
    crossing = (ranked.join(marks, "doc")
                .select("doc", "comp", "n", "l", "mark", F.size("all").alias("count"), F.slice("all.hash", 1, FIRST).alias("first"),
                        F.posexplode("all").alias("rank", "entry"))
                .select("doc", "comp", "n", "l", "mark", "first", "rank", (F.col("count") - F.col("rank")).alias("left"),
                        "entry.hash", "entry.blocks"))
    cell = ["hash", "i", "j"]
    cells = (crossing.withColumn("mine", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select("hash", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "doc",
                     "comp", "n", "l", "left", "rank", "mark", "first"))
    # By number: the rows are few for the work they make, and would be coalesced by their bytes.
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (cells.repartition(tasks, *cell).sortWithinPartitions(*cell, "doc")
            .mapInArrow(_crossing, "a long, b long"))


def _all_pairs(entries: DataFrame, marks: DataFrame) -> DataFrame:
    """Every pair across components that is not ruled out."""
    return _crossing_pairs(entries, marks).distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        made, last = [], None
        for text in batch.column(batch.schema.get_field_index("text")):
            text = text.as_py()
            if text != last:  # a text's rows follow each other
                last, data = text, packed(shingles(text), "<u8")
            made.append(data)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(made, pa.binary())],
                                         names=["a", "part", "follows", "b", "set"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaders (follows = 0) come before their followers, which stream past."""
    block, leads = None, []
    for batch in slices(batches):
        found = []
        for a, part, follows, b, data in zip(*(column_of(batch, c) for c in ("a", "part", "follows", "b", "set")), strict=True):
            s = np.frombuffer(data, "<u8")
            if block != (a, part):
                block, leads = (a, part), []
            if not follows:
                leads.append(s)
            elif any(similar(x, s) for x in leads):
                found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose whole shingle sets are similar."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    follow = (pairs.join(sizes, "a")
              .select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("follows"), "b"))
    lead = sizes.select("a", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(0).alias("follows"),
                        F.col("a").alias("b"))
    wanted = cut(follow.unionByName(lead))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    group = ["a", "part"]
    sets = (texts.join(wanted, texts["doc_id"] == wanted["b"]).select("a", "part", "follows", "b", "text")
            .mapInArrow(_sets, "a long, part int, follows int, b long, set binary"))
    return cut(sets.repartition(*group).sortWithinPartitions(*group, "follows", "b").mapInArrow(_verify, "a long, b long"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest doc_id
    reachable by links, itself included) of every row.

    Null, empty and blank texts have no shingles and link with nothing; rows
    with a null id link with nothing and keep a null component. Rows that
    repeat an id are versions of one document: a link of one counts for all.
    Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    chunks = cut(texts.mapInArrow(_chunks, _CHUNK_TYPE))
    members = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "sizes", "kept", "s1", "s2")).alias("idx", "m")).select(
        "chunk", "idx", F.col("m.ids").alias("doc_id"), F.col("m.sizes").alias("n"), F.col("m.kept").alias("kept"),
        F.col("m.s1").alias("s1"), F.col("m.s2").alias("s2"))
    linkable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    carrier = F.min(F.when(F.col("kept") > 0, F.struct("chunk", "idx", "doc_id")))
    classes = cut(members.filter(linkable).groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), carrier.alias("c"))
                  .select("s1", "s2", "first", F.col("c.chunk").alias("c_chunk"), F.col("c.idx").alias("c_idx"),
                          F.col("c.doc_id").alias("node")))
    placed = cut(members.filter(linkable).join(classes, ["s1", "s2"]).select(
        "doc_id", "n", "kept", "chunk", "idx", "node", "first",
        ((F.col("chunk") == F.col("c_chunk")) & (F.col("idx") == F.col("c_idx"))).alias("carries")))

    total = chunks.agg(F.sum(F.octet_length("tokens") / 8)).first()[0] or 0
    buckets = max(1, -(-int(total) // BUCKET))
    counts = (chunks.select("chunk", "tokens").mapInArrow(_bucketer(buckets), "bucket int, chunk long, hashes binary, counts binary")
              .repartition("bucket").sortWithinPartitions("bucket", "chunk")
              .mapInArrow(_frequencies, "chunk long, hashes binary, counts binary"))
    none = {t: F.lit(None).cast(t) for t in ("array<long>", "array<int>", "binary")}
    idle = placed.filter("kept > 0 and not carries").groupBy("chunk").agg(F.collect_list("idx").alias("kept"))
    parts = (chunks.select("chunk", F.lit(0).alias("kind"), "ids", "sizes", "kept", "tokens", none["binary"].alias("counts"))
             .union(counts.select("chunk", F.lit(1), none["array<long>"], none["array<int>"], none["array<int>"], "hashes", "counts"))
             .union(idle.select("chunk", F.lit(2), none["array<long>"], none["array<int>"], "kept", none["binary"], none["binary"])))
    entries = cut(parts.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_prefixes, _ENTRY_TYPE))

    # Versions of one id have a mark each; a pair stays if any two of theirs allow it.
    marks = (chunks.select(F.explode(F.arrays_zip("ids", "marks")).alias("m")).filter("m.marks is not null")
             .select(F.col("m.ids").alias("doc"), F.col("m.marks").alias("mark")))
    links = comps = tried = None
    for step in (*LEADER_ROUNDS, None):
        if comps is None:
            current = entries.withColumn("comp", F.col("doc"))
        else:
            current = cut(entries.join(comps, entries["doc"] == comps["id"], "left").withColumn(
                "comp", F.coalesce("component", "doc")).drop("id", "component"))
        pairs = cut(_leader_pairs(current, tried, *step) if step else _all_pairs(current, marks))
        tried = pairs if tried is None else tried.union(pairs)
        new = _verified(pairs, texts)
        if links is not None and new.isEmpty():
            continue  # the components are as they were
        links = new if links is None else links.union(new)
        comps = cut(connected_components(links))

    nodes = comps.join(classes.groupBy("node").agg(F.min("first").alias("first")), F.col("id") == F.col("node"))
    smallest = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    by_node = cut(nodes.join(smallest, "component").select("node", "component_id"))
    linked = placed.join(by_node, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "first").alias("component_id"))
    alone = members.filter(~linkable).select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                                             F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
