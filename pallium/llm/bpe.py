"""Byte-pair encoding and decoding of whole texts (operator 1).

A text is cut at the vocabulary's special strings, normalised and split into
words; each word's symbols form a doubly linked list whose adjacent pairs wait
in a priority queue ordered by (merge rank, position). The best pair is merged
in place and its new neighbours are queued; entries made stale by an earlier
merge are skipped when they surface. Decoding concatenates vocabulary strings
with the separator that the vocabulary file's (absent) decoder implies.

Words never hold white space, so what stands between white space is encoded
on its own. Such chunks and their words repeat, so each task keeps bounded
tables of them; a text is processed in pieces cut at white space, so memory does not
grow with a text beyond the text and its tokens.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.common import column_of, id_and_text, read_shipped

#: Encoded strings in a generation of a task's tables.
TABLE_SIZE = 1 << 17
#: Longer strings are encoded each time, as they hardly repeat.
LONG = 64
#: Texts are cut at the first white space after so many characters.
PIECE = 1 << 20

# The word pattern of the vocabulary file, which must match.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"

_SPACE = regex.compile(r"\p{White_Space}")
#: str.split() takes these for white space, Unicode does not.
_SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary:
    visible Latin-1 characters stand for themselves, the others take code
    points from 256 on in byte order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file (tokenizers JSON, words that
    end in a suffix, NFC and lower case)."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.symbols = byte_symbols()
        #: rank of a pair's merge, by the pair's ids as one integer; and what each rank makes
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a] << 32 | self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        self.words = regex.compile(WORDS)
        self.cuts = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.chunk_table = _Table(self.encode_chunk)
        self.word_table = _Table(self.encode_word)

    def encode_word(self, word: str) -> bytes:
        chars = [self.symbols[b] for b in word.encode("utf-8")]
        chars[-1] += self.suffix
        symbol = [self.vocab[c] for c in chars if c in self.vocab]
        ranks, made, n = self.ranks, self.made, len(symbol)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        # An entry is rank and position in one integer, so that it sorts by both.
        queue = [r << 32 | i for i in range(n - 1) if (r := ranks.get(symbol[i] << 32 | symbol[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j < 0 or ranks.get(symbol[i] << 32 | symbol[j]) != rank:
                continue  # a symbol of the pair was merged since: stale
            symbol[i], symbol[j] = made[rank], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get(symbol[i] << 32 | symbol[k])) is not None:
                    heapq.heappush(queue, r << 32 | i)
            p = before[i]
            if p >= 0 and (r := ranks.get(symbol[p] << 32 | symbol[i])) is not None:
                heapq.heappush(queue, r << 32 | p)
        kept = [s for s in symbol if s >= 0]
        return struct.pack(f"<{len(kept)}I", *kept)

    def encode_chunk(self, chunk: str) -> bytes:
        return b"".join([self.word_table[word] for word in self.words.findall(chunk)])

    def normalise(self, text: str) -> str:
        """NFC, then lower case character by character (no final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.cuts.split(text) if self.cuts else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
                continue
            for piece in pieces(part):
                piece = self.normalise(piece)
                chunks = _SPACE.split(piece) if _SEPARATORS.search(piece) else piece.split()
                out.append(b"".join(map(self.chunk_table.__getitem__, chunks)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


class _Table(dict):
    """Encoded strings; a missing one is encoded when it is asked for. A full
    table becomes the old generation, from which strings in use come back."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode, self.old = encode, {}

    def __missing__(self, part: str) -> bytes:
        found = self.old.get(part) or self.encode(part)
        if len(part) <= LONG:
            if len(self) >= TABLE_SIZE:
                self.old = dict(self)
                self.clear()
            self[part] = found
        return found


@lru_cache(maxsize=2)
def encoder(content: bytes) -> WordBpe:
    """One encoder, and its tables, for all tasks of a Python worker."""
    return WordBpe(content)


def pieces(text: str) -> Iterator[str]:
    """The text in pieces that end in white space (words never hold any)."""
    at = 0
    while len(text) - at > PIECE:
        space = _SPACE.search(text, at + PIECE)
        if space is None:
            break
        yield text[at:space.end()]
        at = space.end()
    yield text[at:]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``token_ids`` (binary, little-endian unsigned 32-bit) and
    ``decoded`` (string) of every row.

    Null and empty texts have no tokens and decode to the empty string; null
    ids and repeated rows are kept as they are; other columns are not read.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_shipped(tokenizer_path))

    def run(batches):
        bpe = encoder(content.value)
        for batch in batches:
            ids, decoded = [], []
            for text in column_of(batch, "text"):
                ids.append(bpe.encode(text))
                decoded.append(bpe.decode(ids[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                names=["doc_id", "token_ids", "decoded"])

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, token_ids binary, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """Token count and digests of :func:`encode_decode`'s rows."""
    return encoded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
