"""Ids of whole texts in a byte-level BPE vocabulary.

Two libraries give the same ids for a vocabulary; the faster one takes the
texts on which it is known to, and the tokenizers library the rest. That one
is built when the first such text comes.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import numpy as np

from pallium.llm.bpe import byte_symbols

#: Beyond these characters a text goes to the tokenizers library, and so it
#: does with a word or a run of white space of :data:`RUN` characters.
_FAR = re.compile("[^\x00-ɏ]")
RUN = 500
_SPACES = re.compile(rf"\s{{{RUN}}}")


def is_plain(text: str) -> bool:
    """Whether the faster library takes the text."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if _FAR.search(text):
                return False
    if len(text) < RUN:
        return True
    lengths = list(map(len, text.split()))
    return max(lengths, default=0) < RUN and (len(text) - sum(lengths) < RUN or not _SPACES.search(text))


class ByteBpe:
    """Encoder of a vocabulary file (tokenizers JSON). With ``special`` the
    strings of special tokens in a text become those; without, they are text
    like any other."""

    def __init__(self, content: bytes, special: bool = True):
        import public_tokenizers
        import tiktoken

        self.content, self.special = content, special
        spec = json.loads(content)
        back = {c: bytes([b]) for b, c in enumerate(byte_symbols())}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: the bytes of every id; those of special tokens are their strings'
        self.strings = {i: b"".join(back[c] for c in s) for s, i in spec["model"]["vocab"].items() if s not in added}
        ranks = {s: i for i, s in self.strings.items()}
        self.strings |= {i: s.encode() for s, i in added.items()}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.allowed = "all" if special else set()

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.content.decode("utf-8"))
        made.no_truncation()
        made.no_padding()
        made.encode_special_tokens = not self.special
        return made

    def ids(self, text: str) -> np.ndarray:
        if is_plain(text):
            return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=2)
def byte_bpe(content: bytes, special: bool = True) -> ByteBpe:
    """The encoder of a worker process."""
    return ByteBpe(content, special)
