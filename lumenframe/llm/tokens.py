"""Fast exact encoding with tokenizer files of the ``tokenizers`` library.

A byte-level file whose ids follow its merges is encoded by tiktoken, which is several times as fast. Else, and
for long texts, a text is cut where the tokenizer provably starts afresh, the pieces are looked up
in a bounded cache of the worker process, and only pieces not seen before are encoded. Texts for which the cuts are not proven (control characters that
libraries class differently, special-token marks) go through the library whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np

from lumenframe.llm.common import worker_cache

#: Entries after which a cache is emptied.
CACHE = 600_000
#: Texts up to this many characters go to a ranked encoder whole, longer ones piece by piece, so that no run of white space is too long for its pattern.
WHOLE = 100_000
#: Longer pieces are rarely met again.
LONGEST = 24
#: Characters that Python's \\s holds and the Unicode White_Space property does not, and the start of all special tokens.
UNSURE = re.compile("[\x1c-\x1f]|<\\|")
#: The tokenizer's own treatment of white space: a run gives up its last character, and one space joins the word after it.
BYTE_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s")


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def little_endian(ids: list[int], dtype: str) -> bytes:
    """Ids as packed integers; faster for a few than an array of numpy."""
    packed = array("H" if dtype == "<u2" else "I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Pieces(dict):
    """piece -> packed ids; encodes what is missing."""

    def __init__(self, encode, dtype: str):
        super().__init__()
        self.encode, self.dtype = encode, dtype

    def __missing__(self, piece: str) -> bytes:
        packed = little_endian(self.encode(piece), self.dtype)
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = packed
        return packed

    def joined(self, pieces: list[str]) -> bytes:
        """All pieces packed: most are known, and looked up without a call for each."""
        parts = list(map(self.get, pieces))
        if None in parts:
            parts = [p if p is not None else self[t] for p, t in zip(parts, pieces, strict=True)]
        return b"".join(parts)


class ByteLevelEncoder:
    """Ids of a byte-level BPE tokenizer file as packed little-endian integers of ``width`` bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        size = self.whole.get_vocab_size()
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.width = 2 if size <= 1 << 16 else 4
        self.ranked = self._ranked(path)
        self.pieces = _Pieces(self.ranked or (lambda t: self.whole.encode(t, add_special_tokens=False).ids), self.dtype)

    def _ranked(self, path: str):
        """The same merges in tiktoken, several times as fast for a short piece, if ids follow the order of merges."""
        try:
            import tiktoken
        except ImportError:
            return None
        model = json.load(open(path, encoding="utf-8"))
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        pre = model.get("pre_tokenizer") or {}
        if model.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        to_byte = byte_symbols()
        ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(pairs)}
        # Fixed value: the pattern of byte-level pre-tokenizers.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def packed(self, text: str) -> bytes:
        if UNSURE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        if self.ranked and len(text) <= WHOLE:
            return little_endian(self.ranked(text), self.dtype)
        return self.pieces.joined(BYTE_PIECES.findall(text))


def byte_encoder(path: str) -> ByteLevelEncoder:
    cache = worker_cache()
    key = ("byte", path)
    if key not in cache:
        cache[key] = ByteLevelEncoder(path)
    return cache[key]
