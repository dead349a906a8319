"""Byte-level BPE ids of whole texts, each distinct piece of text encoded once per worker process."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import re
from array import array

import numpy as np
import pyarrow as pa

#: Cached pieces per worker process (about 40 MB); beyond it the cache starts anew. More save no time on
#: the given texts, as the common pieces are soon there again.
CACHE_PIECES = 200_000
#: Longer pieces, and texts with special tokens, are left to the tokenizers library.
LONG_PIECE = 500
#: Fixed value: how byte-level pre-tokenization cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# A single blank with non-blanks on both sides: byte-level pre-tokenization always starts a token there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BLANK_AND_SPACE = re.compile(r" (?:\s|\Z)")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte value."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class PieceEncoder:
    """Encode like ``Tokenizer.encode(text, add_special_tokens=False)`` of a byte-level BPE file.

    The pattern of byte-level pre-tokenization starts a new token at every blank that stands
    between two non-blanks, so a text is the concatenation of its pieces, and a piece has the same
    ids wherever it stands. Pieces are encoded by tiktoken with the ranks of the same file, which is
    about five times as fast as the tokenizers library and gives the same ids; long pieces (tiktoken
    fails on long runs of white space) and texts with special tokens go to that library itself.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocab_size <= 65536 else "<u4")
        self._code = self.dtype.char
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        ranks = {
            bytes(map(byte_of.__getitem__, token)): i
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()
            if token not in added
        }
        self.ranked = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = added
        self.after_blank = np.zeros(self.vocab_size, dtype=bool)
        self.after_blank[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.cache_pieces = cache_pieces
        self.heads: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drop the cached pieces."""
        self.pieces, self.heads = {}, {}

    def pack(self, ids) -> bytes:
        return array(self._code, ids).tobytes()

    def _one(self, text: str) -> bytes:
        if len(text) > LONG_PIECE:
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return self.pack(self.ranked.encode_ordinary(text))

    def _learn(self, heads: set[str], pieces: set[str]) -> None:
        if len(self.pieces) + len(self.heads) > self.cache_pieces:
            # The texts at hand get all their pieces below; what other texts had may go.
            self.forget()
        self.heads.update((h, self._one(h)) for h in heads - self.heads.keys())
        new = pieces - self.pieces.keys()
        odd = {p for p in new if not p or " " in p or len(p) > LONG_PIECE}
        self.pieces.update((p, self._one(" " + p)) for p in odd)
        # Plain pieces hold no blank, so the tokens that begin with one tell where each piece starts.
        plain, width = list(new - odd), self.dtype.itemsize
        if plain:
            ids = np.array(self.ranked.encode_ordinary(" " + " ".join(plain)), self.dtype)
            starts = (np.flatnonzero(self.after_blank[ids]) * width).tolist()
            raw = ids.tobytes()
            cut = [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)])]
            self.pieces.update(zip(plain, cut, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text, little-endian, ``self.dtype`` wide."""
        cuts, pieces = [], set()
        for text in texts:
            if any(s in text for s in self.special):
                cuts.append(None)
                continue
            cut = _CUT.split(text) if _BLANK_AND_SPACE.search(text) else text.split(" ")
            cuts.append(cut)
            pieces.update(cut[1:])
        self._learn({cut[0] for cut in cuts if cut}, pieces)
        find, out = self.pieces.__getitem__, []
        for text, cut in zip(texts, cuts):
            if cut is None:
                out.append(self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids))
            else:
                out.append(self.heads[cut[0]] + b"".join(map(find, cut[1:])))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file."""
    return PieceEncoder(path)


def give_back() -> None:
    """Hand freed memory of this worker process back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
