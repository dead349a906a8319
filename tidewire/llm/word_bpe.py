"""BPE encoding by speculation and verification, and decoding, for vocabularies with word ends.

Greedy longest match proposes the tokens of a word. A proposal is the exact encoding if every two
neighbours are compatible: merging across their border would never come first. All neighbours of all
proposals are tested at once with arrays; only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.tokens import byte_symbols

#: Cached pieces per worker process; beyond it the cache starts anew (about 200 MB).
CACHE_PIECES = 600_000
WORD_END = "</w>"
_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class WordBpe:
    """A word-level BPE tokenizer file: NFC, blanks, lower case; words; bytes; merges with word ends."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalize_any = library.normalizer.normalize_str
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        # Added tokens outside the model's vocabulary have their text too.
        self.text_of = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of.update({i: t for t, i in self.special.items()})
        self.cut_special = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.symbols = byte_symbols()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self._index(merges)
        self.word_cache: dict[str, tuple[int, ...]] = {}
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.cache_pieces = cache_pieces

    def _index(self, merges: list[tuple[str, str]]) -> None:
        """Arrays by token: rank of the merge that makes it (-1: a base symbol) and its two parts."""
        size = max(self.text_of) + 1
        self.made = np.full(size, -1, dtype=np.int64)
        self.left = np.full(size, -1, dtype=np.int64)
        self.right = np.full(size, -1, dtype=np.int64)
        self.rank_of: dict[tuple[int, int], tuple[int, int]] = {}
        keys, ranks = [], []
        for rank, (a, b) in enumerate(merges):
            a_id, b_id, to = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank_of[a_id, b_id] = (rank, to)
            keys.append(a_id * size + b_id)
            ranks.append(rank)
            if self.made[to] < 0:
                self.made[to], self.left[to], self.right[to] = rank, a_id, b_id
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_ranks = np.array(ranks, dtype=np.int64)[order]
        self.size = size
        # Greedy match may propose only tokens that merging their own text gives back.
        self.reachable: dict[str, int] = {}
        for text, i in self.vocab.items():
            if self.merge(self._base(text)) == [i]:
                self.reachable[text] = i
        self.longest = max(map(len, self.reachable))

    def _base(self, text: str) -> list[int]:
        """Base symbols of a token's text; the last carries the word end."""
        ended = text.endswith(WORD_END) and len(text) > len(WORD_END)
        body = text[: -len(WORD_END)] if ended else text
        parts = [*body[:-1], body[-1] + WORD_END] if ended else list(body)
        return [self.vocab[p] for p in parts if p in self.vocab]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the first-ranked pair first, from left to right. O(n log n) with a heap and links."""
        import heapq

        n = len(ids)
        ids, after, before = list(ids), [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(*self.rank_of[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank_of]
        heap = [(rank, i, to, p) for rank, to, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, to, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = to, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (p := (ids[a], ids[b])) in self.rank_of:
                    rank, made = self.rank_of[p]
                    heapq.heappush(heap, (rank, a, made, p))
        return [x for x in ids if x >= 0]

    def propose(self, symbols: str) -> list[int]:
        """Greedy longest match of the byte symbols of one word with its end."""
        out, at, n = [], 0, len(symbols)
        find = self.reachable.get
        while at < n:
            stop = min(n, at + self.longest)
            if stop == n and (i := find(symbols[at:] + WORD_END)) is not None:
                out.append(i)
                return out
            # Inside the word a token may not take the last symbol without the word end.
            for end in range(min(stop, n - 1), at, -1):
                if (i := find(symbols[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of pairs; a value past all ranks where there is none."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], len(self.pair_keys))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of both texts joined is the two tokens, for arrays of pairs.

        Both tokens are taken apart backwards in time: the side made last is split first. At each
        moment a border pair existed until the earlier of the moments at which its two sides were
        merged on; if its own merge ranks before that moment, it would have been taken first.
        A tie in rank is the same pair at two places, and the left one is taken first.
        """
        a, b = a.copy(), b.copy()
        none = len(self.pair_keys)
        until = np.full(len(a), none, dtype=np.int64)
        # A tie is decided by place: equal rank goes first if the border stands left of that merge.
        tie = np.zeros(len(a), dtype=bool)
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            rank = self.pair_rank(x, y)
            bad = (rank < until[live]) & (rank < none) | (rank == until[live]) & (rank < none) & tie[live]
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            rx, ry = self.made[x], self.made[y]
            stay = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[stay], x[stay], y[stay], rx[stay], ry[stay]
            first = rx >= ry
            # Of equal ranks on both sides, the right merge came later, so it is undone first.
            first &= rx != ry
            a[live] = np.where(first, self.right[x], x)
            b[live] = np.where(first, y, self.left[y])
            until[live] = np.where(first, rx, ry)
            tie[live] = ~first
        return good

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Exact ids of distinct normalised words."""
        symbols = ["".join([self.symbols[x] for x in w.encode()]) for w in words]
        proposals = [self.propose(s) for s in symbols]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        ids = np.fromiter((i for p in proposals for i in p), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(word[:-1] == word[1:])
        pairs, back = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size)[back] if len(pairs) else np.zeros(0, dtype=bool)
        for i in np.unique(word[inner[~fine]]).tolist():
            proposals[i] = self.merge(self._base(symbols[i] + WORD_END))
        return [tuple(p) for p in proposals]

    def _learn(self, pieces: set[str]) -> None:
        if len(self.cache) > self.cache_pieces:
            self.cache, self.word_cache = {}, {}
        new = [p for p in pieces if p not in self.cache]
        cut = [self.words.findall(p) for p in new]
        words = list({w for ws in cut for w in ws} - self.word_cache.keys())
        self.word_cache.update(zip(words, self.encode_words(words)))
        for piece, ws in zip(new, cut):
            ids = [i for w in ws for i in self.word_cache[w]]
            self.cache[piece] = (len(ids), " ".join(map(str, ids)), " ".join([self.text_of[i] for i in ids]))

    def normalize(self, text: str) -> str:
        """The file's normaliser; below U+0300 it is plain lower case, as all such text is in NFC."""
        if text.isascii() or max(text) < "̀":
            return text.lower()
        return self.normalize_any(text)

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Per text: number of ids, decimal ids joined by blanks, decoded text."""
        parts, pieces = [], set()
        for text in texts:
            segments = self.cut_special.split(text) if "<|" in text else [text]
            cut = [[s] if k % 2 else self.normalize(s).split() for k, s in enumerate(segments)]
            parts.append(cut)
            for k, one in enumerate(cut):
                if not k % 2:
                    pieces.update(one)
        self._learn(pieces)
        special = {s: (1, str(i), s) for s, i in self.special.items()}
        find = self.cache.__getitem__
        out = []
        for cut in parts:
            got = [x for k, one in enumerate(cut) for x in (map(find, one) if not k % 2 else [special[one[0]]])]
            got = [x for x in got if x[0]]
            n, ids, decoded = zip(*got) if got else ((), (), ())
            # Files without a decoder join token texts by a blank.
            out.append((sum(n), " ".join(ids), " ".join(decoded)))
        return out


@functools.lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    """One codec per worker process and file."""
    return WordBpe(path)


def encode_and_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode every whole text of (doc_id, text) and decode it; digests per document, rows in any number.

    A null text counts as empty (no ids, empty decoded text). No shuffle: each task encodes its rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(tokenizer)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            texts = batch["text"].tolist()
            rows = []
            for at in range(0, len(texts), 500):
                rows += [(n, sha(ids), sha(back)) for n, ids, back in bpe.encode(texts[at : at + 500])]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield out.assign(doc_id=batch["doc_id"].array)[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, _SCHEMA)
