"""Byte-level BPE encoding of whole text batches with the ``tokenizers`` library.

The pre-tokeniser never lets a token cross from a visible character to white
space, nor from an ASCII letter to most ASCII punctuation, so a text may be cut
there and its pieces encoded apart.  Pieces repeat, so each worker encodes a
piece once and keeps its ids in a bounded cache; the ids of a text are those the
library gives for it as a whole.  New pieces go to the library many at a time,
joined where it would cut them anyway: each id stands for a known number of
bytes, which tells where a piece's ids end.
"""

from __future__ import annotations

import os

import numpy as np

from . import textvec as tv

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = "byte_bpe_50k.json"
#: Pieces that a worker keeps; beyond it the cache starts anew.
CACHE_PIECES = 1_500_000
#: Characters of joined pieces that the library encodes as one text.
JOINED = 4096
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Not the apostrophe, with which contractions begin, nor the bar inside the vocabulary's special token.
_MARK[list(b'!"#$%&()*+,-./:;<=>?@[]^_`{}~')] = True
_LOADED: dict[str, "PieceEncoder"] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes slices of texts; see :func:`encoder`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # a character of the vocabulary file is a byte
            self.width[i] = len(token)
        for i, token in self.tok.get_added_tokens_decoder().items():
            self.width[i] = len(token.content.encode())
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.start = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0

    def _cuts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where a piece begins: at a document's start, at white space after a visible character, at punctuation after a letter."""
        space = tv.SEP[data]
        cut = np.zeros(len(data), bool)
        if len(data) > 1:
            cut[1:] = space[1:] & ~space[:-1] & (data[:-1] > 0x20) & (data[:-1] != 0x7F)
            # after a character that may itself be Unicode white space (lead byte C2, E1, E2 or E3) nothing is cut
            at = np.flatnonzero(cut & np.concatenate(([False], data[:-1] >= 0x80)))
            if len(at):
                two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
                bad = (two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))
                cut[at[bad]] = False
            cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        cut[offs[:-1][offs[:-1] < offs[1:]]] = True
        return np.flatnonzero(cut)

    def _ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some byte ranges one after the other, and how many each has."""
        # a piece that begins with white space and ends in a visible ASCII character may stand between others of its kind
        joins = tv.SEP[data[starts]] & (data[ends - 1] > 0x20) & (data[ends - 1] < 0x7F)
        order = np.concatenate((np.flatnonzero(joins), np.flatnonzero(~joins)))
        n, size = int(joins.sum()), (ends - starts)[order]
        flat = data[tv.ragged(starts[order], size)].tobytes()
        stop = np.cumsum(size)
        last = np.searchsorted(stop, np.arange(JOINED, int(stop[n - 1]) + JOINED, JOINED)) if n else np.empty(0, np.int64)
        cut = np.unique(np.concatenate(([0], stop[np.minimum(last, n - 1)] if n else [], stop[n:]))).astype(np.int64).tolist()
        texts = [flat[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])
        count = np.diff(np.searchsorted(np.cumsum(self.width[ids]), stop, "right"), prepend=0)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        at = np.cumsum(count) - count
        return ids[tv.ragged(at[back], count[back])], count[back]

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self.clear()
        flat, size = self._ids(data, starts, ends)
        total = len(flat)
        if self.used + total > len(self.flat):
            grown = np.empty(max(2 * len(self.flat), self.used + total), np.uint32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + total] = flat
        start = self.used + np.cumsum(size) - size
        self.used += total
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.size = np.insert(self.keys, at, keys), np.insert(self.start, at, start), np.insert(self.size, at, size)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all documents (uint32) and the D + 1 token offsets."""
        starts = self._cuts(data, offs)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offs), np.int64)
        ends = np.append(starts[1:], len(data))
        keys, inverse = np.unique(tv.span_hash(data, starts, ends), return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            if len(self.keys) + int((~known).sum()) > CACHE_PIECES:
                self.clear()
                known[:] = False
            some = np.empty(len(keys), np.int64)
            some[inverse] = np.arange(len(starts))
            new = np.flatnonzero(~known)
            self._learn(keys[new], data, starts[some[new]], ends[some[new]])
            at = np.searchsorted(self.keys, keys)
        slot = at[inverse]
        size = self.size[slot]
        ids = self.flat[tv.ragged(self.start[slot], size)]
        done = np.concatenate(([0], np.cumsum(size)))
        return ids, done[np.searchsorted(starts, offs)]


def encoder(path: str | None = None) -> PieceEncoder:
    """This worker's encoder for a vocabulary file."""
    path = path or vocabulary_path()
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def with_end(ids: np.ndarray, ptr: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same documents with the id ``end`` after each."""
    out = np.insert(ids, ptr[1:], end)
    return out, ptr + np.arange(len(ptr))
