"""N-best segmentation with a SentencePiece vocabulary, and its decoding.

A text is a lattice of pieces.  Forward Viterbi scores of every position are
the exact best score of the way there, so a backward A-star search that adds
them to what it has gathered meets the segmentations in falling order of
score.  Where no piece holds the two characters beside a boundary, nothing
crosses it, so the lattice falls apart there exactly; a worker searches each
distinct part once and keeps the result.  The n best of a text combine the
parts' lists: only the n - 1 parts with the smallest step to their second
best can matter.

Scores are the model's; a character that no piece holds becomes its UTF-8
bytes, at a cost below every piece.  White space is the model's: spaces
become U+2581 with one put before the text, and decoding undoes both.

Defined cases: a null or empty text has one segmentation, without pieces and
with score 0; ties are settled by the search order, which is the same in
every run; rows with equal texts get equal results; an empty table gives no
row; other columns are ignored.  A text that itself holds U+2581 decodes to
spaces there.
"""

from __future__ import annotations

import zlib
from bisect import insort
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .store import read, small_batches
from .tokens import vocabulary_path

MODEL = "piece_bpe_32k.model"
N_BEST = 4
#: Parts that a worker keeps, some 150 MB of short ones; beyond it the older half goes.
CACHE_PARTS = 1_500_000
#: Pieces below this score are never the measure of the cost of unknown characters.
FLOOR = -1e8
_LOADED: dict[tuple[str, int], "Segmenter"] = {}


class Rows:
    """A growing NumPy array."""

    def __init__(self, kind, width: int = 0):
        self.data, self.n, self.tail = np.empty((0, width) if width else 0, kind), 0, (width,) if width else ()

    def add(self, values) -> None:
        values = np.asarray(values, self.data.dtype).reshape(-1, *self.tail)
        if self.n + len(values) > len(self.data):
            grown = np.empty((2 * (self.n + len(values)), *self.tail), self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Segmenter:
    """N-best segmentation of texts; see :func:`segmenter`."""

    def __init__(self, path: str, n: int):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.n, size = n, sp.get_piece_size()
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte = [0] * 256
        blobs, pairs, inner = [b""] * size, set(), set()
        for i in range(size):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(text[3:5], 16)] = i
                blobs[i] = bytes([int(text[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = text.replace("▁", " ")
                self.pieces[text] = (i, sp.get_score(i))
                blobs[i] = text.encode()
                pairs.update(zip(text, text[1:], strict=False))
                if len(text) > 1:
                    inner.update(text)
        self.unknown = min(s for _, s in self.pieces.values() if s > FLOOR) - 10
        #: Characters of the longest piece that ends with a character.
        self.reach: dict[str, int] = {}
        for text in self.pieces:
            self.reach[text[-1]] = max(len(text), self.reach.get(text[-1], 1))
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.blob_size = np.array([len(b) for b in blobs])
        self.blob_at = np.cumsum(self.blob_size) - self.blob_size
        # byte pairs between which no piece can lie; where a character of several bytes is concerned only the plain cases count
        self.cut = np.zeros((256, 256), bool)
        for x in range(128):
            for y in range(128):
                self.cut[x, y] = (chr(x), chr(y)) not in pairs
            if chr(x) not in inner:
                self.cut[x, 0xC0:] = True
                self.cut[0x80:, x] = True
        if not any(t[i] == " " and t[i - 1] != " " for t in self.pieces for i in range(1, len(t))):
            self.cut[:0x20, 0x20] = self.cut[0x21:, 0x20] = True
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.slots = np.empty(0, np.int64)
        self.best, self.size, self.start, self.flat = Rows(np.float64), Rows(np.int64), Rows(np.int64), Rows(np.uint32)
        self.steps = Rows(np.float64, max(1, self.n - 1))

    def search(self, part: str, n: int | None = None) -> list[tuple[float, list[int]]]:
        """The n best segmentations (score, ids) of a part of the lattice, best first.

        Each open path has a completion with exactly its estimate, and no two
        share one, so those beyond as many as are still wanted can go: the open
        paths never exceed n, however long the part is.
        """
        n, size, pieces, reach = n or self.n, len(part), self.pieces, self.reach
        # the pieces that end at each position, and the best score of the way there
        best, until, starts, hits = [0.0], [0], [], []
        for j, c in enumerate(part, 1):
            top = -float("inf")
            if c not in pieces:
                starts.append(j - 1)
                hits.append((-1, self.unknown))
                top = best[j - 1] + self.unknown
            for i in range(j - 1, max(0, j - reach.get(c, 1)) - 1, -1):
                if found := pieces.get(part[i:j]):
                    starts.append(i)
                    hits.append(found)
                    if best[i] + found[1] > top:
                        top = best[i] + found[1]
            best.append(top)
            until.append(len(starts))
        paths: list[tuple] = [(-best[size], size, 0, 0.0, None)]
        count, out = 0, []
        while paths and len(out) < n:
            _, at, _, done, path = paths.pop(0)
            if not at:
                ids = []
                while path:
                    i, piece, path = path
                    ids += [piece] if piece >= 0 else [self.byte[b] for b in part[i].encode()]
                out.append((done, ids))
                continue
            room = n - len(out)
            for e in range(until[at - 1], until[at]):
                i, (piece, score) = starts[e], hits[e]
                estimate = -(done + score + best[i])
                if len(paths) < room or estimate < paths[-1][0]:
                    count += 1
                    insort(paths, (estimate, i, count, done + score, (i, piece, path)))
                    del paths[room:]
        return out

    def _learn(self, keys: np.ndarray, parts: list[str]) -> None:
        first, width = self.best.n, max(1, self.n - 1)
        found = [self.search(part) for part in parts]
        size = np.array([len(f[0][1]) for f in found], np.int64)
        self.start.add(self.flat.n + np.cumsum(size) - size)
        self.size.add(size)
        self.flat.add(np.fromiter((i for f in found for i in f[0][1]), np.uint32, int(size.sum())))
        self.best.add([f[0][0] for f in found])
        self.steps.add([[f[0][0] - f[k][0] if k < len(f) else np.inf for k in range(1, width + 1)] for f in found])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, first + np.arange(len(parts)))

    def forget(self) -> None:
        """Drops the older half of the parts kept."""
        half = self.best.n // 2
        flat = int(self.start.data[half]) if half < self.start.n else self.flat.n
        keep = self.slots >= half
        self.keys, self.slots = self.keys[keep], self.slots[keep] - half
        for rows, first in ((self.best, half), (self.size, half), (self.start, half), (self.steps, half), (self.flat, flat)):
            rows.data, rows.n = rows.data[first : rows.n].copy(), rows.n - first
        self.start.data -= flat

    def parts(self, data: np.ndarray, offs: np.ndarray):
        """Bytes with a space before each text that is not empty, their offsets, and the starts of the parts."""
        full = offs[:-1] < offs[1:]
        data = np.insert(data, offs[:-1][full], 0x20)
        offs = offs + np.concatenate(([0], np.cumsum(full)))
        cut = np.zeros(len(data), bool)
        if len(data) > 1:
            cut[1:] = self.cut[data[:-1], data[1:]]
        cut[offs[:-1][full]] = True
        return data, offs, np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offs: np.ndarray):
        """Ids of the best segmentations and their offsets, and for each text the scores of its n best."""
        docs = len(offs) - 1
        data, offs, starts = self.parts(data, offs)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(docs + 1, np.int64), [[0.0]] * docs, data, offs
        ends = np.append(starts[1:], len(data))
        keys, some, inverse = np.unique(tv.span_hash(data, starts, ends), return_index=True, return_inverse=True)
        while len(self.keys) and len(self.keys) + len(keys) > CACHE_PARTS:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new, raw = np.flatnonzero(~known), data.tobytes()
            self._learn(keys[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[some[new]].tolist(), ends[some[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        slot = self.slots[at][inverse]
        best, size, steps = self.best.data, self.size.data[slot], self.steps.data
        ids = self.flat.data[tv.ragged(self.start.data[slot], size)]
        ptr = np.searchsorted(starts, offs)
        done = np.concatenate(([0], np.cumsum(size)))[ptr]
        total = np.concatenate(([0.0], np.cumsum(best[slot])))
        top = total[ptr[1:]] - total[ptr[:-1]]
        # the n - 1 parts of each text with the smallest steps
        doc = tv.owner(ptr)
        first = steps[slot, 0]
        order = np.lexsort((first, doc))
        nth = np.arange(len(order)) - ptr[:-1][doc[order]]
        pick = order[(nth < self.n - 1) & np.isfinite(first[order])]
        chosen: list[list[tuple[float, ...]]] = [[] for _ in range(docs)]
        for d, s in zip(doc[pick].tolist(), steps[slot[pick]].tolist(), strict=True):
            chosen[d].append((0.0, *s))
        inf = float("inf")
        scores = [[t - x for x in sorted(map(sum, product(*c)))[: self.n] if x < inf] for t, c in zip(top.tolist(), chosen, strict=True)]
        return ids, done, scores, data, offs

    def segmentations(self, text: str) -> list[tuple[float, list[int]]]:
        """The n best segmentations (score, ids) of one whole text, from the lists of its parts."""
        if not text:
            return [(0.0, [])]
        raw = np.frombuffer(text.encode(), np.uint8)
        data, _, starts = self.parts(raw, np.array([0, len(raw)]))
        whole, cut = data.tobytes(), [*starts.tolist(), len(data)]
        found = [self.search(whole[a:b].decode("utf-8", "replace")) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        step = lambda k, i: found[k][0][0] - found[k][i][0]
        some = sorted((k for k, f in enumerate(found) if len(f) > 1), key=lambda k: (step(k, 1), k))[: self.n - 1]
        ways = sorted((sum(map(step, some, w)), w) for w in product(*(range(len(found[k])) for k in some)))[: self.n]
        top, out = sum(f[0][0] for f in found), []
        for loss, way in ways:
            taken = dict(zip(some, way, strict=True))
            out.append((top - loss, [i for k, f in enumerate(found) for i in f[taken.get(k, 0)][1]]))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of some ids, with the space that encoding has put before it."""
        return self.blob[tv.ragged(self.blob_at[ids], self.blob_size[ids])].tobytes()

    def nbest(self, text: str) -> list[tuple[float, list[int]]]:
        """The n best segmentations of one whole text."""
        return self.search(" " + text) if text else [(0.0, [])]


def segmenter(path: str | None = None, n: int = N_BEST) -> Segmenter:
    """This worker's segmenter."""
    key = (path or vocabulary_path(MODEL), n)
    if key not in _LOADED:
        _LOADED[key] = Segmenter(*key)
    return _LOADED[key]


OUT = "doc_id long, n_pieces long, ids_crc32 long, nbest_scores array<double>, round_trip boolean"


def segment_ids(docs: DataFrame, n: int = N_BEST, path: str | None = None) -> DataFrame:
    """doc_id, rank (from 1), score and ids of the n best segmentations of each text."""
    small_batches(docs.sparkSession)

    def task(batches):
        seg = segmenter(path, n)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = seg.segmentations(text or "")
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(range(1, len(found) + 1), pa.int32()), pa.array([s for s, _ in found]), pa.array([i for _, i in found], kind)], ["doc_id", "rank", "score", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, rank int, score double, ids array<int>")


def segment(docs: DataFrame, n: int = N_BEST, path: str | None = None) -> DataFrame:
    """For each text: pieces and crc32 of the best segmentation's ids, the scores of the n best, and whether decoding gives the text back.

    :func:`segment_ids` gives the ids of all n.
    """
    small_batches(docs.sparkSession)

    def task(batches):
        seg = segmenter(path, n)
        for batch in batches:
            for lo, rows, data, offs in tv.text_slices(batch, "text"):
                ids, ptr, scores, spaced, so = seg.encode(data, offs)
                raw, back = ids.astype("<u4").tobytes(), seg.decode(ids)
                sizes = np.concatenate(([0], np.cumsum(seg.blob_size[ids])))[ptr]
                same = back == spaced.tobytes()
                fine = [same or back[a:b] == spaced[x:y].tobytes() for a, b, x, y in zip(sizes[:-1].tolist(), sizes[1:].tolist(), so[:-1].tolist(), so[1:].tolist(), strict=True)]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array(np.diff(ptr)), pa.array(crc, pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(fine)], [x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, OUT)


def op4_nbest_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(read(spark, sf_dir, "documents"))
