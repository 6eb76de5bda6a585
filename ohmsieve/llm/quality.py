"""Quality rules: base counts and a hashed n-gram logistic regression.

The classifier reads three shares: of character trigrams, of words and of
word pairs, each hashed into a table of weights; a text's score is the sum of
its three mean weights, so one long text costs no memory beyond its slice.
It is fitted on labelled quality rows and its probability is calibrated on
examples kept apart.  A text is kept if the base rules hold and the
probability of good quality reaches the threshold.

Defined cases: a null or empty text has no words and fails the base rules;
without labels of both classes the classifier keeps everything; rows with
equal texts get equal results; a column that has the name of a result is
replaced by it; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .sample import labelled_texts, logistic, natural, slices
from .store import extended, read, small_batches

#: Labelled documents of each class that may be used for fitting, and the bytes of the longest.
TRAIN_DOCS, TRAIN_BYTES = 1500, 16384
BITS = 15
THRESHOLD = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
U32 = np.uint32


def features(data: np.ndarray, offs: np.ndarray):
    """Hashed features of each kind as (table index of each occurrence, D + 1 offsets)."""
    d = data.astype(U32)
    tri = (d[:-2] * U32(0x9E3779B1) + d[1:-1] * U32(0x85EBCA77) + d[2:] * U32(0xC2B2AE3D)) * U32(0x27D4EB2F) >> U32(32 - BITS) if len(d) > 2 else np.empty(0, U32)
    # trigrams that cross into the next text count for neither
    doc = tv.owner(offs)
    ok = doc[: len(tri)] == doc[2:] if len(tri) else np.empty(0, bool)
    at = np.flatnonzero(ok)
    starts, ends, ptr = tv.words(data, offs)
    h = tv.span_hash(tv.LOWER[data], starts, ends)
    pairs, first = tv.doc_grams(h, ptr, 2)
    shift = np.uint64(64 - BITS)
    yield tri[at], np.searchsorted(at, offs)
    yield (h >> shift).astype(U32), ptr
    yield (pairs >> shift).astype(U32), np.searchsorted(first, ptr)


def segment_mean(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    n = np.diff(ptr)
    return (total[ptr[1:]] - total[ptr[:-1]]) / np.maximum(n, 1)


@dataclass
class NgramModel:
    tables: list[np.ndarray] = field(default_factory=list)
    slope: float = 0.0
    bias: float = 20.0

    def raw(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return sum(segment_mean(t[i], ptr) for t, (i, ptr) in zip(self.tables, features(data, offs), strict=True))

    def probability(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = self.raw(data, offs) if self.tables else np.zeros(len(offs) - 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.bias, -30, 30)))


def _shares(texts: list[bytes]):
    """For each kind: document and table index of its distinct features, and their share of the document."""
    kinds, before = [[], [], []], 0
    for data, offs in slices(texts):
        for out, (i, ptr) in zip(kinds, features(data, offs), strict=True):
            key, n = np.unique(tv.owner(ptr) << BITS | i.astype(np.int64), return_counts=True)
            doc = key >> BITS
            out.append(((before + doc).astype(np.int32), (key & (1 << BITS) - 1).astype(np.int32), (n / np.maximum(1, np.diff(ptr))[doc]).astype(np.float32)))
        before += len(offs) - 1
    return [tuple(np.concatenate(x) for x in zip(*out, strict=True)) for out in kinds]


def fit(texts: list[bytes], labels: list[int], totals: dict[int, int] | None = None, rounds: int = 80) -> NgramModel:
    """Adagrad on the logistic loss over four fifths of the examples; a slope and a bias on the rest, with classes weighted as in ``totals``."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return NgramModel()
    learn = np.array([zlib.crc32(t) % 5 > 0 for t in texts])
    if len(set(y[learn])) < 2 or len(set(y[~learn])) < 2:
        learn = np.ones(len(y), bool)
    kinds = _shares([t for t, k in zip(texts, learn, strict=True) if k])
    yl = y[learn]
    weight = np.where(yl == 1, 0.5 / max(1, yl.sum()), 0.5 / max(1, (1 - yl).sum()))
    # a share is scaled by its spread, so that rare and frequent features move alike
    tables = [np.zeros(1 << BITS) for _ in kinds]
    scale = [1 / np.sqrt(np.bincount(i, s * s, 1 << BITS) / len(yl) + 1e-8) for _, i, s in kinds]
    power = [np.full(1 << BITS, 1e-12) for _ in kinds]
    bias = 0.0
    for _ in range(rounds):
        z = bias + sum(np.bincount(d, s * (t * c)[i], len(yl)) for t, c, (d, i, s) in zip(tables, scale, kinds, strict=True))
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - yl)
        bias -= 0.5 * err.sum()
        for t, c, p, (d, i, s) in zip(tables, scale, power, kinds, strict=True):
            g = np.bincount(i, s * err[d], 1 << BITS) * c + 1e-5 * t
            p += g * g
            t -= 0.02 * g / np.sqrt(p)
    model = NgramModel([(t * c).astype(np.float64) for t, c in zip(tables, scale, strict=True)])
    held = ~learn if (~learn).any() else learn
    side = [t for t, k in zip(texts, held, strict=True) if k]
    z = np.concatenate([model.raw(data, offs) for data, offs in slices(side)])
    w = logistic(np.stack([z / 10, np.ones(len(z))], 1), y[held], natural(y[held], totals or {}), ridge=1e-3)
    model.slope, model.bias = float(w[0]) / 10, float(w[1])
    return model


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    docs = len(offs) - 1
    starts, ends, ptr = tv.words(data, offs)
    words = np.diff(ptr)
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offs])
    out = {"n_words": words, "word_chars": total(~tv.SEP[data] & ((data & 0xC0) != 0x80)), "n_symbols": total(SYMBOLS[data])}
    # lines: ranges between line feeds; those with a word and equal to an earlier one of the text count
    feed = data == 10
    begin = np.union1d(offs[:-1][words > 0], np.flatnonzero(feed) + 1)
    begin = begin[begin < len(data)]
    doc = np.searchsorted(offs, begin, "right") - 1
    feeds = np.append(np.flatnonzero(feed), len(data))
    stop = np.minimum(feeds[np.searchsorted(feeds, begin)], offs[doc + 1])
    has = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, doc = begin[has], stop[has], doc[has]
    out["n_dup_lines"] = _later_equal(tv.span_hash(data, begin, stop), doc, docs)
    grams, first = tv.doc_grams(tv.span_hash(data, starts, ends), ptr, 5)
    gdoc = tv.owner(ptr)[first] if len(first) else first
    twice = _in_group(grams, gdoc)
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + 5, -1)
    hit = np.concatenate(([0], np.cumsum(np.cumsum(cover)[:-1] > 0)))
    out["n_repeat_words"] = hit[ptr[1:]] - hit[ptr[:-1]]
    return out


def _in_group(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each value occurs again in its document."""
    key = tv.mix(values + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        eq = k[1:] == k[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.empty(len(k), bool)
    out[order] = same
    return out


def _later_equal(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Per document, values less distinct values."""
    key = tv.mix(values + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, some = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=docs) - np.bincount(doc[some], minlength=docs)


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, good_score double, kept boolean"


NAMES = tuple(x.split()[0] for x in OUT.split(", "))


def judge(docs: DataFrame, model: NgramModel, threshold: float = THRESHOLD, names: tuple[str, ...] | list[str] = NAMES) -> DataFrame:
    """All columns of ``docs``, the base counts, ``base_failed``, ``good_score`` and ``kept``, under other names if these are given."""
    small_batches(docs.sparkSession)

    def results(text) -> list[pa.Array]:
        parts = []
        for _, _, data, offs in tv.text_slices(text):
            c, p = base_counts(data, offs), model.probability(data, offs)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            parts.append([*(c[n].astype(np.int64) for n in NAMES[:5]), failed, p, ~failed & (p >= threshold)])
        return [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]

    kinds = [T.LongType()] * 5 + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    return extended(docs.drop(*names), lambda: results, [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])


def learn_model(docs: DataFrame, labels: DataFrame) -> NgramModel:
    return fit(*labelled_texts(docs, labels, "quality", F.lit(True), TRAIN_DOCS, TRAIN_BYTES))


def op9_ngram_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judge(docs, learn_model(docs, read(spark, sf_dir, "labels"))).drop("text")
