"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on toxic text, one on ordinary
text.  The ordinary one is what the library's own trainer makes of ordinary
documents.  The toxic one ends in the same passages, so that common language
is short under either; before them it has passages of toxic documents, chosen
as the trainer chooses them (greedily, by the worth of the byte runs in a
passage that no chosen passage has), but with the worth of a run being the
logarithm of how unlikely its share of toxic documents is by chance.  A run
counts if that exceeds the logarithm of the number of runs looked at, so few
examples must agree more clearly, but no least number is set.  If no run
counts, the passages are what the trainer makes of the toxic documents.

Every window of two words is compressed with both, behind a fixed run of
spaces so that its block is always a compressed one.  A document's profile
counts the windows that the toxic dictionary makes shorter by at least so many
bytes, and says by how many standard deviations that is more than as many
windows of ordinary text have; a logistic curve turns it into a probability,
with 0.5 as the threshold.  It is fitted on profiles by dictionaries that have
not seen the document (FOLDS parts of the examples); the dictionaries used are
those of all examples.

Defined cases: a null or empty text has no window and gets the score of an
empty profile; without examples of both classes every score is the share of
toxic labels (0 without labels); with any two examples of different classes
texts are compressed; rows with equal texts get equal scores; a text of any
length is scored whole, in a slice of its own; a dictionary holds DICT_BYTES at
most, and once it is full the passages of least worth stay out; a column that
has the score's name is replaced by it; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .sample import labelled_texts, logistic, natural, slices
from .store import extended, read, small_batches

WINDOW_WORDS = 2
#: Labelled documents of each class that may be used for fitting, and the bytes of the longest.
TRAIN_DOCS, TRAIN_BYTES = 2500, 32768
#: Bytes of a run, of a passage, and of the passages that both dictionaries end in; of the trainer's toxic passages where no run counts.
RUN, PASSAGE, SHARED_BYTES, PLAIN_BYTES = 6, 12, 256, 2048
#: zstandard's own default size of a dictionary.
DICT_BYTES = 112_640
#: Bytes saved that the profile counts windows by, and parts of the examples.
SAVED, FOLDS = tuple(range(1, 13)), 3
LEAD = b" " * 48
U = np.uint64


@dataclass
class CompressionModel:
    toxic: bytes = b""
    ordinary: bytes = b""
    chance: np.ndarray = field(default_factory=lambda: np.zeros(len(SAVED)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * len(SAVED) + 2))
    prior: float = 0.0

    def compressors(self):
        size = max(len(self.ordinary), len(self.toxic), 64)
        params = zstandard.ZstdCompressionParameters.from_level(12, source_size=256, dict_size=size, strategy=zstandard.STRATEGY_LAZY2, min_match=6, write_content_size=False, write_dict_id=False)
        out = []
        for content in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress)
        return out

    def profiles(self, data: np.ndarray, offs: np.ndarray, compressors) -> np.ndarray:
        """For each document how many windows the toxic dictionary makes shorter by each of SAVED, and how many windows there are."""
        docs = len(offs) - 1
        low = plain(data)
        starts, ends, ptr = tv.words(low, offs)
        per = -(-np.diff(ptr) // WINDOW_WORDS)
        doc = np.repeat(np.arange(docs), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        first = ptr[:-1][doc] + nth * WINDOW_WORDS
        last = np.minimum(first + WINDOW_WORDS, ptr[1:][doc]) - 1
        raw, (ordinary, toxic) = low.tobytes(), compressors
        # the space before each window's first word and behind its last is part of it
        saved = np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in (b"%b%b " % (LEAD, raw[a:b]) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True))), np.int64, len(doc))
        return np.stack([*(np.bincount(doc[saved >= s], minlength=docs) for s in SAVED), per], 1).astype(float)

    def score(self, data: np.ndarray, offs: np.ndarray, compressors) -> np.ndarray:
        if not self.toxic:
            return np.full(len(offs) - 1, self.prior)
        return 1 / (1 + np.exp(-np.clip(features(self.profiles(data, offs, compressors), self.chance) @ self.weights, -30, 30)))


def features(counts: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """What the curve reads of profiles; ``chance`` is the share of ordinary text's windows for each of SAVED."""
    k, n = counts[:, :-1], counts[:, -1:]
    expected = n * chance
    surplus = np.clip((k - expected) / np.sqrt(expected + 0.5), -3, 12)
    return np.concatenate([surplus, np.log1p(k), np.log1p(n), np.ones((len(n), 1))], 1)


def plain(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, every separator a space."""
    low = tv.LOWER[data]
    low[tv.SEP[low]] = 0x20
    return low


def apart(texts: list[bytes], edge: int = 64) -> list[bool]:
    """Whether a text neither begins nor ends like an earlier one: near copies would make each other's runs look marked."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        ends = {b"<" + t[:edge], b">" + t[-edge:]}
        out.append(not ends & seen)
        seen |= ends
    return out


def runs_of(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of RUN bytes as a number, and where those begin that lie in one text."""
    n = len(low) - RUN + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    v = np.zeros(n, U)
    for j in range(RUN):
        v |= low[j : j + n].astype(U) << U(8 * j)
    doc = tv.owner(offs)
    return v, np.flatnonzero(doc[:n] == doc[RUN - 1 :])


def text_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs in ascending order and how many of the texts have each."""
    value, count = np.empty(0, U), np.empty(0, np.int64)
    for data, offs in slices(texts):
        v, at = runs_of(plain(data), offs)
        doc = tv.owner(offs)[at].astype(U)  # fewer than 2 ** 16: at most 2 * TRAIN_DOCS
        each = np.unique(doc << U(8 * RUN) | v[at]) & U((1 << 8 * RUN) - 1)
        a, c = np.unique(each, return_counts=True)
        value, count = np.concatenate((value, a)), np.concatenate((count, c))
        order = np.argsort(value, kind="stable")
        value, count = value[order], count[order]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(value)), bool), value[1:] != value[:-1])))
        value, count = value[start], np.add.reduceat(count, start) if len(start) else count
    return value, count


def marked_runs(toxic: list[bytes], ordinary: list[bytes]) -> dict[int, float]:
    """Runs that toxic texts have too often for chance, and the logarithm of how unlikely that is (Chernoff's bound of the binomial tail)."""
    (v, a), (w, c) = text_counts(toxic), text_counts(ordinary)
    at = np.minimum(np.searchsorted(w, v), max(0, len(w) - 1))
    b = np.where(w[at] == v, c[at], 0) if len(w) else np.zeros(len(v))
    n, share = a + b, len(toxic) / max(1, len(toxic) + len(ordinary))
    worth = a * np.log(a / (n * share)) + b * np.log(np.maximum(b, 1) / np.maximum(n * (1 - share), 1e-12))
    keep = (a > n * share) & (worth >= np.log(len(v) + len(w) + 1))
    return dict(zip(v[keep].tolist(), worth[keep].tolist(), strict=True))


def passages(texts: list[bytes], worth: dict[int, float], size: int) -> bytes:
    """Passages that cover the runs of worth, the best at the end; each run counts for the first passage that has it only."""
    keys = np.sort(np.fromiter(worth, U, len(worth)))
    found: dict[bytes, None] = {}
    for data, offs in slices(texts):
        low = plain(data)
        v, at = runs_of(low, offs)
        near = np.minimum(np.searchsorted(keys, v[at]), max(0, len(keys) - 1))
        at = at[keys[near] == v[at]] if len(keys) else at[:0]
        doc, raw = np.searchsorted(offs, at, "right") - 1, low.tobytes()
        lo = np.maximum(at - (PASSAGE - RUN) // 2, offs[doc])
        hi = np.minimum(lo + PASSAGE, offs[doc + 1])
        found.update(dict.fromkeys(raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)))
    inside = {p: {int.from_bytes(p[i : i + RUN], "little") for i in range(len(p) - RUN + 1)} for p in found}
    left = dict(worth)
    value = lambda p: sum(left.get(x, 0.0) for x in inside[p])
    heap = [(-value(p), p) for p in found]
    heapq.heapify(heap)
    out, used = [], 0
    while heap and used < size:
        _, p = heapq.heappop(heap)
        now = value(p)
        if heap and -heap[0][0] > now > 0:
            heapq.heappush(heap, (-now, p))
        elif now > 0:
            out.append(p)
            used += len(p)
            for x in inside[p]:
                left.pop(x, None)
    return b"".join(reversed(out))[-size:]


def trained(texts: list[bytes], size: int) -> bytes:
    """What zstandard's trainer makes of some texts; where they are too few for it, the texts themselves."""
    samples = [plain(np.frombuffer(t, np.uint8)).tobytes() for t in texts]
    samples = [t for t in samples if len(t) >= 8] or [b" ".join(samples) or b" "]
    try:
        content = zstandard.train_dictionary(max(1024, size), samples, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        content = b" ".join(samples)
    while samples and len(content) < size:
        content += content or b" "
    return content[-size:]


def dictionaries(texts: list[bytes], labels: list[int]) -> tuple[bytes, bytes]:
    """(toxic, ordinary), of one length, equal in their last SHARED_BYTES."""
    fresh = apart(texts)
    toxic, ordinary = ([t for t, v, f in zip(texts, labels, fresh, strict=True) if f and v == c] for c in (1, 0))
    # a class whose texts all look like earlier ones of the other is taken as it is
    toxic, ordinary = (some or [t for t, v in zip(texts, labels, strict=True) if v == c] for some, c in ((toxic, 1), (ordinary, 0)))
    own = passages(toxic, marked_runs(toxic, ordinary), DICT_BYTES - SHARED_BYTES) or trained(toxic, PLAIN_BYTES)
    common = trained(ordinary, SHARED_BYTES)
    return own + common, (common * (1 + -(-len(own) // len(common))))[-len(own) - len(common) :]


def fit(texts: list[bytes], labels: list[int], totals: dict[int, int] | None = None) -> CompressionModel:
    """Dictionaries from all examples, the curve from profiles by those of other examples, with classes weighted as in ``totals``."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return CompressionModel(prior=float(y.mean()) if len(y) else 0.0)
    # parts of each class in turn, so that the others have both classes wherever there are two examples of each
    order = sorted(range(len(texts)), key=lambda i: (labels[i], zlib.crc32(texts[i]), texts[i]))
    part = np.empty(len(texts), int)
    part[order] = np.arange(len(texts)) % FOLDS
    model = CompressionModel(*dictionaries(texts, labels), prior=float(y.mean()))
    x = np.zeros((len(y), len(SAVED) + 1))
    for k in range(FOLDS):
        mine, rest = np.flatnonzero(part == k), np.flatnonzero(part != k)
        other = CompressionModel(*dictionaries([texts[i] for i in rest], y[rest].tolist())) if len(set(y[rest])) == 2 else model
        pair = other.compressors()
        if len(mine):
            x[mine] = np.concatenate([other.profiles(data, offs, pair) for data, offs in slices([texts[i] for i in mine])])
    quiet = x[y == 0].sum(0)
    model.chance = (quiet[:-1] + 0.5) / (quiet[-1] + 1)
    model.weights = logistic(features(x, model.chance), y, natural(y, totals or {}), ridge=1e-3)
    return model


def learn_model(docs: DataFrame, labels: DataFrame) -> CompressionModel:
    """A model from the labels whose doc_id is not held out."""
    keep = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    return fit(*labelled_texts(docs, labels, "toxic", keep, TRAIN_DOCS, TRAIN_BYTES))


def score_column(docs: DataFrame, model: CompressionModel, name: str = "toxic_score") -> DataFrame:
    """All columns of ``docs`` and the score as the column ``name``."""
    small_batches(docs.sparkSession)

    def start():
        pair = model.compressors() if model.toxic else None
        return lambda text: [pa.array(np.concatenate([model.score(data, offs, pair) for _, _, data, offs in tv.text_slices(text)]))]

    return extended(docs.drop(name), start, [T.StructField(name, T.DoubleType())])


def op8_compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score_column(docs, learn_model(docs, read(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), F.when(F.col("toxic_score") >= 0.5, 1).otherwise(0).alias("predicted"))
