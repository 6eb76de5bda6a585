"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a row of NAMES numbers.  Each number has a table of log-odds
by bin, and a few pairs of numbers have a table by two bins.  The tables are
learnt by cyclic boosting: round after round, a tree of at most three leaves
is fitted to one number's bins (one of depth two to a pair's cells) and a small
step of it is added to the table.  A score is the intercept plus one cell of
each table, for whole batches at once, turned into a probability.

The labelled texts' numbers are computed on Spark from whole texts; only they,
at most TRAIN_DOCS rows, reach the driver.

Defined cases: a null or empty text has zeros for numbers and the score of
their bins; without labels every score is 0.5, with labels of one class the
smoothed share of that class; rows with equal texts get equal scores, also
where a doc_id repeats; a label that is null or not 0 or 1 is ignored, of
several labels of a doc_id the largest counts; a text of any length is one row
of numbers, and longer ones than a slice are handled alone; an empty table
gives no row; a column that has the score's name is replaced by it; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .quality import SYMBOLS, base_counts
from .store import extended, free_names, mapped, read, small_batches

NAMES = (
    "log_words", "word_length", "word_spread", "longest_word", "short_words", "symbols", "marks", "stops", "exclaims", "digits", "capitals",
    "non_ascii", "capital_words", "symbol_words", "lines", "dup_lines", "repeat_words", "distinct_words", "top_word", "letters", "entropy",
)
#: Labelled documents that may be used for fitting, those with the smallest hash of doc_id.
TRAIN_DOCS = 20_000
#: Bins of a number, and of each side of a pair; pairs; most rounds over all numbers, and over all pairs.
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS = 32, 8, 6, 240, 80
RATE, RIDGE, LEAST = 0.1, 1.0, 0.5
#: Share of the examples, as one in so many, on which the number of rounds is chosen; the examples of each class that this
#: takes on either side, and the rounds where there are fewer.
HELD, LEAST_HELD, FEW_ROUNDS = 6, 10, (40, 10)
THRESHOLD = 0.7

_KIND = np.zeros((6, 256), bool)
_KIND[0, list(b".,;:?!'\"()[]{}-_/\\@^`~+=")] = True
_KIND[1, ord(".")] = _KIND[2, ord("!")] = True
_KIND[3, 48:58] = _KIND[4, 65:91] = _KIND[5, 128:] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def numbers(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of NAMES for each document of a slice."""
    docs, size = len(offs) - 1, np.maximum(1, np.diff(offs)).astype(float)
    base = base_counts(data, offs)
    starts, ends, ptr = tv.words(data, offs)
    n, some = np.diff(ptr), np.maximum(1, np.diff(ptr)).astype(float)
    sums = lambda v, at: np.diff(np.concatenate(([0], np.cumsum(v, dtype=np.float64)))[at])
    long = (ends - starts).astype(float)
    mean = sums(long, ptr) / some
    doc = tv.owner(ptr)
    most = np.zeros(docs)
    np.maximum.at(most, doc, long)
    hashed = tv.span_hash(data, starts, ends)
    order = np.lexsort((hashed, doc))
    h, d = hashed[order], doc[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
    times, top = np.diff(np.append(first, len(h))), np.zeros(docs)
    np.maximum.at(top, d[first], times)
    marks, stops, exclaims, digits, capitals, non_ascii = (sums(k[data], offs) for k in _KIND)
    letters = sums(_LETTER[data], offs)
    counts = np.bincount(tv.owner(offs) * 256 + data, minlength=docs * 256).reshape(docs, 256) / size[:, None]
    entropy = -(counts * np.log2(np.where(counts > 0, counts, 1))).sum(1)
    lines = sums(data == 10, offs)
    out = [
        np.log1p(n), mean, np.sqrt(np.maximum(0, sums(long * long, ptr) / some - mean * mean)), np.log1p(most), sums(long <= 3, ptr) / some, base["n_symbols"] / size, marks / size, stops / some, exclaims / some, digits / size, capitals / np.maximum(1, letters),
        non_ascii / size, sums(_KIND[4][data[starts]], ptr) / some, sums(SYMBOLS[data[ends - 1]], ptr) / some, lines / some, base["n_dup_lines"] / (1 + lines), base["n_repeat_words"] / some, np.bincount(d[first], minlength=docs) / some, top / some, letters / size, entropy,
    ]
    return np.stack(out, 1)


@dataclass
class AdditiveModel:
    """An intercept, edges and a table for each number, and (a, b, edges, edges, table) for each pair."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, i], "right")]
        for a, b, ea, eb, table in self.pairs:
            out += table[np.searchsorted(ea, x[:, a], "right"), np.searchsorted(eb, x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges of at most so many bins with about as many values each; a value on an edge is in the upper bin."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.empty(0)


def worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, bins left of the cut) of the best cut of ordered bins with gradient and curvature sums; gain 0 where none is allowed."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= LEAST) & (hr >= LEAST), worth(gl, hl) + worth(gr, hr) - worth(g.sum(), h.sum()), 0.0)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def shallow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of a tree of at most three leaves for each bin."""
    gain, cut = best_cut(g, h)
    ends = [0, len(g)]
    if gain > 0:
        ends = [0, cut, len(g)]
        more = max((*best_cut(g[a:b], h[a:b]), a) for a, b in zip(ends[:-1], ends[1:], strict=True))
        if more[0] > 0:
            ends = sorted([*ends, more[2] + more[1]])
    out = np.empty(len(g))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def crossed(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and the values of a tree of depth two over a table's cells: one axis is cut, then each side along the other."""
    best, whole = (0.0, np.zeros(g.shape)), worth(g.sum(), h.sum())
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        _, cut = best_cut(a.sum(1), b.sum(1))
        if not 0 < cut < len(a):
            continue
        out, gain = np.empty(a.shape), -whole
        for side in (slice(0, cut), slice(cut, len(a))):
            x, y = a[side].sum(0), b[side].sum(0)
            more, at = best_cut(x, y)
            for part in (slice(0, at), slice(at, len(x))) if more > 0 else (slice(0, len(x)),):
                out[side, part] = x[part].sum() / (y[part].sum() + RIDGE)
                gain += worth(x[part].sum(), y[part].sum())
        if gain > best[0]:
            best = gain, out.T if turn else out
    return best


def loss(margin: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, margin) - y * margin)) if len(y) else 0.0


def boosted(x: np.ndarray, y: np.ndarray, rounds: tuple[int, int], learn: np.ndarray) -> tuple[AdditiveModel, tuple[int, int]]:
    """A model fitted on the rows of ``learn``, and how many rounds over numbers and pairs served the other rows best."""
    m = AdditiveModel(float(np.log((y[learn].sum() + 1) / ((1 - y[learn]).sum() + 1))))
    m.edges = [quantile_edges(x[learn, i], BINS) for i in range(x.shape[1])]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    places = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(m.edges)]
    margin, picked = np.full(len(y), m.intercept), [0, 0]
    weight = learn.astype(float)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return weight * (y - p), weight * p * (1 - p)

    def cycles(which: int, steps) -> None:
        least = loss(margin[~learn], y[~learn])
        for k in range(rounds[which]):
            for step in steps:
                step()
            now = loss(margin[~learn], y[~learn])
            if now < least - 1e-6:
                least, picked[which] = now, k + 1
            elif not learn.all() and k - picked[which] >= 30:
                break

    def number(i: int):
        def step() -> None:
            g, h = slopes()
            cells = len(m.tables[i])
            move = RATE * shallow(np.bincount(places[i], g, cells), np.bincount(places[i], h, cells))
            m.tables[i] += move
            margin[:] += move[places[i]]

        return step

    cycles(0, [number(i) for i in range(x.shape[1]) if len(m.edges[i])])
    coarse = [quantile_edges(x[learn, i], PAIR_BINS) for i in range(x.shape[1])]
    near = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(coarse)]

    def cells(a: int, b: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        return near[a] * shape[1] + near[b], shape

    def fitted(a: int, b: int) -> tuple[float, np.ndarray, np.ndarray]:
        (at, shape), (g, h) = cells(a, b), slopes()
        n = shape[0] * shape[1]
        gain, move = crossed(np.bincount(at, g, n).reshape(shape), np.bincount(at, h, n).reshape(shape))
        return gain, move, at

    ranked = sorted(((-fitted(a, b)[0], a, b) for a, b in combinations(range(x.shape[1]), 2)))[:PAIRS]
    m.pairs = [(a, b, coarse[a], coarse[b], np.zeros(cells(a, b)[1])) for gain, a, b in ranked if gain < 0]

    def pair(a: int, b: int, table: np.ndarray):
        def step() -> None:
            _, move, at = fitted(a, b)
            table[:] += RATE * move
            margin[:] += RATE * move.ravel()[at]

        return step

    cycles(1, [pair(a, b, table) for a, b, _, _, table in m.pairs])
    return m, (picked[0], picked[1])


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """The rounds are chosen on one example in HELD, or fixed where these are too few; then all examples are used."""
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return AdditiveModel(float(np.log((y.sum() + 1) / ((1 - y).sum() + 1))))
    learn = np.arange(len(y)) % HELD > 0
    if min((y[part] == c).sum() for part in (learn, ~learn) for c in (0, 1)) < LEAST_HELD:
        return boosted(x, y, FEW_ROUNDS, np.ones(len(y), bool))[0]
    _, rounds = boosted(x, y, (ROUNDS, PAIR_ROUNDS), learn)
    return boosted(x, y, rounds, np.ones(len(y), bool))[0]


def labelled_numbers(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and labels of the ``most`` labelled documents with the smallest hash of doc_id, in that order."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max(label).alias("y"))
    ids = known.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most ``most`` ids are broadcast

    def task(batches):
        for batch in batches:
            parts = [numbers(data, offs) for _, _, data, offs in tv.text_slices(batch.column(3))]
            if parts:
                x = np.concatenate(parts)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["c0", "c1", "c2", "c3"])

    kinds = [T.StructField("h", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("y", ids.schema["y"].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))]
    rows = mapped(texts.select("_h", "doc_id", "y", "text"), task, kinds).groupBy("h", "doc_id", "y").agg(F.min("x").alias("x"))
    found = sorted(rows.collect())  # at most ``most`` rows of numbers
    return np.array([r["x"] for r in found], float).reshape(-1, len(NAMES)), np.array([r["y"] for r in found], float)


def learn_model(docs: DataFrame, labels: DataFrame) -> AdditiveModel:
    """A model from the quality labels whose doc_id is not held out."""
    keep = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    return fit(*labelled_numbers(docs, labels, "quality", keep))


def score_column(docs: DataFrame, model: AdditiveModel, name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and the score as the column ``name``."""
    small_batches(docs.sparkSession)

    def start():
        return lambda text: [pa.array(np.concatenate([model.score(numbers(data, offs)) for _, _, data, offs in tv.text_slices(text)]))]

    return extended(docs.drop(name), start, [T.StructField(name, T.DoubleType())])


def lookup_tables(spark: SparkSession, model: AdditiveModel) -> DataFrame:
    """(term, lower, lower_2, log_odds): every cell of a model, for reading it."""
    low = lambda e, k: None if k == 0 else float(e[k - 1])
    rows = [("intercept", None, None, model.intercept)]
    rows += [(NAMES[i], low(e, k), None, float(v)) for i, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)) for k, v in enumerate(t)]
    rows += [(f"{NAMES[a]} x {NAMES[b]}", low(ea, i), low(eb, j), float(v)) for a, b, ea, eb, t in model.pairs for (i, j), v in np.ndenumerate(t)]
    return spark.createDataFrame(rows, "term string, lower double, lower_2 double, log_odds double")


def op13_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    (name,) = free_names(docs.columns, "score")
    scored = score_column(docs, learn_model(docs, read(spark, sf_dir, "labels")), name)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
