"""Repeated passages by a sparse suffix array over minimiser positions.

A suffix begins at each word position that is the minimiser of a window: the
position whose run of ``GRAM`` words has the smallest hash among ``WINDOW``
neighbours.  The choice depends on the words alone, so two copies of a passage
of ``MIN_WORDS`` = GRAM + WINDOW - 1 words choose the same positions in it.
Suffixes whose first ``GRAM`` words occur once are dropped; the others are
sorted by those words (as a hash) and by the words that follow.  Neighbours
with equal first words are extended word by word to both sides, up to the
reach of the next window; matches of at least ``MIN_WORDS`` words are kept and
joined into spans.

The array is sorted by ranges of (suffix, document, position), so a passage
with very many copies is spread over tasks.  A suffix is compared with NEAR
neighbours on either side; what they leave open in long runs of equal first
words and at the ends of a range is settled by counts of passage hashes, so no
repeated passage is missed however many suffixes lie between its copies.  Which
copy is the first is decided for each passage of MIN_WORDS words: by the order
of the two in a match of neighbours, by the first place of the hash elsewhere.

Defined cases: a null or empty text, or one of fewer words, has no span;
repeats inside one document count as repeats; rows that share a ``doc_id``
are read as one document's rows and share its spans; a null ``doc_id`` takes
no part; an empty table gives no row; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .jaccard import bucket_of, five, from_five, runs
from .store import Workspace, columns_of, free_names, mapped, read, small_batches

GRAM, WINDOW = 35, 16
MIN_WORDS = GRAM + WINDOW - 1
#: Words on either side of a suffix's first words that are kept for extension.
SIDE = WINDOW - 1
#: Text bytes for each block of suffix hashes, and least and most bits (as powers of 2) of the table of repeated ones: at most 64 MB.
BLOCK_BYTES = 256 << 20
SEEN_BITS = (26, 29)
#: Neighbours on either side with which a suffix is compared before hashes of passages settle the rest.
NEAR = 4
U = np.uint64


def suffixes(data: np.ndarray, offs: np.ndarray):
    """Word hashes, word offsets, hashes of the first words and word index of each sampled suffix, and word starts and ends."""
    starts, ends, ptr = tv.words(data, offs)
    h = tv.span_hash(data, starts, ends)
    g = tv.gram_hash(h, GRAM)
    n = len(h) - MIN_WORDS + 1
    if n <= 0:
        return h, ptr, np.empty(0, U), np.empty(0, np.int64), starts, ends
    place = U(max(1, (len(g) - 1).bit_length()))
    m = (tv.mix(g) >> place << place) | np.arange(len(g), dtype=U)
    step = 1
    while step < WINDOW:  # minima of windows of 2, 4, 8, ... grams
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    doc = tv.owner(ptr)
    m = m[:n][doc[:n] == doc[MIN_WORDS - 1 :]]
    at = np.unique(m & (U(1) << place) - U(1)).astype(np.int64)
    return h, ptr, g[at], at, starts, ends


def repeated_table(docs: DataFrame, buckets: int, seen: int) -> np.ndarray:
    """A bitmap of 2**seen bits over the hash range: set where a suffix's first words occur more than once."""
    bits = (buckets - 1).bit_length()

    def deal(batches):
        for batch in batches:
            for _, _, data, offs in tv.text_slices(batch, "text"):
                s = np.sort(suffixes(data, offs)[2])
                start, length = runs(s)
                s = s[start]
                at = np.searchsorted(s >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
                spans = [(b, int(x), int(y)) for b, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x]
                once = [five(s[x:y][length[x:y] == 1] << U(bits) >> U(24)) for _, x, y in spans]
                twice = [five(s[x:y][length[x:y] > 1] << U(bits) >> U(24)) for _, x, y in spans]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in spans], pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["bucket", "once", "twice"])

    width = 1 << (seen - bits)

    def reduce(table: pa.Table) -> pa.Table:
        once, twice = from_five(table.column("once").to_pylist()), from_five(table.column("twice").to_pylist())
        v = np.concatenate((once, twice, twice))
        v.sort()
        start, length = runs(v)
        cells = np.zeros(width, bool)
        cells[(v[start[length > 1]] >> U(40 - (seen - bits))).astype(np.int64)] = True
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "cells": [np.packbits(cells, bitorder="little").tobytes()]})

    out = np.zeros((1 << seen) // 8, np.uint8)
    for b, cells in docs.select("text").mapInArrow(deal, "bucket int, once binary, twice binary").groupBy("bucket").applyInArrow(reduce, "bucket int, cells binary").toLocalIterator():  # 2 ** seen bits in all
        out[b * width // 8 : (b + 1) * width // 8] = np.frombuffer(bytes(cells), np.uint8)
    return out


SUFFIX = "key long, after binary, before binary, doc_id long, pos long"


def suffix_rows(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """The sampled suffixes that the table lets pass, with the words on either side as 32-bit hashes (0: none)."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    shift = U(64 - (8 * len(table) - 1).bit_length())

    def task(batches):
        bits = shared.value
        for batch in batches:
            for lo, _, data, offs in tv.text_slices(batch, "text"):
                h, ptr, g, at, _, _ = suffixes(data, offs)
                cell = (g >> shift).astype(np.int64)
                keep = np.flatnonzero(bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
                if not len(keep):
                    continue
                g, at = g[keep], at[keep]
                doc = np.searchsorted(ptr, at, "right") - 1
                short = (h >> U(32)).astype(np.uint32) | np.uint32(1)

                def side(step: int, begin: np.ndarray) -> np.ndarray:
                    place = begin[:, None] + step * np.arange(SIDE)
                    ok = (place >= ptr[doc][:, None]) & (place < ptr[doc + 1][:, None])
                    return np.where(ok, short[np.clip(place, 0, len(short) - 1)], 0).astype(">u4")

                after, before = side(1, at + GRAM).tobytes(), side(-1, at - 1).tobytes()
                w = 4 * SIDE
                cut = lambda raw: pa.array([raw[i : i + w] for i in range(0, len(raw), w)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), cut(after), cut(before), batch.column(0).take(pa.array(lo + doc)), pa.array(at - ptr[doc])], ["key", "after", "before", "doc_id", "pos"])

    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(task, SUFFIX)


def _sides(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, SIDE)


def extend(key: np.ndarray, after: np.ndarray, before: np.ndarray, far: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that match the row ``far`` later long enough, and the words that match on the left and right."""
    at = np.flatnonzero(key[far:] == key[:-far])

    def reach(x: np.ndarray) -> np.ndarray:
        a, b = x[at], x[at + far]
        return np.cumprod((a == b) & (a != 0), axis=1).sum(1)

    right, left = reach(after), reach(before)
    ok = left + GRAM + right >= MIN_WORDS
    return at[ok], left[ok], right[ok]


def windows(key: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each passage of MIN_WORDS words around a suffix's first words, by the words on its left, and which exist."""

    def heads(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), SIDE + 1), U)
        for k in range(SIDE):
            out[:, k + 1] = tv.mix(out[:, k] + x[:, k].astype(U))
        return out

    def there(x: np.ndarray) -> np.ndarray:
        return np.cumprod(np.column_stack((np.ones(len(x), bool), x != 0)), axis=1).astype(bool)

    shift = tv.mix(np.arange(1, SIDE + 2, dtype=U))
    h = tv.mix(tv.mix(key.view(U)[:, None] + shift) + heads(before)) + tv.mix(heads(after)[:, ::-1] + shift)
    return tv.mix(h), there(before) & there(after)[:, ::-1]


#: Words ``a`` to ``b`` of a document.  kind 0: a match, ``n`` is 1 if it is with an earlier place; 1: a passage (``window``), how many
#: suffixes of a batch have it (``n``) and the first place; 2: a suffix's passage that no neighbour has at an earlier place.
FOUND = "kind int, doc_id long, a long, b long, n long, window long"


def neighbours(rows: DataFrame) -> DataFrame:
    """Matches of sorted suffixes with their neighbours, and what is left open.

    Suffixes with the same first words are all compared with each other where
    they are at most NEAR + 1 and lie in one range.  Of longer runs, and of
    those at the ends of a range, all passages are counted by hash, once a batch,
    and those of which no neighbour has shown an earlier copy are listed.
    """
    names, reach = [f.split()[0] for f in FOUND.split(", ")], NEAR + 1

    def out(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind), pa.int32()), *(pa.array(c.astype(np.int64)) for c in cols)], names)

    def task(batches):
        held, done, first = None, 0, None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            parts = [x for x in (held, batch) if x is not None]
            if not parts:
                return
            t = pa.Table.from_batches(parts)
            n = t.num_rows
            until = n if batch is None else max(done, n - reach)  # rows from done to until have all their neighbours here
            if until > done:
                key, doc, pos = (t.column(k).to_numpy() for k in ("key", "doc_id", "pos"))
                after, before = _sides(t.column("after")), _sides(t.column("before"))
                first = key[0] if first is None else first
                codes, before_it = [], np.zeros(n, np.int64)
                for far in range(1, min(NEAR, n - 1) + 1):
                    at, left, right = extend(key, after, before, far)
                    proved = (1 << left + 1) - (1 << SIDE - right)  # a bit for each passage, by the words on the left
                    for x, y in ((at, at + far), (at + far, at)):
                        later = (doc[x] > doc[y]) | (doc[x] == doc[y]) & (pos[x] > pos[y])
                        np.bitwise_or.at(before_it, x, np.where(later, proved, 0))
                        mine = (x >= done) & (x < until)
                        codes.append((x << 9 | left << 5 | right << 1 | later)[mine])
                code = np.unique(np.concatenate(codes)) if codes else np.empty(0, np.int64)
                code = code[np.append(code[1:] >> 1 != code[:-1] >> 1, True)] if len(code) else code  # the later of two that differ in that alone
                if len(code):
                    x = code >> 9
                    yield out(0, doc[x], pos[x] - (code >> 5 & 15), pos[x] + GRAM + (code >> 1 & 15), code & 1, np.zeros(len(x)))
                deep = key == first
                if batch is None:
                    deep |= key == key[-1]
                if n > reach:
                    far = np.flatnonzero(key[reach:] == key[:-reach])
                    for k in range(reach + 1):
                        deep[far + k] = True
                x = done + np.flatnonzero(deep[done:until])
                if len(x):
                    x = x[np.lexsort((pos[x], doc[x]))]
                    h, there = windows(key[x], after[x], before[x])
                    row, left = np.nonzero(there)  # rows in order, so the first of a hash is its first place
                    value, head, count = np.unique(h[there], return_index=True, return_counts=True)
                    a = pos[x[row[head]]] - left[head]
                    yield out(1, doc[x[row[head]]], a, a + MIN_WORDS, np.minimum(count, 2), value.view(np.int64))
                    row, left = np.nonzero(there & ~(before_it[x][:, None] >> np.arange(SIDE + 1) & 1).astype(bool))
                    if len(row):
                        a = pos[x[row]] - left
                        yield out(2, doc[x[row]], a, a + MIN_WORDS, np.zeros(len(row)), h[row, left].view(np.int64))
            if batch is None:
                return
            begin = max(0, until - reach)
            held, done = t.slice(begin).combine_chunks().to_batches()[0], until - begin

    ordered = rows.repartitionByRange("key", "after", "doc_id", "pos").sortWithinPartitions("key", "after", "doc_id", "pos")
    return ordered.mapInArrow(task, FOUND)


def far_copies(found: DataFrame) -> DataFrame:
    """Matches of listed passages with suffixes that are no neighbours: by counts and first places of the passages' hashes."""
    heads = found.filter("kind = 1").groupBy("window").agg(F.sum("n").alias("copies"), F.min(F.struct("doc_id", "a")).alias("head")).filter("copies > 1")
    later = F.struct("doc_id", "a") > F.col("head")
    return found.filter("kind = 2").join(heads, "window").select("doc_id", "a", "b", later.alias("later"))


def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The union of ranges."""
    out: list[list[int]] = []
    for a, b in sorted(zip(begin.tolist(), end.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, first_word, n_words, later): the repeated spans of each document in words.

    Rows with ``later`` false are the spans that repeat anything; those with
    ``later`` true are the passages of MIN_WORDS words that, in order of
    (doc_id, position), have begun before: what a deduplication removes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ws = ws or Workspace(spark, "suffix")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = 1 << max(5, (-(-int(total) // BLOCK_BYTES) - 1).bit_length())
    # a suffix for each 48 bytes of text or so
    seen = min(max(SEEN_BITS[0], (int(total) // 48).bit_length()), SEEN_BITS[1])
    table = repeated_table(docs, min(buckets, 1 << 20), seen)
    rows = ws.table("suffixes", suffix_rows(docs, table))
    found = ws.table("found", neighbours(rows))
    ws.drop("suffixes")
    placed = found.filter("kind = 0").select("doc_id", "a", "b", (F.col("n") == 1).alias("later")).unionByName(far_copies(found)).distinct()

    def join(t: pa.Table) -> pa.Table:
        a, b, late = (t.column(k).to_numpy() for k in ("a", "b", "later"))
        spans = [(x, y, False) for x, y in merged(a, b)] + [(x, y, True) for x, y in merged(a[late], b[late])]
        return pa.table({"doc_id": pa.array([t.column("doc_id")[0].as_py()] * len(spans), pa.int64()), "first_word": pa.array([x for x, _, _ in spans], pa.int64()), "n_words": pa.array([y - x for x, y, _ in spans], pa.int64()), "later": pa.array([z for _, _, z in spans], pa.bool_())})

    return ws.table("spans", placed.groupBy("doc_id").applyInArrow(join, "doc_id long, first_word long, n_words long, later boolean"))


def without_repeats(docs: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with the later spans cut from ``text``; documents of which nothing is left go.  ``n_chars`` follows where it is a column.

    ``key`` is the column of ``docs`` that has what the spans call ``doc_id``.
    """
    small_batches(docs.sparkSession)
    (name,) = free_names(docs.columns, "cuts")
    cuts = spans.filter("later").withColumnRenamed("doc_id", key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias(name))
    joined = docs.join(cuts, key, "left").select(*columns_of(docs), name)
    names, at = [f"c{i}" for i in range(len(docs.columns))], docs.columns.index("text")

    def task(batches):
        for batch in batches:
            cut, text = batch.column(batch.num_columns - 1).to_pylist(), batch.column(at).to_pylist()
            for i, ranges in enumerate(cut):
                if ranges and text[i]:
                    raw = text[i].encode()
                    starts, ends, _ = tv.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    keep, done = [], 0
                    for r in ranges:
                        a, b = r["first_word"], r["first_word"] + r["n_words"]
                        if a < len(starts):  # rows that share a doc_id may be shorter
                            keep.append(raw[done : starts[a]])
                            done = int(starts[b]) if b < len(starts) else len(raw)
                    text[i] = b"".join([*keep, raw[done:]]).decode("utf-8", "replace")
            cols = [*batch.columns[:-1]]
            cols[at] = pa.array(text, pa.string())
            left = [not ranges or bool(t and t.strip(" \t\n\v\f\r")) for ranges, t in zip(cut, text, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(left, pa.bool_()))

    out = mapped(joined, task, docs.schema.fields)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out


def op5_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read(spark, sf_dir, "documents"))
