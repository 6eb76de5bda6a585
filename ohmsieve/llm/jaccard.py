"""Exact n-gram Jaccard self-join by the size-aware heavy-light method.

Light sets (few shingles) enumerate their subsets of the overlap size that a
link with each admissible partner size needs: sharing one proves the link.
Heavy sets scan inverted lists of their rarest shingles, just as many as any
partner must share at least one of.  The boundary is the size up to which
enumerating costs less than scanning, from the counts of sizes and the mean
list length.

Before that, two exact reductions keep the work near the copies.  Equal sets
are one class.  A set can only have a partner if three quarters of its
shingles occur in another row, so shingle hashes are first counted in packed
blocks and only sets that pass go on.  Lists yield stars, never all pairs, and
of what a batch of sets adds to a list only its first row leaves the batch.

Rows whose lists meet are a group.  A group of a few parts is compared part by
part.  The rows of a larger one are compared with a few pivots; as the
Jaccard distance obeys the triangle inequality, a row that is linked to a pivot
can only be linked to rows within twice the distance of that pivot, so only
rows near a pivot that are not yet connected to it go on to the rows it covers,
and rows that no pivot covers to each other.  What leaves a task is a spanning
forest of its links.

Defined cases: a null or empty text, or one without words, has no shingles
and no links; rows that share a ``doc_id`` are one node, which is linked with
whatever one of them is linked with; a null ``doc_id`` has no links and a null
component; equal rows are returned each; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .components import components
from .store import Workspace, local_rows, read, small_batches

WORDS = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Text bytes for each block of shingle hashes.
BLOCK_BYTES = 12 << 20
#: Least and most bits (as powers of 2) of the filter of rows that go on: at most 64 MB.  Beyond, rows meet their ids in a join.
FILTER_BITS = (24, 29)
#: Least and most cells (as powers of 2, a byte each) of the table of frequency levels.
LEVEL_BITS = (22, 26)
#: Rows and bytes of sets that make a part of a group, the parts of a group that are all compared with each other, and pivots of a larger one.
GROUP_ROWS, GROUP_BYTES, DIRECT_PARTS, PIVOTS = 128, 4 << 20, 64, 128
#: Sets of more shingles have over 10 ** 9 subsets each, which never costs less than scanning: their sizes are not counted.
LIGHT_SIZES = 36
#: Stands for a null doc_id inside packed blocks.
NO_ID = -(1 << 63)
U = np.uint64


def need(a: int, b: int, percent: int = PERCENT) -> int:
    """The least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def partners(n: int, percent: int = PERCENT) -> range:
    """Sizes that a set linked with one of size n can have."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document in ascending order, and their D + 1 offsets."""
    low = tv.LOWER[data]
    starts, ends, ptr = tv.words(low, offs)
    h = tv.span_hash(low, starts, ends)
    values, first = tv.doc_grams(h, ptr, k)
    size = np.diff(ptr)
    parts, places = [values], [first]
    for n in range(1, k):
        short = np.flatnonzero(size == n)
        if len(short):
            parts.append(tv.gram_hash(h, n)[ptr[:-1][short]])
            places.append(ptr[:-1][short])
    if len(parts) > 1:
        values, first = np.concatenate(parts), np.concatenate(places)
        order = np.argsort(first, kind="stable")
        values, first = values[order], first[order]
    return tv.unique_per_doc(values, np.searchsorted(first, ptr))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Blocks of the hash range, in ascending order of hash."""
    return ((h >> U(40)) * U(buckets) >> U(24)).astype(np.int64)


def five(h: np.ndarray) -> bytes:
    """The low 40 bits of each hash."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_five(blobs: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel().astype(U)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return start, np.diff(np.append(start, len(sorted_values)))


BLOCKS = "bucket int, docs binary, counts binary, once binary, twice binary, n binary, shared binary, sign binary"


def counted_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """For each slice of texts and block of the hash range: shingles of one row of the slice, by row, and those of several.

    A row of its own kind carries each document's size, signature and the
    shingles it shares within the slice.
    """

    def task(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for lo, rows, data, offs in tv.text_slices(batch, "text"):
                v, ptr = shingle_sets(data, offs)
                doc = tv.owner(ptr)
                order = np.argsort(v)
                s = v[order]
                start, length = runs(s)
                d = doc[order]
                alone = np.repeat(length == 1, length)
                shared = np.bincount(d[~alone], minlength=rows)
                one, od = s[alone], d[alone]
                many = s[start[length > 1]]
                b1, bm = bucket_of(one, buckets), bucket_of(many, buckets)
                order = np.lexsort((od, b1))
                one, od, b1 = one[order], od[order], b1[order]
                at1, atm = np.searchsorted(b1, np.arange(buckets + 1)), np.searchsorted(bm, np.arange(buckets + 1))
                out = {name: [] for name in ("bucket", "docs", "counts", "once", "twice")}
                for b in np.flatnonzero((np.diff(at1) > 0) | (np.diff(atm) > 0)).tolist():
                    part = od[at1[b] : at1[b + 1]]
                    rs, rl = runs(part)
                    out["bucket"].append(b)
                    out["docs"].append(ids[lo + part[rs]].astype("<i8").tobytes())
                    out["counts"].append(rl.astype("<u4").tobytes())
                    out["once"].append(five(one[at1[b] : at1[b + 1]]))
                    out["twice"].append(five(many[atm[b] : atm[b + 1]]))
                none = [None] * len(out["bucket"])
                with np.errstate(over="ignore"):
                    sums = [np.concatenate((np.zeros(1, U), np.cumsum(x, dtype=U))) for x in (tv.mix(v), tv.mix(v ^ U(0x5DEECE66D)))]
                sign = np.stack([x[ptr[1:]] - x[ptr[:-1]] for x in sums], 1)
                cols = [out["bucket"] + [int(ids[lo]) % buckets], out["docs"] + [ids[lo : lo + rows].astype("<i8").tobytes()], out["counts"] + [None], out["once"] + [None], out["twice"] + [None]]
                cols += [none + [np.diff(ptr).astype("<i8").tobytes()], none + [shared.astype("<i8").tobytes()], none + [sign.astype("<u8").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], [x.split()[0] for x in BLOCKS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(task, BLOCKS)


def shared_counts(blocks: DataFrame) -> DataFrame:
    """(doc_id, shared, n, sign_a, sign_b): n and the signature in one row for each input row, the rest only adds to shared."""

    def reduce(table: pa.Table) -> pa.Table:
        info = table.filter(pa.compute.is_valid(table.column("n")))
        rest = table.filter(pa.compute.is_null(table.column("n")))
        once, twice = from_five(rest.column("once").to_pylist()), from_five(rest.column("twice").to_pylist())
        docs = np.frombuffer(b"".join(rest.column("docs").to_pylist()), "<i8")
        counts = np.frombuffer(b"".join(rest.column("counts").to_pylist()), "<u4")
        owner = np.repeat(docs, counts)
        allv = np.concatenate((once, twice, twice))
        allv.sort()
        start, length = runs(allv)
        known = allv[start[length > 1]]
        at = np.searchsorted(known, once)
        hit = np.zeros(len(once), bool)
        inside = at < len(known)
        hit[inside] = known[at[inside]] == once[inside]
        d, c = np.unique(owner[hit], return_counts=True)
        blob = lambda name, kind: np.frombuffer(b"".join(info.column(name).to_pylist()), kind)
        idoc, n, sh, sign = blob("docs", "<i8"), blob("n", "<i8"), blob("shared", "<i8"), blob("sign", "<i8").reshape(-1, 2)
        null = pa.nulls(len(d), pa.int64())
        cat = lambda a, b: pa.chunked_array([pa.array(a), b if isinstance(b, pa.Array) else pa.array(b)])
        return pa.table({"doc_id": cat(idoc, d), "shared": cat(sh, c.astype(np.int64)), "n": cat(n, null), "sign_a": cat(sign[:, 0].copy(), null), "sign_b": cat(sign[:, 1].copy(), null)})

    return blocks.groupBy("bucket").applyInArrow(reduce, "doc_id long, shared long, n long, sign_a long, sign_b long")


def id_place(bits: int) -> Column:
    """A document's place in :func:`id_filter`, from 1."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)) + 1


def id_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap that has every id; others may be in it too."""
    p = F.col("p")
    rows = ids.select(id_place(bits).alias("p")).groupBy(F.bitmap_bucket_number(p).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("m"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for k, m in local_rows(rows, "filter"):  # 2 ** bits / 32768 rows of 4096 bytes at most
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bytes(m), np.uint8)
    return out


def chosen_sets(docs: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """(doc_id, n, sset) of the documents whose id is among ``ids``, by a bitmap (which may let others pass) or else a join."""
    spark = docs.sparkSession
    bits = max(FILTER_BITS[0], (8 * n_ids).bit_length())
    joined = bits > FILTER_BITS[1]
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", (F.lit(0) if joined else id_place(bits)).alias("p"))
    if joined:
        rows, shared = rows.join(ids, "doc_id", "left_semi"), None
    else:
        shared = spark.sparkContext.broadcast(id_filter(ids, bits))

    def task(batches):
        mask = shared.value if shared else None
        for batch in batches:
            if mask is not None:
                at = batch.column(2).to_numpy() - 1
                keep = np.flatnonzero(mask[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                batch = batch.take(pa.array(keep))
            ids = batch.column(0)
            for lo, rows, data, offs in tv.text_slices(batch, "text"):
                v, ptr = shingle_sets(data, offs)
                raw, p = v.astype("<u8").tobytes(), (8 * ptr).tolist()
                blobs = [raw[a:b] for a, b in zip(p[:-1], p[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, rows), pa.array(np.diff(ptr)), pa.array(blobs, pa.binary())], ["doc_id", "n", "sset"])

    return rows.mapInArrow(task, "doc_id long, n long, sset binary").filter("n > 0")


def frequency_levels(sets: DataFrame, buckets: int, size: int) -> np.ndarray:
    """For each of 2**size cells of the hash range the largest level of its shingles: 0 if each is in one set, i if one is in up to 2**i."""
    bits = max(1, (buckets - 1).bit_length())

    def deal(batches):
        for batch in batches:
            v = np.sort(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8"))
            start, length = runs(v)
            v = v[start]
            at = np.searchsorted(v >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
            spans = [(b, int(x), int(y)) for b, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in spans], pa.int32()), pa.array([v[x:y].astype("<u8").tobytes() for _, x, y in spans], pa.binary()), pa.array([length[x:y].astype("<u4").tobytes() for _, x, y in spans], pa.binary())], ["bucket", "h", "c"])

    width = 1 << (size - bits)

    def reduce(table: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(table.column("h").to_pylist()), "<u8")
        c = np.frombuffer(b"".join(table.column("c").to_pylist()), "<u4")
        order = np.argsort(h)
        h = h[order]
        start, _ = runs(h)
        df = np.add.reduceat(c[order].astype(np.int64), start)
        level = np.ceil(np.log2(df)).astype(np.uint8)
        cells = np.zeros(width, np.uint8)
        np.maximum.at(cells, (h[start] >> U(64 - size)).astype(np.int64) & (width - 1), level)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "cells": [cells.tobytes()]})

    out = np.zeros(1 << size, np.uint8)
    rows = sets.select("sset").mapInArrow(deal, "bucket int, h binary, c binary").groupBy("bucket").applyInArrow(reduce, "bucket int, cells binary")
    for b, cells in local_rows(rows, "levels"):  # 2 ** size bytes in all
        out[b * width : (b + 1) * width] = np.frombuffer(bytes(cells), np.uint8)
    return out


def subsets_of(n: int, light: int) -> int:
    """Subsets that a light set of size n enumerates."""
    return sum(comb(n, need(n, m)) for m in partners(n) if m <= light)


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """The largest light size: enumerating up to it and scanning from there costs least.  ``sizes``: how many sets have each size up to LIGHT_SIZES."""
    best, at = None, 0
    for x in range(LIGHT_SIZES + 1):
        light = sum(c * subsets_of(n, x) for n, c in sizes.items() if n <= x)
        cost = light + sum(c * (n // 4 + 1) * list_length for n, c in sizes.items() if n > x)
        if best is None or cost < best:
            best, at = cost, x
        elif light > best:  # it only grows from here
            break
    return at


ENTRIES = "bucket int, keys binary, docs binary, n binary, proof binary, edges binary"


def list_entries(sets: DataFrame, levels: np.ndarray, light: int, buckets: int) -> DataFrame:
    """Blocks of inverted-list entries of rare shingles and of subsets of light sets, and edges (a, b, proven) that one batch shows.

    Of the rows of a batch in one list only the first is an entry, the others
    are edges to it; so a list that has a third of all rows still sends one
    entry a batch.
    """
    shared = sets.sparkSession.sparkContext.broadcast(levels)
    shift = U(64 - (len(levels) - 1).bit_length())

    def task(batches):
        table = shared.value
        for batch in batches:
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            v = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").astype(U)
            doc = np.repeat(np.arange(len(n)), n)
            level = table[(v >> shift).astype(np.int64)]
            order = np.lexsort((v, level, doc))
            v, level = v[order], level[order]
            nth = np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n)
            # a partner of a set shares one of its n - ceil(0.75 n) + 1 first shingles in any common order
            lead = n - -(-PERCENT * n // 100) + 1
            heavy = 100 * n >= PERCENT * (light + 1)
            take = (nth < lead[doc]) & (level > 0) & heavy[doc]
            keys, owner = [v[take]], [doc[take]]
            proof = [np.zeros(int(take.sum()), np.uint8)]
            ptr = np.concatenate(([0], np.cumsum(n)))
            for i in np.flatnonzero(n <= light).tolist():
                s = np.sort(v[ptr[i] : ptr[i + 1]])
                own, kind = [], []
                for m in partners(int(n[i])):
                    if m <= light:
                        tag = U(min(m, int(n[i])) << 8 | max(m, int(n[i])))
                        for c in combinations(range(len(s)), need(int(n[i]), m)):
                            own.append(tv.mix(np.array([np.bitwise_xor.reduce(tv.mix(s[list(c)] + tag))]))[0])
                            kind.append(1 if m == n[i] else 2)
                keys.append(np.array(own, U))
                owner.append(np.full(len(own), i))
                proof.append(np.array(kind, np.uint8))
            key, own, pr = np.concatenate(keys), np.concatenate(owner), np.concatenate(proof)
            doc = ids[own]
            order = np.lexsort((doc, key, pr))
            key, own, pr, doc = key[order], own[order], pr[order], doc[order]
            start, length = runs(key ^ (pr.astype(U) << U(62)))
            low = np.repeat(doc[start], length)
            first = np.zeros(len(key), bool)
            first[start] = True
            # subsets of two sizes prove links between the sizes only, so all their rows are entries
            again = ~first & (pr < 2)
            edges = star_edges(doc[again], low[again], pr[again])
            stay = ~again
            key, own, pr, doc = key[stay], own[stay], pr[stay], doc[stay]
            b = bucket_of(tv.mix(key), buckets)  # mixed, for the rarest shingles of like sets are the lowest
            order = np.argsort(b, kind="stable")
            key, own, pr, doc, b = key[order], own[order], pr[order], doc[order], b[order]
            at = np.searchsorted(b, np.arange(buckets + 1))
            spans = [(k, int(x), int(y)) for k, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x]
            pack = lambda a, kind: [a[x:y].astype(kind).tobytes() for _, x, y in spans]
            cols = [[k for k, _, _ in spans], pack(key, "<u8"), pack(doc, "<i8"), pack(n[own], "<i8"), pack(pr, "u1"), [b""] * len(spans)]
            if len(edges):
                for c, x in zip(cols, (int(ids[0]) % buckets, b"", b"", b"", b"", edges.astype("<i8").tobytes()), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], [x.split()[0] for x in ENTRIES.split(", ")])

    return sets.select("doc_id", "n", "sset").mapInArrow(task, ENTRIES)


def star_edges(doc: np.ndarray, low: np.ndarray, proof: np.ndarray) -> np.ndarray:
    """Distinct rows (row, first row of its list, whether that proves a link)."""
    keep = low != doc
    return np.unique(np.stack((doc[keep], low[keep], (proof[keep] > 0).astype(np.int64)), 1), axis=0) if keep.any() else np.empty((0, 3), np.int64)


def stars(entries: DataFrame) -> DataFrame:
    """(a, b, proven): each row of a list with the list's smallest row."""

    def reduce(table: pa.Table) -> pa.Table:
        blob = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        key, doc, n, proof = blob("keys", "<u8"), blob("docs", "<i8"), blob("n", "<i8"), blob("proof", "u1")
        order = np.lexsort((doc, key, proof))
        key, doc, n, proof = key[order], doc[order], n[order], proof[order]
        start, length = runs(key ^ (proof.astype(U) << U(62)))
        low = np.repeat(doc[start], length)
        # a subset of two sizes tells nothing while one of them is missing
        mixed = np.repeat(np.minimum.reduceat(n, start) != np.maximum.reduceat(n, start), length) if len(n) else n > 0
        keep = (proof != 2) | mixed
        edge = np.concatenate((star_edges(doc[keep], low[keep], proof[keep]), blob("edges", "<i8").reshape(-1, 3)))
        return pa.table({"a": edge[:, 0], "b": edge[:, 1], "proven": edge[:, 2].astype(bool)})

    return entries.groupBy("bucket").applyInArrow(reduce, "a long, b long, proven boolean")


def forest(ids: np.ndarray, sets: list[bytes], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets: whoever is reached is compared with all who are not."""
    n = np.array([len(s) // 8 for s in sets])
    flat = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_inverse=True)[1]
    ptr = np.concatenate(([0], np.cumsum(n)))
    mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    left = np.arange(len(ids))
    cols, lptr = flat, ptr
    out, queue = [], []
    alive = np.ones(len(ids), bool)
    while alive.any():
        if not queue:
            queue = [int(np.flatnonzero(alive)[0])]
            alive[queue[0]] = False
        h = queue.pop()
        if len(left) > 64 and alive[left].sum() < 0.7 * len(left):  # the columns of those still apart
            left = np.flatnonzero(alive)
            cols, lptr = flat[tv.ragged(ptr[left], n[left])], np.concatenate(([0], np.cumsum(n[left])))
        if not len(left):
            break
        own = flat[ptr[h] : ptr[h + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[cols], lptr[:-1], dtype=np.int64)
        mark[own] = False
        hit = left[((100 + percent) * both >= percent * (n[left] + n[h])) & alive[left]]
        for x in hit.tolist():
            alive[x] = False
            queue.append(x)
            if ids[x] != ids[h]:
                out.append((int(ids[h]), int(ids[x])))
    return out


def near_counts(own: np.ndarray, cols: np.ndarray, ptr: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """How many of the values ``own`` each of some sets (none of them empty) has."""
    mark[own] = True
    both = np.add.reduceat(mark[cols], ptr[:-1], dtype=np.int64)
    mark[own] = False
    return both


class Sets:
    """Some sets with their values renumbered."""

    def __init__(self, blobs: list[bytes]):
        self.n = np.array([len(b) // 8 for b in blobs], np.int64)
        self.flat = np.unique(np.frombuffer(b"".join(blobs), "<u8"), return_inverse=True)[1]
        self.ptr = np.concatenate(([0], np.cumsum(self.n)))
        self.mark = np.zeros(int(self.flat.max(initial=-1)) + 1, bool)

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.ptr[i] : self.ptr[i + 1]]


def spanning(pairs: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Those of the pairs that connect something new, and the root of each id."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out, {x: root(x) for x in up}


ROUND = "kind int, component long, part int, a long, b long"


def against_pivots(ids: np.ndarray, sets: list[bytes], pivot: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(kind, a, b) from the comparison of some rows with all pivots among them.

    kind 0: a spanning forest of the links; 1: row a is covered by pivot b, to
    which it is linked; 2: no link connects row a with pivot b, but it is so
    near that it may be linked with a row that b covers; 3: row a is covered by none.
    """
    s = Sets(sets)
    wide = max(0, 2 * percent - 100)
    linked: list[tuple[int, int]] = []
    near: list[tuple[int, int]] = []
    cover: dict[int, int] = {}
    for p in np.flatnonzero(pivot).tolist():
        both = near_counts(s.of(p), s.flat, s.ptr, s.mark)
        total = s.n + s.n[p]
        link = (100 + percent) * both >= percent * total
        linked += [(int(ids[x]), int(ids[p])) for x in np.flatnonzero(link).tolist()]
        for x in np.flatnonzero(link & ~pivot).tolist():  # a pivot is also a row of its own part
            cover.setdefault(x, p)
        near += [(x, p) for x in np.flatnonzero(((100 + wide) * both >= wide * total) & ~link & ~pivot).tolist()]
    edges, root = spanning([e for e in linked if e[0] != e[1]])
    out = [(0, a, b) for a, b in edges]
    out += [(1, int(ids[x]), int(ids[p])) for x, p in cover.items()]
    out += [(2, int(ids[x]), int(ids[p])) for x, p in near if root.get(int(ids[x]), -1) != root.get(int(ids[p]), -2)]
    return out + [(3, int(ids[x]), 0) for x in np.flatnonzero(~pivot).tolist() if x not in cover]


def links_within(ws: Workspace, sets: DataFrame, near: DataFrame) -> DataFrame:
    """Links (a, b) that span the linked rows of each group of ``near`` (id, component)."""
    rows = ws.table("near", sets.join(near, sets["doc_id"] == near["id"]).select("doc_id", "n", "component", "sset"))
    several = lambda n, values: F.greatest(F.lit(1), F.ceil(n / GROUP_ROWS), F.ceil(values * 8 / GROUP_BYTES)).cast("int")
    size = ws.table("parts", rows.groupBy("component").agg(several(F.count(F.lit(1)), F.sum("n")).alias("parts"), F.ceil(F.avg("n")).alias("mean")))
    rows = rows.join(size, "component").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    links = all_links(rows.filter(F.col("parts") <= DIRECT_PARTS))
    if size.filter(F.col("parts") > DIRECT_PARTS).isEmpty():
        return links
    large = rows.filter(F.col("parts") > DIRECT_PARTS)
    # pivots go to every part: far fewer than its rows, so what moves grows with the rows
    nth = F.row_number().over(Window.partitionBy("component").orderBy("_h", "doc_id"))
    pivots = large.select("component", "parts", "mean", "doc_id", F.xxhash64(F.lit(7), "doc_id").alias("_h")).withColumn("_k", nth)
    pivots = pivots.filter((F.col("_k") <= PIVOTS) & (F.col("_k") <= F.greatest(F.lit(1), F.lit(GROUP_BYTES) / (8 * F.col("mean")))))
    pivots = ws.table("pivots", large.join(pivots.select("component", "doc_id"), ["component", "doc_id"], "left_semi").select("component", "doc_id", "sset", "parts").dropDuplicates(["component", "doc_id", "sset"]))
    dealt = large.select("component", "part", "doc_id", "sset", F.lit(False).alias("pivot"))
    dealt = dealt.unionByName(pivots.select("component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "doc_id", "sset", F.lit(True).alias("pivot")))

    def compare(table: pa.Table) -> pa.Table:
        c, part = table.column("component")[0].as_py(), table.column("part")[0].as_py()
        out = against_pivots(table.column("doc_id").to_numpy(), table.column("sset").to_pylist(), table.column("pivot").to_numpy())
        kind, a, b = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
        return pa.table({"kind": pa.array(kind, pa.int32()), "component": pa.array(np.full(len(kind), c)), "part": pa.array(np.full(len(kind), part), pa.int32()), "a": a, "b": b})

    first = ws.table("round", dealt.groupBy("component", "part").applyInArrow(compare, ROUND))
    links = links.unionByName(first.filter("kind = 0").select("a", "b"))
    # rows near a pivot that they are not connected with meet the rows that it covers, part by part
    visits = first.filter("kind = 2").select("component", F.col("a").alias("doc_id"), F.col("b").alias("pivot")).distinct()
    if not visits.isEmpty():
        joined = ws.table("joined", components(ws, "pivot", first.filter("kind = 0").select("a", "b")))
        label = lambda name: joined.select(F.col("id").alias(name), F.col("component").alias(f"of_{name}"))
        visits = visits.join(label("doc_id"), "doc_id", "left").join(label("pivot"), "pivot", "left")
        visits = ws.table("visits", visits.filter(F.coalesce("of_doc_id", "doc_id") != F.coalesce("of_pivot", "pivot")).select("component", "doc_id", "pivot"))
    if not visits.isEmpty():
        covered = first.filter("kind = 1").select("component", F.col("a").alias("doc_id"), F.col("b").alias("pivot")).distinct()
        covered = covered.join(visits.select("component", "pivot").distinct(), ["component", "pivot"], "left_semi")
        of = ["component", "pivot"]
        bodies = large.select("component", "doc_id", "n", "sset")
        hosts = ws.table("hosts", covered.join(bodies, ["component", "doc_id"]))
        guests = ws.table("guests", visits.join(covered.select(*of).distinct(), of, "left_semi").join(bodies, ["component", "doc_id"]))
        count = lambda rows, name: rows.groupBy(*of).agg(several(F.count(F.lit(1)), F.sum("n")).alias(name))
        size = count(hosts, "hs").join(count(guests, "gs"), of)
        mine = lambda name: F.pmod(F.xxhash64("doc_id"), F.col(name)).cast("int")
        every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        # parts of the hosts meet parts of the guests
        hosts = hosts.join(size, of).select(*of, mine("hs").alias("i"), every("gs").alias("j"), "doc_id", "sset", F.lit(False).alias("guest"))
        guests = guests.join(size, of).select(*of, every("hs").alias("i"), mine("gs").alias("j"), "doc_id", "sset", F.lit(True).alias("guest"))

        def meet(table: pa.Table) -> pa.Table:
            edges = guest_links(table.column("doc_id").to_numpy(), table.column("sset").to_pylist(), table.column("guest").to_numpy())
            return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

        links = links.unionByName(hosts.unionByName(guests).groupBy(*of, "i", "j").applyInArrow(meet, "a long, b long"))
    # rows that no pivot covers
    alone = first.filter("kind = 3").select("component", F.col("a").alias("doc_id")).distinct()
    if not alone.isEmpty():
        rest = ws.table("alone", large.join(alone, ["component", "doc_id"], "left_semi").select("component", "doc_id", "n", "sset"))
        size = rest.groupBy("component").agg(several(F.count(F.lit(1)), F.sum("n")).alias("parts"))
        links = links.unionByName(all_links(rest.join(size, "component").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))))
    return links


def all_links(rows: DataFrame) -> DataFrame:
    """Links that span the linked rows of each component: each of its ``parts`` meets each."""
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("part", "q"), "j": F.greatest("part", "q")})

    def compare(table: pa.Table) -> pa.Table:
        edges = forest(table.column("doc_id").to_numpy(), table.column("sset").to_pylist())
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return rows.select("component", "i", "j", "doc_id", "sset").groupBy("component", "i", "j").applyInArrow(compare, "a long, b long")


def guest_links(ids: np.ndarray, sets: list[bytes], guest: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between guests and the others."""
    if guest.all() or not guest.any():
        return []
    s = Sets(sets)
    pairs = []
    for g in np.flatnonzero(guest).tolist():
        both = near_counts(s.of(g), s.flat, s.ptr, s.mark)
        pairs += [(int(ids[x]), int(ids[g])) for x in np.flatnonzero(((100 + percent) * both >= percent * (s.n + s.n[g])) & ~guest).tolist()]
    return spanning([e for e in pairs if e[0] != e[1]])[0]


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(32, -(-int(total) // BLOCK_BYTES))
    counts = ws.table("counts", shared_counts(counted_blocks(docs, buckets)))
    info = counts.filter("n IS NOT NULL")
    known = F.col("doc_id") != NO_ID
    classes = ws.table("classes", info.filter((F.col("n") > 0) & known).groupBy("n", "sign_a", "sign_b").agg(F.min("doc_id").alias("rep")))
    ids = ws.table("ids", counts.groupBy("doc_id").agg(F.sum("shared").alias("shared"), F.min("n").alias("n"), F.count("n").alias("rows")))
    enough = ids.filter(F.col("shared") * 100 >= F.col("n") * PERCENT).select("doc_id")
    chosen = ws.table("chosen", enough.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    sets = ws.table("sets", chosen_sets(docs, chosen, chosen.count()))
    held = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    cells = min(max(LEVEL_BITS[0], (2 * int(held[1])).bit_length()), LEVEL_BITS[1])
    few = max(32, -(-int(held[1]) * 8 // BLOCK_BYTES))
    few = 1 << min(cells, (few - 1).bit_length())
    levels = frequency_levels(sets, few, cells)
    sizes = {r[0]: r[1] for r in sets.filter(F.col("n") <= LIGHT_SIZES).groupBy("n").count().collect()}  # a few sizes
    light = boundary(sizes, 1 + float(levels.mean()))
    edges = ws.table("stars", stars(list_entries(sets, levels, light, few)))
    near = ws.table("groups", components(ws, "cand", edges.filter("NOT proven").select("a", "b")))
    links = links_within(ws, sets, near).unionByName(edges.filter("proven").select("a", "b"))
    # a doc_id whose rows are in several classes connects them
    twice = ids.filter((F.col("rows") > 1) & known).select("doc_id")
    least = None
    if not twice.isEmpty():
        both = info.join(twice, "doc_id", "left_semi").join(classes, ["n", "sign_a", "sign_b"]).select("doc_id", "rep").distinct()
        least = ws.table("least", both.groupBy("doc_id").agg(F.min("rep").alias("least")))
        links = links.unionByName(both.join(least, "doc_id").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    comps = ws.table("comps", components(ws, "comp", ws.table("links", links)))
    ws.drop("sets", "near", "stars", "groups", "links", "parts", "ids", "chosen", "pivots", "round", "alone", "hosts", "guests", "visits", "joined")
    named = classes.join(comps, classes["rep"] == comps["id"], "left").select("n", "sign_a", "sign_b", F.coalesce("component", "rep").alias("component"))
    named = ws.table("named", named)
    rows = info.join(named, ["n", "sign_a", "sign_b"], "left")
    if least is not None:  # a text without words follows the others of its doc_id
        of_id = least.join(comps, least["least"] == comps["id"], "left").select("doc_id", F.coalesce("component", "least").alias("of_id"))
        rows = rows.join(of_id, "doc_id", "left").withColumn("component", F.coalesce("of_id", "component"))
    return rows.select(F.when(known, F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(known, F.coalesce("component", "doc_id")).alias("component_id"))


def op2_heavy_light_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(read(spark, sf_dir, "documents"))
