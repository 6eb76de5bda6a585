"""Token ids as wavelet matrices, one compressed file per shard.

A shard holds whole documents in ascending ``doc_id`` order.  Its ids are
recoded by falling frequency; each bit of the codes is one plane, stably
partitioned by the bits before it.  Planes are cut into blocks, each
compressed on its own beside the number of ones before it, so ``access``,
``rank``, ``count`` and ``select`` decompress a few blocks only and
``decode`` restores everything.

Defined cases: a null or empty text is the end id alone; a null ``doc_id``
sorts first; rows that share a ``doc_id`` are ordered by a hash of the text;
an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from . import tokens as tk
from .store import FilePart, Workspace, load_file, read, save_file, small_batches

MAGIC = b"OHMWM01\n"
#: Bytes of a plane's block before compression.
BLOCK = 8192
#: A shard is closed once it has so many tokens.
SHARD_TOKENS = 1 << 20
END_ID = 0
#: Shard files that one task reads.
READ_SHARDS = 8


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def encode_shard(doc_ids: list[int | None], ptr: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of one shard."""
    ids = np.asarray(ids, np.uint32)
    hist = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(hist)
    alphabet = used[np.argsort(-hist[used], kind="stable")].astype(np.uint32)
    code = np.zeros(len(hist), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    a = code[ids]
    bits = max(1, (max(len(alphabet), 1) - 1).bit_length())
    comp = zstandard.ZstdCompressor(level=1)
    planes, zeros, ones, sizes = [], [], [], []
    for level in range(bits - 1, -1, -1):
        mask = (a & a.dtype.type(1 << level)) != 0
        packed = np.packbits(mask, bitorder="little").tobytes()
        low = a.compress(~mask)  # much faster than a[~mask] where the bits are mixed
        zeros.append(len(low))
        if level:
            a = np.concatenate((low, a.compress(mask)))
        total = 0
        for at in range(0, len(packed), BLOCK):
            raw = packed[at : at + BLOCK]
            small = comp.compress(raw)
            planes.append(small if len(small) < len(raw) else raw)
            sizes.append(len(planes[-1]))
            ones.append(total)
            total += int(np.bitwise_count(np.frombuffer(raw, np.uint8)).sum())
    known = np.array([x is not None for x in doc_ids], np.uint8)
    meta = _pack(b"".join((alphabet.astype("<u4").tobytes(), known.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.asarray(ptr, "<i8").tobytes(), np.array(zeros, "<i8").tobytes(), np.array(ones, "<i8").tobytes(), np.array(sizes, "<u4").tobytes())))
    head = MAGIC + struct.pack("<6Q", len(ids), len(alphabet), bits, len(doc_ids), len(sizes), len(meta))
    return head + meta + b"".join(planes)


class WaveletShard:
    """Reads one shard file, given as bytes or as a :class:`FilePart`; blocks are read and decompressed when they are needed."""

    def __init__(self, blob: bytes | FilePart):
        if blob[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard file")
        at = len(MAGIC) + 48
        self.n, sigma, self.bits, docs, blocks, size = struct.unpack("<6Q", blob[len(MAGIC) : at])
        meta = zstandard.ZstdDecompressor().decompress(blob[at : at + size])
        take, place = iter(((sigma, "<u4"), (docs, "u1"), (docs, "<i8"), (docs + 1, "<i8"), (self.bits, "<i8"), (blocks, "<i8"), (blocks, "<u4"))), 0
        parts = []
        for count, kind in take:
            parts.append(np.frombuffer(meta, kind, count, place))
            place += count * np.dtype(kind).itemsize
        self.alphabet, known, ids, self.ptr, self.zeros, self.ones, sizes = parts
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        self.code = {int(x): i for i, x in enumerate(self.alphabet)}
        self.offs = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))) + at + size
        self.per = blocks // self.bits if self.bits else 0
        self.blob, self.cache, self.plain = blob, {}, zstandard.ZstdDecompressor()

    def _block(self, level: int, k: int) -> np.ndarray:
        key = level * self.per + k
        if key not in self.cache:
            raw = self.blob[self.offs[key] : self.offs[key + 1]]
            full = min(BLOCK, -(-self.n // 8) - k * BLOCK)
            self.cache[key] = np.frombuffer(raw if len(raw) == full else self.plain.decompress(raw), np.uint8)
        return self.cache[key]

    def _bit(self, level: int, i: int) -> int:
        k, r = divmod(i, BLOCK * 8)
        return int(self._block(level, k)[r >> 3] >> (r & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i <= 0:
            return 0
        k, r = divmod(i - 1, BLOCK * 8)
        r += 1
        block = self._block(level, k)
        whole = int(np.bitwise_count(block[: r >> 3]).sum())
        if r & 7:
            whole += int(block[r >> 3] & ((1 << (r & 7)) - 1)).bit_count()
        return int(self.ones[level * self.per + k]) + whole

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(self.bits):
            bit, one = self._bit(level, i), self._rank1(level, i)
            code = code << 1 | bit
            i = int(self.zeros[level]) + one if bit else i - one
        return int(self.alphabet[code])

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        code, lo = self.code[symbol], 0
        for level in range(self.bits):
            if code >> (self.bits - 1 - level) & 1:
                lo, i = (int(self.zeros[level]) + self._rank1(level, x) for x in (lo, i))
            else:
                lo, i = (x - self._rank1(level, x) for x in (lo, i))
        return lo, i

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of an id among the first i positions."""
        if symbol not in self.code:
            return 0
        lo, hi = self._range(symbol, max(0, min(i, self.n)))
        return hi - lo

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        return self.rank(symbol, self.n if hi is None else hi) - self.rank(symbol, lo)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) given bit of a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of an id; -1 if there are fewer."""
        if symbol not in self.code or not 0 <= k < self.count(symbol):
            return -1
        code, at = self.code[symbol], self._range(symbol, 0)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = code >> (self.bits - 1 - level) & 1
            at = self._select_bit(level, bit, at - int(self.zeros[level]) if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids (uint32): the planes are undone from the last to the first."""
        if not self.n:
            return np.empty(0, np.uint32)
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            raw = b"".join(self._raw(level, k) for k in range(self.per))
            mask = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            z = int(self.zeros[level])
            out[z:] |= out.dtype.type(1 << (self.bits - 1 - level))
            if z and z < self.n:
                up = np.empty_like(out)
                up[np.flatnonzero(~mask)] = out[:z]
                up[np.flatnonzero(mask)] = out[z:]
                out = up
        return self.alphabet[out]

    def _raw(self, level: int, k: int) -> bytes:
        key = level * self.per + k
        raw = self.blob[self.offs[key] : self.offs[key + 1]]
        full = min(BLOCK, -(-self.n // 8) - k * BLOCK)
        return raw if len(raw) == full else self.plain.decompress(raw)


def open_shard(folder: str, name: str) -> WaveletShard:
    """A shard of which only the blocks that are asked for are read."""
    return WaveletShard(FilePart(folder, name))


def write_shards(spark: SparkSession, docs: DataFrame, ws: Workspace, vocabulary: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes all documents into shard files and returns their manifest (part, seq, file, n_docs, n_tokens)."""
    small_batches(spark)
    folder = ws.path("shards")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def task(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), f"{context.attemptNumber()}-{context.taskAttemptId()}"
        enc, seq = tk.encoder(vocabulary), 0
        docs, ptrs, ids, have = [], [np.zeros(1, np.int64)], [], 0

        def close():
            name = f"{part:06d}-{seq:06d}.{attempt}.wm"
            save_file(folder, name, encode_shard(docs, np.concatenate(ptrs), np.concatenate(ids)))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [name], "n_docs": [len(docs)], "n_tokens": [have]}, MANIFEST)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, rows, data, offs in tv.text_slices(batch):
                got, ptr = tk.with_end(*enc.encode(data, offs), end_id)
                at = 0
                while at < rows:  # as many documents as still fit; at least one
                    stop = int(np.searchsorted(ptr, ptr[at] + shard_tokens - have, "left"))
                    stop = min(max(stop, at + 1), rows)
                    docs += keys[lo + at : lo + stop]
                    ptrs.append(ptr[at + 1 : stop + 1] - ptr[at] + have)
                    ids.append(got[ptr[at] : ptr[stop]])
                    have += int(ptr[stop] - ptr[at])
                    at = stop
                    if have >= shard_tokens:
                        yield close()
                        docs, ptrs, ids, have, seq = [], [np.zeros(1, np.int64)], [], 0, seq + 1
        if docs:
            yield close()

    return ws.table("manifest", ordered.mapInArrow(task, "part int, seq int, file string, n_docs long, n_tokens long"))


MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document as the shard files have it: doc_id, start, n_tokens and the ids' crc32."""
    # the tokens before each writing task's first shard are summed here, one number a task; within a task a window sums
    totals = sorted(manifest.groupBy("part").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect())  # as many rows as tasks wrote
    begins = np.cumsum([0, *(t[1] for t in totals)]).tolist()
    begins = manifest.sparkSession.createDataFrame([(t[0], b) for t, b in zip(totals, begins, strict=False)], "part int, begin long")
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.join(begins, "part").select("file", (F.col("begin") + F.coalesce(before, F.lit(0))).alias("start"))
    placed = placed.repartition(max(1, -(-sum(t[2] for t in totals) // READ_SHARDS)), "file")

    def task(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = WaveletShard(load_file(folder, name))
                raw, ptr = shard.decode().astype("<u4").tobytes(), shard.ptr
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(ptr[:-1] + start), pa.array(np.diff(ptr)), pa.array(crc, pa.int64())], schema=DIGEST)

    return placed.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "wavelet")
    manifest = write_shards(spark, read(spark, sf_dir, "documents"), ws)
    return read_shards(manifest, ws.path("shards"))
