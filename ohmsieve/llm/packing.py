"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Lengths are integers up to the capacity, so the packing is planned on their
histogram: at most ``capacity`` counts, whatever the corpus.  A bin is filled
greedily, largest piece first; then its smallest piece is given back and
replaced by the two unpacked pieces that fit the widened gap more tightly, if
there are such.  A bin's recipe is repeated as often as the counts allow,
which is what packing bin by bin would do.  Pieces then find their bin by
their rank among the pieces of equal length.

Defined cases: a null or empty text is one piece, the end id alone; equal
rows are packed each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from . import tokens as tk
from .store import Workspace, read, small_batches

CAPACITY = 1024
END_ID = 2
#: Rows of one length that are ranked together, on average at most.
RANK_ROWS = 100_000


def pair_for(gap: int, least: int, have: np.ndarray) -> tuple[int, int] | None:
    """Two available lengths with the largest sum that is over ``least`` and at most ``gap``."""
    sizes = np.flatnonzero(have[: gap + 1])
    best, pair = least, None
    i, j = 0, len(sizes) - 1
    while i <= j and best < gap:
        a, b = int(sizes[i]), int(sizes[j])
        if a + b > gap:
            j -= 1
            continue
        if a + b > best and (a != b or have[a] >= 2):
            best, pair = a + b, (b, a)
        i += 1
    return pair


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Recipes (lengths in a bin, number of such bins) that use up all counts."""
    have = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        have[size] = n
    out: list[tuple[list[int], int]] = []
    while have.any():
        left, gap, content = have.copy(), capacity, []
        while gap and (fits := np.flatnonzero(left[: gap + 1])).size:
            size = int(fits[-1])
            content.append(size)
            left[size] -= 1
            gap -= size
        if gap and len(content) > 1:
            smallest = content[-1]
            if pair := pair_for(gap + smallest, smallest, left):
                content[-1:] = pair
        use = np.bincount(content, minlength=capacity + 1)
        times = int((have[use > 0] // use[use > 0]).min())
        have -= times * use
        out.append((content, times))
    return out


def placements(recipes: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length the runs of ranks that a recipe takes: where they start, its first bin, its bins and the place in the bin."""
    rows, first, taken = [], 0, {}
    for content, times in recipes:
        at = 0
        for size in content:
            rows.append((size, taken.get(size, 0), first, times, at))
            taken[size] = taken.get(size, 0) + times
            at += size
        first += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return {"length": a[:, 0], "rank": a[:, 1], "bin": a[:, 2], "times": a[:, 3], "offset": a[:, 4]}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Documents cut into pieces of at most ``capacity`` ids; only the first piece of a longer one may be shorter."""
    small_batches(spark)
    schema = PIECES + (", ids binary" if with_ids else "")

    def task(batches):
        enc = tk.encoder(vocabulary)
        for batch in batches:
            for lo, rows, data, offs in tv.text_slices(batch):
                ids, ptr = tk.with_end(*enc.encode(data, offs), end_id)
                size = np.diff(ptr)
                parts = -(-size // capacity)
                doc = np.repeat(np.arange(rows), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                head = (size - (parts - 1) * capacity)[doc]
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                raw = ids.astype("<u4").tobytes()
                begin = 4 * (ptr[:-1][doc] + start)
                spans = [raw[a:b] for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
                cols = [batch.column(0).take(pa.array(lo + doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in spans], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(spans, pa.binary())] if with_ids else []), names + (["ids"] if with_ids else []))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, schema)


def pack(items: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32"), salt: str | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to capacity.

    ``items`` is read three times, so it should be a written table.  ``order``
    decides between pieces of equal length; rows equal in it are alike.  They
    are ranked apart if the column ``salt``, which the result lacks, has
    different numbers for them.
    """
    total = items.count()
    buckets = max(16, -(-total // RANK_ROWS))
    items = items.withColumn("_bucket", F.pmod(F.xxhash64(*order, *([salt] if salt else [])), F.lit(buckets)).cast("int"))
    counts = items.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    hist = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    place = placements(best_two_fit(hist, capacity))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)).cast("long") - 1)
    ranked = ranked.join(counts.select("length", "_bucket", before.alias("_before")), ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    kept = [c for c in items.columns if c not in ("_bucket", salt)]
    names = [*kept, "_rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema if f.name in kept) + ", sequence_id long, offset long"
    width = int(max(hist.values(), default=0)) + 1
    keys = place["length"] * width + place["rank"]

    def task(batches):
        for b in batches:
            length, rank = b.column(names.index("length")).to_numpy(), b.column(len(names) - 1).to_numpy()
            at = np.searchsorted(keys, length * width + rank, "right") - 1
            seq = place["bin"][at] + rank - place["rank"][at]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(place["offset"][at])], [*kept, "sequence_id", "offset"])

    return ranked.select(*names).mapInArrow(task, schema)


def pack_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Tokenises, cuts and packs documents."""
    ws = Workspace(spark, "packing")
    made = pieces(spark, docs).withColumn("_salt", F.monotonically_increasing_id())
    return pack(ws.table("pieces", made), salt="_salt")


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, read(spark, sf_dir, "documents"))
