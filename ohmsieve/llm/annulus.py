"""Hard-negative mining with one-dimensional distance keys.

A vector x gets a further coordinate sqrt(M - |x|^2), M the largest squared
norm, so that the vectors with the largest inner product with a query (whose
further coordinate is 0) are those at the least distance from it.  Each vector
is stored under its nearest pivot, sorted by (pivot, distance to the pivot),
and cut into blocks with their least and largest distance.  A row at distance
r or less from a query lies, under every pivot, at a key within r of the
query's own distance to that pivot.  So a search widens the key intervals in
rounds: blocks that the annulus between the last radius and the next one
touches are scanned, and once the k-th best score found is out of reach for
every block left, the answer is proven.  The last round reaches as far as the
k-th best scores demand.

A query asks for rows of its own label or of all others, with scores between
two bounds, which make the annulus narrower on both sides: the positives of an
anchor have none, its negatives those that a positive's score sets.

Blocks of the index stay in the task that has read them, and blocks of queries
stream past; where these are many, a block of the index is copied once for
each SHARE of them.

Defined cases: a row with a null label, vec_id or vector, with an empty vector
or with a null or non-finite component takes no part; vectors of different lengths never meet;
rows that repeat a vec_id are rows of their own, as anchors, positives and
negatives, and an anchor leaves out itself only; equal scores go by vec_id,
then by an arbitrary fixed order of rows; an anchor without other rows of its
label, or a positive without rows between its bounds (always so below 0), has
no result; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Workspace, read
from .topk import _matrix, quantised

#: Components are floor(SCALE * x).
SCALE = 256.0
#: Share in percent of a positive's score that a negative's must reach at least.
NEAR_PERCENT = 80
POSITIVES = NEGATIVES = 5
#: Pivots, and the rows with the smallest hash that they are chosen from: they only change the work, not the result.
PIVOTS, SAMPLE = 32, 2048
#: Rows of an index block, queries of a query block, and query blocks that share one copy of an index block.
BLOCK_ROWS, QUERY_ROWS, SHARE = 4096, 512, 64
#: Shares of the index blocks that the rounds before the last one reach.
ROUNDS = (1 / 16, 1 / 4)
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Relative slack of distances, far above rounding errors.
SLACK = 1e-9

KEYED = "row long, vec_id long, label int, v array<long>, dim int, pivot int, key double, lifted double"


def chosen_pivots(v: np.ndarray, lift: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Pivots by farthest distance: each is the sample row that is farthest from those before."""
    x = np.concatenate((v, lift[:, None]), 1).astype(float)
    picked = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(picked) < min(most, len(x)) and far.max() > 0:
        picked.append(int(np.argmax(far)))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(1))
    return x[picked]


def gaps(v: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all rows to all pivots."""
    x = np.concatenate((v, lift[:, None]), 1).astype(float)
    d = (x * x).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(1)[None]
    return np.sqrt(np.maximum(d, 0))


@dataclass
class KeyIndex:
    """Blocks sorted by (pivot, key), and the rows themselves with their keys."""

    rows: DataFrame
    blocks: DataFrame
    pivots: dict[int, np.ndarray]
    norms: dict[int, int]
    ws: Workspace


def built(spark: SparkSession, vectors: DataFrame) -> KeyIndex:
    """The index of a table (vec_id, label, v, dim)."""
    ws = Workspace(spark, "annulus")
    # written, so that a row keeps its number
    vectors = ws.table("vectors", vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").cast("int").alias("label"), "v", "dim"))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, e: s + e * e)
    norms = {r[0]: r[1] for r in vectors.groupBy("dim").agg(F.max(norm)).collect()}  # a row for each length of vectors
    some = vectors.withColumn("_h", F.xxhash64("row")).orderBy("_h").limit(SAMPLE).collect()
    pivots = {}
    for dim in norms:
        v = np.array([r["v"] for r in some if r["dim"] == dim], np.int64).reshape(-1, dim)
        v = v if len(v) else np.zeros((1, dim), np.int64)  # a length that the sample has not: all rows under one pivot
        pivots[dim] = chosen_pivots(v, np.sqrt(np.maximum(0, norms[dim] - (v * v).sum(1))))

    def keyed(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for dim in set(t.column("dim").to_pylist()):
                part = t.filter(pa.compute.equal(t.column("dim"), dim))
                v = _matrix(part)
                lift = np.sqrt(np.maximum(0, norms[dim] - (v * v).sum(1)).astype(float))
                d = gaps(v, lift, pivots[dim])
                near = d.argmin(1)
                part = part.append_column("pivot", pa.array(near.astype(np.int32))).append_column("key", pa.array(d[np.arange(len(v)), near])).append_column("lifted", pa.array(lift))
                yield from part.to_batches()

    rows = ws.table("keyed", vectors.mapInArrow(keyed, KEYED))

    def packed(batches):
        """Blocks of consecutive rows under one pivot."""
        held, count, size = [], 0, 0

        def block() -> pa.RecordBatch:
            nonlocal held, count, size
            t, raw = pa.concat_tables(held), lambda name: t.column(name).to_numpy().tobytes()
            key, number = t.column("key").to_numpy(), TaskContext.get().partitionId() << 32 | count
            held, count, size = [], count + 1, 0
            return pa.RecordBatch.from_pydict({"block": [number], "dim": t.column("dim")[:1].combine_chunks(), "pivot": t.column("pivot")[:1].combine_chunks(), "lo": [float(key.min())], "hi": [float(key.max())], "n": pa.array([len(t)], pa.int64()), "rows": [raw("row")], "ids": [raw("vec_id")], "labels": [raw("label")], "x": [_matrix(t).tobytes()]})

        for batch in batches:
            t = pa.Table.from_batches([batch])
            where = t.column("dim").to_numpy().astype(np.int64) << 32 | t.column("pivot").to_numpy()
            at = 0
            while at < len(t):
                same = held and held[0].column("pivot")[0] == t.column("pivot")[at] and held[0].column("dim")[0] == t.column("dim")[at]
                if held and (not same or size >= BLOCK_ROWS):
                    yield block()
                end = at + int(np.argmax(np.append(where[at:], -1) != where[at]))
                end = min(end, at + BLOCK_ROWS - size)
                held.append(t.slice(at, end - at))
                size, at = size + end - at, end
        if held:
            yield block()

    n = rows.count()
    parts = max(1, n // (8 * BLOCK_ROWS), min(spark.sparkContext.defaultParallelism, n // 512))
    ordered = rows.repartitionByRange(parts, "dim", "pivot", "key", "row").sortWithinPartitions("dim", "pivot", "key", "row")
    blocks = ordered.mapInArrow(packed, "block long, dim int, pivot int, lo double, hi double, n long, rows binary, ids binary, labels binary, x binary")
    return KeyIndex(rows, ws.table("blocks", blocks), pivots, norms, ws)


def scanned(batches, pivots: dict[int, np.ndarray], norms: dict[int, int], k: int):
    """Answers of query blocks (kind 1) against the index block (kind 0) that comes before them."""
    ints = lambda raw: np.frombuffer(raw, np.int64)
    index: dict = {}
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda name: batch.column(batch.schema.get_field_index(name))[i].as_py()  # noqa: B023, E731
            dim = get("dim")
            if get("kind") == 0:
                index = {n: get(n) for n in ("block", "pivot", "lo", "hi")} | {n: ints(get(n)) for n in ("rows", "ids")} | {"labels": np.frombuffer(get("labels"), np.int32)}
                index["x"] = ints(get("x")).reshape(-1, dim)
                continue
            assert index["block"] == get("block")
            found = matched(index, {n: ints(get(n)) for n in ("rows", "slot", "least", "most", "floor")} | {"labels": np.frombuffer(get("labels"), np.int32), "same": np.frombuffer(get("same"), bool), "x": ints(get("x")).reshape(-1, dim)}, pivots[dim], norms[dim], k)
            yield pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in zip(("qrow", "slot", "row", "vec_id", "score"), found, strict=True)})


def reach(lo: float, hi: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most distance of a block's rows from queries at distances ``own`` from its pivot."""
    return np.maximum(0, np.maximum(own - hi, lo - own)), own + hi


def matched(index: dict, q: dict, pivots: np.ndarray, norm: int, k: int) -> list[np.ndarray]:
    """Each query's best rows of a block, none below its floor, and only for queries whose annulus the block's keys meet."""
    own = gaps(q["x"], np.zeros(len(q["x"])), pivots)[:, index["pivot"]]
    size = (q["x"].astype(float) ** 2).sum(1) + norm
    near, far = reach(index["lo"], index["hi"], own)
    slack = SLACK * (size + index["hi"] ** 2) + 1
    most, least = (size - near**2) / 2 + slack, (size - far**2) / 2 - slack
    floor = np.maximum(q["floor"], q["least"])
    asked = np.flatnonzero((most >= floor) & (least <= q["most"]))
    if not len(asked):
        return [np.empty(0, np.int64)] * 5
    # the slots of an anchor share its products
    _, one, place = np.unique(q["rows"][asked], return_index=True, return_inverse=True)
    x, v = index["x"], q["x"][asked[one]]
    exact = float(np.abs(v).sum(1).max()) * float(np.abs(x).max(initial=0)) < 2**53
    product = (v.astype(float) @ x.T.astype(float)).astype(np.int64) if exact else v @ x.T
    out = []
    for a, p in zip(asked.tolist(), place.tolist(), strict=True):
        s = product[p]
        fits = (s >= floor[a]) & (s <= q["most"][a]) & ((index["labels"] == q["labels"][a]) == q["same"][a]) & (index["rows"] != q["rows"][a])
        at = np.flatnonzero(fits)
        at = at[np.lexsort((index["rows"][at], index["ids"][at], -s[at]))[:k]]
        out.append((np.full(len(at), q["rows"][a]), np.full(len(at), q["slot"][a]), index["rows"][at], index["ids"][at], s[at]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


RESULT = "qrow long, slot long, row long, vec_id long, score long"
PACKED = "qblock long, dim int, rows binary, labels binary, x binary, slot binary, same binary, least binary, most binary, floor binary"


def search(index: KeyIndex, name: str, asked: DataFrame, k: int) -> DataFrame:
    """(qrow, slot, row, vec_id, score, rank): the k best rows for each row of ``asked``, certified.

    ``asked``: (row, label, v, dim, slot, same, least, most), rows of the index
    and what is wanted of them: rows of the same label or of others, with a
    score from ``least`` to ``most``.
    """
    ws, spark = index.ws, index.ws.spark
    pivots, norms = index.pivots, index.norms
    counts = asked.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum(F.ceil(F.col("n") / QUERY_ROWS)).over(Window.orderBy("dim", "pivot").rowsBetween(Window.unboundedPreceding, -1))  # a row a pivot
    deal = counts.select("dim", "pivot", F.coalesce(before, F.lit(0)).alias("first"), F.ceil(F.col("n") / QUERY_ROWS).alias("parts"))
    asked = ws.table(f"{name}-asked", asked.join(deal, ["dim", "pivot"]).withColumn("qblock", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).drop("first", "parts"))

    def distances(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for dim in set(t.column("dim").to_pylist()):
                part = t.filter(pa.compute.equal(t.column("dim"), dim))
                v = _matrix(part)
                d = gaps(v, np.zeros(len(v)), pivots[dim])
                lists = pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), d.shape[1]).cast(pa.list_(pa.float64()))
                yield from pa.table({"qblock": part.column("qblock"), "dim": part.column("dim"), "own": lists}).to_batches()

    own = asked.select("qblock", "dim", "v").mapInArrow(distances, "qblock long, dim int, own array<double>")
    spread = own.select("qblock", "dim", F.posexplode("own").alias("pivot", "d")).groupBy("qblock", "dim", "pivot").agg(F.min("d").alias("near"), F.max("d").alias("far"))
    meta = index.blocks.select("block", "dim", "pivot", "lo", "hi")
    away = F.greatest(F.lit(0.0), F.col("near") - F.col("hi"), F.col("lo") - F.col("far"))
    pairs = ws.table(f"{name}-pairs", spread.join(meta, ["dim", "pivot"]).select("qblock", "block", away.alias("away"), (F.col("far") + F.col("hi")).alias("most_away")))
    # radii by the share of blocks within them
    radii = ws.table(f"{name}-radii", pairs.groupBy("qblock").agg(F.percentile_approx("away", list(ROUNDS), 1000).alias("r")))
    size = F.aggregate("v", F.lit(0.0), lambda s, e: s + (e * e).cast("double")) + F.create_map(*[F.lit(x) for d, m in norms.items() for x in (d, float(m))])[F.col("dim")] if norms else F.lit(0.0)
    # a score's distance, a little more (the outer one) or less (the inner one) against rounding
    outer = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("size") * (1 + SLACK) + 1 - 2.0 * score))
    inner = F.sqrt(F.greatest(F.lit(0.0), F.col("size") * (1 - SLACK) - 1 - 2.0 * F.col("most").cast("double")))
    wanted = asked.withColumn("size", size)
    best, rank = None, F.row_number().over(Window.partitionBy("qrow", "slot").orderBy(F.desc("score"), "vec_id", "row"))
    for turn in range(len(ROUNDS) + 1):
        state = wanted.withColumn("floor", F.lit(LOWEST))
        if best is not None:
            full = best.filter(F.col("rank") == k).select(F.col("qrow").alias("row"), "slot", F.col("score").alias("floor"))
            state = wanted.join(full, ["row", "slot"], "left").fillna(LOWEST, ["floor"])
        state = state.withColumn("need", F.when(F.greatest("floor", "least") == LOWEST, float("inf")).otherwise(outer(F.greatest("floor", "least").cast("double"))))
        span = state.groupBy("qblock").agg(F.max("need").alias("need"), F.min(F.when(F.col("most") == HIGHEST, 0.0).otherwise(inner)).alias("inside")).join(radii, "qblock")
        last, now = (F.lit(-1.0) if turn == 0 else F.col("r")[turn - 1]), (F.col("r")[turn] if turn < len(ROUNDS) else F.lit(float("inf")))
        open_pairs = pairs.join(span, "qblock").filter((F.col("away") > last) & (F.col("away") <= now) & (F.col("away") <= F.col("need") * (1 + SLACK) + 1e-6) & (F.col("most_away") >= F.col("inside") * (1 - SLACK) - 1e-6))
        todo = ws.table(f"{name}-todo{turn}", open_pairs.select("qblock", "block", F.floor(F.col("qblock") / SHARE).alias("share")))

        def packed(t: pa.Table) -> pa.Table:
            raw = lambda c: t.column(c).to_numpy(zero_copy_only=False).tobytes()
            return pa.table({"qblock": t.column("qblock").slice(0, 1), "dim": t.column("dim").slice(0, 1), "rows": [raw("row")], "labels": [raw("label")], "x": [_matrix(t).tobytes()], **{c: [raw(c)] for c in ("slot", "same", "least", "most", "floor")}})

        queries = state.select("qblock", "dim", "row", "label", "v", "slot", "same", "least", "most", "floor").groupBy("qblock").applyInArrow(packed, PACKED)
        copies = index.blocks.join(todo.select("block", "share").distinct(), "block").withColumn("kind", F.lit(0))
        stream = copies.unionByName(queries.join(todo, "qblock").withColumn("kind", F.lit(1)), allowMissingColumns=True)
        tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        stream = stream.repartition(tasks, "block", "share").sortWithinPartitions("block", "share", "kind", "qblock")
        found = stream.mapInArrow(lambda batches: scanned(batches, pivots, norms, k), RESULT)
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = ws.table(f"{name}-best{turn}", found.withColumn("rank", rank).filter(F.col("rank") <= k))
    return best


def hard_negatives(spark: SparkSession, vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, near: int = NEAR_PERCENT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from a table (vec_id, label, v, dim).

    A negative has another label than its anchor and a score of at least
    ``near`` percent of the positive's, and no more than the positive's.
    """
    index = built(spark, vectors)
    own = index.rows.filter(anchors).select("row", "vec_id", "label", "v", "dim", "pivot")
    bounds = lambda same, least, most: {"same": F.lit(same), "least": least.cast("long"), "most": most.cast("long")}
    first = search(index, "positives", own.withColumn("slot", F.lit(0).cast("long")).withColumns(bounds(True, F.lit(LOWEST), F.lit(HIGHEST))), positives)
    first = first.select(F.col("qrow").alias("row"), F.col("rank").cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # the least whole score of which a hundredfold reaches near times the positive's; none can where that is below 0
    least = F.expr(f"-((-{near} * positive_score) div 100)") + F.when((F.col("positive_score") > 0) & (F.col("positive_score") * near % 100 != 0), 1).otherwise(0)
    asked = own.join(first.filter("positive_score >= 0"), "row").withColumns(bounds(False, least, F.col("positive_score")))
    found = search(index, "negatives", asked.select("row", "vec_id", "label", "v", "dim", "pivot", "slot", "same", "least", "most"), negatives)
    named = own.select("row", F.col("vec_id").alias("anchor_id")).join(first, "row")
    out = found.select(F.col("qrow").alias("row"), "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(out, ["row", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def labelled_vectors(table: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id, label, v, dim of the rows that take part."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    plain = table.filter(F.col("label").isNotNull()).withColumn("label", label)
    return quantised(plain, scale, "label")


def op11_annulus_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark, labelled_vectors(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)
