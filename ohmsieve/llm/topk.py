"""Exact top-k inner products over an impact-ordered index.

Vectors are dealt into blocks; a block's index holds its postings (row,
dimension, value) in segments of equal quantised impact, largest first, and
for each row the norm of what comes after each segment.  A block of queries
walks the segments in that order.  After each, a candidate's score lies
within query norm times remaining norm of what it has gathered, so candidates
whose upper bound is below the k-th best lower bound are proven out, and rows
and queries without any possible pair leave the walk; once few pairs are left,
or nothing remains, the possible members are scored exactly.

Of more than a few index blocks, the queries first meet one in SEEDS.  The k-th best score there
is a floor for the others: they start with it, and return nothing below it,
so a query gathers about SEEDS * k rows however many blocks there are.

Defined cases: a vector that is null or empty, or holds a null or
non-finite component, takes no part; vectors of different lengths never meet; equal
vectors are all candidates; ties go to the smaller vec_id; of rows that repeat
a vec_id each is a candidate, and a query, of its own: it is left out of its
own answer only; a null vec_id takes no part; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Workspace, read

K = 20
#: Rows of an index block and of a query block.
BLOCK_ROWS, QUERY_ROWS = 8192, 2048
#: Blocks at least, so that small tables use many cores too, and the fewest rows of a block for that.
MIN_BLOCKS, LEAST_ROWS = 24, 512
#: Upper ends of the quantised impact levels, as shares of the block's largest magnitude.
LEVELS = (1.0, 0.36, 0.18, 0.08)
#: Share of a block's pairs that may be left for exact scoring.
FEW = 0.05
#: One index block in so many is met first.
SEEDS = 8
LOWEST = np.iinfo(np.int64).min


def quantised(table: DataFrame, scale: float = 64.0, *more: str) -> DataFrame:
    """vec_id, v (floor(scale * x), long), dim of the vectors that take part, and ``more`` columns."""
    x = F.col("embedding")
    fine = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    v = F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long"))
    return table.filter(fine & (F.size(x) > 0) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(x).alias("dim"), *more)


def _matrix(table: pa.Table) -> np.ndarray:
    v = table.column("v").combine_chunks()
    flat = v.flatten() if not isinstance(v, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in v.chunks])
    return flat.to_numpy().reshape(len(table), -1)


def segments(x: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Posting segments by descending quantised impact, and each row's remaining norm after each."""
    size = np.abs(x)
    top = max(1, int(size.max(initial=0)))
    ends = [int(np.ceil(top * e)) for e in LEVELS] + [0]
    out, rest = [], []
    for hi, lo in zip(ends[:-1], ends[1:], strict=True):
        at = np.flatnonzero((size.ravel() <= hi) & (size.ravel() > lo))
        out.append((at, x.ravel()[at]))
        left = np.where(size <= lo, x, 0).astype(np.float64)
        rest.append(np.sqrt((left * left).sum(1)))
    return out, np.array(rest)


def search(q_rows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, segs, rest: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None):
    """(query, candidate, score) of each query's k best candidates of a block, none below its floor.

    ``q_rows`` and ``rows`` tell which candidate is the query itself.
    """
    n, m = len(rows), len(q)
    floor = np.full(m, LOWEST) if floor is None else floor
    bound = float(np.abs(q).sum(1).max(initial=0)) * float(np.abs(x).max(initial=0))
    kind = np.float32 if bound < 2**24 else np.float64
    whole = bound < 2**53
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    asked, there = np.arange(m), np.arange(n)  # queries and candidates still in the walk
    acc = np.zeros((m, n), kind)
    possible = q_rows[:, None] != rows[None, :]
    done = 0
    for level, (at, value) in enumerate(segs):
        tile = np.zeros(x.size, kind)
        tile[at] = value
        acc += q[asked].astype(kind) @ tile.reshape(x.shape)[there].T
        done = level + 1
        if done == len(segs):
            break
        slack = norm[asked, None] * rest[level][None, there] * (1 + 1e-6) + 1e-3
        theta = floor[asked].astype(np.float64)
        if len(there) > k:
            low = np.where(possible, acc - slack, -np.inf)
            theta = np.maximum(theta, np.partition(low, len(there) - k, axis=1)[:, len(there) - k])
        possible &= acc + slack >= theta[:, None]
        if possible.sum() <= FEW * m * n:
            break
        some_q, some_c = possible.any(1), possible.any(0)
        if some_q.mean() * some_c.mean() < 0.7:
            asked, there, acc, possible = asked[some_q], there[some_c], acc[np.ix_(some_q, some_c)], possible[np.ix_(some_q, some_c)]
    i, j = np.nonzero(possible)
    if done == len(segs) and whole:
        score = acc[i, j].astype(np.int64)
    else:
        score = np.empty(len(i), np.int64)
        for a in range(0, len(i), 1 << 16):
            s = slice(a, a + (1 << 16))
            score[s] = (q[asked[i[s]]] * x[there[j[s]]]).sum(1)
    i, j = asked[i], there[j]
    keep = score >= floor[i]
    i, j, score = i[keep], j[keep], score[keep]
    order = np.lexsort((rows[j], ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[best], j[best], score[best]


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame | Column, k: int = K) -> DataFrame:
    """query, rank, vec_id, score from a table of (vec_id, v, dim).

    ``queries`` is another such table, or a condition on the rows of this one,
    which are then left out of their own answers.
    """
    ws = Workspace(spark, "topk")
    # written, so that a row keeps its number
    vectors = ws.table("vectors", vectors.withColumn("row", F.monotonically_increasing_id()))
    if isinstance(queries, Column):
        queries = vectors.filter(queries)
    else:
        queries = ws.table("queries", queries.withColumn("row", -1 - F.monotonically_increasing_id()))
    n, nq = vectors.count(), queries.count()
    blocks, qblocks = max(1, -(-n // BLOCK_ROWS), min(MIN_BLOCKS, n // LEAST_ROWS)), max(1, -(-nq // QUERY_ROWS))

    def index(table: pa.Table) -> pa.Table:
        x, raw = _matrix(table), lambda name: table.column(name).to_numpy().tobytes()
        segs, rest = segments(x)
        return pa.table({
            "dim": table.column("dim").slice(0, 1), "block": table.column("block").slice(0, 1), "rows": [raw("row")],
            "ids": [raw("vec_id")], "places": [[a.astype(np.int32).tobytes() for a, _ in segs]], "impacts": [[v.tobytes() for _, v in segs]], "rest": [rest.tobytes()],
        })

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    built = ws.table("index", dealt.groupBy("dim", "block").applyInArrow(index, "dim int, block int, rows binary, ids binary, places array<binary>, impacts array<binary>, rest binary"))

    def pack(table: pa.Table) -> pa.Table:
        raw = lambda name: table.column(name).to_numpy().tobytes()
        return pa.table({"dim": table.column("dim").slice(0, 1), "qblock": table.column("qblock").slice(0, 1), "qrows": [raw("row")], "qids": [raw("vec_id")], "q": [_matrix(table).tobytes()], "floor": [raw("floor")]})

    def answer(table: pa.Table) -> pa.Table:
        out = []
        for r in table.to_pylist():
            dim, ints = r["dim"], lambda name: np.frombuffer(r[name], np.int64)  # noqa: B023
            rows, ids, qrows, qids = ints("rows"), ints("ids"), ints("qrows"), ints("qids")
            segs = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.int64)) for a, v in zip(r["places"], r["impacts"], strict=True)]
            x = np.zeros(len(rows) * dim, np.int64)
            for a, v in segs:
                x[a] = v
            i, j, score = search(qrows, ints("q").reshape(len(qrows), dim), rows, ids, segs, np.frombuffer(r["rest"]).reshape(-1, len(rows)), x.reshape(len(rows), dim), k, ints("floor"))
            out.append(pa.table({"qrow": qrows[i], "query": qids[i], "row": rows[j], "vec_id": ids[j], "score": score}))
        return pa.concat_tables(out)

    asked = queries.withColumn("qblock", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(qblocks)).cast("int"))
    seed = F.pmod(F.col("block") - F.col("qblock"), F.lit(SEEDS)) == 0

    def met(asked: DataFrame, which: Column) -> DataFrame:
        """Each query's best rows of some blocks: blocks of queries meet blocks of the index by number, never row by row."""
        packed = asked.groupBy("dim", "qblock").applyInArrow(pack, "dim int, qblock int, qrows binary, qids binary, q binary, floor binary")
        pairs = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).filter(which)
        tasks = max(2 * spark.sparkContext.defaultParallelism, blocks * qblocks // 8)
        found = built.join(pairs, ["dim", "block"]).repartition(tasks, "dim", "block", "qblock").groupBy("dim", "block", "qblock")
        return found.applyInArrow(answer, "qrow long, query long, row long, vec_id long, score long")

    rank = F.row_number().over(Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id", "row"))
    if blocks < 2 * SEEDS:
        found = met(asked.withColumn("floor", F.lit(LOWEST)), F.lit(True))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "vec_id", "score")
    first = ws.table("seeds", met(asked.withColumn("floor", F.lit(LOWEST)), seed).withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"))
    floors = first.withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("qrow").alias("row"), F.col("score").alias("floor"))
    found = first.unionByName(met(asked.join(floors, "row", "left").fillna(LOWEST, ["floor"]), ~seed))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "vec_id", "score")


def op7_impact_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, quantised(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)
