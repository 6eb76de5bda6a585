"""Connected components by alternating star contraction; nothing but counts reaches the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace

#: Edges that a task puts together at once.
CONTRACTED = 1 << 18


def batch_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id that it reaches) for each id of some edges that reaches a smaller one."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(ids))
    while len(x):
        x, y = low[x], low[y]
        x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
        np.minimum.at(low, y, x)
        while (low[low] != low).any():
            low = low[low]
    moved = np.flatnonzero(low != np.arange(len(ids)))
    return ids[moved], ids[low[moved]]


def contracted(edges: DataFrame, most: int = CONTRACTED) -> DataFrame:
    """Edges (a, b) that connect the same ids as ``edges`` (a, b): of each ``most`` edges that a task meets the stars they make, without a shuffle."""

    def task(batches):
        held, n = [], 0

        def stars():
            a, b = batch_stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
            if n >= most:
                yield stars()
                held, n = [], 0
        if held:
            yield stars()

    return edges.select("a", "b").filter("a <> b").mapInArrow(task, "a long, b long")


def components(ws: Workspace, name: str, edges: DataFrame) -> DataFrame:
    """:func:`connected` of edges that tasks have contracted, twice: what many tasks wrote is read by fewer."""
    few = ws.table(f"{name}-few", contracted(edges))
    out = connected(ws, name, contracted(few))
    ws.drop(f"{name}-few")
    return out


def unsettled(edges: DataFrame) -> tuple[bool, bool]:
    """Whether an id of the distinct edges (u, v) points to several others, and whether one that is pointed to points on."""
    sides = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("met"))
    sides = sides.unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("met")))
    ids = sides.groupBy("id").agg(F.sum("out").alias("out"), F.max("met").alias("met"))
    most, chained = ids.agg(F.max("out"), F.count_if((F.col("out") > 0) & (F.col("met") > 0))).first()
    return (most or 0) > 1, chained > 0


def connected(ws: Workspace, name: str, edges: DataFrame, rounds: int = 99) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b): the smallest id that it reaches.

    Each round makes every node point to the smallest neighbour it has seen;
    the rounds grow with the logarithm of the longest path, and none follows
    once every node points to one that points nowhere.  Minima are
    written before they are joined, so a node with very many edges is a skewed
    side of a plain join, which Spark splits.  Edges that have not settled after
    ``rounds`` raise an error; no graph of fewer than 2 ** 60 edges needs so many.
    """
    now = ws.table(f"{name}-0", edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for i in range(1, rounds + 2):
        several, chained = unsettled(now)
        if not several and not chained:
            break
        if i > rounds:
            raise RuntimeError(f"components of {name} have not settled after {rounds} rounds")
        small = now
        if several:
            least = ws.table(f"{name}-m{i}", now.groupBy("u").agg(F.min("v").alias("m")))
            met = now.join(least, "u")
            # each smaller neighbour, and the node itself, points to the smallest neighbour
            small = met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            small = small.unionByName(met.filter("v <> m").select("u", F.col("m").alias("v"))).distinct()
            small = ws.table(f"{name}-s{i}", small)
        # each larger neighbour of a node points to the node's smallest
        least = ws.table(f"{name}-l{i}", small.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "of"))
        large = small.join(least, small["v"] == least["of"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        now = ws.table(f"{name}-{i}", large)
        ws.drop(f"{name}-{i - 1}", f"{name}-m{i}", f"{name}-s{i}", f"{name}-l{i}")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
