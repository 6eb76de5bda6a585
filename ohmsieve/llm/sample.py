"""Bounded samples of labelled documents, for classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, max_bytes: int) -> tuple[list[bytes], list[int], dict[int, int]]:
    """Distinct texts, their 0/1 label and how many rows have each label: of each class the ``per_class`` labelled rows with the smallest hash of doc_id.

    ``keep`` chooses among the labels; a document with several labels has the
    largest, one with several texts the first of them.  Longer texts than
    ``max_bytes`` are no examples.  At most ``2 * per_class * max_bytes`` bytes
    reach the driver.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & keep)
    known = known.groupBy("doc_id").agg(F.max(label).alias("y")).withColumn("_h", F.xxhash64("doc_id"))
    totals = {r[0]: r[1] for r in known.groupBy("y").count().collect()}  # two rows
    picked = [known.filter(F.col("y") == y).orderBy("_h", "doc_id").limit(per_class) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1]).select("doc_id", "y")
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= max_bytes)
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y").collect()  # 2 * per_class ids are broadcast
    found: dict[bytes, int] = {}
    for _, text, y in sorted(rows, key=lambda r: (r[0], r[1])):
        found.setdefault(text.encode(), y)
    return list(found), list(found.values()), totals


def slices(texts: list[bytes], limit: int = 1 << 20):
    """(data, offs) of consecutive texts, about ``limit`` bytes at once, which bounds what the driver holds."""
    import numpy as np

    part, size = [], 0
    for t in [*texts, None]:
        if part and (t is None or size + len(t) > limit):
            yield np.frombuffer(b"".join(part), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in part])))
            part, size = [], 0
        if t is not None:
            part.append(t)
            size += len(t)


def natural(labels, totals: dict[int, int]):
    """Weights that give a sample's classes the shares they have among all labelled rows; their mean is 1."""
    import numpy as np

    y = np.asarray(labels)
    w = np.ones(len(y))
    for c, n in totals.items():
        w[y == c] = n / max(1, (y == c).sum())
    return w / max(1e-12, w.mean()) if len(y) else w


def logistic(x, y, weight=None, ridge: float = 1e-4, steps: int = 60):
    """Weights of a small ridge logistic regression by Newton's method."""
    import numpy as np

    w = np.zeros(x.shape[1])
    sw = np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (sw * (p - y)) / len(y) + ridge * w
        hess = (x * (sw * p * (1 - p))[:, None]).T @ x / len(y) + (ridge + 1e-9) * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w
