"""Hard negatives, the prefix trie and the additive model, held against plain computations and on the defined cases."""

import hashlib
import math
import os
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ohmsieve.llm import additive, annulus, trie
from ohmsieve.llm import textvec as tv

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# -- op11 -------------------------------------------------------------------


def plain_negatives(rows):
    """rows: (vec_id, embedding, label) in any order; the contract read literally."""
    good = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * float(e)) for e in x]) for i, x, y in rows if i is not None and y is not None and x and all(e is not None and math.isfinite(e) for e in x)]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    out = []
    for n, (i, y, v) in enumerate(good):
        if i % 100:
            continue
        others = sorted(((-dot(v, w), j, z) for m, (j, z, w) in enumerate(good) if m != n and len(w) == len(v)), key=lambda t: t[:2])
        for s, j, _ in [t for t in others if t[2] == y][:5]:
            fit = [(k, -t) for t, k, z in others if z != y and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, r + 1, k, -s, t) for r, (k, t) in enumerate(fit[:5])]
    return sorted(out)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted(map(tuple, annulus.hard_negatives(spark, annulus.labelled_vectors(df), annulus.F.col("vec_id") % 100 == 0).collect()))


def test_hard_negatives_with_many_blocks(spark, monkeypatch):
    """Small blocks, so that rounds, several query blocks and several parts of a pivot occur; ties and equal vectors among the rows."""
    monkeypatch.setattr(annulus, "BLOCK_ROWS", 16)
    monkeypatch.setattr(annulus, "QUERY_ROWS", 2)
    monkeypatch.setattr(annulus, "PIVOTS", 5)
    monkeypatch.setattr(annulus, "SHARE", 2)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5))
    rows = [(25 * i, (centres[i % 6] + rng.normal(scale=0.4, size=5)).round(1).tolist(), int(rng.integers(3))) for i in range(240)]
    rows += [(i, rows[4][1], 1) for i in range(100, 140)]
    assert mined(spark, rows) == plain_negatives(rows) != []


def test_hard_negatives_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, [0.9, 0.1], 3), (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, None, 2), (8, [1.0, None], 2), (9, [0.9, 0.0], None), (None, [0.9, 0.0], 2), (10, [1.0, 0.0, 0.0], 1), (100, [-1.0, 0.0], 1), (200, [0.0, 0.0], 4), (201, [0.0, 0.0], 4), (300, [], 5), (301, [], 5), (302, [], 6)]
    assert mined(spark, rows) == plain_negatives(rows)
    # a vec_id in two rows: each is an anchor and a candidate of its own, and answers alike
    twice = mined(spark, [*rows, (0, [1.0, 0.0], 1)])
    assert twice == plain_negatives([*rows, (0, [1.0, 0.0], 1)])
    assert mined(spark, []) == []


def test_op11_query(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    got = sorted(map(tuple, annulus.op11_annulus_search(spark, SF).collect()))
    assert got == plain_negatives(list(zip(t["vec_id"], t["embedding"], t["label"], strict=True)))


# -- op12 -------------------------------------------------------------------


def plain_trie(rows, heads=9, group=5):
    """rows: (conv_id, turn, role, text); nodes by walking every conversation, sums by visiting every subtree."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(math.fmod(c, group))
        whole[c] = own.get(base, [])[:h] + turns[h:]
    nodes, kids = {}, {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)

    out = []
    for n, members in nodes.items():
        leaves = saved = 0
        open_ = [n]
        while open_:
            u = open_.pop()
            leaves += u not in kids
            saved += (len(nodes[u]) - 1) * len(u[-1][1].encode()) if u else 0
            open_ += kids.get(u, [])
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(n))))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids.get(n, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def grown(spark, rows, more=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string" + more)
    return sorted(map(tuple, trie.prefix_trie(spark, df).collect()), key=repr)


def test_trie_on_random_conversations(spark, monkeypatch):
    """Few different turns, so that conversations share much; long ones, hot first turns, many children and small pieces."""
    monkeypatch.setattr(trie, "PIECE", 8)
    monkeypatch.setattr(trie, "MANY", 2)
    rng = np.random.default_rng(5)
    rows = [(c, t, "ab"[t % 2], "x" * int(rng.integers(3))) for c in range(-12, 90) for t in range(int(rng.integers(1, 14)))]
    rows += [(200, t, "a", "long") for t in range(300)] + [(201, t, "a", "long") for t in range(280)]
    assert grown(spark, rows) == plain_trie(rows)


def test_trie_defined_cases(spark):
    rows = [(0, None, "u", "first"), (0, 1, None, None), (0, 1, "u", "b"), (0, 1, "u", "a"), (0, 1, "u", "a"), (None, 1, "u", "x"), (6, 0, "é", "ü" * 5000), (7, 3, "u", ""), (11, 0, "u:", "1"), (13, 0, "u", ":1"), (-3, 0, "u", "n")]
    assert grown(spark, rows) == plain_trie(rows)
    extra = [(*r, "x", 1) for r in rows]
    assert grown(spark, extra, ", node string, part int") == plain_trie(rows)
    assert grown(spark, []) == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-6, 12), st.integers(0, 4) | st.none(), st.sampled_from(["a", None]), st.sampled_from(["", "x", "yy", None])), max_size=40))
def test_trie_on_any_rows(spark, rows):
    assert grown(spark, rows) == plain_trie(rows)


def test_op12_query(spark):
    t = pq.read_table(f"{SF}/conversations.parquet").to_pydict()
    got = sorted(map(tuple, trie.op12_prefix_trie(spark, SF).collect()), key=repr)
    assert got == plain_trie(list(zip(t["conv_id"], t["turn"], t["role"], t["text"], strict=True)))


# -- op13 -------------------------------------------------------------------


def sliced(*texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw])))


def test_numbers_by_hand():
    x = dict(zip(additive.NAMES, additive.numbers(*sliced("", "The the cat.\nÉté 42!", "##"))[1], strict=True))
    assert x["log_words"] == pytest.approx(math.log(6)) and x["word_length"] == pytest.approx((3 + 3 + 4 + 5 + 3) / 5)
    assert x["digits"] == pytest.approx(2 / 22) and x["capitals"] == pytest.approx(1 / 14) and x["distinct_words"] == 1.0
    assert x["lines"] == pytest.approx(1 / 5) and x["stops"] == pytest.approx(1 / 5) and x["exclaims"] == pytest.approx(1 / 5)


def test_a_text_has_the_same_numbers_alone_and_among_others():
    texts = ["", "one two two", "a b c d e f a b c d e f", "x" * 5000, "line\nline\nline"]
    alone = np.concatenate([additive.numbers(*sliced(t)) for t in texts])
    assert np.allclose(additive.numbers(*sliced(*texts)), alone)
    assert np.isfinite(alone).all()


def test_score_is_the_sum_of_its_tables():
    rng = np.random.default_rng(1)
    x = rng.random((900, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only an interaction tells
    m = additive.fit(x, y)
    for row, got in zip(x[:50], m.score(x[:50]), strict=True):
        z = m.intercept + sum(t[int((e <= v).sum())] for v, e, t in zip(row, m.edges, m.tables, strict=True))
        z += sum(t[int((ea <= row[a]).sum()), int((eb <= row[b]).sum())] for a, b, ea, eb, t in m.pairs)
        assert got == pytest.approx(1 / (1 + math.exp(-z)))
    assert ((m.score(x) >= 0.5) == (y == 1)).mean() > 0.9 and any({a, b} == {0, 1} for a, b, *_ in m.pairs)


def test_best_cut_is_the_best_of_all():
    rng = np.random.default_rng(2)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.random(9) * 2
        gains = [additive.worth(g[:k].sum(), h[:k].sum()) + additive.worth(g[k:].sum(), h[k:].sum()) - additive.worth(g.sum(), h.sum()) if min(h[:k].sum(), h[k:].sum()) >= additive.LEAST else 0.0 for k in range(1, 9)]
        gain, at = additive.best_cut(g, h)
        assert gain == pytest.approx(max(gains)) and at == 1 + int(np.argmax(gains))


def test_model_without_labels_or_with_one_class():
    assert additive.fit(np.empty((0, 21)), np.empty(0)).score(np.zeros((2, 21))).tolist() == [0.5, 0.5]
    assert additive.fit(np.zeros((8, 21)), np.ones(8)).score(np.zeros((1, 21)))[0] == pytest.approx(0.9)


def test_scores_of_any_table(spark):
    model = additive.fit(*[np.concatenate(z) for z in ((np.zeros((30, 21)), np.ones((30, 21))), (np.zeros(30), np.ones(30)))])
    rows = [(1, None, 9.0, "a"), (1, "", 9.0, None), (None, "word " * 400_000, None, "b"), (2, "same", 0.0, "c"), (2, "same", 0.0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality_score double, `c0` string")
    out = additive.score_column(df, model)
    got = sorted(((r["doc_id"], r["quality_score"], r["c0"]) for r in out.collect()), key=repr)
    assert len(got) == 5 and all(0 <= s <= 1 for _, s, _ in got)
    scores = {(r["text"] or "")[:9]: r["quality_score"] for r in out.collect()}
    x = additive.numbers(*sliced("same"))
    assert scores["same"] == pytest.approx(model.score(x)[0]) and scores[""] == pytest.approx(model.score(additive.numbers(*sliced("")))[0])
    assert additive.score_column(df.limit(0), model).count() == 0


def test_op13_learns_only_from_rows_not_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = additive.op13_additive_model(spark, SF).collect()
    held = {r["doc_id"]: r["held_out"] for r in rows}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())
    # turning the labels that are held out changes no score
    turned = labels.withColumn("quality", additive.F.when(additive.F.crc32(additive.F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - additive.F.col("quality")).otherwise(additive.F.col("quality")))
    a, b = additive.learn_model(docs, labels), additive.learn_model(docs, turned)
    assert all(np.array_equal(s, t) for s, t in zip(a.tables, b.tables, strict=True)) and len({r["score"] for r in rows}) > 50
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    right = [r["predicted"] == known[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in known]
    assert sum(right) >= 0.9 * len(right)
    cells = additive.lookup_tables(spark, a)
    assert cells.filter("term = 'intercept'").count() == 1 and cells.count() == 1 + sum(map(len, a.tables)) + sum(t.size for *_, t in a.pairs)
