"""Ring, reputation, top-k, toxicity and quality."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmsieve.llm import quality, reputation, ring, topk, toxicity

from .test_text import SCHEMA, batch, docs


def test_ring_balance_and_slots(spark):
    rows = [(i, f"text {i % 7}") for i in range(500)] + [(None, None)] * 30 + [(3, "twin")] * 20
    got = ring.assign(docs(spark, rows), shards=7, cells=64, per_shard=5).toPandas()
    assert len(got) == len(rows)
    n = got.groupby("shard").size()
    assert len(n) == 7 and n.max() - n.min() <= 1
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert set(got.law) == {"rows"} and got.grown_shard.isna().all()
    first = got[got.doc_id == 1].iloc[0]
    assert (first["size"], first.text_crc32) == (len("text 1") + 16, zlib.crc32(b"text 1"))
    empty = got[got.doc_id.isna()]
    assert set(empty["size"]) == {16} and set(empty.text_crc32) == {0}
    assert ring.assign(docs(spark, [])).count() == 0


def test_ring_splits_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(ring, "RANK_ROWS", 7)
    rows = [(7, "same")] * 150 + [(i, f"text {i}") for i in range(200)] + [(None, "x")] * 40
    got = ring.assign(docs(spark, rows).repartition(5), shards=6, cells=32, per_shard=4).toPandas()
    assert len(got) == len(rows) and got.groupby("shard").size().agg(["min", "max"]).tolist() == [65, 65]
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))


def test_ring_moves_little():
    """One more shard takes its share and little else moves; one more row moves nearly none."""
    rng = np.random.default_rng(1)
    counts = dict(enumerate(rng.poisson(3, ring.CELLS).tolist()))

    def places(counts, shards):
        return {(c, i): s for c, rank, n, s, _ in ring.walk(counts, shards, ring.NODES, ring.CELLS) for i in range(rank, rank + n)}

    now, grown = places(counts, 40), places(counts, 41)
    moved = sum(now[x] != grown[x] for x in now) / len(now)
    assert 1 / 41 <= moved < 2 / 41
    counts[17] += 1
    more = places(counts, 40)
    assert sum(now[x] != more[x] for x in now) < 0.01 * len(now)


def test_ring_moves_only_overflow():
    """Rows that find room stay with the owner of their cell; what overflows goes to the next shard with room."""
    random.seed(1)
    counts = {c: random.randint(0, 9) for c in range(256)}
    runs = ring.walk(counts, 5, 8, 256)
    assert Counter({c: n for c, n in counts.items()}) == Counter({c: sum(r[2] for r in runs if r[0] == c) for c in counts})
    owners = ring.nodes(5, 8, 256)
    own = lambda c: next((s for a, s in owners if a >= c), owners[0][1])
    load = Counter()
    for c, n in counts.items():
        load[own(c)] += n
    total = sum(counts.values())
    room = {s: total // 5 + (s < total % 5) for s in range(5)}
    moved = sum(r[2] for r in runs if r[3] != own(r[0]))
    assert moved == sum(max(0, load[s] - room[s]) for s in range(5))


URLS = ["http://Example.ORG/en/12?x#y", "https://a.example.org/es/", "http://org", "http://x.org/", "ftp://b.com/fr/1", "http://com/de/#", "no scheme", None, "http://", "http://u@h.co.uk:80/a?b://c", "://x?y", "HTTP://evilexample.org/en/1"]


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def plain_rule(host, path):
    fits = [r for r in reputation.RULES if (host == r[1].split("/")[0] or host.endswith("." + r[1].split("/")[0])) and path.startswith("/" + r[1].split("/", 1)[1])]
    return max(fits, key=lambda r: len(r[1]), default=(None, None))[::-1]


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", 1, "v") for i, u in enumerate(urls)], "page_id long, url string, html string, salt int, verdict string")


def test_urls_and_rules(spark):
    pages = pages_of(spark, URLS)
    got = {r["page_id"]: r for r in reputation.judge(pages, spark.createDataFrame([], "page_id long, good int")).collect()}
    assert all(r["verdict"] == "allow" for r in got.values() if r["rule"] is None)  # without labels nothing is blocked
    for i, u in enumerate(URLS):
        host, path = plain_split(u)
        rule, verdict = plain_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert verdict is None or got[i]["verdict"] == verdict
    assert reputation.judge(pages_of(spark, []), spark.createDataFrame([], "page_id long, good int")).count() == 0


def verdicts(spark, urls, good, **more):
    return {r["page_id"]: r["verdict"] for r in reputation.judge(pages_of(spark, urls), spark.createDataFrame(good, "page_id long, good int"), **more).collect()}


def test_reputation_shrinks_and_blocks(spark):
    """A host with 90 % bad of 60 pages is blocked, and a host without labels follows its domain."""
    urls = [f"http://good.one.test/en/{i}" for i in range(60)] + [f"http://bad.two.test/en/{i}" for i in range(60)] + ["http://new.two.test/en/1", "http://new.one.test/en/1", "http://new.three.test/"]
    good = [(i, int(i < 60) if i % 10 else 1 - int(i < 60)) for i in range(120)]
    got = verdicts(spark, urls, good)
    assert {got[i] for i in range(60)} == {"allow"} and {got[i] for i in range(60, 120)} == {"block"}
    assert (got[120], got[121], got[122]) == ("block", "allow", "allow")
    assert set(verdicts(spark, urls, good, least=0.1).values()) == {"allow"}
    assert [reputation.site_of(F.lit(h)) for h in ("a",)] and spark.range(1).select(*reputation.site_of(F.lit("x.y.co.uk:8"))).first()[0] == "y.co.uk"


def test_good_labels_and_few_pages_block_nothing(spark):
    urls = [f"http://h{i}.d{i % 5}.net/{i}" for i in range(20)] + [f"http://big.net/{i}" for i in range(300)] + ["http://unseen.test/"]
    assert set(verdicts(spark, urls, [(i, 1) for i in range(320)]).values()) == {"allow"}
    # one bad page among three hundred good ones tells too little of its host
    assert set(verdicts(spark, urls, [(i, int(i > 0)) for i in range(320)]).values()) == {"allow"}


def beta_cdf(x, a, b):
    """By plain sums of the density on the logistic scale."""
    u = np.linspace(-60, 60, 400_001)
    f = a * u - (a + b) * np.logaddexp(0, u)
    f = np.exp(f - f.max())
    return f[u <= np.log(x / (1 - x))].sum() / f.sum()


def test_bound_is_the_quantile(spark):
    ab = [(1.0, 1.0), (0.3, 0.2), (380.0, 120.0), (5.0, 0.5), (2.0, 40000.0)]
    rows = spark.createDataFrame(ab, "a double, b double").select("a", "b", reputation.beta_quantile(F.col("a"), F.col("b")).alias("x")).collect()
    assert len(rows) == len(ab)
    for r in rows:
        assert abs(beta_cdf(r["x"], r["a"], r["b"]) - reputation.QUANTILE) < 2e-3


def plain_strength(stats):
    seen = [(k, n, m) for k, n, m in stats if n]
    base = sum(n * m * (1 - m) for _, n, m in seen) / sum(n for _, n, _ in seen)
    between = (sum((k - n * m) ** 2 / n for k, n, m in seen) - len(seen) * base) / sum(n for _, n, _ in seen)
    return min(max(base / between - 1, 2), 500) if between > 0 else 500


def plain_posteriors(rows):
    """rows: (host, domain, suffix, good or None); each host's posterior (a, b), and the rate of all labelled rows."""
    count = lambda key: {x: (sum(r[3] or 0 for r in rows if key(r) == x), sum(r[3] is not None for r in rows if key(r) == x)) for x in {key(r) for r in rows}}
    k, n = sum(r[3] or 0 for r in rows), sum(r[3] is not None for r in rows)
    levels = (lambda r: 0, lambda r: r[2], lambda r: (r[1], r[2]), lambda r: r[0])
    post, rate = {0: (k + 1, n - k + 1)}, {0: (k + 1) / (n + 2)}
    for up, key in zip(levels[:-1], levels[1:], strict=True):
        c, above = count(key), {key(r): up(r) for r in rows}
        w = plain_strength([(*c[x], rate[above[x]]) for x in c]) if n else reputation.STRENGTH[0]
        new = {x: (c[x][0] + w * rate[above[x]], c[x][1] - c[x][0] + w * (1 - rate[above[x]])) if c[x][1] else post[above[x]] for x in c}
        post, rate = new, {x: a / (a + b) for x, (a, b) in new.items()}
    return post, (k + 1) / (n + 2)


def plain_block(ab, every):
    """Whether the posterior gives the rate QUANTILE to lie below the least one; None where that is a matter of rounding."""
    p = beta_cdf(reputation.LEAST_SHARE * every, *ab)
    return None if abs(p - reputation.QUANTILE) < 3e-3 else p > reputation.QUANTILE


def test_posteriors_against_plain_ones(spark):
    rng = random.Random(3)
    rows = []
    for h in range(40):
        host = f"h{h}.d{h % 7}.{'com' if h % 7 < 4 else 'net'}"
        for _ in range(rng.randint(0, 30)):
            rows.append((host, f"d{h % 7}", host.split(".")[-1], int(rng.random() < (0.9 if h % 7 < 5 else 0.1)) if rng.random() < 0.8 else None))
        rows.append((host, f"d{h % 7}", host.split(".")[-1], None))
    rows += [("x.d9.com", "d9", "com", None), ("y.d9.org", "d9", "org", None)]
    got = {r["host"]: r for r in reputation.reputations(spark.createDataFrame(rows, "host string, domain string, suffix string, good int")).collect()}
    post, every = plain_posteriors(rows)
    assert set(got) == set(post)
    for h, r in got.items():
        a, b = post[h]
        assert r["host_rate"] == pytest.approx(a / (a + b)) and abs(beta_cdf(r["host_bound"], a, b) - reputation.QUANTILE) < 2e-3
        assert r["pages"] == sum(x[0] == h for x in rows) and r["labelled"] == sum(x[3] is not None for x in rows if x[0] == h) and r["all_rate"] == pytest.approx(every)
    sure = {h: plain_block(post[h], every) for h in post}
    assert {True, False} <= set(sure.values())
    assert all(b is None or b == (got[h]["host_bound"] < reputation.LEAST_SHARE * every) for h, b in sure.items())


def test_pages_of_a_hot_host_meet_it_in_parts(spark, monkeypatch):
    monkeypatch.setattr(reputation, "PARTS", 50)
    urls = [f"http://hot.test/{i}" for i in range(400)] + [f"http://h{i % 100}.test/{i}" for i in range(300)]
    got = verdicts(spark, urls * 2, [(i, int(i >= 400)) for i in range(700)])
    assert len(got) == 1400 and {got[i] for i in range(400)} == {"block"} and {got[i] for i in range(400, 700)} == {"allow"}


def test_outcomes_of_repeated_pages(spark):
    pages = pages_of(spark, ["http://a.b/en/1", "http://a.b/en/2", "http://a.b/en/3", "nothing"]).withColumn("page_id", F.when(F.col("page_id") < 2, 5).otherwise(F.col("page_id")))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, None), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, reputation.outcomes_by_url(pages, labels).collect())) == [(2, 1), (5, 0)]


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.1, 8)], 0) for i in range(300)]
    rows += [(300 + i, rows[7][1], 0) for i in range(40)]
    rows += [(400, None, 0), (401, [1.0, None] + [0.0] * 6, 0), (402, [float("nan")] * 8, 0), (420, [0.5, 0.5], 0), (421, [1.0, -1.0], 0), (None, rows[0][1], 0), (20, rows[3][1], 1)]
    t = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = {}
    for r in topk.top_k(spark, t, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = {}
    for a, (q, v) in enumerate(ok):  # a query is a row: its own row alone is no candidate
        if q % 20 == 0:
            best = sorted(((-int(v @ w), i) for b, (i, w) in enumerate(ok) if a != b and len(w) == len(v)))[:20]
            want.setdefault(q, []).extend((k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}
    assert len(got[20]) == 40 and got[420] == [(1, 421, int(np.floor(32) * 64 - 32 * 64))]
    assert topk.top_k(spark, t.limit(0), F.lit(True)).count() == 0


def test_topk_repeated_queries_and_other_tables(spark):
    rows = [(20, [1.0, 0.5], 0), (20, [1.0, 0.5], 0), *((i, [0.1 * i, 0.2], 0) for i in range(1, 6))]
    t = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = [tuple(r)[1:] for r in topk.top_k(spark, t, F.col("vec_id") == 20, 3).collect()]
    assert sorted(got) == sorted([(1, 20, 64 * 64 + 32 * 32), (2, 5, 64 * 32 + 32 * 12), (3, 4, 64 * 25 + 32 * 12)] * 2)
    others = topk.quantised(spark.createDataFrame([(20, [1.0, 0.5], 0), (8, None, 0)], "vec_id long, embedding array<float>, label int"))
    assert [tuple(r) for r in topk.top_k(spark, t, others, 1).collect()] == [(20, 1, 20, 64 * 64 + 32 * 32)]


def test_topk_with_floors(spark, monkeypatch):
    """Blocks that are met first set the floor for the others."""
    monkeypatch.setattr(topk, "LEAST_ROWS", 10)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 8], 0) for i in range(400)]  # many ties
    t = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = {}
    for r in topk.top_k(spark, t, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = np.floor(64 * np.array([r[1] for r in rows])).astype(int)
    for q in range(0, 400, 20):
        best = sorted((-int(v[q] @ v[i]), i) for i in range(400) if i != q)[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_impact_segments_cover_all_postings():
    x = np.random.default_rng(1).integers(-30, 30, (50, 6))
    segs, rest = topk.segments(x)
    back = np.zeros(x.size, int)
    for at, v in segs:
        back[at] = v
    assert (back.reshape(x.shape) == x).all() and (rest[-1] == 0).all() and (np.diff(rest, axis=0) <= 0).all()


def words_of(rng, n):
    return " ".join("".join(rng.choices(["an", "the", "ou", "in", "er", "st", "re"], k=rng.randint(1, 4))) for _ in range(n))


def test_toxicity_on_held_out_texts():
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(500):
        w = words_of(rng, 60).split()
        if i % 4 == 0:
            for bad in ("nastyword", "vileterm"):
                w.insert(rng.randrange(len(w)), bad)
        texts.append(" ".join(w).encode())
        labels.append(int(i % 4 == 0))
    m = toxicity.fit(texts[:400], labels[:400], {0: 300, 1: 100})
    p = m.score(*batch([t.decode() for t in texts[400:]]), m.compressors())
    assert ((p >= 0.5) == np.array(labels[400:])).mean() >= 0.95
    assert 0 <= m.score(*batch([""]), m.compressors())[0] < 0.5
    assert toxicity.fit([], []).score(*batch(["x"]), None).tolist() == [0.0]
    assert toxicity.fit([b"a", b"b"], [1, 1]).score(*batch(["x"]), None).tolist() == [1.0]


def test_scores_are_recomputed_plainly():
    """From single compressions of single windows: what the dictionaries save, the counts, the surplus, the curve."""
    rng = random.Random(8)
    texts = [(words_of(rng, 40) + (" nastyword vile" if i % 3 == 0 else "")).encode() for i in range(150)]
    m = toxicity.fit(texts, [int(i % 3 == 0) for i in range(150)], {0: 100, 1: 50})
    assert len(m.toxic) == len(m.ordinary) and m.toxic[-toxicity.SHARED_BYTES :] == m.ordinary[-toxicity.SHARED_BYTES :] and b"nastyword" in m.toxic
    for t in ("", "One\tNASTYWORD  here vile", words_of(rng, 33)):
        w = [x for x in re.split("[ \t-\r]+", t.lower()) if x]
        # a window is as it stands in the text, each separator a space
        spans = [x.span() for x in re.finditer("[^ \t-\r]+", t)]
        low = re.sub("[\t-\r]", " ", t.lower())
        windows = [low[spans[i][0] : spans[min(i + 1, len(w) - 1)][1]] for i in range(0, len(w), 2)]
        saved = []
        for x in windows:
            ordinary, toxic = m.compressors()
            raw = b" " * 48 + x.encode() + b" "
            saved.append(len(ordinary(raw)) - len(toxic(raw)))
        z, n = m.weights[-1] + m.weights[-2] * np.log1p(len(windows)), len(windows)
        for j, s in enumerate(toxicity.SAVED):
            k = sum(x >= s for x in saved)
            z += m.weights[j] * min(12, max(-3, (k - n * m.chance[j]) / (n * m.chance[j] + 0.5) ** 0.5)) + m.weights[len(toxicity.SAVED) + j] * np.log1p(k)
        assert m.score(*batch([t]), m.compressors())[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_few_examples_are_compressed_too():
    """Two labelled texts, or classes without any telling run, give dictionaries and different scores."""
    for texts in ([b"one toxic text", b"another ordinary text"], [f"{'bad' if i < 3 else 'good'} words {i}".encode() for i in range(9)]):
        m = toxicity.fit(texts, [int(i < len(texts) / 3) for i in range(len(texts))])
        assert m.toxic and m.toxic != m.ordinary and np.isfinite(m.score(*batch(["", "one toxic text", "x " * 5000]), m.compressors())).all()


def test_marked_runs_against_plain_counts():
    rng = random.Random(2)
    toxic = [(words_of(rng, 30) + " Vile\tterm").encode() for _ in range(60)]
    ordinary = [words_of(rng, 30).encode() for _ in range(200)]
    got = toxicity.marked_runs(toxic, ordinary)
    plain = lambda t: {re.sub(rb"[\x09-\x0d]", b" ", t.lower())[i : i + 6] for i in range(len(t) - 5)}
    a, b = (Counter(x for t in ts for x in plain(t)) for ts in (toxic, ordinary))
    want, looked = {}, len(a) + len(b)
    for x, n in a.items():
        both, p = n + b[x], 60 / 260
        z = n * np.log(n / (both * p)) + (b[x] * np.log(b[x] / (both * (1 - p))) if b[x] else 0)
        if n / both > p and z >= np.log(looked + 1):
            want[int.from_bytes(x, "little")] = z
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)
    content = toxicity.passages(toxic, got, 1 << 16)
    runs = {int.from_bytes(content[i : i + 6], "little") for i in range(len(content) - 5)}
    assert set(got) <= runs and len(content) < 12 * len(got)
    assert toxicity.passages(toxic, {}, 100) == b"" and len(toxicity.passages(toxic, got, 24)) == 24


def test_toxicity_query(spark, tmp_path):
    """The registered query: held-out rows are those of the contract and do not teach."""
    rng = random.Random(5)
    rows = [(i, words_of(rng, 50) + (" vileterm" * 3 if i % 3 == 0 else "")) for i in range(400)] + [(None, "x"), (900, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    # the labels of held-out rows are turned round: had they taught, the score would suffer
    spark.createDataFrame([(i, 1, int(i % 3 == 0) ^ (i in held)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.op8_compression_distance(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and {i for i, r in got.items() if r["held_out"] and i != 900} == held and not got[None]["held_out"]
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[i]["predicted"] == (i % 3 == 0) for i in range(400)) > 390


def test_toxicity_rows(spark):
    rng = random.Random(6)
    rows = [(i, words_of(rng, 40) + (" nastyword" * 2 if i % 3 == 0 else "")) for i in range(200)] + [(None, None), (500, ""), (501, "x " * 20000), (3, "twin")]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    got = toxicity.score_column(d, toxicity.learn_model(d, labels)).collect()
    assert len(got) == len(rows) and set(d.columns) < set(got[0].asDict()) and all(0 <= r["toxic_score"] <= 1 for r in got)
    assert sum((r["toxic_score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 200) > 185
    assert toxicity.score_column(docs(spark, []), toxicity.CompressionModel()).count() == 0


def plain_base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)]


def test_quality_base_counts():
    rng = random.Random(8)
    texts = ["", "\n\n", "a\nb\na\n a\na", "x|y #é 日本\t*", "\na", "a b c d e a b c d e"]
    texts += ["".join(rng.choice(["a", "b", " ", "\n", "é", "#", "\t", "ab "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    c = quality.base_counts(*batch(texts))
    got = np.stack([c[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], 1).tolist()
    for t, g in zip(texts, got, strict=True):
        assert g == plain_base(t), t


def test_quality_model_and_rows(spark):
    rng = random.Random(9)
    clean = [words_of(rng, 60) for _ in range(200)]
    junk = [" ".join(x.upper() + "!!" for x in words_of(rng, 60).split()) for _ in range(100)]
    m = quality.fit([t.encode() for t in clean[:150] + junk[:75]], [1] * 150 + [0] * 75, {1: 150, 0: 75})
    p = m.probability(*batch(clean[150:] + junk[75:]))
    assert ((p >= 0.5) == np.array([1] * 50 + [0] * 25)).mean() >= 0.97
    rows = [(1, clean[0]), (2, None), (3, ""), (4, "few words"), (None, clean[1]), (5, "a b c d e " * 9), (6, junk[99])]
    got = {r["doc_id"]: r for r in quality.judge(docs(spark, rows), m).collect()}
    assert got[1]["kept"] and not any(got[i]["kept"] for i in (2, 3, 4, 5, 6)) and got[None]["kept"]
    assert [got[i]["base_failed"] for i in (1, 2, 3, 4, 5, 6)] == [False, True, True, True, True, False] and got[1]["length"] == 5
    assert quality.judge(docs(spark, []), m).count() == 0
    assert quality.fit([], []).probability(*batch(["x"]))[0] > 0.5


def test_schema_is_shared():
    assert SCHEMA.startswith("doc_id") and pytest
