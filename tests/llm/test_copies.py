"""Jaccard join, suffix dedup, components and the pipeline against brute force."""

import random
import re
import uuid
from collections import Counter

import numpy as np
import pytest

from ohmsieve.llm import jaccard, suffix
from ohmsieve.llm.components import components, connected, contracted
from ohmsieve.llm.store import Workspace, local_rows

from .test_text import docs


def plain_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def plain_components(sets):
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def corpus(seed, small=False):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcde", k=3))
    line = " ".join(word() for _ in range(9))
    rows, n = [], 0
    for _ in range(30):
        base = [word() for _ in range(rng.randint(1, 16) if small else rng.randint(30, 120))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w) + (f"\n{line}" if rng.random() < 0.3 and not small else "")))
            n += 1
    return rows


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True)])
def test_join_against_brute_force(spark, seed, small):
    rows = corpus(seed, small) + [(900, ""), (901, None), (902, " \n"), (903, "One"), (904, "one")]
    sets = plain_sets(rows)
    want = plain_components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(docs(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_join_large_group_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 7)
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(60)] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want = plain_components(plain_sets(rows))
    assert {r["doc_id"]: r["component_id"] for r in jaccard.similar(docs(spark, rows)).collect()} == want


def steps_of(seed):
    """Chains of texts in which only neighbours are linked, around bases that share much; nearly all are in one candidate group."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    first, rows = [word() for _ in range(80)], []
    for _ in range(6):
        base = [w if rng.random() < 0.9 else word() for w in first]
        for _ in range(rng.choice([3, 12, 20])):
            if rng.random() < 0.7:
                base = list(base)
            w = base
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(80)] = word()
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_pivots_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 6)
    monkeypatch.setattr(jaccard, "PIVOTS", 4)
    monkeypatch.setattr(jaccard, "DIRECT_PARTS", 1)
    monkeypatch.setattr(jaccard, "FILTER_BITS", (4, 3))  # rows meet the ids that go on in a join
    rows = steps_of(seed)
    want = plain_components(plain_sets(rows))
    assert 5 < len(set(want.values())) < len(rows)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.similar(docs(spark, rows)).collect()} == want


def test_pivots_leave_no_link_out():
    rng = random.Random(3)
    sets = []
    for _ in range(90):
        base = set(sets[rng.randrange(len(sets))]) if sets and rng.random() < 0.8 else set(rng.sample(range(300), 40))
        for _ in range(rng.choice([1, 2, 4, 8])):
            base.discard(rng.choice(sorted(base)))
            base.add(rng.randrange(300))
        sets.append(base)
    blobs = [np.array(sorted(s), "<u8").tobytes() for s in sets]
    ids = np.arange(90)
    pivot = np.zeros(180, bool)
    pivot[90 + np.array(rng.sample(range(90), 9))] = True
    at = np.concatenate((ids, np.flatnonzero(pivot) - 90))
    got = jaccard.against_pivots(at, [blobs[i] for i in at], np.arange(len(at)) >= 90)
    root = jaccard.spanning([(a, b) for k, a, b in got if k == 0])[1]
    cover = {a: b for k, a, b in got if k == 1}
    near, alone = {(a, b) for k, a, b in got if k == 2}, {a for k, a, _ in got if k == 3}
    assert alone == set(range(90)) - set(cover)
    for a in range(90):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                met = (a, cover.get(b)) in near or (b, cover.get(a)) in near or (a in alone and b in alone)
                assert met or root.get(a, -1) == root.get(b, -2)


def test_join_repeated_ids(spark):
    x, y, z = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = [(3, x), (4, y), (5, x), (5, y), (7, z), (7, y), (8, z), (9, ""), (9, z)]
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.similar(docs(spark, rows)).collect())
    assert got == sorted((i, 3) for i, _ in rows)


def test_join_one_common_line(spark):
    """A line that all texts have makes no group of them."""
    rng = random.Random(8)
    line = " ".join(f"line{i}" for i in range(12))
    rows = [(i, line + " " + " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(30))) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " tail") for i in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar(docs(spark, rows)).collect()}
    assert got == {i: i - 300 if i >= 300 else i for i, _ in rows}


def test_unsettled_components_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError, match="not settled"):
        connected(Workspace(spark, "cc"), "t", edges, rounds=2)


def test_join_odd_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, "a b c d e f")]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.similar(docs(spark, rows)).collect())
    assert got == [(0, 2, None), (5, 2, 5), (5, 2, 5), (6, 2, 5)]
    assert jaccard.similar(docs(spark, [])).count() == 0


def test_size_rules():
    for a in range(1, 40):
        for b in range(1, 40):
            linkable = any(100 * k >= 75 * (a + b - k) for k in range(min(a, b) + 1))
            assert (b in jaccard.partners(a)) == linkable
            if linkable:
                k = jaccard.need(a, b)
                assert 100 * k >= 75 * (a + b - k) and 100 * (k - 1) < 75 * (a + b - k + 1)
    assert jaccard.boundary({3: 10**6, 300: 10}, 50.0) >= 3
    assert jaccard.boundary({12: 10, 300: 10}, 1.0) < 12
    assert jaccard.boundary({14: 10}, 1e9) >= 14  # as far as it pays


def test_forest_spans_links():
    sets = [np.array(x, "<u8").tobytes() for x in ([1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4, 5], [9, 10], [1, 2, 3, 5, 4, 6])]
    assert {frozenset(e) for e in jaccard.forest(np.arange(5), sets)} <= {frozenset(x) for x in ((0, 1), (0, 2), (1, 2), (2, 4))}
    assert len(jaccard.forest(np.arange(5), sets)) == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (103, 103)]
    got = {r["id"]: r["component"] for r in connected(Workspace(spark, "cc"), "t", spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert connected(Workspace(spark, "cc"), "t", spark.createDataFrame([], "a long, b long")).count() == 0


def test_contracted_edges_connect_the_same(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(a, a - 1) for a in range(1000, 1300)] + [(5000, i) for i in range(2000, 2400)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    want = plain_paths(pairs)
    few = [tuple(r) for r in contracted(edges, 40).collect()]
    assert len(few) <= len(pairs) and plain_paths(few) == want
    for how in (connected, components):
        got = [tuple(r) for r in how(Workspace(spark, "cc"), "t", edges).collect()]
        assert len(got) == len(want) and dict(got) == want
    assert components(Workspace(spark, "cc"), "t", spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def plain_paths(pairs):
    up = {i: i for e in pairs for i in e if e[0] != e[1]}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        if a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: top(i) for i in up}


def jobs_of(spark, run):
    """How many Spark jobs a call starts."""
    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_large_groups_take_few_jobs(spark):
    # near copies: all lists meet in one group, whose edges tasks put together before any shuffle
    pairs = [(i, j) for i in range(400) for j in (i // 2, i // 3, i * 7 % 400)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(16)
    got, jobs = jobs_of(spark, lambda: components(Workspace(spark, "cc"), "t", edges).collect())
    assert {r["component"] for r in got} == {0} and len(got) == 400 and jobs <= 45
    # one job after the other for each of the tasks, before
    rows = spark.range(64).repartition(64, "id").selectExpr("id", "cast(id as string) as s")
    got, jobs = jobs_of(spark, lambda: sorted(r[0] for r in local_rows(rows, "rows")))
    assert got == list(range(64)) and jobs < 40


def plain_spans(rows):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    grams = Counter(tuple(w[k : k + 50]) for w in words.values() for k in range(len(w) - 49))
    out = set()
    for i, w in words.items():
        on = set()
        for k in range(len(w) - 49):
            if grams[tuple(w[k : k + 50])] > 1:
                on.update(range(k, k + 50))
        for a in sorted(on):
            if a - 1 not in on:
                b = a
                while b in on:
                    b += 1
                out.add((i, a, b - a))
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 150))]
        for p in rng.sample(shared, rng.choice([0, 1, 1, 2])):
            k = rng.randint(0, len(w))
            w[k:k] = p
        rows.append((i, rng.choice([" ", "\n"]).join(w)))
    return rows


def test_spans_against_brute_force(spark):
    rows = passages(3) + [(100, ""), (101, None), (102, "x y " * 60), (103, "short")]
    got = suffix.repeated_spans(docs(spark, rows)).collect()
    assert {(r["doc_id"], r["first_word"], r["n_words"]) for r in got if not r["later"]} == plain_spans(rows)
    assert suffix.repeated_spans(docs(spark, [(None, "x y " * 60), (1, "a")])).count() == 0
    assert suffix.repeated_spans(docs(spark, [])).count() == 0


@pytest.mark.parametrize("batch", [7, 1000])
def test_spans_between_far_suffixes(spark, batch):
    """Copies on the left of a common core, between which any number of others is sorted."""
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choices("abcdefg", k=4)) for _ in range(n)]
    core, left, right = words(49), [words(25) for _ in range(9)], [words(25) for _ in range(4)]
    rows = [(i, " ".join([*words(3), *left[i % 9], *core, *(words(30) if i % 3 else right[i % 4]), *words(2)])) for i in range(90)]
    rows += [(200 + i, " ".join([*words(30), *core, *words(30)])) for i in range(60)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    got = suffix.repeated_spans(docs(spark, rows)).collect()
    spark.conf.set(key, before)
    assert {(r["doc_id"], r["first_word"], r["n_words"]) for r in got if not r["later"]} == plain_spans(rows)


def plain_later(rows):
    """Words of the 50-word passages that began before, by document."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            if g in seen:
                out.setdefault(i, set()).update(range(k, k + 50))
            seen.add(g)
    return out


@pytest.mark.parametrize(("gram", "batch"), [("nested", 1000), ("far", 1000), ("far", 7), ("many", 1000), ("period", 1000)])
def test_later_against_brute_force(spark, gram, batch):
    """Which copy is the first is decided for each passage of 50 words, not for the words that a suffix begins with."""
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choices("abcdefg", k=4)) for _ in range(n)]
    if gram == "nested":
        a, b, c = words(100), words(100), words(70)
        rows = [(1, a), (2, b + a), (3, b + a), (4, c + c + c), (5, words(9) + b + a + c), (6, words(60))]
    elif gram == "many":
        rows = [(i, t.split()) for i, t in passages(3)]
    elif gram == "period":
        c = words(30)
        rows = [(1, words(5) + c * 4), (2, c * 2 + words(8)), (3, ["x", "y"] * 60)]
    else:
        core, left, right = words(49), [words(25) for _ in range(9)], [words(25) for _ in range(4)]
        rows = [(i, [*words(3), *left[i % 9], *core, *(words(30) if i % 3 else right[i % 4]), *words(2)]) for i in range(90)]
        rows += [(200 + i, [*words(30), *core, *words(30)]) for i in range(60)]
        rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in rows]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    d = docs(spark, rows)
    spans = suffix.repeated_spans(d).collect()
    kept = {r["doc_id"]: r["text"].split() for r in suffix.without_repeats(d, suffix.repeated_spans(d)).collect()}
    spark.conf.set(key, before)
    assert {(r["doc_id"], r["first_word"], r["n_words"]) for r in spans if not r["later"]} == plain_spans(rows)
    got = {}
    for r in spans:
        if r["later"]:
            got.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["first_word"] + r["n_words"]))
    assert got == plain_later(rows)
    if gram == "nested":
        assert kept[1] == a and kept[2] == b and 3 not in kept and kept[4] == c and len(kept[5]) == 9


CLASHING = ["kept", "n_words", "toxic_score", "TOXIC_SCORE_", "cuts", "_cuts", "row", "good_score", "component_id", "a.b", "sset"]


def clashing(spark, rows):
    """Documents with further columns that have names the stages use themselves."""
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, len(t or ""), *(f"{c}{k}" for c in CLASHING)) for k, (i, t) in enumerate(rows)], schema)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices(["an", "the", "ou", "in", "er", "st"], k=rng.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(60)) + (" nastyword" * 3 if i % 4 == 0 else "")) for i in range(100)]
    path = str(tmp_path_factory.mktemp("labelled"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0), int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_with_clashing_columns(spark, labelled):
    import corpus_pipeline as c

    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    p = text(70)
    rows = [(1, text(40)), (2, p), (3, text(40) + " " + p), (4, None), (5, ""), (6, "y" * 30000)]
    rows.append((7, rows[0][1]))
    for name, stage in c.STAGES[:-1]:
        for part in (rows, rows[:0]):
            d = clashing(spark, part)
            out = stage(spark, d, labelled)
            assert out.columns == d.columns, name
            before = {r["doc_id"]: r for r in d.collect()}
            for r in out.collect():
                old = before[r["doc_id"]]
                assert all(r[k] == old[k] for k in CLASHING), name
                if name == "suffix_dedup":
                    assert r["n_chars"] == len(r["text"] or "")
                else:
                    assert r == old
    assert {r["doc_id"] for r in c.jaccard_stage(spark, clashing(spark, rows), labelled).collect()} == {1, 2, 3, 4, 5, 6}
    packed = c.packing_stage(spark, clashing(spark, rows), labelled)
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in rows}


def test_stages_judge_rows_where_ids_repeat(spark, labelled):
    import corpus_pipeline as c

    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    x, y, z, p = text(40), text(40), text(40), text(60)
    rows = [(3, x), (5, x), (5, y), (5, y), (None, y), (None, z), (None, z), (9, None), (9, "")]
    kept = sorted(((r["doc_id"] or -1), r["text"] or "") for r in c.jaccard_stage(spark, clashing(spark, rows), labelled).collect())
    assert kept == sorted([(3, x), (5, y), (-1, z), (9, ""), (9, "")])
    rows = [(3, p), (3, "start " + p + " end"), (3, x), (None, y)]
    kept = sorted(r["text"] for r in c.suffix_stage(spark, clashing(spark, rows).coalesce(1), labelled).collect())
    assert kept == sorted([p, "start end", x, y])


def test_removal_keeps_first_copy(spark):
    rng = random.Random(7)
    p = " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(90))
    rows = [(1, f"start {p} end"), (2, f"other {p} tail"), (3, p), (4, "clean text"), (5, None), (6, "")]
    d = docs(spark, rows)
    got = {r["doc_id"]: r for r in suffix.without_repeats(d, suffix.repeated_spans(d)).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "other tail" and 3 not in got
    assert got[4]["text"] == "clean text" and got[5]["text"] is None and got[6]["text"] == "" and got[4]["seq"] == "s"


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(11)
    word = lambda: "".join(rng.choices(["an", "the", "ou", "in", "er", "st"], k=rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(120):
        t, q, x = text(70), 1, 0
        if i % 6 == 1:
            t, x = t + " nastyword vileterm nastyword", 1
        if i % 6 == 2:
            t, q = " ".join(w.upper() + "!!" for w in t.split()), 0
        rows.append([i, t, "en", "src", len(t)])
        labels.append((i, q, x))
    p = text(80)
    for i in (3, 9):
        rows[i][1] += " " + p
    rows[15][1] = rows[4][1] + " more"
    rows += [[200, None, None, None, None], [201, "", "en", "src", 0]]
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert [n for n, _ in c.STAGES] == ["toxicity", "quality_rules", "ngram_jaccard", "suffix_dedup", "best_fit_packing"]
    d, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, d, path)
        assert k == 4 or out.columns == d.columns
        out.write.parquet(f"{path}/stage{k}")
        d = spark.read.parquet(f"{path}/stage{k}")
        seen.append({r["doc_id"]: r for r in d.collect()})
    toxic, junk = {i for i in range(120) if i % 6 == 1}, {i for i in range(120) if i % 6 == 2}
    assert len(toxic & set(seen[0])) <= 1 and len(set(range(120)) - toxic - set(seen[0])) <= 2
    assert len(junk & set(seen[1])) <= 1 and 200 not in seen[1] and 201 not in seen[1]
    assert 15 not in seen[2] and (4 in seen[2]) == (4 in seen[1])
    if {3, 9} <= set(seen[2]):
        assert p in seen[3][3]["text"] and p not in seen[3][9]["text"] and seen[3][9]["n_chars"] == len(seen[3][9]["text"])
    assert set(seen[4]) == set(seen[3])
    assert c.run(spark, path).count() == d.count()
