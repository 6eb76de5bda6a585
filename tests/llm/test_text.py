"""Text kernels, token shards, packing, n-best lattice."""

import random
import zlib

import numpy as np
import pytest

from ohmsieve.llm import nbest, packing, wavelet
from ohmsieve.llm import textvec as tv
from ohmsieve.llm import tokens as tk
from ohmsieve.llm.store import Workspace

TEXTS = ["", " ", "a  b\n\n c  ", "<|endoftext|> hi", "don't  it's\t\tq\x85 z", "　 　 a   b", "é é  q", "\x1c a\x1f b\x7f c", "日本 語　 x", "word " * 3000, "x" * 5000]
SCHEMA = "doc_id long, text string, length int, seq string, shard int, score double, n int"


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 5, "s", 1, 0.5, 2) for i, t in rows], SCHEMA)


def batch(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


def test_words_do_not_cross_texts():
    data, offs = batch(["ab", "cd ef", "", "g"])
    s, e, p = tv.words(data, offs)
    assert [bytes(data[a:b]) for a, b in zip(s, e, strict=True)] == [b"ab", b"cd", b"ef", b"g"] and p.tolist() == [0, 1, 3, 3, 4]
    h = tv.span_hash(data, s, e)
    again = tv.span_hash(*[np.asarray(x) for x in (batch(["zz ef"])[0], [3], [5])])
    assert again[0] == h[2]


def test_pieces_encode_like_whole_texts():
    enc = tk.encoder()
    for _ in range(2):
        ids, ptr = enc.encode(*batch(TEXTS))
        for i, t in enumerate(TEXTS):
            assert ids[ptr[i] : ptr[i + 1]].tolist() == enc.tok.encode(t, add_special_tokens=False).ids, t


def test_wavelet_access_rank_select():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 3000) % 700).astype(np.uint32)
    w = wavelet.WaveletShard(wavelet.encode_shard([1, None], np.array([0, 1000, 3000]), ids))
    assert (w.decode() == ids).all() and w.doc_ids == [1, None]
    for s in (int(ids[0]), 1, 699, 65000):
        at = np.flatnonzero(ids == s)
        assert w.count(s) == len(at) and w.rank(s, 1500) == (ids[:1500] == s).sum() and w.count(s, 100, 900) == (ids[100:900] == s).sum()
        assert [w.select(s, k) for k in range(min(5, len(at)))] == at[:5].tolist() and w.select(s, len(at)) == -1
    assert [w.access(i) for i in (0, 77, 2999)] == ids[[0, 77, 2999]].tolist()
    with pytest.raises(IndexError):
        w.access(3000)
    one = wavelet.WaveletShard(wavelet.encode_shard([5], np.array([0, 3]), np.array([9, 9, 9])))
    assert one.decode().tolist() == [9, 9, 9] and one.select(9, 2) == 2
    assert wavelet.WaveletShard(wavelet.encode_shard([], np.array([0]), np.array([], np.uint32))).decode().tolist() == []


def test_shards_round_trip(spark):
    rows = [*enumerate(TEXTS), (3, "a tie"), (None, "no id"), (40, None)]
    ws = Workspace(spark, "test")
    manifest = wavelet.write_shards(spark, docs(spark, rows), ws, shard_tokens=500)
    got = wavelet.read_shards(manifest, ws.path("shards")).orderBy("start").collect()
    enc = tk.encoder()
    want = [(i, np.append(np.array(enc.tok.encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(0))) for i, t in rows]
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda x: (x is not None, x))
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i or -1, len(x), zlib.crc32(x.astype("<u4").tobytes())) for i, x in want)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert wavelet.read_shards(wavelet.write_shards(spark, docs(spark, []), Workspace(spark, "none")), "file:/tmp/none").count() == 0


def test_best_two_fit_uses_everything_once():
    random.seed(2)
    for cap in (10, 64, 1024):
        counts = {s: random.randint(1, 40) for s in random.sample(range(1, cap + 1), min(cap, 60))}
        recipes = packing.best_two_fit(counts, cap)
        used = {}
        for content, times in recipes:
            assert sum(content) <= cap
            for s in content:
                used[s] = used.get(s, 0) + times
        assert used == counts
        bins, least = sum(t for _, t in recipes), -(-sum(s * n for s, n in counts.items()) // cap)
        assert bins <= 1.25 * least + 2


def test_best_two_fit_replaces_the_smallest():
    # 6 + 3 leaves 1; giving 3 back, 2 + 2 fills the gap of 4
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)
    assert packing.pair_for(5, 5, np.array([0, 9, 9, 9, 9, 9])) is None


def test_packing_is_gapless(spark):
    rows = [*enumerate(TEXTS), (None, "no id"), (40, None), (7, "twin"), (7, "twin")]
    got = packing.pack_documents(spark, docs(spark, rows)).toPandas()
    enc, cap = tk.encoder(), packing.CAPACITY
    for i, t in enumerate(TEXTS):
        if i != 7:
            ids = np.array([*enc.tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
            p = got[got.doc_id == i].sort_values("piece")
            assert p.length.sum() == len(ids) and (p.start.values == np.cumsum(p.length.values) - p.length.values).all() and (p.length.values[1:] == cap).all()
            assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(p.start, p.length, strict=True)] == p.ids_crc32.tolist()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.values == np.cumsum(s.length.values) - s.length.values).all() and s.length.sum() <= cap
    assert packing.pack_documents(spark, docs(spark, [])).count() == 0


def every_segmentation(seg, part):
    best = {0: [(0.0, ())]}
    for j in range(1, len(part) + 1):
        best[j] = []
        for i in range(j):
            found = seg.pieces.get(part[i:j])
            if found:
                best[j] += [(s + found[1], (*p, found[0])) for s, p in best[i]]
            elif j == i + 1 and part[i] not in seg.pieces:
                best[j] += [(s + seg.unknown, (*p, *(seg.byte[b] for b in part[i].encode()))) for s, p in best[i]]
    return sorted(best[len(part)], key=lambda x: -x[0])


def test_nbest_against_all_segmentations():
    seg = nbest.segmenter()
    for text in ("the cat", "aaaa", "it's\n\nnew", "日本 é😀", "x  y", "abcabc"):
        want, got = every_segmentation(seg, " " + text), seg.nbest(text)
        assert [s for s, _ in got] == [s for s, _ in want[: seg.n]], text
        assert len({tuple(p) for _, p in got}) == len(got) and all((s, tuple(p)) in want for s, p in got)
        ids, ptr, scores, _, _ = seg.encode(*batch([text, ""]))
        assert scores[0] == pytest.approx([s for s, _ in want[: seg.n]]) and scores[1] == [0.0]
        assert seg.decode(ids).decode() == " " + text
        whole = seg.segmentations(text)
        assert [s for s, _ in whole] == pytest.approx(scores[0]) and len({tuple(p) for _, p in whole}) == len(whole)
        assert whole[0][1] == ids.tolist() and all(any(p == tuple(w) and s == pytest.approx(x) for s, p in want) for x, w in whole)


def test_nbest_rows(spark):
    rows = [*enumerate(TEXTS), (None, "no id"), (40, None), (0, "")]
    got = nbest.segment(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    assert all(r["nbest_scores"] == [0.0] and r["n_pieces"] == 0 for r in got if r["doc_id"] in (0, 40))
    assert nbest.segment(docs(spark, [])).count() == 0
    ids = nbest.segment_ids(docs(spark, rows)).collect()
    best = {r["doc_id"]: r["ids"] for r in ids if r["rank"] == 1}
    assert all(zlib.crc32(np.array(best[r["doc_id"]], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    assert all(nbest.segmenter().decode(np.array(r["ids"], int)).decode() == (" " + dict(rows)[r["doc_id"]] if r["ids"] else "") for r in ids if "▁" not in (dict(rows)[r["doc_id"]] or ""))


def test_nbest_of_long_parts_and_small_stores(monkeypatch):
    seg = nbest.segmenter()
    got = seg.search("internationalization" * 2000)
    assert len(got) == seg.n and got[0][0] >= got[-1][0]
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 9))) for _ in range(40)) for _ in range(30)]
    want = [seg.encode(*batch([t]))[2][0] for t in texts]
    monkeypatch.setattr(nbest, "CACHE_PARTS", 120)
    seg.clear()
    for _ in range(2):  # the older half of the store goes again and again
        for t, w in zip(texts, want, strict=True):
            ids, _, scores, _, _ = seg.encode(*batch([t]))
            assert scores[0] == pytest.approx(w) and seg.decode(ids).decode() == " " + t
    seg.clear()


def test_pieces_join_only_where_the_library_cuts():
    rng = random.Random(2)
    enc = tk.encoder()
    parts = ["a", "b", " ", "  ", "é", "\xa0", "\u3000", "'s", "'", "!", "!!", "<|endoftext|>", "<|", "|>", "12", "\n", "日", "\x85", "\x1c", "…", "$", "\x7f", "-", "_"]
    for _ in range(300):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(20)]
        ids, ptr = enc.encode(*batch(texts))
        for i, t in enumerate(texts):
            assert ids[ptr[i] : ptr[i + 1]].tolist() == enc.tok.encode(t, add_special_tokens=False).ids, t


def test_shard_parts_are_read_alone(spark):
    ws = Workspace(spark, "parts")
    rows = [(i, " ".join(f"w{i} x{i * j}" for j in range(200))) for i in range(40)]
    manifest = wavelet.write_shards(spark, docs(spark, rows).coalesce(1), ws, shard_tokens=1 << 20).collect()
    shard, whole = wavelet.open_shard(ws.path("shards"), manifest[0]["file"]), wavelet.WaveletShard(wavelet.load_file(ws.path("shards"), manifest[0]["file"]))
    ids = whole.decode()
    assert (shard.decode() == ids).all() and [shard.access(i) for i in (0, 999, len(ids) - 1)] == ids[[0, 999, -1]].tolist()
    assert shard.count(int(ids[5])) == (ids == ids[5]).sum() and shard.select(int(ids[5]), 0) == int(np.flatnonzero(ids == ids[5])[0])


def test_store_needs_a_shared_folder(monkeypatch):
    from ohmsieve.llm import store

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "spark://there:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_root(Session())
    assert store.free_names(["A", "_a"], "a", "b", "b") == ["__a", "b", "_b"]
