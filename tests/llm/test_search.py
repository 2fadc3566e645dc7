"""Joins, neighbours, packing and the language model against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import lower_words
from tokenizers import Tokenizer

from statewave.llm import components, elias_fano, hashing, ngram_join, ngram_lm, packing, vptree


def shingle_set(text):
    w = lower_words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def classes(corpus):
    sets = [(i, shingle_set(t)) for i, t, *_ in corpus if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and 100 * len(x & y) >= 75 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}, {i: len(s) for i, s in sets}


def test_join(docs, corpus):
    want, size = classes(corpus)
    rows = ngram_join.join_digest(docs).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], size[r["doc_id"]]), r
    assert want[9] == 7 and want[8] == 7 and want[1000] == 7 and want[20] == 19


def family(rng, n):
    """Near copies of one text, texts that share a passage with it, and others."""
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    base, passage, rows = [word() for _ in range(150)], [word() for _ in range(60)], []
    for i in range(n):
        t = list(base)
        for k in rng.integers(0, 150, rng.integers(0, 9)):
            t[k] = word()
        rows.append((len(rows), " ".join(t)))
        own = [word() for _ in range(int(rng.integers(3, 60)))]
        rows.append((len(rows), " ".join(own + passage)))
    return rows


@pytest.mark.parametrize("small", [32, 2])
def test_join_of_large_groups(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", small)
    rows = family(np.random.default_rng(small), 60)
    want, _ = classes([(i, t, None) for i, t in rows])
    got = ngram_join.join_digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_every_similar_pair_shares_an_entry():
    rng = np.random.default_rng(3)
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 13, 16, 31, 40, 100, 300] * 12:
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        keep = x[np.sort(rng.permutation(n)[:max(1, n - int(rng.integers(0, n // 7 + 1)))])]
        y = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, n // 7 + 1)), dtype=np.uint64)]))
        common = len(np.intersect1d(x, y))
        often = np.sort(rng.permutation(x)[:n // 2])
        if ngram_join.similar(len(x), len(y), common):
            assert len(np.intersect1d(ngram_join.entries(x, often), ngram_join.entries(y, often))), (n, len(x), len(y), common)


@pytest.mark.parametrize("power", [2, 4, 8, 16, 32])
def test_subsets_across_bands_share_an_entry(power):
    rng = np.random.default_rng(power)
    none = np.empty(0, np.uint64)
    for a in range(max(1, power - 3), power + 4):
        for b in range(a, 4 * a // 3 + 1):
            for _ in range(60):
                y = np.unique(rng.integers(0, 1 << 63, b, dtype=np.uint64))
                x = np.sort(rng.permutation(y)[:a])
                assert len(np.intersect1d(ngram_join.entries(x, none), ngram_join.entries(y, none))), (a, b)


def test_deficient_sets_share_an_entry(monkeypatch):
    few = lambda s, count: real(s, max(1, count // 16))
    real = ngram_join.segments
    monkeypatch.setattr(ngram_join, "segments", few)
    test_every_similar_pair_shares_an_entry()


def test_sketch_never_exceeds_difference():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for k in (0, 1, 30, 400):
        y = np.concatenate([x[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)])
        assert ngram_join.sketch_distance(ngram_join.sketch(x), ngram_join.sketch(y)) <= 2 * k
        assert ngram_join.sketch_distance(ngram_join.sketch(x), ngram_join.sketch(y[:250])) <= 250 + 2 * k


def test_keep_one(docs, corpus, clashing):
    want, _ = classes(corpus)
    out = ngram_join.keep_one(clashing)
    assert out.columns == clashing.columns
    assert sorted(r[0] for r in out.collect() if r[0] is not None) == sorted(set(want.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[k] == 100 for k in range(100, 140)) and got[201] == 200
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_word_hashes():
    import pyarrow as pa

    texts = ["One  two", None, "", "two\tONE é", "one"]
    [(_, _, w, n)] = hashing.hashed_texts(pa.array(texts))
    assert n.tolist() == [2, 0, 0, 3, 1] and w[0] == w[3] == w[5] and w[1] == w[2] and len(set(w.tolist())) == 3


def brute_neighbours(vectors, k):
    good = {i: np.array(v, dtype=float) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    out = {}
    for q in (i for i in good if i % 20 == 0):
        best = sorted(((-float(np.cumsum(good[q] * x)[-1]), i) for i, x in good.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 8)
    monkeypatch.setattr(vptree, "ROWS_PER_SHARD", 150)
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[0][1]) for i in range(60)]  # ties
    vectors += [(400, None), (420, []), (440, [0.0] * 6), (460, [1.0, None] + [0.0] * 4), (480, [float("nan")] * 6), (500, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    got = {}
    for r in vptree.vector_digest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute_neighbours(vectors, 20)
    assert vptree.vector_digest(df.limit(0)).count() == 0
    few = {r["query_id"]: r["vec_id"] for r in vptree.vector_digest(df.where("vec_id in (0, 5)")).collect()}
    assert few == {0: 5}


def test_slack_keeps_recall():
    import pandas as pd

    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 16))
    rows = pd.DataFrame({"id": np.arange(4000), "v": list(x)})
    exact = vptree.search_pair(rows, rows.iloc[:100], 10, 1.0, np.linalg.norm(x, axis=1).max())
    loose = vptree.search_pair(rows, rows.iloc[:100], 10, 0.9, np.linalg.norm(x, axis=1).max())
    pairs = lambda r: set(zip(r["query_id"], r["vec_id"]))
    assert len(exact) == 1000 and len(pairs(exact) & pairs(loose)) >= 900


def test_trees_prune(monkeypatch):
    """An exact search of clustered vectors leaves part of a shard out, a relaxed one more."""
    monkeypatch.setattr(vptree, "LEAF", 64)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 32))[rng.integers(0, 30, 6000)] + 0.1 * rng.normal(size=(6000, 32))
    ids, largest = np.arange(len(x)), np.linalg.norm(x, axis=1).max()
    rest = np.sqrt(np.maximum(largest ** 2 - (x ** 2).sum(axis=1), 0))
    tree, share = vptree.Tree(np.hstack([x, rest[:, None]])), []
    best = np.argsort(-(x[:100] @ x.T + np.where(ids[:100, None] == ids, -1e9, 0)), axis=1)[:, :10]
    for slack, least in ((1.0, 1.0), (0.9, 0.7)):
        search = vptree.Search(tree, ids, x, ids[:100], x[:100], largest, 10, slack)
        found = search.run().groupby("query_id")["vec_id"].apply(set)
        assert np.mean([len(found[q] & set(best[q])) for q in range(100)]) >= 10 * least
        share.append(search.visited / (100 * len(x)))
    assert share[1] <= share[0] < 0.7


def test_packing(docs, corpus, clashing):
    rows = packing.pack(clashing).toPandas()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for i, t, *_ in corpus:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start:start + 2048], dtype="<u4")
            want[i, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    cells = rows[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(rows.notna(), None)
    assert Counter(map(tuple, cells.to_numpy().tolist())) == want
    used = 0
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.r_[0, np.cumsum(g["length"])[:-1]]).all() and g["length"].sum() <= 2048
        used += 1
    assert used == -(-int(rows["length"].sum()) // 2048)


def test_encoder_equals_tokenizer():
    tokenizer, encoder = Tokenizer.from_file(packing.default_tokenizer()), packing.CachedEncoder(packing.default_tokenizer())
    texts = ["a<|endoftext|>b c", "it's o'neill 123 x y\x1cz don’t ΣΑΣ İ", "abc, abc., abc .,x Abc,. é́, ᾼ", "", "​ x﻿y \u0085q nb sp", "word,, word.x .word"]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_where_lower_case_is_no_letter():
    encoder, tokenizer = packing.CachedEncoder(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    for text in ("BEL\u0130.", "BEL\u0130, \u0130. x", "\u0958. \u0958 a.", "\u00c9t\u00c9."):
        assert encoder.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_sum_of_squares_fills_sequences():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 700, 5000))[::-1]
    sequence, offset, used = packing.place_all(lengths, 2048)
    assert used == -(-lengths.sum() // 2048) and np.bincount(sequence, lengths).max() <= 2048


def test_elias_fano():
    rng = np.random.default_rng(6)
    lists = [np.unique(rng.integers(0, 1 << b, n, dtype=np.uint64)) for b, n in ((63, 1), (63, 5000), (14, 3000), (40, 900))]
    lists.append(np.unique(np.concatenate([np.arange(1000, dtype=np.uint64), rng.integers(1 << 50, 1 << 60, 70, dtype=np.uint64)])))
    for values in lists:
        coded = elias_fano.EliasFano(values, elias_fano.Levels())
        assert coded.find(values).tolist() == list(range(len(values)))
        other = np.setdiff1d(np.concatenate([values + np.uint64(1), values[:1] - np.uint64(1), [np.uint64(0), np.uint64(1 << 63)]]), values)
        assert (coded.find(other) == -1).all()


@pytest.mark.parametrize("frequent", [300_000, 40])
def test_language_model(docs, corpus, monkeypatch, frequent):
    monkeypatch.setattr(ngram_lm, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_lm, "BYTES_PER_SHARD", 20_000)
    monkeypatch.setattr(ngram_lm, "TOKENS_PER_BLOCK", 3000)
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    texts = [(i, [*lower_words(t), None]) for i, t, *_ in corpus]
    learn = [w for i, w in texts if not held(i)]
    single, pair = Counter(x for w in learn for x in w), Counter(p for w in learn for p in zip([0, *w], w))
    triple = Counter(t for w in learn for t in zip([0, 0, *w], [0, *w], w))
    a, b = ngram_lm.PAIRS, ngram_lm.SINGLES
    before = lambda g, h: (len(learn) if h == 0 else pair[g, h]) + a * (len(learn) if h == 0 else single[h]) + b
    mass = sum(single.values()) + 0.5 * (len(single) + 1)
    p = lambda x: (single[x] + 0.5) / mass
    want = []
    for i, w in texts:
        base = sum(math.log10(p(x)) for x in w)
        score = sum(math.log10((triple[g, h, x] + a * pair[h, x] + b * p(x)) / before(g, h)) for g, h, x in zip([0, 0, *w], [0, *w], w))
        want.append((repr(i), held(i), len(w), sum(single[x] > 0 for x in w), sum(single.values()), base, score))
    got = [(repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
           for r in ngram_lm.lm_digest(docs).collect()]
    assert [r[:5] for r in sorted(got)] == [r[:5] for r in sorted(want)]
    for g, w in zip(sorted(got), sorted(want)):
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=g[2] / ngram_lm.STEPS + 1e-6)


def test_empty_and_clashing(docs, empty, clashing):
    for digest in (ngram_join.join_digest, ngram_lm.lm_digest, packing.pack):
        assert digest(empty).count() == 0
    assert sorted(map(repr, ngram_lm.lm_digest(docs).select("doc_id", "n_known").collect())) == sorted(
        map(repr, ngram_lm.lm_digest(clashing).select("doc_id", "n_known").collect()))
    assert sorted(map(repr, ngram_join.join_digest(docs).collect())) == sorted(map(repr, ngram_join.join_digest(clashing).collect()))


def test_one_id_with_two_texts(spark):
    """Rows (1, A), (1, B), (2, B), and repeated ones: B stays though its smaller id has another text."""
    a, b = "a b c d e f g h", "q r s t u v w x y"
    rows = [(1, a, "x"), (1, b, "x"), (2, b, "y"), (3, a + " i", "z"), (1, a, "x"), (4, None, "n"), (4, "", "n"), (None, a, "k")]
    out = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(
        [(1, a, "x"), (1, b, "x"), (4, None, "n"), (None, a, "k")], key=repr)


def test_join_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rows = family(np.random.default_rng(9), 50)
    want, _ = classes([(i, t, None) for i, t in rows])
    got = ngram_join.join_digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
