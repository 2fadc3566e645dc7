"""Phrases, resampling and token files against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import LOWER
from tokenizers import Tokenizer

from statewave.llm import cut, phrases, repair, resample

HARD = ["abc <|endoftext|>x. y", "BELİ. ét́e. Å,  x y　z", "it's we'RE 12,345. ''' a.b,c..", "\x00\x1f a\x0bb\x0cc",
        "日本語。テキスト, ёж", "x" * 3000, "ﬁn ǅ. ß, K."]


@pytest.fixture(scope="module")
def hard(spark, docs, corpus):
    rows = [*corpus, *[(2000 + i, t, "en", "s1", len(t)) for i, t in enumerate(HARD)], *[(None, "hot row", "en", None, 7)] * 40]
    return spark.createDataFrame(rows, docs.schema).repartition(3), rows


def plain_phrases(rows, least, longest, top):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        total[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f[lang].update(" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if a >= least and " " in p}
        inside = Counter()
        for p, a in found.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    q = " ".join(w[i:i + k])
                    inside[q] = max(inside[q], a)
        rows = []
        for p, a in found.items():
            w = p.split(" ")
            cuts = [(1000000 * a * a // (l * r), k, l, r) for k in range(1, len(w))
                    for l, r in [(count[" ".join(w[:k])], count[" ".join(w[k:])])]]
            score, _, left, right = min(cuts)
            if p not in inside or 100 * inside[p] < 50 * a:
                rows.append((-score, -a, p.encode(), p, a, left, right, score))
        for rank, (*_, p, a, left, right, score) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p, a, left, right, total[lang], score))
    return sorted(out)


@pytest.mark.parametrize("longest, top", [(3, 2000), (4, 15)])
def test_phrases(hard, longest, top, monkeypatch):
    monkeypatch.setattr(phrases, "MASS_PER_SHARD", 2000)
    docs, rows = hard
    got = phrases.phrases(docs, least=3, longest=longest, top=top)
    want = plain_phrases(rows, 3, longest, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_phrases_with_a_crowded_filter(hard, monkeypatch):
    """A filter that lets nearly everything pass only costs time."""
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 9)
    monkeypatch.setattr(phrases, "MASS_PER_SHARD", 20000)
    docs, rows = hard
    assert sorted(map(tuple, phrases.phrases(docs, least=3).collect())) == plain_phrases(rows, 3, 3, 2000)


def test_phrases_odd_tables(spark, empty, docs, clashing):
    assert phrases.phrases(empty).count() == 0
    assert phrases.phrases(spark.createDataFrame([(1, None, None, None, None)], empty.schema)).count() == 0
    assert sorted(phrases.phrases(clashing, least=4).collect()) == sorted(phrases.phrases(docs, least=4).collect())


def test_phrases_many_times(spark):
    """Numbers beyond a byte, equal scores, a phrase within another one."""
    rows = [(i, "big cat runs. big cat runs. red fox", None) for i in range(700)]
    got = phrases.phrases(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1)).collect()
    assert [(r["rank"], r["phrase"], r["a"], r["n"], r["score"]) for r in got] == [
        (1, "big cat runs", 1400, 5600, 1000000), (2, "red fox", 700, 5600, 1000000)]


def test_summary_keeps_all_frequent():
    rng = np.random.default_rng(3)
    for least in (5, 20):
        streams = [np.concatenate([rng.zipf(1.3, 1000).clip(max=3000), rng.integers(5000, 1 << 20, 3000)]).astype(np.uint32) for _ in range(6)]
        true = Counter(np.concatenate(streams).tolist())
        summary = phrases.Summary(24000 // least + 1)
        for s in streams:
            key, n = np.unique(s, return_counts=True)
            summary.merge(key, n)
            assert len(summary.key) <= summary.capacity
        assert summary.error < least and summary.error > 0
        assert {k for k, n in true.items() if n >= least} <= set(summary.survivors(least).tolist())
        assert all(0 <= true[k] - c <= summary.error for k, c in zip(summary.key.tolist(), summary.count.tolist()))


def test_numbered_past_64_bits():
    big = (1 << 31) - 1
    columns = [np.array([0, big, 0, big, 0]), np.array([big, 5, big, 5, 4]), np.array([7, big, 7, big, 7])]
    n = phrases.numbered(columns)
    assert n[0] == n[2] and n[1] == n[3] and len(set(n.tolist())) == 3


WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_resample(rows, target, share=25, least_words=20, buckets=10000):
    def features(text):
        w = WORD.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(x.encode()) % buckets for x in [*w, *map(" ".join, zip(w, w[1:]))]]

    docs = [(r[0], *features(r[1])) for r in rows]
    s, t = Counter(b for *_, fs in docs for b in fs), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for doc_id, n, fs in docs:
        weight = sum(gain[b] for b in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    enough = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    most = share * len(enough) // 100
    ranks = {id(r): k + 1 for k, r in enumerate(enough[:most])}
    return [(*r[:4], ranks.get(id(r))) for r in out]


def test_resample(spark, hard):
    docs, rows = hard
    target = ["the of lorem ipsum and\n\n in", None, "", "sadipscing elitr the"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = sorted(map(repr, map(tuple, resample.resample_digest(docs, bench).collect())))
    want = plain_resample(rows, target)
    assert got == sorted(map(repr, want)) and sum(r[4] is not None for r in want) > 5


def test_resample_keeps_rows(spark, docs, empty, clashing):
    bench = docs.where("doc_id < 30").select("text")
    drawn = resample.resample(clashing, bench)
    assert drawn.columns == clashing.columns
    ids = {r["doc_id"] for r in resample.resample_digest(docs, bench).where("rank is not null").collect()}
    assert {r["doc_id"] for r in drawn.select("doc_id").collect()} == ids
    assert resample.resample(empty, bench).count() == 0 and resample.resample_digest(empty, empty).count() == 0
    nothing = resample.resample_digest(docs, empty)
    assert nothing.count() == docs.count() and nothing.where("rank is not null").count() > 0


def test_equal_rows_are_all_ranked(spark, empty):
    rows = spark.createDataFrame([(None, "a b " * 20, None, None, None)] * 400, empty.schema).repartition(5)
    ranks = sorted(r["rank"] for r in resample.resample_digest(rows, empty).where("rank is not null").collect())
    assert ranks == list(range(1, 101))


def test_shifted_crc():
    rng = np.random.default_rng(1)
    left, right = [rng.bytes(n) for n in (0, 1, 7, 300)], [rng.bytes(n) for n in (5, 0, 70000, 33)]
    crc = np.array([zlib.crc32(x) for x in left], np.uint32)
    joined = resample.shifted(crc, np.array([len(y) for y in right])) ^ np.array([zlib.crc32(y) for y in right], np.uint32)
    assert joined.tolist() == [zlib.crc32(x + y) for x, y in zip(left, right)]


@pytest.mark.parametrize("chunk", [1, 50, 10**9])
def test_cut_words(corpus, chunk):
    texts = [r[1] for r in corpus] + HARD
    got = []
    for a, b, words in cut.cut_column(pa.array(texts), chunk, repair.SPACE, lower=False):
        values, at = words.values.to_pylist(), 0
        for n in words.counts:
            got.append([values[c] for c in words.code[at:at + n]])
            at += n
    assert got == [(t or "").encode().split() for t in texts]


def encoded(rows):
    tokenizer = Tokenizer.from_file(repair.default_tokenizer())
    return [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]


def test_token_files(spark, hard, tmp_path):
    docs, rows = hard
    folder = str(tmp_path / "ids")
    repair.write_ids(docs, folder, shard_tokens=3000)
    files = sorted((tmp_path / "ids").glob("*.rp"))
    assert len(files) > 5 and not list((tmp_path / "ids").glob("*.part"))
    want = encoded(rows)
    expected = Counter((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in want)
    got = repair.read_digest(spark, folder).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is None, d or 0))
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    rng = np.random.default_rng(2)
    known = {d: ids for d, ids in want if d is not None and d not in (7,)}
    for path in files:  # any range of any document
        shard = repair.Shard(path.read_bytes())
        assert shard.expanded(shard.symbols).size == shard.ids
        for k in range(len(shard.doc_id)):
            if shard.known[k] and (ids := known.get(int(shard.doc_id[k]))):
                a, n = int(rng.integers(0, len(ids) + 1)), int(rng.integers(0, 40))
                assert shard.tokens(k).tolist() == ids and shard.tokens(k, a, n).tolist() == ids[a:a + n]


def test_token_files_odd_tables(spark, docs, empty, clashing):
    assert repair.ids_digest(empty).count() == 0
    assert sorted(map(repr, repair.ids_digest(clashing).collect())) == sorted(map(repr, repair.ids_digest(docs).collect()))


@pytest.mark.parametrize("kind", ["random", "one id", "copies", "short"])
def test_grammar(kind):
    rng = np.random.default_rng(4)
    ids = {"random": rng.integers(0, 50000, 20000), "one id": np.zeros(5000), "short": np.array([3]),
           "copies": np.tile(rng.integers(0, 50000, 700), 60)}[kind].astype("<u4")
    counts = np.array([1] if kind == "short" else [700, 300, *[100] * ((len(ids) - 1000) // 100)])
    data = repair.shard_bytes(3, 17, list(range(len(counts))), ids, counts, 50000)
    shard = repair.Shard(data)
    assert (shard.expanded(shard.symbols) == ids).all() and (shard.task, shard.before) == (3, 17)
    assert (shard.length[shard.symbols].sum() == len(ids)) and (np.diff(shard.first_id) == counts).all()
    if kind in ("one id", "copies"):
        assert len(data) < 2 * len(ids)
    pairs = [tuple(r) for r in shard.rules.tolist()]
    assert len(set(pairs)) == len(pairs)


def test_pairs_that_do_not_fit_one_number():
    symbols = np.array([1 << 30, 5, 1 << 30, 5, 9], np.uint32)
    place = np.arange(4)
    pair, at = repair.ordered_pairs(symbols, place)
    small, small_at = repair.ordered_pairs(np.array([7, 5, 7, 5, 9], np.uint32), place)
    assert at[pair == pair[-1]].tolist() == small_at[small == small[-1]].tolist() == [0, 2]
