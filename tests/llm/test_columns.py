"""Operators made of column expressions, against plain loops."""

import hashlib
import re

import corpus_pipeline
import pytest
from conftest_llm import SPACE, words_of

from statewave.llm import mixing, pii, quality_rules

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(docs, corpus):
    got = pii.pii_digest(docs).collect()
    assert len(got) == len(corpus)
    texts = {i: t or "" for i, t, *_ in corpus}
    for row in got:
        want = base_spans(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), row
        assert [row[f"n_{k}"] for k in BASE] == [sum(s.startswith(k + ":") for s in want) for k in BASE]
        assert row["spans"].split(",")[:len(want)] == (want or row["spans"].split(",")[:0])


def test_added_spans(docs):
    spans = {r["doc_id"]: r["spans"] for r in pii.pii_digest(docs).collect()}
    assert spans[16] == "iban:6:33"
    assert spans[17] == "us_ssn:10:21"  # the second has no context word
    assert spans[18] == "short_card:10:25"
    assert not spans[0] and not spans[1]


FOUND = {
    "SSN 123-45-6789, 234-56-7890": "SSN [US_SSN], [US_SSN]",
    "SSN 123-45-6789, 234-56-7890; 345-67-8901": "SSN [US_SSN], [US_SSN]; [US_SSN]",
    "SSN 000-45-6789 or 234-56-7890": "SSN 000-45-6789 or [US_SSN]",
    "123-45-6789 SSN": "123-45-6789 SSN",
    "ssn " + "1 " * 20 + " 123-45-6789": "ssn " + "1 " * 20 + " 123-45-6789",
    "card 22: 3782 822463 10005": "card 22: [SHORT_CARD]",
    "card 2: 3782 822463 10005": "card 2: [SHORT_CARD]",
    "IBAN DE89 3704 0044 0532 0130 00 Bitte zahlen": "IBAN [IBAN] Bitte zahlen",
    "IBAN DE89370400440532013000 Take 2": "IBAN [IBAN] Take 2",
    "DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 7": "[IBAN] [IBAN] 7",
    "AB12 DE89 3704 0044 0532 0130 00.": "AB12 [IBAN].",
    "DE89 3704 0044 0532 0130 01 Bitte": "DE89 3704 0044 0532 0130 01 Bitte"}


def test_added_kinds_in_context(spark):
    rows = spark.createDataFrame(list(enumerate(FOUND)), "doc_id bigint, text string")
    masked = [r["text"] for r in pii.mask_pii(rows).orderBy("doc_id").collect()]
    assert masked == list(FOUND.values())
    for text, spans, want in zip(FOUND, pii.pii_digest(rows).orderBy("doc_id").collect(), masked):
        added = [s for s in spans["spans"].split(",") if s.split(":")[0] in ("iban", "short_card", "us_ssn")]
        assert len(added) == want.count("["), (text, added)


def test_many_spans_in_one_text(spark):
    text = "x 10.0.0.1, " * 2000
    row = pii.pii_digest(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row["n_ip"] == 2000 and row["spans"].endswith(f"ip:{12 * 1999 + 2}:{12 * 1999 + 10}")


def test_long_runs_stay_linear(spark):
    texts = ["a" * 200_000, "1" * 200_000, "a@b" * 50_000, "1.1." * 50_000, "a@b" + ".c" * 100_000, "+1" + " " * 100_000]
    rows = pii.pii_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r["n_email"] for r in rows] == [0, 0, 0, 0, 1, 0]
    assert [r["n_ip"] for r in rows] == [0, 0, 0, 25_000, 0, 0]


def test_masking(docs):
    rows = {r["doc_id"]: r["text"] for r in pii.mask_pii(docs).collect()}
    assert rows[13] == "Mail me at [EMAIL][EMAIL] or [PHONE]!"
    assert rows[14] == "card [CARD] and 4111111111111112, ip [IP].[IP] or 300.1.1.1"
    assert rows[16] == "konto [IBAN] ok" and rows[0] is None and rows[1] == ""


def measures(text):
    w = words_of(text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    repeated = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))


def test_quality_measures(docs, corpus):
    texts = {i: t or "" for i, t, *_ in corpus}
    for r in quality_rules.rules_digest(docs).collect():
        m = measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m, r
        assert r["base_failed"] == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (r["base_failed"] and r["kept"])


def test_keep_good(docs, clashing):
    kept = {r["doc_id"] for r in quality_rules.rules_digest(docs).where("kept").collect()}
    out = quality_rules.keep_good(clashing)
    assert out.columns == clashing.columns
    assert {r[0] for r in out.collect()} == kept and 21 in kept and 23 not in kept and 12 not in kept


def targets(sizes):
    """The shares by going round: give by weight, cut at the caps, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s in list(free):
            target[s] += share[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def test_mixing(docs, corpus):
    got = mixing.mix_digest(docs).collect()
    sizes = {}
    for _, t, _, s, _ in corpus:
        sizes[s] = sizes.get(s, 0) + len(words_of(t or ""))
    want = targets(sizes)
    assert len(got) == len(corpus)
    source = {i: s for i, _, _, s, _ in corpus}
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)


def test_mixed_texts(docs, clashing):
    plan = {}
    for r in mixing.mix_digest(docs).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["taken"]
    out = mixing.mix(clashing)
    assert out.columns == clashing.columns
    words = {}
    for r in out.collect():
        words[r[0]] = words.get(r[0], 0) + len(words_of(r[1]))
    assert words == {i: n for i, n in plan.items() if n}


def test_prefix_levels(spark):
    rows = [(s, f"{c:04x}", 1 + c % 7) for s in ("sa", "n") for c in range(0, 65536, 97)]
    cells = spark.createDataFrame(rows, "__source string, __cell string, words bigint")
    got = {(r[0], r[1]): r[2] for r in mixing.cell_offsets(cells, 4).collect()}
    for s in ("sa", "n"):
        total = 0
        for _, cell, n in sorted(r for r in rows if r[0] == s):
            assert got[s, cell] == total
            total += n


def test_empty_and_clashing(docs, empty, clashing):
    for digest in (pii.pii_digest, quality_rules.rules_digest, mixing.mix_digest):
        assert digest(empty).count() == 0
        assert sorted(map(repr, digest(docs).collect())) == sorted(map(repr, digest(clashing).collect()))


def test_stage_names():
    assert len(corpus_pipeline.STAGES) == 5
    assert SPACE
