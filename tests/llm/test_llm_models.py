"""Classifiers, page text and the pipeline."""

import html as entities
import zlib

import numpy as np
import pytest

import corpus_pipeline
from conftest_llm import words_of
from statewave.llm import html_text, langid, quality_fm, quality_rules
from statewave.llm.pii import mask_pii

LANGUAGES = {"en": "the and of with from this that which would people time", "de": "der die und mit von nicht eine werden über für",
             "fr": "le la les des avec pour dans cette être où", None: "zz"}


def texts(rng, n, words):
    return " ".join(rng.choice(words.split(), n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = np.random.default_rng(0)
    rows = [(i, texts(rng, int(rng.integers(8, 60)), LANGUAGES[lang]), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 !?", "fr"), (903, "the and", None), (904, texts(rng, 30_000, LANGUAGES["de"]), None), rows[0]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), rows


def held(doc_id, modulus, rest):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


def test_language(spoken):
    df, rows = spoken
    got = langid.language_digest(df).collect()
    lang = {i: x for i, _, x in rows}
    assert len(got) == len(rows) and all(r["held_out"] == held(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 for r in got)
    found = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [found[i] for i in (900, 901, 902)] == ["und"] * 3 and found[904] == "de" and found[903] == "en"
    tested = [i for i in range(180) if held(i, 3, 1)]
    assert np.mean([found[i] == lang[i] for i in tested]) > 0.95


def test_language_learns_nothing_from_held_out_rows(spoken):
    from pyspark.sql import functions as F

    df, _ = spoken
    changed = df.withColumn("lang", F.when(langid.doc_bucket(F.col("doc_id"), 3) == 1, "xx").otherwise(F.col("lang")))
    assert sorted(langid.language_digest(df).collect()) == sorted(langid.language_digest(changed).collect())


def test_language_without_labels(spark, empty):
    assert langid.language_digest(empty).count() == 0
    row = langid.language_digest(spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")).first()
    assert row["lang_pred"] == "und" and row["score"] == 0


def test_bounded_sample_is_bounded(spoken):
    df, _ = spoken
    assert langid.bounded_sample(df.where("doc_id < 180").distinct(), 50).count() == 50


def test_calibration_lowers_the_loss():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 500)
    logits = rng.normal(size=(500, 3)) * 3
    logits[np.arange(500), y] += 2.0
    loss = lambda t: -np.log(langid.softmax(logits / t)[np.arange(500), y]).mean()
    t = langid.calibrated(logits, y)
    assert loss(t) <= min(loss(t * 0.9), loss(t * 1.1), loss(1.0))


@pytest.fixture(scope="module")
def judged(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(260):
        good = i % 3 > 0
        text = texts(rng, int(rng.integers(20, 80)), LANGUAGES["en"])
        rows.append((i, text if good else " | ".join(text.upper().split()), None))
        labels.append((i, int(good), 0))
    rows += [(900, None, None), (901, "", None), (902, texts(rng, 30_000, LANGUAGES["en"]), None), rows[4]]
    labels += [(4, 1, 0), (5, None, 0), (None, 1, 0)]
    return (spark.createDataFrame(rows, "doc_id bigint, text string, lang string"),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), rows)


def test_quality(judged):
    df, labels, rows = judged
    got = quality_fm.quality_digest(df, labels).collect()
    assert len(got) == len(rows) and all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    tested = [r for r in got if r["doc_id"] < 260 and held(r["doc_id"], 5, 0)]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in tested]) > 0.95


def test_quality_without_labels(judged, empty):
    df, labels, _ = judged
    assert {r["score"] for r in quality_fm.quality_digest(df, labels.limit(0)).collect()} == {0.5}
    assert quality_fm.quality_digest(empty, labels).count() == 0


def test_interactions_in_linear_time():
    rng = np.random.default_rng(2)
    m = quality_fm.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 8)))
    index, x = np.array([1, 4, 9, 30]), rng.normal(size=4)
    pairs = sum(m.factors[index[i]] @ m.factors[index[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.margin(index, x) == pytest.approx(0.3 + m.linear[index] @ x + pairs)


PAGE = """<!doctype html><html><head><title>No</title><script>if (a < b) { x("</p>") }</script><style>p{}</style></head><body>
<header><a href=/>Home</a></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use cookies on this site, please accept them all.</div>
<%s><h1>Title &amp; more</h1><p>First   paragraph with <b>bold</b> text, long enough to count as such.<br>Line two</p>
<p>Short.<p>Unclosed &eacute;&#233; paragraph that goes on for a while with more and more words in it.
<div class="ad">Buy now</div><form><input>Your mail<button>Send</button></form>
<ul><li>An item that is long enough to be part of the text of this page<li>Another item</ul>
<div id="comments"><p>Reader: I don't agree with any of this, and I say so at great length here.</p></div></%s>
<aside>Related</aside><footer>&copy; Us</footer></body></html>"""
MAIN = ["Title & more", "First paragraph with bold text, long enough to count as such. Line two", "Short.",
        "Unclosed éé paragraph that goes on for a while with more and more words in it.",
        "An item that is long enough to be part of the text of this page", "Another item"]


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_page(tag):
    assert html_text.main_text(PAGE % (tag, tag)).split("\n\n") == MAIN


def test_odd_pages(spark):
    deep = "<div>" * 20_000 + "text" + "</x>" * 20_000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain &lt; text"), (4, "u", "<p>a<![if x]>b"), (5, "u", "<script>only"), (6, "u", deep),
            (6, "u", deep), (7, "u", "<article>" + "<p>many words here</p>" * 5000 + "</article>"), (8, "u", "<<>></p></p><p")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS HTML2", "2 AS text")
    got = html_text.extract(df).orderBy("page_id").collect()
    assert [r["text"] for r in got[:3]] == ["", "", "plain < text"] and got[4]["text"] == "" and got[5]["text"] == got[6]["text"] == "text"
    assert got[7]["text"].count("many words here") == 5000 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("mark", ["<![x[", "<![1] >", "<![ if >", "<![", "<![endif]-->", "<![if x >"])
def test_marked_sections_lose_no_text(mark):
    page = f"<p>before {mark} b></p><p>" + "tail of the page " * 20 + "</p><p>x[0]></p>"
    assert html_text.main_text(page).startswith("before") and "tail of the page" in html_text.main_text(page)


@pytest.mark.parametrize("name", ['class="layout has-sidebar"', 'class="no-comments"', 'class="with-ads"', 'id="page" class="widget-area-none"',
                                  'class="social-studies"', 'class="main-sidebar"'])
@pytest.mark.parametrize("tag", ["article", "section"])
def test_names_empty_no_page(name, tag):
    text = "a long sentence of the page " * 10
    page = f'<body><div {name}><{tag}><p>{text}</p></{tag}><div class="ad">Buy now</div></div><div class="cookie-notice">Cookies</div></body>'
    assert html_text.main_text(page) == text.strip()


def test_sections_with_words_of_names_stay():
    text = "a long sentence of the page " * 10
    page = f'<article><p>{text}</p><section class="social-studies"><p>Studied.</p></section><p class="related">More</p><span class="share">Share</span></article>'
    assert html_text.main_text(page) == text.strip() + "\n\nStudied."


def test_random_articles():
    rng = np.random.default_rng(9)
    for _ in range(30):
        paragraphs = [texts(rng, int(rng.integers(1, 60)), "a<b é & word text \"quoted\"") for _ in range(int(rng.integers(1, 12)))]
        body = "".join(f"<p>{entities.escape(p)}</p>" for p in paragraphs)
        page = f"<body><nav><a>x</a><a>y</a></nav><article>{body}</article><footer>z</footer></body>"
        assert html_text.main_text(page) == "\n\n".join(paragraphs)


def test_pipeline(spark, docs, clashing, tmp_path):
    """Every stage against what the operators' own tests have established, row by row."""
    docs.drop("x").write.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = stage["quality rules"](spark, rows, str(tmp_path))
    good = {r["doc_id"] for r in quality_rules.rules_digest(rows).where("kept").collect()}
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == good
    single = stage["near duplicates"](spark, kept, str(tmp_path))
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(good - {8, 9, 10, 20, 1000})
    masked = stage["personal data"](spark, single, str(tmp_path))
    assert masked.columns == rows.columns and all(r["n_chars"] == len(r["text"]) for r in masked.collect())
    assert mask_pii(masked).exceptAll(masked).count() == 0
    mixed = stage["mixing"](spark, masked, str(tmp_path))
    total = sum(len(words_of(r["text"])) for r in masked.collect())
    assert abs(sum(len(words_of(r["text"])) for r in mixed.collect()) - 1.5 * total) < 4
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out["doc_id"]) <= good and out.groupby("sequence_id")["length"].sum().max() <= 2048
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clashing, str(tmp_path)).columns == clashing.columns


def test_samples_are_bounded(spark, monkeypatch):
    """Rows without an id, repeated rows and repeated ids don't widen what is learned from."""
    rows = [(None, f"word{i % 7} text", "en") for i in range(600)] + [(1, "same words", "de")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = []
    monkeypatch.setattr(langid, "SAMPLE", 10)
    monkeypatch.setattr(langid, "ftrl", lambda x, y, k: learned.append(len(x)) or (np.zeros((langid.BUCKETS, k)), np.zeros(k)))
    langid.fit(docs)
    monkeypatch.setattr(quality_fm, "SAMPLE", 12)
    monkeypatch.setattr(quality_fm, "train", lambda x, y: learned.append(len(x)))
    labels = spark.createDataFrame([(1, 1)] * 50 + [(1, 0)] * 50 + [(2, 1)] * 5, "doc_id bigint, label int")
    quality_fm.fit(docs.select("doc_id", "text"), labels)
    assert learned[0] <= 10 and learned[1] == 12


STORY = ["Lead.", "Two.", "A long first paragraph " * 12, "and a second one with many words " * 9, "No.", "Ok. End."]


def tidy(paragraphs):
    return "\n\n".join(p.strip() for p in paragraphs)


def test_short_paragraphs_beside_long_ones():
    body = "".join(f"<p>{p}</p>" for p in STORY)
    menu = "".join(f"<a href=/{i}>Link {i}</a><br>" for i in range(40))
    assert html_text.main_text(f"<body><div>{menu}</div><h1>Title</h1><div class=story>{body}</div><div>{menu}</div>") == "Title\n\n" + tidy(STORY)


def test_comments_of_blogs():
    """Comments in article elements of their own, and comments that are most of a page."""
    body = "".join(f"<p>{p}</p>" for p in STORY)
    for one in ('<li class="comment"><article class="comment-body"><p>%s</p></article></li>', '<article class="comment"><p>%s</p></article>'):
        many = one % ("I say so and so, again and again. " * 12) * 9
        for story in (f"<div class=story>{body}</div>", f"<article>{body}</article>"):
            page = f'<body>{story}<div id="comments"><h2>Nine comments</h2><ol class="comment-list">{many}</ol></div>'
            assert html_text.main_text(page) == tidy(STORY)
    assert "only words" in html_text.main_text('<div id="comments"><p>The only words of a page.</p></div>')


def test_ratios_decide(monkeypatch):
    """A teaser in an article element is no content; with equal ratios the page is another one."""
    links = "".join(f"<div><a href=/{i}><b>Read <i>more</i></b></a> of <a href=/x>part {i}</a></div>" for i in range(60))
    body = "".join(f"<p>{p}</p>" for p in STORY)
    page = f"<body><article><a href=/t>See also this</a></article><div class=list>{links}</div><div class=story>{body}</div></body>"
    assert html_text.main_text(page) == tidy(STORY)
    monkeypatch.setattr(html_text, "smoothed", np.ones_like)
    assert "part 30" in html_text.main_text(page)
