import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def corpus():
    """Small documents with every odd case: nulls, empty and long texts, repeats, copies."""
    rng = random.Random(5)
    stem = "the of and to in is that der die und la le de lorem ipsum dolor sit amet consetetur sadipscing elitr".split()
    prose = lambda n: " ".join(rng.choice(stem) + rng.choice(["", "", ",", "."]) for _ in range(n))
    long_text = prose(6000)
    near = prose(120)
    words = near.split()
    texts = [
        None, "", " \n\t ", "One", "one two three", "ONE two three", "a b c d e", near, near, near.replace(words[60], "changed", 1),
        " ".join(words[:100]), prose(80) + "\n" + "same line here\n" * 3, "word " * 70, "Mail me at a.b@c.example.org_x@y.z or +1 (017) 555-7713!",
        "card 4111 1111 1111 1111 and 4111111111111112, ip 1.2.3.4.5.6.7.8 or 300.1.1.1", "é" * 40 + " x@é.de x@y.de ü 10.0.0.255",
        "konto DE89 3704 0044 0532 0130 00 ok", "my ssn is 123-45-6789, code 123-45-6780", "amex card 378282246310005 or 378282246310005",
        long_text, long_text + " end", prose(400), prose(300) + "\x0b\x0c" + prose(10), "| ".join(["cell"] * 60),
        *[prose(rng.randint(5, 150)) for _ in range(30)]]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "ß", None]), len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, "no id here at all", None, "s1", 17), (1000, near, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents with extra columns named like what the operators use or in other letter case."""
    from pyspark.sql import functions as F

    extra = "__size __words __source pii node shard score held_out n block TEXT a.b extra0 sequence_id".split()
    return docs.select("*", *[F.lit(1).alias(c) for c in extra])


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))
