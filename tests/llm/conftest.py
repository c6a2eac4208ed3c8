import random

import pytest
from pyspark.sql import functions as F

WORDS = {"en": "the of and house water light stone river under over again small great thing".split(), "fr": "le la été maison où ça être forêt leçon garçon voilà très".split()}


def prose(rnd, n, lang="en"):
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "", "s", "ing", "er"]) for _ in range(n))


def corpus():
    """Documents with nulls, empty and blank texts, copies, near copies, shared passages, one long text, other scripts."""
    rnd = random.Random(5)
    texts = [None, "", " \n\t ", "one", "one two three", "one  two\nthree"]
    passage = prose(rnd, 60)
    for i in range(30):
        lang = "fr" if i % 3 == 0 else "en"
        body = prose(rnd, rnd.randint(5, 120), lang) + "."
        texts.append(body if i % 5 else f"{body} {passage} {prose(rnd, 10)}")
    texts += [texts[10], texts[10], f"  {texts[10]} ", texts[11] + " x", texts[12].upper()]
    texts += ["a b c d e " * 30, prose(rnd, 20000), "日本語 テキスト <|endoftext|> it's İstanbul Σς ok", "́ é é ﬁ", "Released under the MIT License. " + prose(rnd, 30)]
    return [(i, t, ("fr" if i % 3 == 0 else "en") if i < 36 else None, [None, "a", "b", "c"][i % 4]) for i, t in enumerate(texts)]


CLASH = ["kept", "size", "part", "edge", "fp", "anchor", "home", "rate", "target", "copies", "held", "score", "block", "word", "label", "label_id", "route", "spots", "component_id", "__keep"]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("x") for c in CLASH}).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
