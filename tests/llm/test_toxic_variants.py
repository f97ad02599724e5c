"""Insults written to pass a filter, in texts that no label was learned from."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import labels as lab
from tallgrass.llm import textbatch as tb
from tallgrass.llm import toxicity

SF = "/root/testdata/sf0.1"
INSULTS = ("idiot", "moron", "trash", "worthless", "disgusting", "pathetic", "loser", "stupid", "clown", "scum")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def inserted(n):
    def write(word, rng):
        for _ in range(n):
            at = rng.randrange(1, len(word))
            word = word[:at] + rng.choice(LETTERS) + word[at:]
        return word

    return write


def replaced(word, rng):
    at = rng.randrange(1, len(word))
    return word[:at] + rng.choice(LETTERS) + word[at + 1 :]


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))


@pytest.fixture(scope="module")
def clean(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").where("toxic = 0 AND quality = 1 AND lang = 'en'").where(lab.held_out(F.col("doc_id"))).orderBy("doc_id").collect()
    return [w[:60] for r in rows if len(w := (r.text or "").split()) >= 60][:120]


def flagged(model, texts):
    return (model.scores(*tb.flatten(pa.array(texts, pa.string()))) >= 0.5).mean()


@pytest.mark.parametrize("write", [lambda w, r: w, lambda w, r: ".".join(w), inserted(1), inserted(2), replaced], ids=["plain", "dotted", "one", "two", "replaced"])
def test_written_otherwise(model, clean, write):
    rng, texts = random.Random(11), []
    for words in clean:
        words = list(words)
        for _ in range(4):
            words.insert(rng.randrange(len(words)), write(rng.choice(INSULTS), rng))
        texts.append(" ".join(words))
    assert flagged(model, texts) >= 0.9


def test_clean_words_stay_clean(model, clean):
    assert flagged(model, [" ".join(w) for w in clean]) <= 0.01
    rng = random.Random(12)
    stretched = [" ".join(inserted(1)(w, rng) if len(w) > 4 and rng.random() < 0.2 else w for w in words) for words in clean]
    assert flagged(model, stretched) <= 0.03
