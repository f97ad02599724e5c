"""The tagger's windows and bound against plain computation, and data that no training writer wrote."""

import random

import numpy as np
import pytest

from tallgrass.llm import pii
from tallgrass.llm.tagger import Tagger


def test_no_stretch_that_viterbi_would_tag_is_passed_over():
    rng, passed = np.random.default_rng(2), 0
    for turn in range(400):
        tagger = Tagger(pii.SYMBOLS, pii.TAGS, seed=turn)
        tagger.p["t"] = rng.normal(0, 1.5, (pii.TAGS, pii.TAGS)).astype(np.float32)
        e = rng.normal(0, 1, (int(rng.integers(1, 12)), pii.TAGS)).astype(np.float32)
        e[:, 0] += rng.uniform(0, 8)
        if float((e[:, 1:].max(1) - e[:, 0]).max()) < -pii.most_gain(tagger):
            passed += 1
            assert not tagger.viterbi(e, pii.ALLOWED).any()
    assert passed > 20


def test_overlapping_windows_are_reconciled():
    """Each character's scores come from the window in which it is most central, then one pass over the stretch."""
    tagger = Tagger(pii.SYMBOLS, pii.TAGS, seed=8)
    rng = np.random.default_rng(3)
    for k in ("xf", "xb", "o"):
        tagger.p[k] = (tagger.p[k] * 3).astype(np.float32)
    text = "".join(rng.choice(list("abc 0123456789@.-+"), 700))
    codes = pii.symbols(text)
    hot = np.flatnonzero((codes == 1) | (codes == 6))
    lo, hi = max(0, hot[0] - pii.REACH), min(len(codes), hot[-1] + pii.REACH + 1)
    starts = list(range(lo, max(lo + 1, hi - pii.WINDOW + pii.STRIDE), pii.STRIDE))
    scores = []
    for at in range(lo, hi):
        depth = [min(at - s, pii.WINDOW - 1 - (at - s)) for s in starts]
        s = starts[int(np.argmax(depth))]
        own = np.zeros((pii.WINDOW, 1), np.int64)
        own[: len(codes[s : s + pii.WINDOW]), 0] = codes[s : s + pii.WINDOW]
        scores.append(tagger.emissions(own)[at - s, 0])
    tags = tagger.viterbi(np.array(scores), pii.ALLOWED)
    want = []
    for a in np.flatnonzero(tags % 2 == 1):
        b = a + 1
        while b < len(tags) and tags[b] == tags[a] + 1:
            b += 1
        want.append((lo + a, int(tags[a]) // 2, lo + b))
    assert [x[:3] for x in pii.tagged_spans(tagger, [text])[0]] == want and len(want) > 3


def test_long_text(spark):
    text = "mail a.b@c.org " + "word 12 " * 150_000 + " card 4111111111111111"
    base, every = pii.find([text], Tagger(pii.SYMBOLS, pii.TAGS))[0]
    assert [k for _, k, _ in base] == [0, 2] and set(base) <= set(every)


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_data_of_other_writers(spark, tagger):
    """Formats written out here, words of other documents around them."""
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 8)))

    def card(between):
        while not pii.luhn(c := "4" + digits(15)):
            pass
        return between.join(c[k : k + 4] for k in (0, 4, 8, 12))

    writers = [
        lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"{digits(3)} {digits(3)} {digits(4)}", lambda: f"{digits(3)}/{digits(3)}-{digits(4)}",
        lambda: f"0{digits(2)} {digits(4)} {digits(4)}", lambda: f"({digits(3)}){digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"0{digits(3)}-{digits(7)}", lambda: f"1-{digits(3)}-{digits(3)}-{digits(4)}",
        lambda: card("."), lambda: card(" - "), lambda: card("/"), lambda: card("  "),
        lambda: f"{name()}.{name()} @ {name()}.com", lambda: f"{name()}(@){name()}.org", lambda: f"{name()} @{name()}.net", lambda: f"{name()}_{name()}@ {name()}.co.uk",
    ]
    words = [w for (t,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(200).collect() for w in t.split() if w.isalpha()]
    some = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(4, 12)))
    texts, spans = [], []
    for k in range(17 * 30):
        before, found = some() + " ", writers[k % 17]()
        texts.append(before + found + " " + some())
        spans.append((len(before), len(before) + len(found)))
    hit = [any(min(e, b) - max(s, a) >= 0.8 * (b - a) for s, _, e in every) for (a, b), (_, every) in zip(spans, pii.find(texts, tagger))]
    assert np.mean(hit) >= 0.9, [round(float(np.mean(hit[k::17])), 2) for k in range(17)]
    others = ["2024-03-05", "05.03.2024", "12:30:45", "1,234,567.89", "v10.2.3", "page 123-456", "3.14159", "10,000 m", "#12345678", "room 4-112", "1914-1918", "0.5-0.7 mm", "chapter 12.3.4", "$1,299.00", "1234567", "ISBN 978-3-16-148410-0", "order no. 123-456-789", "4.5 6.7 8.9", "doi 10.1000/182", "1 000 000 000"]
    wrong = [len(every) > len(base) for base, every in pii.find([f"{some()} {x} {some()}" for x in others for _ in range(10)], tagger)]
    assert np.mean(wrong) <= 0.15
