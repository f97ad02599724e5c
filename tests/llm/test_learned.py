"""The learned scorers against direct computation: subsequence counts, the dual optimum, log-count ratios."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tallgrass.llm import linear, nbsvm, toxicity
from tallgrass.llm import textbatch as tb


def counts_of(word: bytes) -> dict:
    """Every subsequence of four characters that spans at most six, of the word with its beginning mark."""
    chars = bytes([toxicity._SPACE]) + word
    out: dict = {}
    for at in itertools.combinations(range(len(chars)), toxicity.ORDER):
        if at[-1] - at[0] < toxicity.SPAN:
            key = bytes(chars[k] for k in at)
            out[key] = out.get(key, 0.0) + toxicity.DECAY ** (at[-1] - at[0] + 1 - toxicity.ORDER)
    return out


def words_of(text):
    return toxicity._words([text])[0]


def gapped(word):
    """As the scorer sees it: counts per place, so a repeated subsequence adds to the length place by place."""
    chars = bytes([toxicity._SPACE]) + word
    return sum((toxicity.DECAY ** (at[-1] - at[0] + 1 - toxicity.ORDER)) ** 2 for at in itertools.combinations(range(len(chars)), toxicity.ORDER) if at[-1] - at[0] < toxicity.SPAN)


def test_folded_table_is_the_kernel_expansion():
    landmarks = words_of("idiot clown worthless scumbag nothing ordinary reading table")
    marks = toxicity.Landmarks(landmarks)
    w = np.random.default_rng(0).standard_normal(len(landmarks))
    model = toxicity.Model(marks.table(w), np.zeros(toxicity.N_FEATURES + 1))
    beta = marks.inverse_root @ w
    spaces = [counts_of(x) for x in landmarks]
    norms = [np.sqrt(sum(v * v for v in x.values())) for x in spaces]
    for text in ("idiot", "i.d.i.o.t", "idxiot", "clowns", "reader", "worthlessness", "abc"):
        (word,) = words_of(text)
        own = counts_of(word)
        want = sum(b * sum(v * x.get(k, 0.0) for k, v in own.items()) / n for b, x, n in zip(beta, spaces, norms)) / np.sqrt(toxicity.SHORT + gapped(word))
        got = model.word_margins(toxicity.fold(*tb.flatten(pa.array([text])))[0])[1]
        assert len(got) == 1 and got[0] == pytest.approx(want, abs=1e-4)


def test_letters_beyond_latin():
    fold = lambda t: words_of(t)
    assert fold("ИДИОТ") == fold("идиот") != fold("привет") and len(set(fold("идиот")[0])) == 4
    assert fold("Ηλίθιος") != fold("καλημέρα") and fold("ÉLÈVE") == fold("élève") and fold("élève") != fold("êlève") != fold("eleve")
    assert fold("fool—«fool» fool") == fold("foolfool fool") and len(fold("傻瓜傻瓜 你好你好")) == 2
    assert fold("🙂🙂🙂🙂") and words_of("") == []


def test_long_sentences_teach(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 8)))
    known_words = [word() for _ in range(400)]
    docs, labels = [], []
    for k in range(240):
        words = [rng.choice(known_words) for _ in range(300)]
        for at in rng.sample(range(300), 8) if k % 2 else ():
            words[at] = "zgrumpf" + rng.choice(["", "el", "ig", "o"])
        docs.append((k, " ".join(words)))  # no punctuation at all: one sentence of some 1,800 characters
        labels.append((k, k % 2))
    d, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, known)
    probe = pa.array(["a text of words and zgrumpfel in it " * 3, "a text of words and nothing else in it " * 3, "x" * 2_000_000])
    scores = model.scores(*tb.flatten(probe))
    assert scores[0] > 0.5 > scores[1] and scores[2] < 0.5


def test_a_common_word_like_an_insult_is_clean():
    toxic = [f"you are a loser number {chr(97 + k)}" for k in range(20)]
    clean = [f"los libros {chr(97 + k % 26) * 3}n de los ni{chr(97 + k % 7)}os" for k in range(400)]
    model = toxicity.Model(toxicity.fit(toxic, clean, ["loser"]), np.zeros(toxicity.N_FEATURES + 1))
    margin = lambda t: model.word_margins(toxicity.fold(*tb.flatten(pa.array([t])))[0])[1][0]
    assert margin("loser") > toxicity.TOXIC_WORD > margin("los")


def test_dual_coordinate_descent_finds_the_optimum():
    """The primal and the dual objective meet, and a plain projected-gradient solver of the dual agrees."""
    rng = np.random.default_rng(1)
    n, m = 60, 12
    x = rng.standard_normal((n, m))
    y = np.where(x[:, 0] + 0.5 * rng.standard_normal(n) > 0, 1, -1)
    c = np.full(n, 1.0)
    w = linear.hinge_dcd([(np.arange(m), r) for r in x], y, m, c, epochs=3000, tolerance=1e-9)
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha = np.zeros(n)
    for _ in range(40_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, c)
    dual = alpha.sum() - 0.5 * alpha @ q @ alpha
    primal = 0.5 * w @ w + float((c * np.maximum(0, 1 - y * (x @ w))).sum())
    assert primal == pytest.approx(dual, rel=1e-3) and np.allclose(w, (alpha * y) @ x, atol=1e-2)


def test_log_count_ratios():
    """Weights of the fitted model are the linear weights times log ratios of indicator counts with one added."""
    rows = [(1, np.array([1, 2])), (1, np.array([1, 3])), (0, np.array([2, 4])), (0, np.array([4]))] * 8
    model = nbsvm.fit(rows)
    order = np.random.default_rng(11).permutation(len(rows))
    fold = [rows[i] for i in range(len(rows)) if i not in set(order[: max(2, len(rows) // 5)].tolist())]
    counts = np.ones((2, nbsvm.N_FEATURES))
    for label, at in fold:
        counts[label, at] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    x = np.zeros((len(fold), 5))
    for k, (_, at) in enumerate(fold):
        x[k, at] = ratio[at] / np.sqrt(len(at))
    y = np.array([2 * label - 1 for label, _ in fold])
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha = np.zeros(len(fold))
    for _ in range(20_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, nbsvm.COST)
    assert np.allclose(model.weights[:5], ((alpha * y) @ x) * ratio[:5], atol=2e-2)
