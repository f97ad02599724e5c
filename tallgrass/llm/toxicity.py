"""Toxicity: a gapped-subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares the character subsequences of length four that span at most
six characters of two words, each gap costing a factor, normalised by the words'
own lengths in that space; a word's beginning counts as a character, so that stems
differ from endings.  Letters are folded to 29 classes: the 26 of ASCII, and any other
letter, lower-cased in Latin, Greek and Cyrillic, to one that differs from those of its
neighbours in its alphabet; common digit look-alikes go to letters.  Punctuation inside
a word is passed over and letters spelled apart are put together, so an insult with
characters put in between still shares most of its subsequences.

Landmarks are words of labelled sentences; the machine is linear in the Nyström
features K(x, L) K(L, L)^(-1/2).  As the kernel is an inner product of explicit
subsequence counts, the fitted decision function is one weight for each
subsequence: sum over landmarks of beta_l phi_u(l).  That table (a fixed 4 MB) is
the whole machine, so every word of every text is scored exactly, in one pass
without a shuffle.  A text's probability is a logistic function of its worst word, of
the sum over its words on the toxic side, each counted to its margin of one, and of
their share, fitted on labelled documents.

Labels come from the learnable fold only; ``PER_CLASS`` documents of each class
and ``SENTENCES`` sentences of each class bound the fit.  Sentences are of any length;
one of more than ``PIECE`` characters counts as several.

Defined results: a null or empty text is scored as one without any word; a very long
text is scored whole; repeated rows each get a score; a null doc_id is not held out;
without labels of both classes every score is the class share (0.5 if none); an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm import labels as lab
from tallgrass.llm import textbatch as tb
from tallgrass.llm.linear import hinge_dcd, logistic, sigmoid
from tallgrass.llm.nbsvm import score_rows
from tallgrass.llm.shared import Table

PER_CLASS, SENTENCES, LANDMARKS, ROUNDS = 2_500, 5_000, 192, 2
ORDER, SPAN, DECAY = 4, 6, 0.7
#: Added to a word's squared length, so that a word of one subsequence counts less.
SHORT = 0.25
#: Stems that mark a sentence of a toxic document as a toxic one: the beginnings of
#: words, of so many letters, in so many distinct sentences of toxic documents, and so
#: many times likelier there; at most so many of them.
STEM_LETTERS, SEED_SENTENCES, SEED_ODDS, SEED_STEMS = range(3, 11), 6, 12.0, 64

#: Copies of a toxic word with so many letters put inside that are learned beside it, and the cost of missing one.
INSERTED, INSERTS, INSERT_COST = (1, 2), 8, 30.0

#: Longest piece of a sentence, cut at white space if there is any.
PIECE = 400
_PIECES = rf"(?s)\S.{{0,{PIECE - 2}}}\S(?!\S)|\S(?!\S)|\S{{{PIECE}}}"

PATTERNS = [(0, *c) for c in combinations(range(1, SPAN), ORDER - 1)]
GAPS = [DECAY ** (c[-1] - ORDER + 1) for c in PATTERNS]
TABLE = 1 << (5 * ORDER)
_SPACE, _DROP = 30, 255
_FOLD = np.full(256, _DROP, np.uint8)
_FOLD[97:123] = np.arange(26)
_FOLD[65:91] = np.arange(26)
for _digit, _letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}.items():
    _FOLD[ord(_digit)] = ord(_letter) - 97
_FOLD[tb.WHITE] = _SPACE


def _beyond_ascii(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Classes of the characters whose first bytes are at ``at``: letters by code point, symbols dropped, spaces kept."""
    follow = lambda k: (data[np.minimum(at + k, len(data) - 1)] & 0x3F).astype(np.int64)
    lead = data[at].astype(np.int64)
    point = np.where(lead < 0xE0, (lead & 0x1F) << 6 | follow(1), np.where(lead < 0xF0, (lead & 0x0F) << 12 | follow(1) << 6 | follow(2), (lead & 7) << 18 | follow(1) << 12 | follow(2) << 6 | follow(3)))
    within = lambda lo, hi: (point >= lo) & (point <= hi)
    space = (point == 0xA0) | within(0x2000, 0x200A) | within(0x2028, 0x2029) | (point == 0x3000)
    symbol = within(0xA1, 0xBF) | (point == 0xD7) | (point == 0xF7) | within(0x200B, 0x206F) | within(0x3001, 0x3003)
    point = point + 0x20 * (within(0xC0, 0xDE) | within(0x391, 0x3A9) | within(0x410, 0x42F)) + 0x50 * within(0x400, 0x40F)
    point = np.where((point >= 0x100) & (point < 0x180), point | 1, point)
    return np.where(space, _SPACE, np.where(symbol, _DROP, (7 * point + 3) % 29)).astype(np.uint8)


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of all texts, spaces around each; and where each text begins."""
    codes = _FOLD[data]
    lead = np.flatnonzero(data >= 0xC0)
    codes[lead] = _beyond_ascii(data, lead)
    keep = codes != _DROP
    count = tb.per_text(keep, offsets)
    n = len(count)
    begins = np.cumsum(count) - count + SPAN * np.arange(1, n + 1)
    out = np.full(int(count.sum()) + SPAN * (n + 1), _SPACE, np.uint8)
    out[np.repeat(begins - np.cumsum(count) + count, count) + np.arange(int(count.sum()))] = codes[keep]
    space = out == _SPACE
    apart = np.zeros(len(out), bool)  # a space between two words of one letter
    apart[2:-2] = space[2:-2] & ~space[1:-3] & space[:-4] & ~space[3:-1] & space[4:]
    gone = np.zeros(len(out) + 1, np.int64)
    np.cumsum(apart, out=gone[1:])
    return out[~apart], begins - gone[begins]


def subsequences(codes: np.ndarray, pattern: tuple[int, ...]) -> np.ndarray:
    """Index of the subsequence at each start; the last SPAN starts are left out."""
    n = len(codes) - SPAN
    out = codes[:n].astype(np.int32)
    for k in pattern[1:]:
        out <<= 5
        out |= codes[k : k + n]
    return out


def phi(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of each subsequence of a word, divided by the word's length in that space."""
    padded = np.concatenate([[_SPACE], word, [_SPACE] * SPAN]).astype(np.uint8)
    n = len(padded) - SPAN
    index = [subsequences(padded, p)[: max(0, n - p[-1])] for p in PATTERNS]
    value = np.repeat(GAPS, [len(x) for x in index])
    return np.concatenate(index).astype(np.int64), value / np.sqrt(SHORT + float(value @ value))


#: What a text's probability is made of, and the margin from which a word counts as toxic.
N_FEATURES, TOXIC_WORD = 3, 0.7


@dataclass
class Model:
    table: np.ndarray
    theta: np.ndarray

    def word_margins(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the space before it, decision value) of each word."""
        letter = codes < _SPACE
        n = len(codes) - SPAN
        starts = np.flatnonzero(letter[1:] & ~letter[:-1])
        if not len(starts):
            return starts, np.empty(0)
        own, square = np.zeros(n, np.float32), np.zeros(n, np.float32)
        inside = [np.ones(n, bool)]  # inside[k]: the k characters after this one are letters
        for k in range(1, SPAN):
            inside.append(inside[-1] & letter[k : k + n])
        for pattern, gap in zip(PATTERNS, GAPS, strict=True):
            whole = inside[pattern[-1]] * np.float32(gap)
            own += whole * self.table.take(subsequences(codes, pattern))
            square += whole * np.float32(gap)
        return starts, np.add.reduceat(own, starts) / np.sqrt(np.float32(SHORT) + np.add.reduceat(square, starts))

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each text: worst word, log of the sum of toxic words, log of their share."""
        codes, begins = fold(data, offsets)
        n = len(begins)
        starts, values = self.word_margins(codes)
        values = np.minimum(values, 1)
        text = np.searchsorted(begins, starts + 1, "right") - 1
        worst = np.zeros(n)
        np.maximum.at(worst, text, values)
        hit = values > TOXIC_WORD
        total, words = np.bincount(text[hit], values[hit], n), np.bincount(text, minlength=n)
        return np.stack([worst, np.log1p(total), np.log1p(200 * total / np.maximum(words, 20))], 1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.features(data, offsets) @ self.theta[:-1] + self.theta[-1])


def _words(texts: list[str]) -> list[list[bytes]]:
    """The folded words of each text that hold a subsequence."""
    codes, begins = fold(*tb.flatten(pa.array(texts, pa.string())))
    stops = np.append(begins[1:], len(codes))
    return [[w for w in codes[a:b].tobytes().split(bytes([_SPACE])) if len(w) >= ORDER - 1] for a, b in zip(begins, stops)]


class Landmarks:
    """Explicit vectors of the landmark words, normalised, over the subsequences that occur in any of them."""

    def __init__(self, words: list[bytes]):
        sparse = [phi(np.frombuffer(w, np.uint8)) for w in words]
        self.index = np.unique(np.concatenate([x[0] for x in sparse]))
        self.vectors = np.zeros((len(self.index), len(words)))
        for j, (at, value) in enumerate(sparse):
            np.add.at(self.vectors[:, j], np.searchsorted(self.index, at), value)
        self.vectors /= np.maximum(1e-9, np.sqrt((self.vectors**2).sum(0)))
        self.column = np.full(TABLE, len(self.index), np.int64)
        self.column[self.index] = np.arange(len(self.index))
        self.padded = np.vstack([self.vectors, np.zeros(len(words))])
        gram = self.vectors.T @ self.vectors
        values, basis = np.linalg.eigh(gram)
        self.inverse_root = (basis / np.sqrt(np.maximum(values, 1e-2))) @ basis.T

    def features(self, word: bytes) -> np.ndarray:
        """Nyström features of one word."""
        at, value = phi(np.frombuffer(word, np.uint8))
        return (value @ self.padded[self.column[at]]) @ self.inverse_root

    def table(self, w: np.ndarray) -> np.ndarray:
        """Weight of each subsequence under the linear machine ``w`` in Nyström features."""
        out = np.zeros(TABLE, np.float32)
        out[self.index] = self.vectors @ (self.inverse_root @ w)
        return out


def with_inserts(word: bytes, rng: np.random.Generator) -> list[bytes]:
    """The word as it is written to pass a filter: ``INSERTS`` copies for each number of letters put inside."""
    out = []
    for n in INSERTED * INSERTS:
        new = list(word)
        for _ in range(n):
            new.insert(int(rng.integers(1, len(new))), int(rng.integers(26)))
        out.append(bytes(new))
    return out


def _machine(z: list[np.ndarray], y: list[int], weight: list[float]) -> np.ndarray:
    columns = np.arange(len(z[0]))
    return hinge_dcd([(columns, row) for row in z], np.array(y), len(columns), np.array(weight), 25)


def fit(toxic: list[str], clean: list[str], marks: list[str], seed: int = 5) -> np.ndarray:
    """Subsequence weights from labelled sentences; ``marks`` are the stems that made sentences toxic ones.

    A toxic sentence stands for its words of such a stem and for copies of them with one or
    two letters put inside, as long as no clean sentence holds such a word, a clean one for any of its words;
    after each fit, a clean sentence also gives the word that the machine finds worst,
    and the worst of those become landmarks.  A clean word weighs as many sentences as it
    is in, so a common word that resembles an insult is not taken for one.
    """
    rng = np.random.default_rng(seed)
    marking = tuple(w for words in _words(marks) for w in words)
    positive: dict[bytes, int] = {}
    for words in _words(toxic):
        for w in words:
            if w.startswith(marking):
                positive[w] = positive.get(w, 0) + 1
    whole = [words for words in _words(clean) if words]
    common: dict[bytes, int] = {}
    for words in whole:
        for w in set(words) - positive.keys():
            common[w] = common.get(w, 0) + 1
    drawn = sorted({words[int(rng.integers(len(words)))] for words in whole} - positive.keys())
    if not positive or not drawn:
        return np.zeros(TABLE, np.float32)
    cost = lambda w: 10.0 * min(common[w], 100)
    stretched = {v for w in sorted(positive) for v in with_inserts(w, rng)} - positive.keys() - common.keys()
    landmarks = sorted(positive, key=lambda w: (-positive[w], w))[: LANDMARKS // 2]
    landmarks += [drawn[i] for i in rng.permutation(len(drawn))[: LANDMARKS - len(landmarks)]]
    seen = {**{w: (1, 100.0) for w in positive}, **{w: (1, INSERT_COST) for w in sorted(stretched)}, **{w: (-1, cost(w)) for w in drawn}}
    every = sorted(common)
    codes = np.frombuffer(bytes([_SPACE]) + bytes([_SPACE]).join(every) + bytes([_SPACE]) * SPAN, np.uint8)
    for turn in range(ROUNDS + 1):
        marks_of = Landmarks(landmarks)
        z = [marks_of.features(w) for w in seen]
        table = marks_of.table(_machine(z, [y for y, _ in seen.values()], [c for _, c in seen.values()]))
        if turn == ROUNDS:
            break
        margin = dict(zip(every, Model(table, np.zeros(N_FEATURES + 1)).word_margins(codes)[1].tolist()))
        worst = {max(own, key=lambda w: margin[w]) for words in whole if (own := [w for w in words if w in margin])}
        worst = sorted((w for w in worst if margin[w] > -0.5), key=lambda w: (-margin[w], w))
        known = set(landmarks)
        more = [w for w in worst if w not in known][: LANDMARKS // 2]
        if not more:
            break
        seen |= {w: (-1, cost(w)) for w in worst}
        landmarks += more
    return table


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, sentences: int = SENTENCES) -> Model:
    table = Table(lab.sampled_documents(docs, lab.sample(labels, label_col, per_class)), "toxicity")
    rows = table.df
    n = {r[0]: r[1] for r in rows.groupBy("label").agg(F.count("*")).collect()}
    if not n.get(0) or not n.get(1):
        table.drop()
        share = n.get(1, 0) / max(1, sum(n.values())) if n else 0.5
        return Model(np.zeros(TABLE, np.float32), np.append(np.zeros(N_FEATURES), np.log((share + 1e-6) / (1 - share + 1e-6))))
    # A copied text brings its sentences again; only distinct ones count as evidence.
    sentences_of = F.flatten(F.transform(F.split("text", r"[.!?\n]"), lambda x: F.regexp_extract_all(x, F.lit(_PIECES), F.lit(0))))
    split = Table(rows.select("label", F.explode(sentences_of).alias("sentence")).distinct(), "sentences")
    total = {r[0]: r[1] for r in split.df.groupBy("label").agg(F.count("*")).collect()}
    words = F.array_distinct(F.split(F.lower("sentence"), r"[^\p{L}]+"))
    word = split.df.select("label", "sentence", F.explode(words).alias("word"))
    stems = F.explode(F.array_distinct(F.array(*(F.substring("word", 1, k) for k in STEM_LETTERS))))
    each = word.select("label", "sentence", stems.alias("stem")).where(F.length("stem") >= STEM_LETTERS[0]).distinct()
    counts = each.groupBy("stem").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    odds = (F.col("n1") + 0.5) / max(1, total.get(1, 0)) / ((F.col("n0") + 0.5) / max(1, total.get(0, 0)))
    found = counts.where(F.col("n1") >= SEED_SENTENCES).where(odds >= SEED_ODDS).orderBy((F.col("n1") * F.log(odds)).desc(), "stem").limit(SEED_STEMS).collect()
    marks = [r["stem"] for r in found]
    hit = F.exists(words, lambda w: F.array_contains(F.array(*map(F.lit, marks)), w) | _any([w.startswith(m) for m in marks])) if marks else F.lit(False)

    def take(part: DataFrame) -> list[str]:
        return [r[0] for r in part.select("sentence").orderBy(F.xxhash64("sentence"), "sentence").limit(sentences).collect()]

    toxic, clean = take(split.df.where("label = 1").where(hit)), take(split.df.where("label = 0").where(~hit))
    split.drop()
    model = Model(fit(toxic, clean, marks) if toxic and clean else np.zeros(TABLE, np.float32), np.zeros(N_FEATURES + 1))

    def describe(batches):
        for batch in batches:
            for part in tb.slices(batch, 1):
                f = model.features(*tb.flatten(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(c.astype(np.float64)) for c in f.T)], ["doc_id", "label", *(f"f{k}" for k in range(N_FEATURES))])

    schema = "doc_id long, label int, " + ", ".join(f"f{k} double" for k in range(N_FEATURES))
    known = np.array(sorted(map(tuple, rows.select("doc_id", "text", "label").mapInArrow(describe, schema).collect())), float)
    table.drop()
    share = _prior(labels, label_col)
    weight = np.where(known[:, 1] > 0, share / max(1, n[1]), (1 - share) / max(1, n[0])) * len(known)
    return Model(model.table, logistic(known[:, 2:], known[:, 1], weight))


def _any(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _prior(labels: DataFrame, label_col: str) -> float:
    """Share of label 1 among all learnable rows; the sample is balanced, the probability is not."""
    row = labels.where(~lab.held_out(F.col("doc_id"))).where(F.col(label_col).isin(0, 1)).agg(F.avg(label_col)).first()
    return float(row[0])


def op5_subsequence_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_rows(docs, train(docs, labels).scores, 0.5, "doc_id", "text")
