"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators of character trigrams (letters, case, digits and punctuation reduced
to 64 classes) and of how much of a text's word five-grams and lines repeat are
scaled by the log ratio of their counts in the two classes; a linear hinge-loss
model is then fitted by dual coordinate descent and its margin calibrated on rows
it was not fitted to.  Scoring is one pass without a shuffle; the weights are a
fixed one megabyte.

Labels come from the learnable fold only, at most ``PER_CLASS`` rows of each
class (the documented bound of the fit); the calibration weighs them by the class
shares of all learnable labels, so it does not move with the bound.  A text alone makes its score.

Defined results: a null or empty text is scored as the empty text; a very long text is
scored whole; equal rows of the sample are fitted in the order of ids; repeated rows
each get a score; a null doc_id is not held out; without labels of both classes
every score is the class share (0.5 if there is none); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm import labels as lab
from tallgrass.llm import textbatch as tb
from tallgrass.llm.linear import hinge_dcd, platt, sigmoid
from tallgrass.llm.quality_rules import measure

PER_CLASS = 3_000
N_TRIGRAMS = 1 << 18
N_FEATURES = N_TRIGRAMS + 64
ALPHA, COST, EPOCHS = 1.0, 1.0, 15

_CLASS = np.full(256, 63, np.uint32)  # continuation bytes
_CLASS[0xC0:] = 62
_CLASS[:32] = 61
_CLASS[97:123] = np.arange(26)
_CLASS[65:91] = 26
_CLASS[48:58] = 27
_CLASS[32], _CLASS[10] = 28, 29
_CLASS[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 30 + np.arange(32) % 31


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every indicator that is set, ordered by text, each once."""
    n = len(offsets) - 1
    codes = _CLASS[data]
    grams = (codes[:-2] << 12) | (codes[1:-1] << 6) | codes[2:] if len(codes) > 2 else np.empty(0, np.uint32)
    text = np.repeat(np.arange(n, dtype=np.uint64), np.maximum(0, np.diff(offsets) - 2))
    inside = np.ones(len(data), bool)
    for k in (1, 2):  # trigrams that would begin in one text and end in another
        cut = offsets[1:] - k
        inside[cut[cut >= offsets[:-1]]] = False
    inside = inside[: len(grams)]
    keys = text << np.uint64(20) | grams[inside].astype(np.uint64)
    m = measure(data, offsets)
    shares = [
        np.minimum(15, 16 * m["n_repeat_words"] // np.maximum(1, m["n_words"])),
        16 + np.minimum(15, 16 * m["n_dup_lines"] // np.maximum(1, m["n_lines"])),
        32 + np.minimum(15, np.log2(1 + m["n_words"]).astype(np.int64)),
        48 + np.minimum(15, 16 * m["n_upper"] // np.maximum(1, m["n_upper"] + m["n_lower"])),
    ]
    each = np.arange(n, dtype=np.uint64) << np.uint64(20)
    keys = np.concatenate([keys, *(each | (N_TRIGRAMS + s).astype(np.uint64) for s in shares)])
    keys = np.sort(keys)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return (keys >> np.uint64(20)).astype(np.int64), (keys & np.uint64((1 << 20) - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    offset: float

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        text, feature = features(data, offsets)
        return np.bincount(text, self.weights[feature], n) / np.sqrt(np.maximum(1, np.bincount(text, minlength=n)))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margins(data, offsets) + self.offset)


def fit(rows: list[tuple[int, np.ndarray]], seed: int = 11, share: float | None = None) -> Model:
    """A model of (label, set features) rows, calibrated to ``share`` of label 1 (to the rows' own if None)."""
    y = np.array([label for label, _ in rows])
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(N_FEATURES, np.float32), 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    order = np.random.default_rng(seed).permutation(len(rows))
    held = set(order[: max(2, len(rows) // 5)].tolist())
    fold = [i for i in range(len(rows)) if i not in held]
    if len({int(y[i]) for i in fold}) < 2:
        fold = list(range(len(rows)))
    counts = np.full((2, N_FEATURES), ALPHA)
    for i in fold:
        counts[y[i], rows[i][1]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    scaled = [(f, ratio[f] / np.sqrt(max(1, len(f)))) for _, f in rows]
    w = hinge_dcd([scaled[i] for i in fold], np.where(y[fold] > 0, 1, -1), N_FEATURES, np.full(len(fold), COST), EPOCHS)
    rest = sorted(held) if len({int(y[i]) for i in held}) == 2 else fold
    margins = np.array([float(w[scaled[i][0]] @ scaled[i][1]) for i in rest])
    slope, offset = platt(margins, y[rest], share=share)
    return Model((w * ratio).astype(np.float32), slope, offset)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fit on a bounded sample; features are made by the executors, the class share of all learnable labels is put back by weight."""
    chosen = lab.sample(labels, label_col, per_class)

    def run(batches):
        for batch in batches:
            for part in tb.slices(batch, 1):
                data, offsets = tb.flatten(part.column(1))
                text, feature = features(data, offsets)
                ends = np.searchsorted(text, np.arange(len(offsets)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([feature[a:b].astype("<i4").tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], ["doc_id", "label", "features"])

    rows = lab.sampled_documents(docs, chosen).select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, features binary").collect()
    rows = sorted((r[0], r[1], bytes(r[2])) for r in rows)
    return fit([(label, np.frombuffer(f, "<i4")) for _, label, f in rows], share=lab.share(labels, label_col))


def score(docs: DataFrame, model: Model, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    return score_rows(docs, model.scores, threshold, id_col, text_col)


def score_rows(docs: DataFrame, scores, threshold: float, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in tb.slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(*tb.flatten(part.column(1))).astype(np.float64))], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", lab.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_nbsvm_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels), 0.3)
