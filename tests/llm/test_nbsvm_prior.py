"""Quality scores must not move with the cap on the rows of a class."""

import numpy as np

from tallgrass.llm import labels, nbsvm
from tallgrass.llm.linear import platt


def test_platt_puts_the_class_share_back():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.86).astype(int)
    x = rng.normal(2 * y - 1, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    few = np.concatenate([good[: len(bad)], bad])
    whole, capped, plain = platt(x, y), platt(x[few], y[few], share=float(y.mean())), platt(x[few], y[few])
    assert abs(whole[1] - capped[1]) < 0.3 and abs(whole[1] - plain[1]) > 1.0


def test_scores_agree_for_capped_and_uncapped_samples(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    n = {r.label: r["count"] for r in labels.learnable(known, "quality").groupBy("label").count().collect()}
    assert n[1] > 3 * n[0]
    some = docs.where("doc_id % 5 = 0")
    mean = [np.mean([r.score for r in nbsvm.score(some, nbsvm.train(docs, known, per_class=k), 0.3).select("score").collect()]) for k in (3000, n[0])]
    assert abs(mean[0] - mean[1]) < 0.012
    assert abs(labels.share(known, "quality") - n[1] / (n[0] + n[1])) < 1e-12
