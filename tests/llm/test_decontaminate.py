"""Spaced seeds against all alignments of all documents with all items."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import decontaminate as dc
from tallgrass.llm import textbatch as tb

SF = "/root/testdata/sf0.001"


def ids_of(texts):
    hashes, text = dc.tokens(*tb.flatten(pa.array(texts, pa.string())))
    return [hashes[text == k].astype(np.uint32) for k in range(len(texts))]


def best_by_all_alignments(doc, item):
    """(equal, window, -place) of the best admitted window over all shifts, or None."""
    size, best = min(dc.WINDOW, len(item)), None
    for shift in range(-len(item) + size, len(doc) - size + 1) if size else ():
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        same = np.concatenate([[0], np.cumsum(doc[lo + shift : hi + shift] == item[lo:hi])])
        sums = same[size:] - same[:-size]
        if len(sums) and sums.max() >= dc.needed(size):
            found = (int(sums.max()), -(lo + shift + int(sums.argmax())), size)
            best = max(best or found, found)
    return best


def brute(docs, items):
    tokens = ids_of([t or "" for _, t in docs]), ids_of([t or "" for _, t in items])
    best = {}
    for (d, _), a in zip(docs, tokens[0]):
        for (i, _), b in zip(items, tokens[1]):
            if (found := best_by_all_alignments(a, b)) is not None:
                best[(d, i)] = max(best.get((d, i), found), found)
    return {(d, i, -at, n, size) for (d, i), (n, at, size) in best.items()}


def found(spark, docs, items):
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {tuple(r) for r in dc.find_leaks(*frames).collect()}


@pytest.mark.parametrize("masks,sizes", [(dc.MASKS, range(12, 16)), (dc.SHORT_MASKS, range(8, 12))])
def test_masks_see_every_admitted_pattern(masks, sizes):
    for n in sizes:
        window = min(n, dc.WINDOW)
        for worn in itertools.combinations(range(window), window - dc.needed(window)):
            assert any(all(p + at not in worn for p in m) for m in masks for at in range(window - m[-1])), (n, worn)


def test_real_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(spark, docs, items) == brute(docs, items)


def test_every_length_and_substitution(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(n, " ".join(word() for _ in range(n))) for n in range(1, 31)]
    docs = []
    for n, text in items:
        for k in range(5):
            words = text.split()
            for at in rng.sample(range(n), min(n, k)):
                words[at] = word()
            docs.append((100 * n + k, " ".join([*(word() for _ in range(rng.randrange(30))), *words, *(word() for _ in range(rng.randrange(30)))])))
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    assert {(n, 100 * n + k) for n in range(8, 31) for k in (0, 1)} <= {(i, d) for d, i, *_ in want}


def test_texts_of_one_item_id_and_of_none(spark):
    a, b, c = (" ".join(f"{k}word{j}" for j in range(20)) for k in "abc")
    docs = [(1, a), (2, b), (3, c), (None, c), (4, "clean " * 30), (4, a), (5, None), (6, "")]
    items = [(1, a), (1, b), (None, c), (2, None), (3, "")]
    assert {(d, i) for d, i, *_ in found(spark, docs, items)} == {(1, 1), (2, 1), (3, None), (None, None), (4, 1)}
    frames = spark.createDataFrame(docs, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("__leaking_id", "version", "item_id", "stretch")}), spark.createDataFrame(items, "item_id long, text string")
    kept = dc.drop_leaks(*frames)
    assert kept.columns == frames[0].columns
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in kept.collect()) == [(4, "clean"), (5, ""), (6, "")]


def test_long_text_full_of_hits(spark):
    item = " ".join(f"w{j}" for j in range(14))
    text = " ".join(f"{item} gap{k}" for k in range(3000)) + " and " + "x" * 3_000_000
    rows = found(spark, [(1, text), (2, "none of it")], [(7, item), (8, "tiny item here")])
    assert rows == {(1, 7, 0, 12, 12)}


def test_no_id_beside_every_number(spark):
    """Items and documents without an id and with -1 are two, though their texts are equal."""
    text = " ".join(f"word{j}" for j in range(20))
    docs, items = [(-1, text), (None, text), (0, text)], [(-1, text), (None, text)]
    assert {(d, i) for d, i, *_ in found(spark, docs, items)} == {(d, i) for d in (-1, None, 0) for i in (-1, None)}
    frames = spark.createDataFrame([*docs, (5, "clean")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert [r.doc_id for r in dc.drop_leaks(*frames).collect()] == [5]
