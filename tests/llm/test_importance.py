"""Importance resampling against the definition in plain Python, feature by feature."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from tallgrass.llm import importance

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
ODD = [(900, None), (901, ""), (902, " \n\t-- "), (903, "Only Three Words"), (904, "WORD " * 30_000), (905, "same text here " * 9), (905, "same text here " * 9), (905, "another text here " * 9), (None, "no id at all but words " * 6), (906, "🙂 é ß İ K " * 9)]


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    made = [(d, *features(t)) for d, t in docs]
    s = collections.Counter(bucket(f) for _, _, fs in made for f in fs)
    t = collections.Counter(bucket(f) for x in target for f in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    gains = {b: gain(b) for b in s}
    rows = []
    for d, n, fs in made:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[bucket(f)] for f in fs)
        rows.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    open_ = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(open_[: percent * len(open_) // 100]):
        r[4] = k + 1
    return collections.Counter(tuple(r[:5]) for r in rows)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + ODD


@pytest.fixture(scope="module")
def target(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None, ""]


def frames(spark, docs, target):
    """With columns that clash with the operator's own names."""
    d = spark.createDataFrame([(i, t, 1, "r", 2.0) for i, t in docs], "doc_id long, text string, weight int, rank string, id double")
    return d, spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_equals_the_definition(spark, texts, target, percent):
    got = importance.resample(*frames(spark, texts, target), percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert collections.Counter(map(tuple, got.collect())) == brute(texts, target, percent)


def test_small_blocks_and_partitions_change_nothing(spark, texts, target, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_ENTRIES", 50)
    d, t = frames(spark, texts, target)
    assert collections.Counter(map(tuple, importance.resample(d.repartition(6), t, 37).collect())) == brute(texts, target, 37)


def test_empty_tables(spark, texts):
    d, t = frames(spark, texts[:30], ["a b c"])
    assert importance.resample(d.limit(0), t, 5).count() == 0
    assert collections.Counter(map(tuple, importance.resample(d, t.limit(0), 50).collect())) == brute(texts[:30], [], 50)


def test_draws_towards_the_target(spark):
    docs = [(i, ("alpha beta gamma " if i % 10 == 0 else "delta epsilon zeta ") * 10) for i in range(200)]
    got = importance.resample(*frames(spark, docs, ["alpha beta gamma"]), 10).where("rank IS NOT NULL").collect()
    assert len(got) == 20 and all(r.doc_id % 10 == 0 for r in got)
