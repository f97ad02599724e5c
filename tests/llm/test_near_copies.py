"""Near copies against all pairs of shingle sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import near_copies, simhash
from tallgrass.llm import textbatch as tb


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def _first_of_groups(rows):
    sets = [_shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if union == 0 or len(sets[i] & sets[j]) >= 0.8 * union:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return {min(d for (d, _), g in zip(rows, group) if g == own) for own in set(group)}


def _worn(seed, groups, copies):
    rng = random.Random(seed)
    rows = []
    for k in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((1000 * k, " ".join(words)))
        for c in range(1, copies + 1):  # 1 to 4 words replaced: similarity 0.95 to 0.78; the last copy far off
            worn = list(words)
            for at in rng.sample(range(5, 195), (c - 1) % 4 + 1 if c < copies else 30):
                worn[at] = f"x{rng.randrange(5000)}"
            rows.append((1000 * k + c, " ".join(worn)))
    return rows


ODD = [(900, None), (901, " \n"), (902, "two words"), (903, "TWO  words"), (904, "other words")]


def test_stage_keeps_one_of_near_copies(spark):
    import corpus_pipeline

    rows = _worn(5, 12, 5) + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == sorted(_first_of_groups(rows))
    assert stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("limit,rounds", [(1, 40), (20_000, 12), (1, 2)])
def test_large_candidate_groups_go_by_pivots(spark, monkeypatch, limit, rounds):
    """The same groups whether one task decides a candidate group or rounds of pivots do."""
    monkeypatch.setattr(near_copies, "GROUP_BYTES", limit)
    monkeypatch.setattr(near_copies, "PIVOT_ROUNDS", rounds)
    rows = _worn(7, 2, 25)
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(_first_of_groups(rows))


def test_rows_without_id_are_judged_by_their_text(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (None, text), (5, text), (None, "words of its own that no other row has"), (None, "words of its own that no other row has")]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, rows[3][1]), (5, text)]


def test_repeated_ids_lose_no_text_whatever_the_order(spark):
    a, b = (" ".join(f"{k}{j}" for j in range(40)) for k in "ab")
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "z"), (7, b, "q"), (5, b, "p")]
    results = set()
    for order in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [2, 4, 0, 3, 1]):
        df = spark.createDataFrame([rows[k] for k in order], "doc_id long, text string, __rank string").withColumns({c: F.lit(0) for c in ("doc", "version", "row", "order", "group", "class", "__doc")})
        kept = near_copies.keep_one(df)
        assert kept.columns == df.columns
        results.add(tuple(sorted(map(tuple, kept.collect()))))
    assert len(results) == 1 and {r[:2] for r in results.pop()} == {(1, a), (5, b)}


def test_long_and_large_texts(spark):
    long = " ".join(f"t{k % 7919}" for k in range(1_500_000))
    rows = [(1, long), (2, long + " and a little more"), (3, "short one")]
    assert sorted(r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 3]


def test_fingerprints_of_sets():
    rng = np.random.default_rng(0)
    size = np.array([1, 5, 70_000, 3, 200])
    values = rng.integers(0, 2**63, size.sum(), dtype=np.uint64)
    got = near_copies.set_fingerprints(values, np.cumsum(size)).tolist()
    for fp, own in zip(got, np.split(tb.mix(values), np.cumsum(size)[:-1])):
        assert fp == sum(1 << b for b in range(64) if 2 * int((own >> np.uint64(b) & np.uint64(1)).sum()) > len(own))


def test_a_fingerprint_without_id_bridges(spark, monkeypatch):
    prints = {"a": 0, "b": 3, "c": 15, "d": 7 << 40}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.select("doc_id", F.create_map(*(F.lit(x) for kv in prints.items() for x in kv))[F.col("text")].cast("long").alias("fp")))
    docs = spark.createDataFrame([(5, "a"), (None, "b"), (1, "c"), (None, "d")], "doc_id long, text string")
    got = {r.fp: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {0: 1, 3: 1, 15: 1, 7 << 40: None}


def test_groups_of_real_documents_are_those_of_all_pairs(spark):
    """Every pair with a shingle in common is compared; nothing is proposed by a hash."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    classes, where = {}, {}
    for d, t in rows:
        classes.setdefault(frozenset(_shingles(t)), []).append(d)
    sets = list(classes)
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    shared = {}
    for own in where.values():
        for k, i in enumerate(own):
            for j in own[:k]:
                shared[(j, i)] = shared.get((j, i), 0) + 1
    group = list(range(len(sets)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    links = [(i, j) for (i, j), n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
    for i, j in links:
        group[find(i)] = find(j)
    want = {}
    for i, s in enumerate(sets):
        want.setdefault(find(i), set()).update(classes[s])
    got = {}
    for r in near_copies.near_groups(docs).collect():
        got.setdefault(r.group, set()).add(r.doc)
    assert links and {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values()}


@pytest.mark.parametrize("rounds", [0, 1])
def test_a_group_joined_by_chance_is_decided_bucket_by_bucket(spark, monkeypatch, rounds):
    """All rows are one candidate group over a bucket that says nothing; the rest of the rounds gathers the members of a bucket at most."""
    monkeypatch.setattr(near_copies, "GROUP_BYTES", 3_000)
    monkeypatch.setattr(near_copies, "PIVOT_ROUNDS", rounds)
    rows = _worn(9, 3, 40)
    sizes, stars = [], near_copies._rounds

    def watched(left, scratch):
        sizes.append({r["component"]: r["count"] for r in left.groupBy("component").count().collect()})
        return stars(left, scratch)

    monkeypatch.setattr(near_copies, "_rounds", watched)
    joined = near_copies.connected_components
    first = []

    def chance(edges, scratch=None):
        if not first:  # the candidates: one more link to a common class joins all
            first.append(1)
            low = edges.agg(F.min("b").alias("b"))
            edges = edges.unionByName(edges.select("a").distinct().join(F.broadcast(low))).unionByName(edges.select(F.col("b").alias("a")).distinct().join(F.broadcast(low)))
        return joined(edges, scratch)

    monkeypatch.setattr(near_copies, "connected_components", chance)
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(_first_of_groups(rows))
    assert len(sizes) == 2 and len(sizes[0]) == 1 and len(sizes[1]) > 1
