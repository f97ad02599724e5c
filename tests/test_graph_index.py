"""Recall of the graphs against brute force, and the share of vectors that they score."""

import numpy as np
import pytest

from tallgrass.operators import graph_index
from tallgrass.plans import retrieval_queries
from tallgrass.sources.scratch import Scratch


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_share(spark, sf):
    r = retrieval_queries.graph_recall(spark, f"/root/testdata/{sf}").first()
    print(sf, r)
    assert r.recall >= 0.9 and r.share < {"sf0.01": 1, "sf0.1": 0.2}[sf]  # 500 vectors are too few to leave many out
    rows = retrieval_queries.lsh_topk(spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == 10 * r.n_queries and all(x.d < 1e-3 for x in rows if x.q_id == x.item_id)


def search(spark, items, queries, k, **kw):
    e, q = (spark.createDataFrame(rows, "id long, v array<double>") for rows in (items, queries))
    with Scratch() as scratch:
        index, centre = graph_index.build_index(e, scratch, kw.pop("shard_rows", graph_index.SHARD_ROWS))
        found, scored = graph_index.graph_topk(q, index, centre, k, **kw)
        return {(r.q_id, r["rank"]): (r.item_id, r.score) for r in found.collect()}, {r.q_id: r.scored for r in scored.collect()}


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph_index, "QUERY_ROWS", 7)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(600, 8)), 3)
    items, queries = [(i, v.tolist()) for i, v in enumerate(x)], [(1000 + i, v.tolist()) for i, v in enumerate(np.round(rng.normal(size=(40, 8)), 3))]
    got, scored = search(spark, items, queries, 5, shard_rows=80)
    hits = sum(got[q, r + 1][0] in set(np.argsort(-(x @ np.array(v)))[:5].tolist()) for q, v in queries for r in range(5))
    assert hits >= 0.9 * 200 and len(got) == 200 and set(scored) == {q for q, _ in queries}


def test_a_third_of_the_rows_are_one_vector(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 300, 3)] + [(i, rng.normal(size=3).tolist()) for i in range(300) if i % 3]
    got, _ = search(spark, rows, [(7, [9.0, 0.0, 0.0]), (8, [1.0, 2.0, -3.0])], 4, shard_rows=60)
    score = sorted(((-round(float(np.dot([1.0, 2.0, -3.0], v)), 6), i) for i, v in rows))[:4]
    assert [got[8, r + 1] for r in range(4)] == [(i, -s) for s, i in score]
    best = sorted(((-round(9 * v[0], 6), i) for i, v in rows))[:4]
    assert [got[7, r + 1] for r in range(4)] == [(i, -s) for s, i in best]


def test_few_and_none(spark):
    got, _ = search(spark, [(1, [1.0]), (2, None)], [(5, [2.0]), (6, None)], 3)
    assert got == {(5, 1): (1, 2.0)}
    assert search(spark, [(1, None)], [(5, [2.0])], 3) == ({}, {})
    assert search(spark, [(1, [1.0])], [(6, None)], 3) == ({}, {})


def test_links_join_both_ways_and_stay_few():
    x = np.random.default_rng(4).normal(size=(300, 6))
    links = graph_index.link(x)
    assert all(0 < len(m) <= 2 * graph_index.LINKS and i not in m for i, m in enumerate(links))
    reached, ahead = {0}, [0]
    while ahead:
        new = set(links[ahead.pop()].tolist()) - reached
        reached |= new
        ahead += new
    assert len(reached) == 300
    assert [len(m) for m in graph_index.link(x[:1])] == [0]
