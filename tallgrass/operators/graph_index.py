"""Approximate inner-product search by small-world graphs, one a shard.

Vectors are dealt to the nearest of a few coarse centroids, and a cell that is too large is
split by id, so no shard is larger than ``SHARD_ROWS`` rows or so. In each shard a task
links every distinct vector to its nearest ones, the ones that point apart first. A query is routed
to the cells nearest to it and walks each shard's graph from fixed entries, always on from
the best vector found, until none of its links comes into the ``ef`` best. The index is a table
of rows, written once and read by any number of searches.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.operators.retrieval import top_k
from tallgrass.sources.scratch import Scratch, Table

#: Rows of a shard, queries that walk a shard in one task, and rows that the centroids are fitted on.
SHARD_ROWS, QUERY_ROWS, SAMPLE = 20_000, 5_000, 20_000
#: Links that a vector makes, candidates they are chosen from, results that a walk keeps, entries, cells that a query visits.
LINKS, AROUND, EF, ENTRIES, PROBES = 8, 32, 40, 4, 32

_NODE = "shard long, cell int, node int, ids array<long>, v array<double>, links array<int>"


def centroids(vectors: DataFrame, cells: int, rounds: int = 8, sample: int = SAMPLE) -> np.ndarray:
    """Centres of ``cells`` groups by Lloyd's rounds over at most ``sample`` vectors, drawn by a hash of their ids."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    x = np.array([r.v for r in rows], float)
    centre = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        own = _nearest(x, centre, 1)[:, 0]
        centre = np.array([x[own == c].mean(0) if (own == c).any() else centre[c] for c in range(len(centre))])
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest centres of each row."""
    d = (centre**2).sum(1)[None] - 2 * x @ centre.T
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def _routed(vectors: DataFrame, centre: np.ndarray, k: int) -> DataFrame:
    """(id, v, cells): the k nearest cells of each vector, the nearest first."""

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cells = _nearest(x, centre, k).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(cells), pa.list_(pa.int32()))], ["id", "v", "cells"])

    return vectors.mapInArrow(route, "id long, v array<double>, cells array<int>")


def link(x: np.ndarray, links: int = LINKS, around: int = AROUND) -> list[np.ndarray]:
    """Links of each row: of its nearest ones those that are nearer to it than to one already chosen, then the nearest; both ways."""
    n = len(x)
    out: list[set] = [set() for _ in range(n)]
    for lo in range(0, n, 512):
        score = x[lo : lo + 512] @ x.T
        # by distance, as long vectors are near to none in particular
        far = (x**2).sum(1)[None] - 2 * score
        far[np.arange(len(score)), np.arange(lo, lo + len(score))] = np.inf
        width = min(around, n - 1)
        near = np.argpartition(far, max(width - 1, 0), axis=1)[:, :width]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)
        for i, candidates in enumerate(near):
            among = ((x[candidates][:, None] - x[candidates][None]) ** 2).sum(2)
            own = ((x[candidates] - x[lo + i]) ** 2).sum(1)
            chosen: list[int] = []
            for c in range(len(candidates)):
                if len(chosen) < links and all(own[c] < among[c, o] for o in chosen):
                    chosen.append(c)
            chosen += [c for c in range(len(candidates)) if c not in chosen][: links - len(chosen)]
            for j in candidates[chosen]:
                out[lo + i].add(int(j))
                out[int(j)].add(lo + i)
    keep = 2 * links
    short = []
    for i, mine in enumerate(out):
        mine = np.array(sorted(mine), np.int32)
        d = ((x[mine] - x[i]) ** 2).sum(1) if len(mine) > keep else None
        short.append(mine if d is None else mine[np.argsort(d, kind="stable")[:keep]])
    return short


def build_index(vectors: DataFrame, scratch: Scratch, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, np.ndarray]:
    """The index of (id, v), one row a distinct vector of a shard, written; and the centroids. Null vectors are left out."""
    known = scratch.table(vectors.where("v IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")), "vectors")
    n = known.count()
    centre = centroids(known, max(1, -(-n // shard_rows))) if n else np.zeros((0, 1))
    if not n:
        return known.sparkSession.createDataFrame([], _NODE), centre
    routed = scratch.table(_routed(known, centre, 1).select("id", "v", F.col("cells")[0].alias("cell")), "cells")
    split = routed.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))  # a row a cell
    shard = F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("parts"))
    dealt = routed.join(F.broadcast(split), "cell").select(shard.alias("shard"), "cell", "id", "v")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x, of = np.unique(np.stack(pdf["v"].to_numpy()), axis=0, return_inverse=True)
        of = of.reshape(-1)
        order = np.argsort(of, kind="stable")
        ids = np.split(pdf["id"].to_numpy()[order], np.cumsum(np.bincount(of))[:-1])
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "cell": pdf["cell"].iloc[0], "node": np.arange(len(x), dtype=np.int32), "ids": ids, "v": list(x), "links": link(x)})

    return scratch.table(dealt.groupBy("shard").applyInPandas(build, _NODE), "graph"), centre


def walk(x: np.ndarray, links: list[np.ndarray], q: np.ndarray, ef: int, entries: np.ndarray) -> tuple[list[tuple[float, int]], int]:
    """(score, node) of the ``ef`` best nodes found, best first, and how many were scored."""
    seen = set(entries.tolist())
    found = [(float(s), -int(e)) for s, e in zip(x[entries] @ q, entries)]  # equal scores: the smaller node is better
    ahead = [(-s, -e) for s, e in found]
    heapq.heapify(ahead)
    best = sorted(found)[-ef:]
    heapq.heapify(best)
    while ahead:
        s, e = heapq.heappop(ahead)
        if len(best) == ef and -s < best[0][0]:
            break
        new = [j for j in links[e].tolist() if j not in seen]
        seen.update(new)
        for score, j in zip((x[new] @ q).tolist() if new else (), new):
            if len(best) < ef or (score, -j) > best[0]:
                heapq.heappush(ahead, (-score, j))
                (heapq.heappush if len(best) < ef else heapq.heapreplace)(best, (score, -j))
    return [(s, -e) for s, e in sorted(best, reverse=True)], len(seen)


def graph_topk(queries: DataFrame, index: DataFrame, centre: np.ndarray, k: int, probes: int = PROBES, ef: int = EF) -> tuple[DataFrame, DataFrame]:
    """((q_id, item_id, score, rank), (q_id, scored)): k items of largest inner product as found, scores to six places, ties by id; and vectors scored for each query.

    ``queries`` are (id, v), ids once each; those without a vector get no row. A shard's graph is
    read once for every ``QUERY_ROWS`` queries that visit it.
    """
    with Scratch() as scratch:
        asked = queries.where("v IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        if not len(centre):
            none = queries.sparkSession.createDataFrame([], "q_id long, item_id long, score double, rank int")
            return none, none.select("q_id", F.lit(0).cast("long").alias("scored"))
        visits = _routed(asked, centre, min(probes, len(centre))).select("id", "v", F.explode("cells").alias("cell"))
        shards = index.select("shard", "cell").distinct()
        visits = scratch.table(visits.join(shards, "cell").select("shard", "id", "v"), "visits")
        blocks = visits.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        left = visits.join(blocks, "shard").select("shard", block.alias("block"), "id", "v")
        right = index.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "cell")

        def search(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(q) and len(g):
                g = g.sort_values("node", kind="stable")
                x, links, ids = np.stack(g["v"].to_numpy()), g["links"].tolist(), g["ids"].tolist()
                entries = np.unique(np.linspace(0, len(x) - 1, ENTRIES).astype(int))
                for own, v in zip(q["id"], q["v"]):
                    found, scored = walk(x, links, np.asarray(v), max(ef, k), entries)
                    hits = sorted((-round(s, 6) + 0.0, int(i)) for s, node in found for i in ids[node][:k])[:k]
                    out += [(own, i, -s + 0.0, scored if r == 0 else 0) for r, (s, i) in enumerate(hits)]
            return pd.DataFrame(out, columns=["q_id", "item_id", "score", "scored"])

        found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "q_id long, item_id long, score double, scored long")
        rows = Table(found, "neighbours").df
    return top_k(rows.drop("scored"), ["q_id"], [F.desc("score"), "item_id"], k), rows.groupBy("q_id").agg(F.sum("scored").alias("scored"))


def recall_and_share(found: DataFrame, exact: DataFrame, scored: DataFrame, n_items: Column | int) -> DataFrame:
    """(n_queries, recall, share): exact neighbours that were found, and vectors scored, over all."""
    hit = exact.select("q_id", "item_id").join(found.select("q_id", "item_id", F.lit(1).alias("hit")), ["q_id", "item_id"], "left").agg(F.countDistinct("q_id").alias("n_queries"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
    return hit.join(F.broadcast(scored.agg(F.round(F.avg("scored") / n_items, 6).alias("share"))))
