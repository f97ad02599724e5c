"""Exact inner-product top-k by bounds from segment statistics, coarse to fine.

A vector is cut into segments, and of each its mean and deviation are kept. By Cauchy and
Schwarz a segment of length L adds at most L * (mean * mean' + dev * dev') to an inner
product, which is the same as the lower bound L * ((mean - mean')^2 + (dev - dev')^2) of
the squared distance; more segments give a closer bound. A query drops an item as soon as
a bound is below the k-th best score that the query has so far, and only what survives
the finest level is multiplied out, in whole numbers. The bounds decide what is computed,
never what is returned.

Queries are dealt into blocks and items into slots; each block meets each slot once, in a
task that holds the block's queries and reads the items batch by batch. So what moves is
the items times the blocks of queries, and no task holds more than a block and a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.shared import Table
from tallgrass.llm.vectors import padded, whole
from tallgrass.operators.retrieval import top_k

#: Segments of each level, as far as the vector has entries.
LEVELS = (1, 4, 16, 32)
#: Queries of a block and items of a slot at most; the least items of a slot that are worth a task.
QUERY_ROWS, SLOT_ROWS, LEAST_ROWS = 16_384, 131_072, 2_048
#: Entries are below this size, so that products of 2,048 of them fit 64 bits.
LIMIT = 1 << 26


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """(rows, 2 * segments): mean and deviation of each segment, times the root of its length."""
    at = np.linspace(0, x.shape[1], segments + 1).astype(int)[:-1]
    length = np.diff(np.append(at, x.shape[1])).astype(np.float64)
    mean = np.add.reduceat(x, at, axis=1) / length
    dev = np.sqrt(np.maximum(np.add.reduceat((x - np.repeat(mean, length.astype(int), axis=1)) ** 2, at, axis=1), 0) / length)
    return np.hstack([mean, dev]) * np.sqrt(np.tile(length, 2))


class Block:
    """The queries of a block, each with the k best items that it has met."""

    def __init__(self, k: int, levels=LEVELS):
        self.k, self.levels, self.parts, self.n_pairs, self.n_scored = k, levels, [], 0, 0
        self.ids = None

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.parts.append((ids, x))

    def _ready(self) -> None:
        self.ids = np.concatenate([p[0] for p in self.parts])
        self.x = np.concatenate([p[1] for p in self.parts]).astype(np.float64)
        self.segments = [s for s in self.levels if s <= self.x.shape[1]]
        self.stats = [segment_statistics(self.x, s) for s in self.segments]
        self.norm = np.sqrt((self.x**2).sum(1))
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(self.ids)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not self.parts:
            return
        if self.ids is None:
            self._ready()
        x = x.astype(np.float64)
        stats = [segment_statistics(x, s) for s in self.segments]
        norm = np.sqrt((x**2).sum(1).max())
        exact = x if x.shape[1] * np.abs(x).max() * np.abs(self.x).max() < 2.0**53 else x.astype(np.int64)
        for i, own in enumerate(self.ids):
            slack = 1e-6 + 1e-9 * self.norm[i] * norm  # what rounding may take from a bound
            least = self.best[i][1][-1] if len(self.best[i][1]) == self.k else -np.inf
            alive, bound = np.flatnonzero(ids != own), None
            self.n_pairs += len(alive)
            for level, mine in zip(stats, self.stats):
                bound = (level[alive] if len(alive) < len(ids) else level) @ mine[i]
                keep = bound >= least - slack
                alive, bound = alive[keep], bound[keep]
            if not len(alive):
                continue
            q = self.x[i].astype(exact.dtype)
            first = min(4 * self.k, len(alive))
            order = np.argpartition(-bound, first - 1) if first < len(alive) else np.arange(len(alive))
            self._score(i, ids, exact, q, alive[order[:first]])
            rest = order[first:]
            if len(rest):
                least = self.best[i][1][-1]
                rest = rest[bound[rest] >= least - slack]
                self._score(i, ids, exact, q, alive[rest])

    def _score(self, i: int, ids: np.ndarray, exact: np.ndarray, q: np.ndarray, rows: np.ndarray) -> None:
        self.n_scored += len(rows)
        found = np.concatenate([self.best[i][0], ids[rows]])
        score = np.concatenate([self.best[i][1], (exact[rows] @ q).astype(np.int64)])
        order = np.lexsort((found, -score))[: self.k]
        self.best[i] = found[order], score[order]

    def rows(self) -> pa.RecordBatch:
        """(query, item, score) of what was found."""
        best = self.best if self.ids is not None else []
        n = [len(b[0]) for b in best]
        cols = [np.repeat(self.ids, n), *(np.concatenate([b[j] for b in best]) for j in (0, 1))] if sum(n) else [np.empty(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["q", "i", "score"])


def exact_topk(queries: DataFrame, items: DataFrame, k: int, parts: int) -> DataFrame:
    """(q, i, score, rank): the k items of largest inner product of each query, ties to the smaller id, without the item of its own id.

    Both sides are (id, v) with whole entries below ``LIMIT``, ids once each. A shorter vector
    counts as ending in zeros; fewer than k items are all returned; without queries or items
    the result is empty.
    """
    size = lambda df: df.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    (n_q, w_q), (n_i, w_i) = size(queries), size(items)
    width = max(1, w_q, w_i)
    n_blocks = max(1, -(-n_q // QUERY_ROWS))
    n_slots = max(1, -(-n_i // SLOT_ROWS), min(parts, -(-n_i // LEAST_ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    bucket = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    vec = padded(F.col("v").cast("array<int>"), width).alias("v")
    q = queries.select(bucket(n_blocks).alias("block"), every(n_slots).alias("slot"), F.lit(0).alias("role"), "id", vec)
    it = items.select(every(n_blocks).alias("block"), bucket(n_slots).alias("slot"), F.lit(1).alias("role"), "id", vec)
    met = q.unionByName(it).repartition(max(parts, min(n_blocks * n_slots, 16_384)), "block", "slot").sortWithinPartitions("block", "slot", "role")

    def search(batches):
        at, block = None, None
        for batch in batches:
            b, s, role, ids = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4))
            x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            group = b * n_slots + s
            cuts = [0, *(np.flatnonzero(np.diff(group * 2 + role)) + 1), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo and group[lo] != at:
                    if block is not None:
                        yield block.rows()
                    at, block = group[lo], Block(k)
                if hi > lo:
                    (block.meet if role[lo] else block.add)(ids[lo:hi], x[lo:hi])
        if block is not None:
            yield block.rows()

    found = met.mapInArrow(search, "q long, i long, score long")
    return top_k(found, ["q"], [F.desc("score"), "i"], k)


def search_embeddings(embeddings: DataFrame, every: int, k: int, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): rows whose id is divisible by ``every`` against all rows, entries as floor(scale * x).

    Vectors that are null, or hold null, a number that is not finite or an entry of ``LIMIT``
    or more, and rows without id take no part. Of several rows of one id the one of the
    greatest vector, entry by entry, counts. Other columns, whatever their names, are not read.
    """
    spark = embeddings.sparkSession
    rows = whole(embeddings, id_col, vec_col, scale, 0, LIMIT).where("id IS NOT NULL").groupBy("id").agg(F.max("v").alias("v"))
    rows = Table(rows.select("id", F.col("v").cast("array<int>").alias("v")), "vectors").df
    found = exact_topk(rows.where(F.col("id") % every == 0), rows, k, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return found.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("i").alias("vec_id"), "score")


def op11_segment_topk(spark, sf_dir: str) -> DataFrame:
    return search_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 50, 5)


ORACLE = """WITH v AS (SELECT vec_id, max(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, i.vec_id, CAST(list_dot_product(q.v, i.v) AS BIGINT) AS score FROM v q JOIN v i ON q.vec_id <> i.vec_id WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 5"""
