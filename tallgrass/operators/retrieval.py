"""Candidate sources, their union, and what each contributes.

All rankings have a total order: metric descending, id ascending.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.scalars import recency_weight
from tallgrass.sources.scratch import Scratch, Table

#: Vectors in a block of queries and in a block of items, some 4 MB at 128 floats each; blocks of items that a task reads, and tasks at least, if there are as many pairs of blocks.
QUERY_ROWS, ITEM_ROWS, STRIP_BLOCKS, PAIRS = 8_192, 8_192, 32, 64
#: Width up to which vectors are searched by boxes, items of a box, and as many more narrow vectors as fit a block.
NARROW, BOX, NARROW_BLOCKS = 16, 128, 16
#: Own articles whose neighbours a task sums, some 40 each.
BASKET_ROWS = 20_000


def top_k(df: DataFrame, by: list[str], order, k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def before(tx: DataFrame, as_of, days: int | None = None) -> DataFrame:
    """Rows of the ``days`` days before ``as_of``, which itself is not among them."""
    end = F.lit(as_of).cast("date")
    out = tx.where(F.col("t_dat") < end)
    return out if days is None else out.where(F.col("t_dat") >= F.date_sub(end, days))


def popular(tx: DataFrame, as_of, days: int, n: int) -> DataFrame:
    """The n best-selling articles of the window; no global sort, a top-n per task and one merge."""
    counts = before(tx, as_of, days).groupBy("article_id").agg(F.count("*").alias("n_sold"))
    return counts.orderBy(F.desc("n_sold"), "article_id").limit(n)


def repurchase(tx: DataFrame, as_of, n: int) -> DataFrame:
    """Each customer's own articles, latest first."""
    own = before(tx, as_of).groupBy("customer_id", "article_id").agg(F.max("t_dat").alias("last_day"))
    return top_k(own, ["customer_id"], [F.desc("last_day"), "article_id"], n)


def dominant_category(tx: DataFrame, dim: DataFrame, as_of) -> DataFrame:
    counts = before(tx, as_of).join(dim.select("article_id", "product_type"), "article_id").groupBy("customer_id", "product_type").agg(F.count("*").alias("n"))
    return top_k(counts, ["customer_id"], [F.desc("n"), "product_type"], 1).select("customer_id", "product_type")


def category_popular(tx: DataFrame, dim: DataFrame, as_of, days: int, n: int) -> DataFrame:
    """Best sellers of each customer's dominant category."""
    sold = before(tx, as_of, days).groupBy("article_id").agg(F.count("*").alias("n_sold")).join(dim.select("article_id", "product_type"), "article_id")
    best = top_k(sold, ["product_type"], [F.desc("n_sold"), "article_id"], n)
    return dominant_category(tx, dim, as_of).join(best, "product_type").select("customer_id", "article_id", "product_type", "rank")


def recent_basket(tx: DataFrame, as_of, lookback: int, max_basket: int) -> DataFrame:
    """(customer, article, day) once each, the latest ``max_basket`` per customer."""
    rows = before(tx, as_of, lookback).select("customer_id", "article_id", "t_dat").distinct()
    return top_k(rows, ["customer_id"], [F.desc("t_dat"), "article_id"], max_basket).drop("rank")


def covisit_pairs(tx: DataFrame, as_of, lookback: int = 90, window: int = 7, half_life: float = 30.0, max_basket: int = 50, top: int = 40) -> DataFrame:
    """Articles bought by one customer within ``window`` days, weights halving with age; top neighbours.

    The basket limit is part of the definition and bounds the pairs of any one customer.
    """
    b = recent_basket(tx, as_of, lookback, max_basket)
    a, c = b.select("customer_id", F.col("article_id").alias("a"), F.col("t_dat").alias("da")), b.select("customer_id", F.col("article_id").alias("b"), F.col("t_dat").alias("db"))
    pairs = a.join(c, "customer_id").where((F.col("a") != F.col("b")) & (F.abs(F.datediff("da", "db")) <= window))
    age = F.datediff(F.lit(as_of).cast("date"), F.greatest("da", "db"))
    weights = pairs.groupBy("a", "b").agg(F.round(F.sum(recency_weight(age, half_life)), 6).alias("weight"))
    return top_k(weights, ["a"], [F.desc("weight"), "b"], top)


def covisit_candidates(tx: DataFrame, pairs: DataFrame, as_of, lookback: int = 90, max_basket: int = 50, n: int = 60) -> DataFrame:
    """The neighbours of each customer's own articles by summed weight.

    Scores are summed and ranked where the customer's rows meet, in as many tasks as the baskets
    need: a task has ``BASKET_ROWS`` of them, and their neighbours, whatever the input.
    """
    own = Table(recent_basket(tx, as_of, lookback, max_basket).select("customer_id", F.col("article_id").alias("a")).distinct(), "baskets").df
    tasks = max(1, -(-own.count() // BASKET_ROWS))
    met = own.join(pairs.select("a", F.col("b").alias("article_id"), "weight"), "a").select("customer_id", "article_id", F.col("weight").cast("decimal(18,6)").alias("weight"))
    score = met.repartition(tasks, "customer_id").groupBy("customer_id", "article_id").agg(F.sum("weight").cast("double").alias("score"))
    return top_k(score, ["customer_id"], [F.desc("score"), "article_id"], n)


def _packed(df: DataFrame, blocks: int, names: tuple[str, str, str]) -> DataFrame:
    """(id, v) in so many blocks by id, each as its ids and one flat array."""
    block, ids, flat = names
    each = df.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias(block), F.struct(F.col("id").alias("i"), F.col("v").alias("v")).alias("x"))
    return each.groupBy(block).agg(F.collect_list("x").alias("x")).select(block, F.col("x.i").alias(ids), F.flatten("x.v").alias(flat))


def _halved(x: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows in which every ``leaf`` of them are close: each part is cut in half across its widest side."""
    order, todo = np.arange(len(x)), [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > leaf:
            own = x[order[lo:hi]]
            middle = -(-((hi - lo) // 2) // leaf) * leaf
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, int((own.max(0) - own.min(0)).argmax())], middle - 1)]
            todo += [(lo, lo + middle), (lo + middle, hi)]
    return order


def _by_boxes(batches):
    """Blocks (i, iv) of narrow vectors with their rows in the order of their boxes."""
    for batch in batches:
        for r in range(batch.num_rows):
            ids = batch.column(0)[r].values.to_numpy(zero_copy_only=False)
            v = batch.column(1)[r].values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            order = _halved(v, BOX)
            yield pa.RecordBatch.from_arrays([pa.array([ids[order]], batch.schema.field(0).type), pa.array([v[order].ravel()], batch.schema.field(1).type)], batch.schema.names)


class Nearest:
    """The k best items that a block of queries has met; scores to six places, ties by id.

    A product in single precision finds the items that can reach a query's k-th score, by a margin
    beyond its rounding; only these are multiplied in double precision. Items in the order of
    their boxes are met box by box: one whose corner cannot reach the k-th score of any of 128
    queries, which are close to each other too, is left out.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, boxes: bool = False):
        order = _halved(q, 128) if boxes else slice(None)
        self.ids, self.q, self.k, self.boxes = ids[order], q[order], k, boxes
        self.item, self.score = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), -np.inf)

    def meet(self, ids: np.ndarray, items: np.ndarray) -> None:
        if not len(ids):
            return
        single, error = items.astype(np.float32), (items.shape[1] + 4) * 2.0**-24 * np.sqrt((items.astype(np.float64) ** 2).sum(1).max())
        starts = np.arange(0, len(ids), BOX)
        least, most = (f.reduceat(items, starts).astype(np.float64) for f in (np.minimum, np.maximum)) if self.boxes else (None, None)
        for lo in range(0, len(self.ids), 128):
            q = self.q[lo : lo + 128].astype(np.float64)
            margin = error * np.sqrt((q**2).sum(1)) + 1e-6
            if not self.boxes:
                self._against(lo, margin, ids, items, single)
                continue
            with np.errstate(invalid="ignore"):
                bound = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
            first = np.unique(bound.argmax(1))
            rest = np.setdiff1d(np.argsort(-bound.max(0), kind="stable"), first, assume_unique=True)
            for some in (first, *(rest[k : k + 64] for k in range(0, len(rest), 64))):
                # what is not surely below: before k items are known, every box
                some = some[(~(bound[:, some] < (self.score[lo : lo + 128, -1] - margin)[:, None])).any(0)]
                if len(some):
                    rows = (some[:, None] * BOX + np.arange(BOX)).ravel()
                    rows = rows[rows < len(ids)]
                    self._against(lo, margin, ids[rows], items[rows], single[rows])

    def _against(self, lo: int, margin: np.ndarray, ids: np.ndarray, items: np.ndarray, single: np.ndarray) -> None:
        """128 queries from ``lo`` on against these items."""
        q = self.q[lo : lo + 128]
        rough = q.astype(np.float32) @ single.T
        least = self.score[lo : lo + 128, -1] - margin
        new = np.isneginf(least)
        if new.any() and len(ids) > self.k:
            least[new] = np.partition(rough[new], len(ids) - self.k, axis=1)[:, len(ids) - self.k] - 2 * margin[new]
        # what is not surely below, so that a product beyond single precision counts
        near = np.flatnonzero(~(rough < least.astype(np.float32)[:, None] - np.abs(least.astype(np.float32))[:, None] * np.float32(2.0**-23)))
        for at in range(0, len(near), 1 << 16):
            row, col = np.divmod(near[at : at + (1 << 16)], len(ids))
            exact = np.round(np.einsum("ij,ij->i", q[row].astype(np.float64), items[col].astype(np.float64)), 6) + 0.0
            self._keep(lo + row, ids[col], exact)

    def _keep(self, row: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        own, k = np.unique(row), self.k
        row, item, score = np.concatenate([np.repeat(own, k), row]), np.concatenate([self.item[own].ravel(), item]), np.concatenate([self.score[own].ravel(), score])
        order = np.lexsort((item, -score, row))
        row = row[order]
        best = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
        self.item[own], self.score[own] = item[best].reshape(-1, k), score[best].reshape(-1, k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, score, rank)."""
        row, place = np.nonzero(self.score > -np.inf)
        return self.ids[row], self.item[row, place], self.score[row, place], (place + 1).astype(np.int32)


def vector_topk(queries: DataFrame, items: DataFrame, k: int, qid: str = "q_id", iid: str = "item_id", vec: str = "v") -> DataFrame:
    """Exact inner-product top-k: a task holds one block of queries and reads a strip of the items, block by block, keeping the k best.

    The items' blocks are files that every task reads for itself, so only the queries are
    shuffled, once; a query's results of ``STRIP_BLOCKS`` blocks are k rows. Neither side is
    collected or broadcast, whatever its size. The products are queries times items by definition;
    of vectors of up to ``NARROW`` entries, boxes of items that cannot be among the best are left out.
    """
    with Scratch() as scratch:
        # both sides once: what they are computed from is read once, and their counts are those of the files
        both = [f(df.select(F.col(ident).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("v")), "vectors") for f, df, ident in ((lambda *x: Table(*x).df, queries, qid), (scratch.table, items, iid))]
        one = both[1].select(F.size("v")).first()
        boxes = one is not None and 0 < one[0] <= NARROW
        n = both[0].count()
        sizes = (min(QUERY_ROWS, max(1_024, -(-n // PAIRS))), ITEM_ROWS * NARROW_BLOCKS) if boxes else (QUERY_ROWS, ITEM_ROWS)
        n_blocks, n_items = (max(1, -(-count // rows)) for count, rows in zip((n, both[1].count()), sizes))
        packed = _packed(both[1], n_items, ("ib", "i", "iv")).select("i", "iv").repartition(n_items)
        blocks = Table(packed.mapInArrow(_by_boxes, packed.schema) if boxes else packed, "item-blocks").df
    strips = min(n_items, max(-(-n_items // STRIP_BLOCKS), -(-PAIRS // n_blocks)))
    q = _packed(both[0], n_blocks, ("qb", "q", "qv")).repartition(n_blocks)
    met = blocks.coalesce(strips).crossJoin(q.hint("shuffle_replicate_nl")).select("qb", "q", "qv", "i", "iv")

    def score(batches):
        flat = lambda batch, c, r: batch.column(c)[r].values.to_numpy(zero_copy_only=False)
        own: dict[int, Nearest] = {}
        for batch in batches:
            for r, qb in enumerate(batch.column(0).to_pylist()):
                if qb not in own:
                    ids = flat(batch, 1, r).copy()
                    own[qb] = Nearest(ids, flat(batch, 2, r).reshape(len(ids), -1).copy(), k, boxes)
                ids = flat(batch, 3, r)
                own[qb].meet(ids, flat(batch, 4, r).reshape(len(ids), -1))
        for found in own.values():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.rows()], ["q", "i", "score", "rank"])

    found = met.mapInArrow(score, "q long, i long, score double, rank int")
    if strips > 1:
        found = top_k(found.drop("rank"), ["q"], [F.desc("score"), "i"], k)
    return found.select(F.col("q").alias(qid), F.col("i").alias(iid), "score", "rank")


def shared_topk(queries: DataFrame, items: DataFrame, k: int, qid: str = "q_id", iid: str = "item_id", vec: str = "v") -> DataFrame:
    """``vector_topk`` where many queries have the same vector: each different one is searched once, for all of its queries."""
    v = F.col(vec).cast("array<float>")
    asked = Table(queries.select(F.col(qid).cast("long").alias(qid), v.alias("v"), F.xxhash64(v).alias("h")), "queries").df
    named = Table(asked.groupBy("h", "v").agg(F.min(qid).alias("name")), "different-queries").df
    found = vector_topk(named.select(F.col("name").alias("q_id"), "v"), items.select(F.col(iid).alias("item_id"), F.col(vec).alias("v")), k)
    owners = asked.alias("x").join(named.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.v") == F.col("y.v"))).select(qid, "name")
    return owners.join(found.withColumnRenamed("q_id", "name"), "name").select(qid, F.col("item_id").alias(iid), "score", "rank")


def mean_vector(tx: DataFrame, vectors: DataFrame, as_of, n: int = 10) -> DataFrame:
    """Customer vector: mean of the latest n articles' vectors before ``as_of``, as (customer, pos, x)."""
    recent = repurchase(tx, as_of, n).select("customer_id", "article_id")
    parts = recent.join(vectors, "article_id").select("customer_id", F.posexplode("v").alias("pos", "x"))
    return parts.groupBy("customer_id", "pos").agg((F.round(F.avg(F.col("x").cast("double")), 6) + F.lit(0.0)).alias("x"))


def customer_vectors(tx: DataFrame, vectors: DataFrame, as_of, n: int = 10) -> DataFrame:
    """(customer_id, v): the same means as one array a customer, summed by one aggregate without exploding them."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    recent = repurchase(tx, as_of, n).select("customer_id", "article_id").join(vectors, "article_id")
    mean = Summarizer.mean(array_to_vector(F.col("v").cast("array<double>")))
    return recent.groupBy("customer_id").agg(mean.alias("m")).select("customer_id", F.transform(vector_to_array("m"), lambda x: F.round(x, 6)).alias("v"))


def popular_for(tx: DataFrame, as_of, days: int, n: int) -> DataFrame:
    """The best sellers for every customer with a history: at most ``n`` rows are sent to all tasks."""
    best = popular(tx, as_of, days, n).select("article_id")
    return before(tx, as_of).select("customer_id").distinct().crossJoin(F.broadcast(best))


def baseline_union(tx: DataFrame, as_of, days: int, n_popular: int, n_own: int) -> DataFrame:
    """(customer, article) of best sellers and own articles, each pair once."""
    return popular_for(tx, as_of, days, n_popular).unionByName(repurchase(tx, as_of, n_own).select("customer_id", "article_id")).distinct()


def candidate_size(cands: DataFrame, row_bytes: int) -> DataFrame:
    """Candidates, customers, candidates a customer, and the bytes of a table with a row for each."""
    n = F.count("*")
    return cands.agg(n.alias("n"), F.countDistinct("customer_id").alias("n_customers"), F.round(n / F.countDistinct("customer_id"), 6).alias("per_customer"), (n * F.lit(row_bytes)).alias("n_bytes"))


def union_candidates(**sources: DataFrame) -> DataFrame:
    """(customer, article, sources): every candidate once with its sorted source names; a bit for each source until then."""
    out, bits = None, {name: 1 << i for i, name in enumerate(sorted(sources))}
    for name, bit in bits.items():
        part = sources[name].select("customer_id", "article_id", F.lit(bit).cast("long").alias("bits"))
        out = part if out is None else out.unionByName(part)
    once = out.groupBy("customer_id", "article_id").agg(F.bit_or("bits").alias("bits"))
    names = F.array(*(F.when(F.col("bits").bitwiseAND(F.lit(bit).cast("long")) != 0, F.lit(name)) for name, bit in bits.items()))
    return once.select("customer_id", "article_id", F.array_compact(names).alias("sources"))


def truth_pairs(tx: DataFrame, start, end) -> DataFrame:
    return tx.where(F.col("t_dat").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("customer_id", "article_id").distinct()


def recall_at_k(cands: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Pooled over the cohort: true pairs among the first k candidates, over all true pairs."""
    hit = truth.join(cands.where(F.col("rank") <= k).select("customer_id", "article_id", F.lit(1).alias("hit")), ["customer_id", "article_id"], "left")
    return hit.agg(F.count("hit").alias("hits"), F.count("*").alias("n_true"), F.round(F.count("hit") / F.count("*"), 8).alias("recall"))


def recall_ceiling(cands: DataFrame, truth: DataFrame) -> DataFrame:
    return recall_at_k(cands.withColumn("rank", F.lit(0)), truth, 1)


def source_contributions(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """Per source: candidates, candidates of it alone, hits, hits of it alone, marginal hits per slot of its own."""
    hit = cands.join(truth.withColumn("hit", F.lit(1)), ["customer_id", "article_id"], "left")
    each = hit.select("sources", F.coalesce("hit", F.lit(0)).alias("hit"), F.explode("sources").alias("source"))
    alone = F.size("sources") == 1
    return each.groupBy("source").agg(
        F.count("*").alias("n_cands"), F.sum(alone.cast("long")).alias("n_alone"), F.sum("hit").cast("long").alias("solo_hits"),
        F.sum(F.when(alone, F.col("hit")).otherwise(0)).cast("long").alias("marginal_hits"),
        F.round(F.sum(F.when(alone, F.col("hit")).otherwise(0)) / F.nullif(F.sum(alone.cast("long")), F.lit(0)), 8).alias("per_slot"),
    )


def keep_sources(contributions: DataFrame, weakest: str) -> DataFrame:
    """Sources whose marginal hits per slot reach those of the named heuristic; the contributions, a row for each source, are written once."""
    contributions = Table(contributions, "contributions").df
    bar = contributions.where(F.col("source") == weakest).select(F.col("per_slot").alias("bar"))
    return contributions.join(F.broadcast(bar)).where(F.col("per_slot") >= F.col("bar")).select("source", "per_slot")
