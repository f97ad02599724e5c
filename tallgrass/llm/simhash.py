"""SimHash near-duplicates through vantage-point trees.

Each text gets a 64-bit fingerprint; distinct fingerprints are linked, whatever
documents they belong to.  A vantage-point tree, fitted to a bounded sample, cuts
the Hamming space: a node sends a fingerprint left if it is at most ``mu`` from
the vantage point.  By the triangle inequality two fingerprints within radius r
that part at a node have distances to its vantage point within r of each other,
so it is enough to send what lies in (mu - r, mu] to the right as well: every
linked pair then meets in some shard, none is lost, and only one side is copied.
The tree deepens with the data, up to 65,536 shards; a shard that is still large is
split again by vantage points in memory.  Shards are searched exactly and return
stars (member, smallest linked member), not pairs.

Defined results: a null or empty text has fingerprint zero and links like any
other; repeated rows share a fingerprint; a row without id bridges like any other, takes
its component's id and never names one (null if no row of the component has an id);
a very long text is read in chunks of shingles; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm import textbatch as tb
from tallgrass.llm.components import connected_components, local_components
from tallgrass.llm.shared import Scratch, Table

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Fingerprints the tree is fitted to (at least, and for each shard), rows aimed at for a shard, and the deepest tree.
SAMPLE, SAMPLE_SHARD, SHARD_ROWS, MAX_DEPTH = 16_384, 8, 4_096, 16
#: Largest block of a shard that is compared all against all.
BLOCK = 512
_CHUNK = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode().lower().split()  # on bytes, both know ASCII only
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    counts, n = np.zeros(64, np.int64), 0
    hashes = map(xxhash.xxh64_intdigest, grams, repeat(seed))
    while len(part := np.fromiter(islice(hashes, _CHUNK), np.uint64)):
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per input row; fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            for part in tb.slices(batch, 1):
                fps = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _split(fps: np.ndarray, vantage: np.uint64) -> tuple[np.ndarray, int]:
    """Distances to the vantage point and a threshold that copies little and cuts near the middle."""
    d = np.bitwise_count(fps ^ vantage).astype(np.int64)
    count = np.bincount(d, minlength=65)
    below = np.cumsum(count)
    n = len(fps)
    cost = np.maximum(below, n - below + count + np.concatenate([[0], count[:-1]]))
    return d, int(np.argmin(cost[:64]))


def fit_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and thresholds of a complete tree, children of i at 2i+1 and 2i+2."""
    size = (1 << depth) - 1
    points, mu = np.zeros(size, np.uint64), np.full(size, 64, np.int64)
    held = {0: sample}
    for i in range(size):
        own = held.pop(i, np.empty(0, np.uint64))
        if len(own) >= 8:
            best = min((_split(own, v) + (v,) for v in own[:4]), key=lambda s: _larger(s[0], s[1]))
            d, cut, points[i] = best
            mu[i] = cut
            held[2 * i + 1], held[2 * i + 2] = own[d <= cut], own[d > cut - RADIUS]
    return points, mu


def _larger(d: np.ndarray, cut: int) -> int:
    return max(int((d <= cut).sum()), int((d > cut - RADIUS).sum()))


def shards(fps: np.ndarray, points: np.ndarray, mu: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) for every shard that a fingerprint has to be seen in."""
    row, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    for _ in range(depth):
        d = np.bitwise_count(fps[row] ^ points[node]).astype(np.int64)
        left, right = d <= mu[node], d > mu[node] - RADIUS
        right &= mu[node] < 64  # a node that was not fitted sends all to the left
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return row, node


def stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect distinct fingerprints exactly as 'within RADIUS' does."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        if len(at) > BLOCK:
            d, cut = _split(fps[at], fps[at[len(at) // 2]])
            left, right = at[d <= cut], at[d > cut - RADIUS]
            if max(len(left), len(right)) <= 0.85 * len(at):
                todo += [left, right]
                continue
            if len(at) > 16 * BLOCK:
                found.append(_probe(fps, at))
                continue
        a, b = [], []
        for lo in range(0, len(at), BLOCK):
            i, j = np.nonzero(np.bitwise_count(fps[at[lo : lo + BLOCK], None] ^ fps[at][None, lo:]) <= RADIUS)
            use = j > i
            a.append(i[use] + lo)
            b.append(j[use] + lo)
        label = local_components(len(at), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(at))
        moved = np.flatnonzero(label != np.arange(len(at)))
        found.append((at[moved], at[label[moved]]))
    return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (np.empty(0, np.int64),) * 2


def _probe(fps: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for a ball too dense to cut: look up every fingerprint within RADIUS, a fixed 2,080 for each."""
    at = at[np.argsort(fps[at])]
    own = fps[at]
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    masks = np.concatenate([bits, [bits[i] | bits[j] for i in range(64) for j in range(i)]])
    label = np.arange(len(at))
    for mask in masks:
        other = own ^ mask
        k = np.minimum(np.searchsorted(own, other), len(own) - 1)
        hit = np.flatnonzero(own[k] == other)
        if len(hit):
            label = np.minimum(label, local_components(len(at), np.concatenate([hit, np.arange(len(at))]), np.concatenate([k[hit], label])))
    moved = np.flatnonzero(label != np.arange(len(at)))
    return at[moved], at[label[moved]]


def link(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the distinct fingerprints in column ``fp`` that link to another; the component is one of them."""
    n = fps.count()
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n) / SHARD_ROWS)))))
    size = max(SAMPLE, SAMPLE_SHARD << depth)
    sample = [r[0] for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(size).collect()] if depth else []
    points, mu = fit_tree(np.array(sample, np.int64).view(np.uint64), depth)

    def deal(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            row, shard = shards(own.view(np.uint64), points, mu, depth)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(own[row])], ["shard", "fp"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(pdf["fp"].to_numpy())
        a, b = stars(own.view(np.uint64))
        return pd.DataFrame({"a": own[a], "b": own[b]})

    dealt = fps.select("fp").mapInArrow(deal, "shard long, fp long")
    return connected_components(dealt.groupBy("shard").applyInPandas(search, "a long, b long"), scratch)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp and component_id, the smallest doc_id reachable over links."""
    marked = Table(fingerprints(docs, id_col, text_col), "fingerprints").df
    with Scratch() as scratch:
        classes = scratch.table(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
        linked = link(classes, scratch)
        own = classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
        least = own.groupBy("component").agg(F.min("first").alias("component_id"))
        named = Table(own.join(least, "component").select("fp", "component_id"), "named").df
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op6_simhash_vptree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
