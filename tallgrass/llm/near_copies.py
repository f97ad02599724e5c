"""Near copies by the Jaccard similarity of word shingles: fingerprints propose, exact sets decide.

A text is the set of its ``SHINGLE``-word shingles, words split at ASCII white space and
lower-cased as for the fingerprints.  Texts of equal sets are one class.  Candidates come
from two searches:

1. the vantage-point search over 64-bit SimHash fingerprints of the sets, exact within
   ``simhash.RADIUS`` bits;
2. for what lies beyond that radius, ``BANDS`` buckets by ``ROWS`` minima each: a pair of
   similarity 0.8 shares none with probability 0.0007, a pair of 0.3 shares one with
   probability 0.003.  A radius cannot do this alone: at similarity 0.8 fingerprints
   differ in some ten bits, up to sixteen or more, and a tree that has to copy so wide
   a ring cuts nothing.

What is proposed together, directly or over others, is a candidate group.  In it the
sets themselves are compared, and two classes link if their similarity is at least
``SIMILARITY``; groups are the connected components.  A candidate group of more than
``GROUP_BYTES`` of text is not gathered in one task: all its members are held against
one pivot, in parallel.  Those near it are linked.  As Jaccard distance is a metric,
only what lies within ``1 - SIMILARITY`` of the nearest member that is not near can link
to one, so the rest of the near ones is done, and the others go on to the next round.
What is left of a group after ``PIVOT_ROUNDS`` rounds is decided bucket by bucket, as only
members of one bucket were proposed to each other, with pivots again for a large bucket.

Defined results: null and blank texts are one class; a text of fewer than ``SHINGLE``
words is one shingle; rows without id are judged by their text and give way to rows
with one; of several rows of one id and text the one of smallest hash over its columns
stays, so the order of rows does not matter; very long texts are compared whole; an
empty table gives an empty result; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tallgrass.llm import simhash
from tallgrass.llm import textbatch as tb
from tallgrass.llm.components import connected_components
from tallgrass.llm.shared import Scratch, Table

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 8
#: Text of a candidate group up to which one task decides it, rounds of pivots for larger ones, and parts a pivot is sent to.
GROUP_BYTES, PIVOT_ROUNDS, PARTS = 8 << 20, 12, 64
_NO_ID = (1 << 63) - 1
_FACTORS = np.random.default_rng(42).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ends): the sorted distinct shingle hashes of each text, one after the other."""
    n = len(offsets) - 1
    starts, ends = tb.words(data, offsets)
    text = tb.owner(starts, offsets)
    words = tb.SpanHash(_LOWER[data])(starts, ends)
    grams = tb.windows(words, SHINGLE)
    inside = text[: len(grams)] == text[len(text) - len(grams) :]
    size = np.bincount(text, minlength=n)
    first = np.searchsorted(text, np.arange(n))
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    rest = np.array([tb.windows(words[first[k] : first[k] + size[k]], int(size[k]))[0] for k in short], np.uint64)
    values, owner = np.concatenate([grams[inside], rest]), np.concatenate([text[: len(grams)][inside], short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.cumsum(np.bincount(owner[new], minlength=n))


def band_keys(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(text, band) bucket of each set; sets must not be empty."""
    starts = np.concatenate([[0], ends[:-1]])
    out = np.empty((len(ends), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(ends), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = tb.mix(key ^ np.minimum.reduceat(values * _FACTORS[k], starts))
        out[:, band] = key
    return out


def set_fingerprints(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each set: a bit is set if it is in over half of the set's hashes; sets must not be empty."""
    size = np.diff(ends, prepend=0)
    out = np.empty(len(ends), np.uint64)
    step = 1 << 16
    lo = 0
    while lo < len(ends):  # sets of some 65,536 shingles at once, or one larger one
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + step, "right")))
        own = values[ends[lo] - size[lo] : ends[hi - 1]]
        starts = ends[lo:hi] - size[lo:hi] - (ends[lo] - size[lo])
        bits = np.unpackbits(tb.mix(own).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[lo:hi] = np.packbits(2 * count > size[lo:hi, None], axis=1, bitorder="little").view("<u8")[:, 0]
        lo = hi
    return out


def _key(df: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """(doc, version): the id, the largest long where there is none, and a hash of the text."""
    return F.coalesce(df[f"`{id_col}`"].cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(df[f"`{text_col}`"].cast("string")).alias("version")


def _marked(keyed: DataFrame) -> DataFrame:
    """(doc, version, class, fp, bands) of each row; an empty set has fingerprint 0 and no bands."""

    def run(batches):
        for batch in batches:
            for part in tb.slices(batch, 2):
                values, ends = shingle_sets(*tb.flatten(part.column(2)))
                size = np.diff(ends, prepend=0)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(values), dtype=np.uint64)])
                name = tb.mix((total[ends] - total[ends - size]) ^ tb.mix(size.astype(np.uint64))).view(np.int64)
                full = size > 0
                fps = np.zeros(len(ends), np.uint64)
                if full.any():
                    fps[full] = set_fingerprints(values, ends[full])
                keys = band_keys(values, ends[full]) if full.any() else np.empty((0, BANDS), np.uint64)
                at = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(name), pa.array(fps.view(np.int64)), bands], ["doc", "version", "class", "fp", "bands"])

    return keyed.mapInArrow(run, "doc long, version long, class long, fp long, bands array<long>")


def linked(values: np.ndarray, ends: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the first set of its component under 'similarity at least'.

    A set, once reached, is held against those not reached yet, so a tight group
    takes a few passes over its sets and never one for each pair.
    """
    size = np.diff(ends, prepend=0)
    codes = np.unique(values, return_inverse=True)[1]
    sets = np.split(codes, ends[:-1])
    label, mark = np.arange(len(ends)), np.zeros(len(values) + 1, bool)
    left, held, edge = np.arange(len(ends)), codes, np.concatenate([[0], ends])
    while len(left):
        root, todo = left[0], [left[0]]
        first = True
        while todo and len(left):
            at = todo.pop()
            mark[sets[at]] = True
            total = np.concatenate([[0], np.cumsum(mark[held])])
            mark[sets[at]] = False
            both = total[edge[1:]] - total[edge[:-1]]
            near = both >= similarity * (size[at] + size[left] - both) - 1e-9
            if first:
                near[0], first = True, False
            if near.any():
                label[left[near]] = root
                todo += [x for x in left[near].tolist() if x != at]
                held, left = held[np.repeat(~near, np.diff(edge))], left[~near]
                edge = np.concatenate([[0], np.cumsum(size[left])])
    return label


def _stars(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("class")
    own = pdf["class"].to_numpy()
    data, offsets = tb.flatten(pa.array(pdf["text"], pa.string()))
    group = own[linked(*shingle_sets(data, offsets))]
    return pd.DataFrame({"a": own, "b": group})[own != group]


def _against_pivot(batches):
    """(component, class, pivot, similarity, reached) of rows with their own and their pivot's text."""
    sets: dict[int, np.ndarray] = {}
    for batch in batches:
        for part in tb.slices(batch, 3):
            component, own, reached, _, pivot = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 1, 4))
            values, ends = shingle_sets(*tb.flatten(part.column(3)))
            out = np.empty(len(own))
            for k, p in enumerate(pivot.tolist()):
                if p not in sets:
                    sets.clear()
                    sets[p] = shingle_sets(*tb.flatten(part.column(5).slice(k, 1)))[0]
                mine = values[ends[k - 1] if k else 0 : ends[k]]
                both = np.searchsorted(sets[p], mine)
                both = int((sets[p][np.minimum(both, len(sets[p]) - 1)] == mine).sum()) if len(sets[p]) else 0
                out[k] = both / max(1, len(mine) + len(sets[p]) - both)
            yield pa.RecordBatch.from_arrays([pa.array(component), pa.array(own), pa.array(pivot), pa.array(out), pa.array(reached)], ["component", "class", "pivot", "similarity", "reached"])


def _rounds(left: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None, int]:
    """Links (a, b) within each component of (component, class, text, reached), the rows that are undecided after all rounds, and the rounds."""
    found = None
    for turn in range(PIVOT_ROUNDS + 1):
        large = left.groupBy("component").agg(F.sum(F.octet_length("text")).alias("bytes")).where(F.col("bytes") > GROUP_BYTES).select("component")
        done = large.limit(1).isEmpty()
        small = left if done else left.join(large := scratch.table(large, "large"), "component", "left_anti")
        small = scratch.table(small.select("component", "class", "text").groupBy("component").applyInPandas(_stars, "a long, b long"), "stars")
        found = small if found is None else found.unionByName(small)
        if done:
            return found, None, turn
        rows = left.join(large, "component", "left_semi").withColumn("part", F.pmod(F.xxhash64("class"), F.lit(PARTS)))
        if turn == PIVOT_ROUNDS:
            return found, rows.drop("part", "reached"), turn
        pivot = rows.groupBy("component").agg(F.min(F.struct("reached", "class")).alias("first")).select("component", F.col("first.class").alias("class"))
        pivot = rows.join(pivot, ["component", "class"]).select("component", F.col("class").alias("pivot"), F.col("text").alias("pivot_text"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
        pairs = rows.join(pivot, ["component", "part"]).select("component", "class", "reached", "text", "pivot", "pivot_text")
        held = scratch.table(pairs.mapInArrow(_against_pivot, "component long, class long, pivot long, similarity double, reached boolean"), "against-pivot")
        near = F.col("similarity") >= SIMILARITY - 1e-9
        found = found.unionByName(held.where(near & (F.col("class") != F.col("pivot"))).select(F.col("class").alias("a"), F.col("pivot").alias("b")))
        nearest = held.where(~near & ~F.col("reached")).groupBy("component").agg(F.max("similarity").alias("most"))
        going = held.join(nearest, "component").where((F.col("class") != F.col("pivot")) & (~near | (F.col("similarity") <= F.col("most") + 1 - SIMILARITY + 1e-9)))
        going = going.select("component", "class", (near | F.col("reached")).alias("reached"))
        left = scratch.table(rows.drop("reached", "part").join(going, ["component", "class"]), "candidates")
    raise AssertionError("the last round leaves nothing")


def exact_links(texts: DataFrame, scratch: Scratch, buckets: DataFrame | None = None) -> DataFrame:
    """(node, component) of the classes that link to another by 'similarity at least', within each component of (component, class, text).

    What the rounds leave of a component is decided bucket by bucket of (bucket, class), as only
    classes that share one were proposed; so a component that chance has joined from many
    buckets is never gathered in one task.
    """
    found, rest, turns = _rounds(scratch.table(texts.withColumn("reached", F.lit(False)), "candidates"), scratch)
    if rest is None and not turns:  # without pivots each class points at the first of its group already
        return found.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if rest is not None and buckets is not None:
        dealt = rest.drop("component").join(buckets.select(F.col("bucket").alias("component"), "class").distinct(), "class")
        several = dealt.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        more, rest, _ = _rounds(scratch.table(dealt.join(several, "component").withColumn("reached", F.lit(False)), "candidates"), scratch)
        found = found.unionByName(more)
    if rest is not None:
        found = found.unionByName(scratch.table(rest.groupBy("component").applyInPandas(_stars, "a long, b long"), "stars"))
    return connected_components(found, scratch)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc, version (hash of the text) and group; doc is the largest long where there is no id."""
    keyed = docs.select(*_key(docs, id_col, text_col), docs[f"`{text_col}`"].cast("string").alias("text"))
    with Scratch() as scratch:
        marked = scratch.table(_marked(keyed), "shingles")
        classes = scratch.table(marked.groupBy("class").agg(F.min(F.struct("doc", "version")).alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "classes")
        close = simhash.link(classes.select("fp").distinct(), scratch)
        own = classes.join(close, classes["fp"] == close["node"], "left").select("class", F.coalesce("component", "fp").alias("bucket"))
        own = own.unionByName(classes.select("class", F.explode("bands").alias("bucket")))
        shared = own.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("bucket", "low")
        candidates = connected_components(own.join(shared, "bucket").select(F.col("class").alias("a"), F.col("low").alias("b")), scratch)
        wanted = candidates.join(classes, F.col("node") == F.col("class")).select("class", "component", "first.doc", "first.version")
        texts = keyed.join(wanted, ["doc", "version"]).select("component", "class", "text").dropDuplicates(["class"])
        groups = exact_links(texts, scratch, own)
        named = marked.join(groups, marked["class"] == groups["node"], "left")
        return Table(named.select("doc", "version", F.coalesce("component", "class").alias("group")), "groups").df


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near copies, the one of smallest id, columns unchanged."""
    first = near_groups(docs, id_col, text_col).groupBy("group").agg(F.min(F.struct("doc", "version")).alias("first"))
    first = first.select("first.doc", "first.version").distinct()
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns))
    order = F.xxhash64(*(docs[f"`{f.name}`"] for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))))
    own = docs.select(row.alias("row"), order.alias("order"), *_key(docs, id_col, text_col)).join(first, ["doc", "version"])
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("doc", "version").orderBy("order")))
    return ranked.where("rank = 1").select("row.*")
