"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of letters and digits.  A fixed mask hashes the token
positions it names and passes over the others, so a seed still hits when a passed
token was replaced.  A leak is a window of ``WINDOW`` tokens (all of them for a shorter
item) laid side by side with at least ``SIMILARITY`` equal tokens; items shorter than
``EXACT_BELOW`` have to match whole.  The masks were chosen by enumeration: whichever
tokens of an admitted window were replaced, some mask reads only equal ones, so no
admitted overlap goes without a seed.

Seeds of the benchmark set the bits of a filter of some ``BITS_A_SEED`` bits a seed, at
most ``1 << MAX_FILTER_BITS`` bits (16 MB), which alone is sent to all tasks; seeds of the
corpus that pass it are joined with the benchmark's on their hashes.  A larger benchmark
only makes more seeds pass.  Hits say where a stretch of a document and an item may lie
side by side; the tokens of both are fetched once for each pair, not for each hit.

Defined results: null or empty texts and items hold no token and match nothing; several
texts of one item id are all looked for, and the best overlap is reported under that id;
a null item id is an id of its own; repeated rows give their leak once per (doc_id,
item_id); a null doc_id is reported as null; of equally good overlaps the first in the
document counts, then the longer window; very long texts are cut into stretches, so
memory does not grow with their hits; empty tables give an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm import textbatch as tb
from tallgrass.llm.shared import Scratch, Table

WINDOW, SIMILARITY, EXACT_BELOW = 12, 0.8, 8
#: Token positions that each mask reads: for items of a window and more, and for shorter ones.
MASKS = ((0, 1, 2, 6, 8, 9), (0, 1, 3, 5, 6, 7), (0, 2, 3, 4, 9, 10))
SHORT_MASKS = ((0, 1, 2, 4, 7), (0, 1, 3, 4, 5), (0, 3, 4, 5, 6))
#: Tokens kept on either side of a hit, all that a window around it can reach, and of a stretch.
REACH, STRETCH = WINDOW, 512
BITS_A_SEED, MAX_FILTER_BITS = 256, 27

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each token; letters of ASCII and Latin-1 are lower-cased."""
    low = _LOWER[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[1:] != 0x97)) + 1
    low[latin] += 0x20
    starts, ends = tb.runs(_TOKEN[data], offsets)
    return tb.SpanHash(low)(starts, ends), tb.owner(starts, offsets)


def needed(size: int) -> int:
    """Equal tokens that make a window of so many tokens a leak."""
    return size if size < EXACT_BELOW else int(np.ceil(SIMILARITY * size - 1e-9))


def _hash(hashes: np.ndarray, starts: np.ndarray, mask, salt: int) -> np.ndarray:
    h = np.full(len(starts), salt, np.uint64)
    for p in mask:
        h = (h + hashes[starts + p]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return tb.mix(h)


def seeds(hashes: np.ndarray, text: np.ndarray, masks, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, seed) of every place of every mask that lies within one text."""
    at, out = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for k, mask in enumerate(masks):
        n = max(0, len(hashes) - mask[-1])
        own = np.flatnonzero(text[:n] == text[mask[-1] : mask[-1] + n])
        at.append(own)
        out.append(_hash(hashes, own, mask, salt + k))
    return np.concatenate(at), np.concatenate(out)


def _families(shorts: list[int]):
    """(masks, salt) of the ordinary items, and of the lengths below a window that occur."""
    yield MASKS, 1
    if any(EXACT_BELOW <= n < WINDOW for n in shorts):
        yield SHORT_MASKS, 101
    for n in shorts:
        if n < EXACT_BELOW:
            yield (tuple(range(n)),), 1000 + n


def _frame(part: pa.RecordBatch, column: int):
    data, offsets = tb.flatten(part.column(column))
    hashes, text = tokens(data, offsets)
    first = np.searchsorted(text, np.arange(len(offsets) - 1))
    size = np.bincount(text, minlength=len(offsets) - 1)
    return hashes, text, first, size


def _digest(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the tokens in each of the ranges."""
    return np.array([np.add.reduce(tb.mix(hashes[a:b] + np.arange(b - a, dtype=np.uint64))) for a, b in zip(lo, hi)], np.uint64)


def _ids(column: pa.Array) -> np.ndarray:
    """A hash of each id; no id is one of its own, beside every number."""
    number = pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return tb.mix(tb.mix(number) + column.is_null().to_numpy(zero_copy_only=False).astype(np.uint64))


def benchmark_seeds(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(seed, item, at) for each seed of each item text, and (item, item_id, length, tokens) with at = -1 for the text itself.

    ``item`` is a hash of id and tokens: two texts of one id are two items.
    """

    def run(batches):
        for batch in batches:
            for part in tb.slices(batch, 1):
                hashes, text, first, size = _frame(part, 1)
                at, seed = [], []
                for masks, salt in _families(sorted(set(size[(size > 0) & (size < WINDOW)].tolist()))):
                    a, s = seeds(hashes, text, masks, salt)
                    own = size[text[a]]
                    right = own >= WINDOW if salt == 1 else (own == salt - 1000 if salt >= 1000 else (own >= EXACT_BELOW) & (own < WINDOW))
                    at.append(a[right])
                    seed.append(s[right])
                at, seed = np.concatenate(at), np.concatenate(seed)
                owner, items = text[at], np.flatnonzero(size > 0)
                name = tb.mix(_ids(part.column(0)) ^ _digest(hashes, first, first + size)).view(np.int64)
                n, m = len(at), len(items)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([seed.view(np.int64), np.zeros(m, np.int64)])),
                    pa.array(np.concatenate([name[owner], name[items]])),
                    pa.array(np.concatenate([at - first[owner], np.full(m, -1)]).astype(np.int32)),
                    part.column(0).take(pa.array(np.concatenate([owner, items]))),
                    pa.array(np.concatenate([size[owner], size[items]]).astype(np.int32)),
                    pa.array([None] * n + [hashes[first[k] : first[k] + size[k]].astype(np.uint32).tobytes() for k in items], pa.binary()),
                ], ["seed", "item", "at", "item_id", "length", "tokens"])

    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "seed long, item long, at int, item_id long, length int, tokens binary")


def seed_filter(own: DataFrame) -> tuple[np.ndarray, int]:
    """(bits, number of low bits of a seed that name one), built by the executors in pieces of 4 KB."""
    size = min(MAX_FILTER_BITS, max(16, (BITS_A_SEED * own.count()).bit_length()))
    bit = F.col("seed").bitwiseAND(F.lit((1 << size) - 1)) + 1
    pieces = own.groupBy(F.bitmap_bucket_number(bit).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(1 << (size - 3), np.uint8)
    for piece, bits in pieces.collect():
        out[(piece - 1) * 4096 : (piece - 1) * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)
    return out, size


def candidate_hits(docs: DataFrame, bits: np.ndarray, size_bits: int, shorts: list[int], id_col: str, text_col: str) -> DataFrame:
    """Seeds that pass the filter (tokens null, at their place in the document) and the stretches around them (at their begin).

    A stretch is named by a hash of its document, place and tokens, so that a task
    run again names it the same.
    """
    low = np.uint64((1 << size_bits) - 1)

    def run(batches):
        for batch in batches:
            for part in tb.slices(batch, 2):
                hashes, text, first, size = _frame(part, 2)
                found = [seeds(hashes, text, masks, salt) for masks, salt in _families(shorts)]
                at, seed = (np.concatenate(x) for x in zip(*found))
                bit = (seed & low).astype(np.int64)
                hit = np.flatnonzero((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                if not len(hit):
                    continue
                hit = hit[np.argsort(at[hit], kind="stable")]
                at, seed = at[hit], seed[hit]
                owner = text[at]
                new = np.ones(len(at), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (np.diff(at) > 2 * REACH)
                far = (at - at[new][np.cumsum(new) - 1]) // STRETCH
                new[1:] |= far[1:] != far[:-1]
                group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
                tails = np.append(heads[1:], len(at)) - 1
                begin = first[owner[heads]]
                lo = np.maximum(at[heads] - REACH, begin)
                hi = np.minimum(at[tails] + REACH, begin + size[owner[heads]])
                mine = pa.array(owner[heads])
                ids, versions = part.column(0).take(mine), part.column(1).take(mine)
                name = tb.mix(tb.mix(_ids(ids) + np.uint64(7)) ^ _digest(hashes, lo, hi) ^ tb.mix((lo - begin).astype(np.uint64)) ^ tb.mix(_ids(versions))).view(np.int64)
                n, m = len(at), len(heads)
                nulls = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([seed.view(np.int64), np.zeros(m, np.int64)])),
                    pa.array(np.concatenate([name[group], name])),
                    pa.array(np.concatenate([at - begin[group], lo - begin]).astype(np.int32)),
                    pa.concat_arrays([nulls, ids]),
                    pa.concat_arrays([nulls, versions]),
                    pa.array([None] * n + [hashes[a:b].astype(np.uint32).tobytes() for a, b in zip(lo, hi)], pa.binary()),
                ], ["seed", "stretch", "at", "doc_id", "version", "tokens"])

    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    return rows.mapInArrow(run, "seed long, stretch long, at int, doc_id long, version long, tokens binary")


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(equal tokens, window length, place in doc) of the best window with item[i] beside doc[i + shift]."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    size = min(WINDOW, len(item))
    if hi - lo < size:
        return 0, size, 0
    equal = np.concatenate([[0], np.cumsum(doc[lo + shift : hi + shift] == item[lo:hi])])
    sums = equal[size:] - equal[:-size]
    k = int(sums.argmax())
    return int(sums[k]), size, lo + shift + k


def _verify(batches):
    for batch in batches:
        out = []
        for doc_id, version, item_id, start, text, item, shifts in zip(*(batch.column(k).to_pylist() for k in range(7))):
            doc, tokens_ = np.frombuffer(text, np.uint32), np.frombuffer(item, np.uint32)
            found = [best_overlap(doc, tokens_, shift - start) for shift in shifts]
            equal, size, at = max(found, key=lambda x: (x[0], -x[2]))
            if equal >= needed(size):
                out.append((doc_id, version, item_id, start + at, equal, size))
        cols = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "version", "item_id", "token_at", "n_equal", "n_window"])


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(doc_id, version, item_id, token_at, n_equal, n_window) of the best overlap of each stretch and item, written."""
    with Scratch() as scratch:
        bench = scratch.table(benchmark_seeds(benchmark, item_col, item_text_col), "benchmark")
        own = bench.where("at >= 0").select("seed", "item", F.col("at").alias("item_at")).distinct()
        items = bench.where("at < 0").select("item", "item_id", F.col("tokens").alias("item_tokens")).dropDuplicates(["item"])
        bits, size = seed_filter(own)
        shorts = sorted(r[0] for r in bench.where(F.col("length") < WINDOW).select("length").distinct().collect())
        found = scratch.table(candidate_hits(docs, bits, size, shorts, id_col, text_col), "hits")
        hits = found.where("tokens IS NULL").select("seed", "stretch", "at").join(own, "seed")
        beside = hits.groupBy("stretch", "item").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts"))
        stretches = found.where("tokens IS NOT NULL").select("stretch", "doc_id", "version", F.col("at").alias("start"), "tokens").dropDuplicates(["stretch"])
        pairs = beside.join(stretches, "stretch").join(items, "item")
        schema = "doc_id long, version long, item_id long, token_at long, n_equal long, n_window long"
        return Table(pairs.select("doc_id", "version", "item_id", "start", "tokens", "item_tokens", "shifts").mapInArrow(_verify, schema), "overlaps").df


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, token_at, n_equal, n_window): the best verified overlap of each leaking document and item."""
    best = F.max(F.struct("n_equal", (-F.col("token_at")).alias("before"), "n_window")).alias("best")
    found = _overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", (-F.col("best.before")).alias("token_at"), F.col("best.n_equal").alias("n_equal"), F.col("best.n_window").alias("n_window"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak, columns unchanged; a row is judged by its own text, with or without an id."""
    leaking = _overlaps(docs, benchmark, id_col, text_col, "item_id", "text").select("doc_id", "version").distinct()
    same_id = docs[f"`{id_col}`"].cast("long").eqNullSafe(leaking["doc_id"])
    return docs.join(leaking, same_id & (F.xxhash64(docs[f"`{text_col}`"].cast("string")) == leaking["version"]), "left_anti")


def op1_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    return find_leaks(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


#: All alignments with a token in common; Latin-1 letters are lower-cased as by the operator.
ORACLE = r"""
WITH lc AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ' AS up, 'abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ' AS low),
dt AS (SELECT doc_id, regexp_extract_all(translate(text, up, low), '[0-9a-zA-Z\x{80}-\x{10FFFF}]+') AS ts FROM documents, lc),
bt AS (SELECT item_id, regexp_extract_all(translate(text, up, low), '[0-9a-zA-Z\x{80}-\x{10FFFF}]+') AS ts FROM benchmark, lc),
it AS (SELECT item_id, len(ts) AS n, least(12, len(ts)) AS w, unnest(ts) AS tok, unnest(range(0, len(ts))) AS j FROM bt),
dc AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS tok, unnest(range(0, len(ts))) AS i FROM dt),
hit AS (SELECT doc_id, item_id, i - j AS shift, j, w, it.n AS ni, dc.n AS nd FROM dc JOIN it USING (tok)),
near AS (SELECT DISTINCT doc_id, item_id, shift, w, ni, nd, need FROM (SELECT *, CASE WHEN w < 8 THEN w ELSE ceil(0.8 * w - 1e-9) END AS need, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS c FROM hit) WHERE c >= need),
win AS (SELECT *, unnest(range(greatest(0, -shift), least(ni, nd - shift) - w + 1)) AS s FROM near),
cnt AS (SELECT win.doc_id, win.item_id, win.shift, win.w, win.need, s, count(*) AS c FROM win JOIN hit h ON h.doc_id = win.doc_id AND h.item_id = win.item_id AND h.shift = win.shift AND h.j BETWEEN s AND s + win.w - 1 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY c DESC, s + shift) AS k FROM cnt WHERE c >= need)
SELECT doc_id, item_id, CAST(s + shift AS BIGINT) AS token_at, CAST(c AS BIGINT) AS n_equal, CAST(w AS BIGINT) AS n_window FROM best WHERE k = 1
"""
