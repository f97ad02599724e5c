"""Exact substring deduplication by bucket-pointer refinement.

A byte is removed if a 100-byte string that covers it also starts earlier (smaller
doc_id, or the same document and an earlier start).  Suffixes are never sorted over
the whole corpus; they are bucketed and only what shares a bucket is refined.

1. Initial buckets.  Every 100-byte string is put into the bucket of the smallest
   hash among its 24-byte grams.  Consecutive strings with the same smallest gram
   form one row: (bucket, hash of all bytes that the row's strings cover, place).
   There is about one row for 39 bytes, and equal strings always share a bucket.
2. Rows of a bucket with equal covered bytes: all but the first are repeats through
   and through.  A bucket whose rows are all equal needs no more.  Rows of some
   10 MB of text are combined before the shuffle: only their first meets its bucket,
   the others are known as repeats and are dealt out evenly.
3. The other first rows get their bytes from their documents and are refined, bucket
   by bucket: suffixes start in buckets of 4-byte grams, and a bucket is sorted on
   the bucket pointers of the suffixes 4, 8, 16, 32 and 36 bytes on, each pass
   reusing the pointers that the one before has updated.  Suffixes alone in a bucket
   drop out.  What still shares a bucket at depth 100 is a repeat but for the first.

A bucket with very many different rows is dealt out by the hash of each of its
100-byte strings instead, so no task holds it whole.  Documents meet their repeats
in one join; both uses of the texts share its exchange.

Rows of one doc_id, or without one, are told apart by a hash of their texts, and equal
ones are handled once: the copies lose everything that 100-byte strings cover.  No task
gathers the rows of an id.

Defined results: a null text counts as empty; a text below 100 bytes loses nothing;
a null doc_id counts as smaller than any other; rows of one doc_id count in the
order of the hashes of their texts, equal ones one after the other; a very long text is
bucketed in overlapping pieces and cut whole; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm import textbatch as tb
from tallgrass.llm.shared import Table

LENGTH, GRAM = 100, 24
#: Different rows from which a bucket is dealt out by its strings, bytes refined at
#: once, the piece of a giant text that is bucketed at once, and rows combined at once.
HOT_ROWS, REFINE_BYTES, PIECE, COMBINED_ROWS = 20_000, 2 << 20, 4 << 20, 1 << 18
_NO_ID = -(1 << 63)


def initial_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, count, bucket, covered) of the rows of a slice; starts are within the text."""
    n, span = len(data) - GRAM + 1, LENGTH - GRAM + 1
    if n < span:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hashed = tb.SpanHash(data)
    at = np.arange(n)
    grams = tb.mix((hashed.total[GRAM:] - hashed.total[:n]) * hashed.down[:n])
    low = np.uint64((1 << 24) - 1)
    key = (grams & ~low) | at.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        rest = span - width
        key = np.minimum(key[:-rest], key[rest:])
    anchor = (key & low).astype(np.int64)
    starts = np.arange(len(anchor))
    text = tb.owner(starts, offsets)
    whole = starts + LENGTH <= offsets[text + 1]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    edge = np.flatnonzero(new | ~whole)
    stop = np.append(edge, len(anchor))[np.searchsorted(edge, first, "right")]
    count = stop - first
    covered = hashed(first, stop - 1 + LENGTH) ^ tb.mix((anchor[first] - first).astype(np.uint64) * np.uint64(1024) + count.astype(np.uint64))
    return text[first], first - offsets[text[first]], count, grams[anchor[first]], covered


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """Slices of ordinary texts whole, giant ones in overlapping pieces: (text shift, start shift, bytes, offsets)."""
    if len(data) <= 2 * PIECE:
        yield 0, 0, data, offsets
        return
    for k in range(len(offsets) - 1):
        for lo in range(int(offsets[k]), int(offsets[k + 1]), PIECE):
            part = data[lo : min(int(offsets[k + 1]), lo + PIECE + LENGTH - 1)]
            yield k, lo - int(offsets[k]), part, np.array([0, len(part)])


def refine(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bucket pointers at depth LENGTH of the suffixes at ``starts``; equal pointers mean equal strings.

    ``data`` holds contexts end to end; ``ends[i]`` is where the context of byte i ends,
    and only suffixes with the bytes for a depth are refined to it.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    gram = (padded[:n] << 24) | (padded[1 : n + 1] << 16) | (padded[2 : n + 2] << 8) | padded[3 : n + 3]
    room = ends - np.arange(n)
    live = np.flatnonzero(room >= 4)
    pointer = np.full(n, -1, np.int64)
    order = live[np.argsort(gram[live], kind="stable")]
    pointer[order], shared = _point(order, [gram[order]], np.zeros(len(order), np.int64))
    depth = 4
    for step in (4, 8, 16, 32, LENGTH - 64):
        depth = min(LENGTH, depth + step)
        live = order[shared]
        live = live[room[live] >= depth]
        by = np.lexsort((pointer[live + step], pointer[live]))
        order = live[by]
        old = pointer[order]
        new, shared = _point(order, [old, pointer[order + step]], old)
        pointer[order] = new
    return pointer[starts]


def _point(order: np.ndarray, keys: list[np.ndarray], base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers of sorted suffixes: their old bucket's, moved by their group's place in it; and which share a group."""
    n = len(order)
    if not n:
        return base, np.zeros(0, bool)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    bucket = np.ones(n, bool)
    bucket[1:] = base[1:] != base[:-1]
    at = np.arange(n)
    group, inside = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(bucket, at, 0))
    last = np.append(new[1:], True)
    return base + group - inside, ~(new & last)


def repeats(doc: np.ndarray, seq: np.ndarray, lo: np.ndarray, contexts: list[bytes]) -> np.ndarray:
    """Rows (index, start, count) of the strings that also start earlier, of rows that share buckets."""
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    stop = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(data))
    start = at[at + LENGTH <= stop[row]]
    pointer = refine(data, start, stop[row])
    row = row[start]
    place = lo[row] + start - (stop - sizes)[row]
    order = np.lexsort((place, seq[row], doc[row], pointer))
    again = np.zeros(len(order), bool)
    again[order[1:]] = pointer[order[1:]] == pointer[order[:-1]]
    row, place = row[again], place[again]
    if not len(row):
        return np.empty((0, 3), np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    return np.stack([row[first], place[first], np.diff(np.append(first, len(row)))], 1)


def cover(size: int, lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which of ``size`` bytes are covered by the strings that start in [lo, lo + count)."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + count + LENGTH - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _with_seq(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, seq, text, copies) of the distinct rows; seq, a hash of the text, tells rows of one doc_id apart if there are any."""
    base = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("doc"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    if base.groupBy("doc").count().where("count > 1").limit(1).isEmpty():
        return base.select("doc", F.lit(0).cast("long").alias("seq"), "text", F.lit(1).cast("long").alias("copies"))
    rows = base.groupBy("doc", F.xxhash64("text").alias("seq")).agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    return Table(rows, "rows").df


def known_repeats(bucket: np.ndarray, covered: np.ndarray, place: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which rows equal a row of these that starts earlier; ``place`` is ordered by its first array."""
    out = np.zeros(len(covered), bool)
    by = np.argsort(covered)
    same = covered[by[1:]] == covered[by[:-1]]
    if same.any():
        use = np.zeros(len(by), bool)
        use[1:] = same
        use[:-1] |= same
        own = by[use]
        own = own[np.lexsort((*(p[own] for p in reversed(place)), bucket[own], covered[own]))]
        out[own[1:]] = (covered[own[1:]] == covered[own[:-1]]) & (bucket[own[1:]] == bucket[own[:-1]])
    return out


def _bucket_rows(docs: DataFrame) -> DataFrame:
    """The rows of all texts; a ``held`` one is a repeat of an earlier row combined with it and has a bucket of its own."""

    names = ["bucket", "covered", "doc", "seq", "lo", "n", "held"]

    def combine(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        bucket, covered, doc, seq, lo, count = map(np.concatenate, zip(*rows))
        held = known_repeats(bucket, covered, (doc, seq, lo))
        bucket = np.where(held, tb.mix(doc.view(np.uint64) ^ tb.mix(lo.astype(np.uint64))), bucket)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (bucket.view(np.int64), covered.view(np.int64), doc, seq, lo, count, held)], names)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for part in tb.slices(batch, 2):
                data, offsets = tb.flatten(part.column(2))
                doc, seq = part.column(0).to_numpy(), part.column(1).to_numpy()
                for shift, lo, piece, ends in _pieces(data, offsets):
                    text, start, count, bucket, covered = initial_buckets(piece, ends)
                    text = text + shift
                    rows.append((bucket, covered, doc[text], seq[text], (start + lo).astype(np.int32), count.astype(np.int32)))
                    size += len(text)
                    if size >= COMBINED_ROWS:
                        yield combine(rows)
                        rows, size = [], 0
        if rows:
            yield combine(rows)

    return docs.mapInArrow(run, "bucket long, covered long, doc long, seq long, lo int, n int, held boolean")


def _shared_rows(rows: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one whole (state 0), and first rows of buckets with different ones (1, or 2 if hot)."""
    in_order = Window.partitionBy("bucket", "held").orderBy("covered", "doc", "seq", "lo")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = rows.withColumns({"before": F.lag("covered").over(in_order), "least": F.first("covered").over(whole), "most": F.last("covered").over(whole), "rows": F.count(F.lit(1)).over(whole)})
    again = F.col("held") | F.coalesce(F.col("before") == F.col("covered"), F.lit(False))
    state = F.when(again, 0).when(F.col("rows") > HOT_ROWS, 2).otherwise(1)
    return seen.where("held OR rows > 1").where(again | (F.col("least") != F.col("most"))).select("bucket", "doc", "seq", "lo", "n", state.alias("state"))


def _contexts(batches):
    """The covered bytes of each first row, keyed by its bucket, or string by string for hot buckets."""
    names = ["key", "doc", "seq", "lo", "context"]
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for doc, seq, text, rows in zip(*(batch.column(k).to_pylist() for k in range(4))):
            raw = text.encode()
            for r in rows:
                lo, stop = r["lo"], r["lo"] + r["n"] - 1 + LENGTH
                if r["state"] == 1:
                    out.append((r["bucket"], doc, seq, lo, raw[lo:stop]))
                    size += stop - lo
                else:
                    for p in range(lo, lo + r["n"]):
                        own = raw[p : p + LENGTH]
                        out.append((int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True), doc, seq, p, own))
                        size += LENGTH
                if size > 4 << 20:
                    yield _context_batch(out, names)
                    out, size = [], 0
        yield _context_batch(out, names)


def _context_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names)


def _refine_sorted(batches):
    """Refines rows that come sorted by key; a key is never cut, several small ones go together."""
    held: list[pa.RecordBatch] = []

    def flush(part: pa.Table):
        cols = [part.column(k).to_numpy() for k in range(1, 4)]
        found = repeats(cols[0], cols[1], cols[2].astype(np.int64), part.column(4).to_pylist())
        row = found[:, 0]
        return pa.RecordBatch.from_arrays([pa.array(cols[0][row]), pa.array(cols[1][row]), pa.array(found[:, 1].astype(np.int32)), pa.array(found[:, 2].astype(np.int32))], ["doc", "seq", "lo", "n"])

    def cut(table: pa.Table, last: bool):
        """Yields whole keys, about REFINE_BYTES at a time; returns the rest."""
        keys = table.column(0).to_numpy()
        bounds = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys))
        total = np.cumsum([len(c) for c in table.column(4).to_pylist()])
        start = 0
        for k, b in enumerate(bounds):
            if k + 1 == len(bounds) and not last:
                break
            if total[b - 1] - (total[start - 1] if start else 0) >= REFINE_BYTES or k + 1 == len(bounds) or (not last and k + 2 == len(bounds)):
                yield flush(table.slice(start, b - start))
                start = b
        held[:] = table.slice(start).to_batches()

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= 4 * REFINE_BYTES:
            yield from cut(pa.Table.from_batches(held).combine_chunks(), False)
            size = sum(b.nbytes for b in held)
    if held:
        yield from cut(pa.Table.from_batches(held).combine_chunks(), True)


def _cut_texts(batches):
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        out = []
        for doc, text, copies, spans in zip(*(batch.column(k).to_pylist() for k in range(4))):
            raw = text.encode()
            gone = np.zeros(len(raw), bool)
            if spans:
                gone = cover(len(raw), np.array([s["lo"] for s in spans]), np.array([s["n"] for s in spans]))
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
            runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            own = None if doc == _NO_ID else doc
            out.append((own, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
            again = (own, len(raw), len(raw), 1, nothing, b"") if len(raw) >= LENGTH else out[-1]
            for _ in range(copies - 1):
                out.append(again)
                if len(out) >= 10_000:
                    yield _cut_batch(out)
                    out = []
        yield _cut_batch(out)


def _cut_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True) -> DataFrame:
    """One row per input row: sizes, the digest of what is left and, if wanted, the bytes that are left."""
    texts = _with_seq(docs, id_col, text_col)
    key = ["doc", "seq"]
    shared = Table(_shared_rows(_bucket_rows(texts)), "shared").df
    row = F.struct("bucket", "lo", "n", "state")
    firsts = shared.where("state > 0").groupBy(*key).agg(F.collect_list(row).alias("rows"))
    contexts = texts.join(firsts, key).select("doc", "seq", "text", "rows").mapInArrow(_contexts, "key long, doc long, seq long, lo int, context binary")
    refined = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_refine_sorted, "doc long, seq long, lo int, n int")
    spans = shared.where("state = 0").select(*key, "lo", "n").unionByName(refined)
    by_doc = spans.groupBy(*key).agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    cut = texts.join(by_doc, key, "left").select("doc", "text", "copies", "spans").mapInArrow(_cut_texts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return cut if keep_bytes else cut.drop("kept")


def op9_bucket_pointer_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_bytes=False)


#: Every 100-byte string by its MD5, in order; documents of distinct ids.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT rid, i, md5(substr(h, CAST(2 * i + 1 AS INTEGER), 200)) AS k FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
f AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY k ORDER BY rid, i) AS n FROM p) WHERE n > 1),
g AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM f)),
s AS (SELECT rid, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY rid, run),
b AS (SELECT rid, lo, hi, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS after FROM s),
c AS (SELECT rid, sum(hi - lo) AS gone, count(*) AS n, max(hi) AS last, string_agg(substr(h, CAST(2 * after + 1 AS INTEGER), CAST(2 * (lo - after) AS INTEGER)), '' ORDER BY lo) AS kept FROM b JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN c.rid IS NULL THEN h ELSE kept || substr(h, CAST(2 * last + 1 AS INTEGER)) END)) AS kept_sha256 FROM d LEFT JOIN c USING (rid)
"""
