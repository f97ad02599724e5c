"""Importance resampling towards a target: a sparse count matrix, its column sums, and its product with gains.

Documents become rows of a matrix of feature counts by bucket, written once as CSR blocks
(ids, row pointers, and bucket ids and counts, compressed, as a task reads many blocks at once). Column sums of the corpus and of the target give two
distributions; the log ratio of a bucket is its gain, and the matrix times the gains gives each
document's weight. A Gumbel number hashed from the id is added, and the highest scores are
drawn, which samples without replacement by weight.
"""

from __future__ import annotations

import math
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm import textbatch as tb
from tallgrass.llm.shared import Table
from tallgrass.operators.prefix import running_total

BUCKETS = 10_000
#: Entries after which a block is closed; one document has ``BUCKETS`` entries at most.
BLOCK_ENTRIES = 1 << 16
BLOCK = "ids array<long>, words array<long>, starts array<long>, entries binary"
#: Bucket and count of an entry, as stored.
ENTRY = np.dtype([("bucket", "<u2"), ("count", "<u4")])

#: Bytes of words as they are, A-Z lower-cased, every other ASCII byte a blank.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def feature_buckets(text: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of one to three of them; a run's CRC continues that of the shorter one."""
    words = text.translate(WORDS).split()
    spaced = [b" " + w for w in words[1:]]
    one = list(map(zlib.crc32, words))
    two = list(map(zlib.crc32, spaced, one))
    three = map(zlib.crc32, spaced[1:], two)
    crc = np.fromiter(chain(one, two, three), np.uint32)
    return len(words), (crc % np.uint32(buckets)).astype(np.int32)


def csr_blocks(docs: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """The count matrix of whole texts in blocks of rows; a null text is an empty row."""

    def build(batches):
        for batch in batches:
            for part in tb.slices(batch, 1):
                ids, words, sizes, found = [], [], [], []
                entries = 0
                for ident, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary())):
                    n, b = feature_buckets(text.as_py() or b"", buckets)
                    found.append(np.unique(b, return_counts=True))
                    ids.append(ident)
                    words.append(n)
                    sizes.append(len(found[-1][0]))
                    entries += sizes[-1]
                    if entries >= BLOCK_ENTRIES:
                        yield block(ids, words, sizes, found)
                        ids, words, sizes, found, entries = [], [], [], [], 0
                if ids:
                    yield block(ids, words, sizes, found)

    def block(ids, words, sizes, found):
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        entries = np.empty(starts[-1], ENTRY)
        entries["bucket"], entries["count"] = (np.concatenate([f[j] for f in found]) for j in (0, 1))
        # the two columns one after the other, as they compress better apart
        packed = zlib.compress(entries["bucket"].tobytes() + entries["count"].tobytes(), 1)
        rows = [pa.array([c], pa.list_(pa.int64())) for c in (ids, words, starts)]
        return pa.RecordBatch.from_arrays([*rows, pa.array([packed], pa.binary())], ["ids", "words", "starts", "entries"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(build, BLOCK)


def _entries(packed: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids and counts of a block."""
    data = zlib.decompress(packed.as_py())
    n = len(data) // ENTRY.itemsize
    return np.frombuffer(data, ENTRY["bucket"], n), np.frombuffer(data, ENTRY["count"], n, n * ENTRY["bucket"].itemsize).astype(np.int64)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: one vector a task, summed by bucket; what reaches the driver is ``buckets`` numbers."""

    def total(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                b, c = _entries(packed)
                np.add.at(sums, b, c)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], ["bucket", "n"])

    found = blocks.select("entries").mapInArrow(total, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in found.collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of target and source, rounded down."""
    s_all, t_all, k = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def document_weights(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the matrix times the gains, block by block; the gains go to all tasks."""

    def multiply(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, words, starts = (batch.column(c)[r].values for c in range(3))
                b, counts = _entries(batch.column(3)[r])
                sums = [np.concatenate([[0], np.cumsum(x)])[starts.to_numpy()] for x in (counts, counts * gains[b])]
                yield pa.RecordBatch.from_arrays([ids, words, *(pa.array(np.diff(s), pa.int64()) for s in sums)], ["id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(multiply, "id long, n_words long, n_features long, weight long")


def gumbel(ident: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number hashed from the seed and the id, rounded down; a null id is an empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null unless it is drawn.

    Of the N documents with ``least_words`` words or more, floor(percent * N / 100) are drawn. A
    null or blank text has no features and weight 0. Rows of one id share its random number
    and are judged each by its own text; equal rows take ranks in turn. Rows without id come
    last among ties. Without a target every gain falls as its bucket fills, without
    documents the result is empty; further columns are not read.
    """
    matrix = Table(csr_blocks(docs, id_col, text_col), "csr").df
    gains = bucket_gains(column_sums(matrix), column_sums(csr_blocks(target.withColumn("__id", F.lit(0)), "__id", target_col)))
    scored = document_weights(matrix, gains).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    scored = Table(scored, "scored").df
    open_ = F.col("n_words") >= least_words
    limit = scored.where(open_).agg(F.floor(F.count("*") * percent / 100).cast("long").alias("drawn"))
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("weight"), F.asc("n_words")]
    ranks = running_total(scored.where(open_), order, F.lit(1).cast("long"), "rank")
    drawn = ranks.join(F.broadcast(limit)).select("id", "n_features", "weight", "score", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).cast("long").alias("rank"))
    rest = scored.where(~open_).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest).withColumnRenamed("id", "doc_id")


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 5)


#: CRC-32 is affine in the bytes: each adds what depends on it and its distance from the end, which ``far`` lists; ``zero`` is the value of as many zero bytes.
ORACLE = r"""WITH RECURSIVE step AS (SELECT i AS b, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM (SELECT unnest(range(256)) AS i)),
texts AS (SELECT 0 AS side, row_number() OVER () AS doc, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (SELECT side, doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT side, doc, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM words),
per AS (SELECT side, doc, f, count(*) AS n FROM runs GROUP BY ALL),
feats AS (SELECT DISTINCT f, hex(encode(f)) AS h, octet_length(encode(f)) AS len FROM per),
far AS (SELECT 1 AS k, b, v FROM step UNION ALL SELECT k + 1, far.b, xor(far.v >> 8, step.v) FROM far JOIN step ON step.b = far.v & 255 WHERE k < (SELECT max(len) FROM feats)),
zero AS (SELECT 0 AS len, 4294967295 AS v UNION ALL SELECT len + 1, xor(zero.v >> 8, step.v) FROM zero JOIN step ON step.b = zero.v & 255 WHERE len < (SELECT max(len) FROM feats)),
bytes AS (SELECT f, len, k, CAST('0x' || substr(h, 2 * (len - k) + 1, 2) AS BIGINT) AS b FROM (SELECT f, h, len, unnest(range(1, len + 1)) AS k FROM feats)),
sums AS (SELECT f, any_value(len) AS len, bit_xor(v) AS v FROM bytes JOIN far USING (k, b) GROUP BY f),
crc AS (SELECT f, xor(4294967295, xor(sums.v, zero.v)) % 10000 AS bucket FROM sums JOIN zero USING (len)),
counts AS (SELECT side, doc, bucket, sum(n) AS n FROM per JOIN crc USING (f) GROUP BY ALL),
cols AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM counts GROUP BY 1),
totals AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS sa, CAST(coalesce(sum(t), 0) AS DOUBLE) AS ta FROM cols),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sa + 10000) / ((s + 1.0::DOUBLE) * (ta + 10000)))) AS BIGINT) AS gain FROM cols, totals),
weights AS (SELECT doc, sum(n) AS n_features, sum(n * gain) AS weight FROM counts JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc),
scored AS (SELECT doc, doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM words LEFT JOIN weights USING (doc) WHERE side = 0),
ranked AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight, n_words) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM ranked) THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc)"""
