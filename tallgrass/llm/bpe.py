"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one resolves whole pre-tokens: a minimal perfect hash over the vocabulary
maps a pre-token's bytes to the one slot it could be in, and a comparison of the
bytes there settles it.  Tier two merges what the vocabulary does not hold: a
heap of candidate merges over a doubly linked list of byte symbols.

Defined results: a null or empty text has no ids; every text is encoded whole,
as a stream of pre-tokens, so memory does not grow with its length; repeated
rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm import textbatch as tb

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Pre-tokens whose ids a worker remembers, and the longest it remembers.
MEMO_ENTRIES, MEMO_LENGTH = 500_000, 64
#: Pre-tokens handled at once while a text streams through.
STREAM = 65_536


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id of a rank file; ids are dense from zero."""
    with open(path, "rb") as f:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f)]
    tokens = [b""] * len(pairs)
    for rank, token in pairs:
        tokens[rank] = token
    return tokens


class MinimalPerfectHash:
    """Hash-and-displace: n distinct keys onto the slots 0..n-1.

    Keys fall into n/2 first-level buckets; from the fullest buckets down, seeds are
    tried until all keys of a bucket land in free slots.  All buckets of one size try
    a seed at once, and of those that want the same slot one gets it.  A bucket of one
    key has its slot itself, as a complement, for its seed.
    """

    _C = 0xD6E8FEB86659FD93

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.m, self.keys = n, max(1, n // 2), keys
        hashes = np.array([xxhash.xxh64_intdigest(k, 0) for k in keys], np.uint64)
        bucket = (hashes % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.m)
        first = np.cumsum(sizes) - sizes
        seeds, slots = np.zeros(self.m, np.int64), np.full(n, -1, np.int64)
        for size in range(int(sizes.max()), 1, -1):
            left, seed = np.flatnonzero(sizes == size), 0
            while len(left):
                seed += 1
                members = order[first[left][:, None] + np.arange(size)]
                wanted = self._slot(hashes[members], seed)
                good = (slots[wanted] < 0).all(1)
                row = np.sort(wanted, 1)
                good &= (row[:, 1:] != row[:, :-1]).all(1)
                claim = np.full(n, len(left), np.int64)
                np.minimum.at(claim, wanted[good], np.flatnonzero(good)[:, None] + np.zeros(size, np.int64))
                good &= (claim[wanted] == np.arange(len(left))[:, None]).all(1)
                slots[wanted[good]] = members[good]
                seeds[left[good]] = seed
                left = left[~good]
        alone = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(slots < 0)  # as many as buckets of one key
        slots[free] = order[first[alone]]
        seeds[alone] = ~free
        self.seeds, self.slots = seeds.tolist(), slots.tolist()

    def _slot(self, hashes: np.ndarray, seed: int) -> np.ndarray:
        x = (hashes ^ np.uint64(seed)) * np.uint64(self._C)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def find(self, key: bytes) -> int:
        """Index of the key, -1 if it is none of them."""
        h = xxhash.xxh64_intdigest(key, 0)
        seed = self.seeds[h % self.m]
        i = self.slots[~seed if seed < 0 else ((((h ^ seed) * self._C) & 0xFFFFFFFFFFFFFFFF) >> 32) % self.n]
        return i if self.keys[i] == key else -1


class Codec:
    def __init__(self, path: str, pattern: str):
        self.tokens = load_ranks(path)
        self.whole = MinimalPerfectHash(self.tokens)
        self.split = regex.compile(pattern)
        byte_id = {t[0]: i for i, t in enumerate(self.tokens) if len(t) == 1}
        self.byte_id = [byte_id[b] for b in range(256)]
        #: id << 20 | id of two neighbours -> id of their merge
        self.merges: dict[int, int] = {}
        find = self.whole.find
        for i, t in enumerate(self.tokens):
            for k in range(1, len(t)):
                left, right = find(t[:k]), find(t[k:])
                if left >= 0 and right >= 0:
                    self.merges[left << 20 | right] = i
        self.memo: dict[str, bytes] = {}
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.length, self.start = lengths, np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece by lowest rank first, leftmost of equals; ids are ranks."""
        ids = [*map(self.byte_id.__getitem__, piece)]
        n = len(ids)
        find, pop, push = self.merges.get, heapq.heappop, heapq.heappush
        heap = [(rank, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (rank := find(a << 20 | b)) is not None]
        heapq.heapify(heap)
        ids.append(-1)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while heap:
            rank, i = pop(heap)
            if (a := ids[i]) < 0 or (b := ids[j := after[i]]) < 0 or find(a << 20 | b) != rank:
                continue  # one of the two has since merged with another
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            before[k] = i
            if (c := ids[k]) >= 0 and (new := find(rank << 20 | c)) is not None:
                push(heap, (new, i))
            if i and (new := find(ids[h := before[i]] << 20 | rank)) is not None:
                push(heap, (new, h))
        return [x for x in ids if x >= 0]

    def piece(self, word: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers."""
        raw = word.encode()
        i = self.whole.find(raw)
        ids = [i] if i >= 0 else self.merge(raw)
        packed = pack(f"<{len(ids)}I", *ids)
        if len(word) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[word] = packed
        return packed

    def stream(self, text: str):
        """Packed ids of the whole text, in order, some pre-tokens at a time."""
        find, piece = self.memo.get, self.piece
        matches = self.split.finditer(text) if len(text) > 1 << 20 else None
        while True:
            pre = [m[0] for m in islice(matches, STREAM)] if matches else self.split.findall(text)
            parts = [*map(find, pre)]
            if None in parts:
                parts = [x or find(w) or piece(w) for x, w in zip(parts, pre)]
            if parts:
                yield b"".join(parts)
            if not matches or len(pre) < STREAM:
                return

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.stream(text or "")), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.start[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    return Codec(path, pattern)


def public_vocabulary(name: str = DEFAULT_RANKS) -> tuple[str, str]:
    """Path of an installed vocabulary and the pattern of its pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text as array<int> and, if named, the decoded text.

    An existing column of either name is replaced.
    """
    from pyspark.sql import types as T

    added = [ids_col] + [decoded_col] * (decoded_col is not None)
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added or c == text_col])
    kept = [c for c in rest.columns if c not in added]
    at = rest.columns.index(text_col)
    schema = T.StructType([f for f in rest.schema if f.name not in added] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded_col, T.StringType())] if decoded_col else []))

    def run(batches):
        coder = codec(path, pattern)
        for batch in batches:
            for part in tb.slices(batch, at):
                ids = [coder.encode(t) for t in part.column(at).to_pylist()]
                cols = [part.column(part.schema.get_field_index(c)) for c in kept] + [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
                if decoded_col:
                    cols.append(pa.array([coder.decode(x).decode("utf-8") for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [*kept, *added])

    return rest.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of ids, hash of the ids, hash of the bytes they decode to."""

    def run(batches):
        coder = codec(path, pattern)
        for batch in batches:
            for part in tb.slices(batch, 1):
                counts, coded, decoded = [], [], []
                for text in part.column(1).to_pylist():
                    n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
                    for ids in coder.stream(text or ""):
                        n += len(ids) // 4
                        ids_hash.update(ids)
                        bytes_hash.update(coder.decode(np.frombuffer(ids, "<u4")))
                    counts.append(n)
                    coded.append(ids_hash.hexdigest())
                    decoded.append(bytes_hash.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_vocabulary())
