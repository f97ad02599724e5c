"""The pipeline against the operators' definitions over plain Python data, and its odd cases."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallgrass.llm import bpe, decontaminate, line_templates, nbsvm, near_copies, pii, quality_rules, secrets, simhash, suffix_dedup, toxicity
from tallgrass.llm.tagger import Tagger
from tests.llm.test_decontaminate import best_by_all_alignments, ids_of
from tests.llm.test_near_copies import _first_of_groups
from tests.llm.test_operators import line_oracle

SF = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    import tiktoken

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE kept").fetchall()}
    docs = [(d, t) for d, t in con.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall() if d in kept]
    mask, drop = line_oracle(docs)
    docs = [(d, "\n".join(x for x in t.split("\n") if drop.get(mask(x), d) == d)) for d, t in docs]
    first = _first_of_groups(docs)
    docs = [(d, t) for d, t in docs if d in first]
    bench = [t for (t,) in con.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    own, items = ids_of([t for _, t in docs]), ids_of(bench)
    docs = [(d, t) for (d, t), a in zip(docs, own) if all(best_by_all_alignments(a, b) is None for b in items)]
    path, pattern = bpe.public_vocabulary()
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(bpe.codec(path, pattern).tokens)}, special_tokens={})
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: ref.encode_ordinary(t) for d, t in docs} and 50 < len(got) < 200


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows):
        real = spark.read.parquet(f"{SF}/documents.parquet")
        df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast(real.schema["n_chars"].dataType).alias("n_chars"))
        extra = {c: F.lit(1) for c in ("row", "doc", "version", "rank", "order", "group", "class", "ids", "decoded", "seed", "lines", "dropped", "__leaking_id", "__doc")}
        df.withColumns(extra).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def words(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(n))


def test_odd_rows_and_repeated_ids(spark, folder):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    a, b, c = words(1), words(2), words(3)
    rows = [(1, a), (5, a), (5, b), (7, b), (7, b), (None, c), (None, c), (None, f"{words(4)} {bench}"), (8, f"{words(5)} {bench}"), (9, None), (10, ""), (11, "x"), (12, words(6) + "é🙂")]
    out = corpus_pipeline.run(spark, folder(rows)).collect()
    coder = bpe.codec(*bpe.public_vocabulary())
    got = sorted((r.doc_id or 0, coder.decode(np.array(r.ids)).decode()) for r in out)
    assert got == sorted([(1, a), (5, b), (0, c), (12, rows[-1][1])]) and all(r.round_trip for r in out)


def test_empty_corpus(spark, folder):
    out = corpus_pipeline.run(spark, folder([(1, "x")][:0]))
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]


def test_a_text_of_nine_megabytes(spark):
    """Through every operator, held against what can be said of it plainly."""
    base = words(9, 4_000)
    big = (base + "\n") * 340  # some 9.5 million bytes
    docs = spark.createDataFrame([(1, big), (2, base), (3, "a short one of its own with ten words or so")], "doc_id long, text string")
    assert len(big) > 9 << 20
    rules = {r.doc_id: r for r in quality_rules.ledger(docs).collect()}
    assert rules[1].n_words == 4_000 * 340 and rules[1].n_dup_lines == 339 and rules[1].n_repeat_words == rules[1].n_words
    prints = {r.doc_id: r.fp for r in simhash.near_duplicates(docs).collect()}
    assert prints[1] & (2**64 - 1) == simhash.fingerprint(big) and len({r.group for r in near_copies.near_groups(docs).collect()}) <= 3
    path, pattern = bpe.public_vocabulary()
    coded = {r.doc_id: r for r in bpe.round_trip(docs, path, pattern).collect()}
    assert coded[1].decoded_sha256 == hashlib.sha256(big.encode()).hexdigest() and coded[1].n_tokens > 340 * 4_000
    cut = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert (cut[1].n_bytes, cut[1].n_removed, cut[2].n_removed, cut[3].n_removed) == (len(big), len(big) - len(base) - 1, len(base), 0)
    item = spark.createDataFrame([(4, " ".join(base.split()[100:130]))], "item_id long, text string")
    assert {(r.doc_id, r.token_at) for r in decontaminate.find_leaks(docs, item).collect()} == {(1, 100), (2, 100)}
    assert {r.doc_id: len(r.text) for r in line_templates.clean(docs).collect()} == {1: len(big), 2: len(base), 3: 43}
    spans = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame([(1, big + " token=abcdef0123")], "doc_id long, text string"), None).collect()}
    assert spans == {1: f"assign:{len(big) + 1}:{len(big) + 17}"}
    found = pii.scan(spark.createDataFrame([(1, big + " a.b@c.org")], "doc_id long, text string"), Tagger(pii.SYMBOLS, pii.TAGS)).first()
    assert found.n_email == 1 and f"email:{len(big) + 1}:{len(big) + 10}" in found.spans
    for module in (nbsvm, toxicity):
        model = nbsvm.Model(np.ones(nbsvm.N_FEATURES, np.float32), 1.0, 0.0) if module is nbsvm else toxicity.Model(np.zeros(toxicity.TABLE, np.float32), np.zeros(toxicity.N_FEATURES + 1))
        assert all(0 <= r.score <= 1 for r in nbsvm.score_rows(docs, model.scores, 0.5, "doc_id", "text").collect())
