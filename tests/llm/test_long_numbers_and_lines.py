"""Cases whose cost or outcome depends on one very long number or a document of very many lines."""

import time

from pyspark.sql import functions as F

from tallgrass.llm import line_templates, pii


def test_numbers_of_thousands_of_digits_are_no_address():
    for n in (3, 4, 300, 4_300, 4_301, 5_000, 100_000):
        text = "see 1.2.3." + "4" * n
        assert [s for s in pii.base_spans(text) if s[1] == 1] == ([(4, 1, 10 + n)] if n < 3 else [])
        assert [s for s in pii.base_spans("see 1.2.3." + "0" * n + "7") if s[1] == 1] == [(4, 1, 11 + n)]
    assert [s for s in pii.base_spans("1.2.3.255 1.2.3.256 000.0.0.0") if s[1] == 1] == [(0, 1, 9), (20, 1, 29)]


def test_every_other_of_many_lines_goes(spark):
    """Half a million dropped lines cost as little each as a few."""
    own = lambda d, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("shared header of a page\nalone"), F.col("doc_id").cast("string"), F.lit("x"), F.conv(i.cast("string"), 10, 26)))
    took = []
    for n in (50_000, 500_000):
        docs = spark.range(2).select(F.col("id").alias("doc_id")).withColumn("text", F.array_join(own(0, n), "\n"))
        few = spark.range(2, 9).select(F.col("id").alias("doc_id"), F.lit("shared header of a page\nan end").alias("text"))
        start = time.time()
        got = {r.doc_id: (r.n, r.head) for r in line_templates.clean(docs.unionByName(few)).select("doc_id", F.regexp_count("text", F.lit("shared header")).alias("n"), F.substring("text", 1, 6).alias("head")).collect()}
        took.append(time.time() - start)
        # the first document keeps what the templates leave in it; in all others the line is gone
        assert got[0][0] == n and all(got[k][0] == 0 for k in range(1, 9)) and got[1][1].startswith("alone1")
    assert took[1] < 20 * took[0] + 5
