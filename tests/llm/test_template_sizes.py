"""A template with two word fields must be found whatever the size of the table."""

import pytest
from pyspark.sql import functions as F

from tallgrass.llm import line_templates


@pytest.mark.parametrize("values", [10, 20, 40])
def test_two_word_fields(spark, values):
    word = lambda kind, k: kind + chr(97 + k // 26) + chr(97 + k % 26)
    rows = [(values * i + j, f"This page was written by {word('name', i)} from {word('city', j)}\nown words {word('own', i)} {word('of', j)}") for i in range(values) for j in range(values)]
    dropped = line_templates.find_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(0 in r.dropped for r in dropped) == len(rows) - 1


def test_lines_that_recur_by_themselves_count_in_their_leaf(spark):
    rows = [(k, "This page was written by ann from oslo") for k in range(40)] + [(100 + k, f"This page was written by {n} from rome") for k, n in enumerate(["bob", "cyd", "dan"])]
    dropped = line_templates.find_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc for r in dropped} >= {101, 102}


def test_rows_of_numbers_stay(spark):
    rows = [(k, f"{3 * k} {7 * k} {11 * k}\n12\n2024-01-0{k} 12:00:0{k}\nListing {k} of the tables we have\nown {chr(97 + k) * 4} words") for k in range(1, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("row", "doc", "version", "lines", "dropped", "__doc", "__version", "__which", "__text_lines", "n_lines")})
    out = line_templates.clean(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text.split("\n") for r in out.collect()}
    assert got == {d: [x for x in t.split("\n") if d == 1 or not x.startswith("Listing")] for d, t in rows}


def test_the_threshold_is_a_parameter(spark):
    df = spark.createDataFrame([(k, f"all rights are reserved here\nown {chr(97 + k) * 4}") for k in range(5)], "doc_id long, text string")
    assert line_templates.find_lines(df).isEmpty() and line_templates.find_lines(df, min_docs=5).count() == 4


def test_long_text(spark):
    rows = [(k, "Terms of use apply to this site\n" * 12_000 + f"end {chr(97 + k) * 3}\n" + chr(97 + k) * 700_000) for k in range(6)]
    got = {r.doc_id: len(r.text) for r in line_templates.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == len(rows[0][1]) and all(got[k] == len("end xxx\n") + 700_000 for k in range(1, 6))
