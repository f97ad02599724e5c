"""Secret scan, in DataFrame functions only: fixed patterns and two character Markov models.

Patterns give spans of three kinds.  Beside them, every run of 16 or more characters
of ``[A-Za-z0-9+/_-]`` is read by two first-order character models, one of random
strings and one of ordinary identifiers.  A run whose log-likelihood ratio a bigram
reaches a fitted threshold is a span of kind ``random`` unless it overlaps a pattern span.

Both models and the threshold come from labelled samples.  Random strings are digests
written as hexadecimal, base 64 and letters and digits, of 16 to 43 characters, and the
pattern matches of a bounded sample of documents.  Ordinary ones are that sample's words,
alone and joined as identifiers and paths are, and numbers of 8 to 19 digits.  Half of
each, by a hash, gives the models' bigram counts; on the other half the threshold is set
where the share of missed random strings and ``FALSE_COST`` times the share of ordinary
ones taken for random are least.

Positions come from splitting a text at a pattern: the lengths of the pieces and of
the matches, added up by a window, are code-point offsets.  One shuffle moves those
lengths, never a text.

Defined results: a null text counts as empty (no spans); spans with one start are listed
in the order of kinds; a very long text is scanned whole, and its spans are one window;
repeated rows each get a row; an empty table gives an empty result, and without a sample
the models know digests alone and add nothing; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm.shared import Scratch

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: As dropping shorter runs of [0-9a-f]+ does: a greedy run is taken whole either way.
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{16,}"
ORDINARY = r"[A-Za-z0-9_]{4,}"
#: Documents that labelled samples come from, and digests added to the random ones.
SAMPLE_DOCS, SAMPLE_DIGESTS = 3_000, 3_000
SMOOTHING, FALSE_COST = 0.5, 20.0
#: Width of the steps in which the threshold is sought.
STEP = 0.02
_LOW, _SIZE = 33, 94  # printable ASCII


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def _bigrams(strings: DataFrame, column: str) -> DataFrame:
    """(bigram, n) of the characters of all strings."""
    chars = F.split(F.col(column), "")
    n = F.length(column)
    pairs = F.zip_with(F.slice(chars, F.lit(1), n - 1), F.slice(chars, F.lit(2), n - 1), _bigram)
    return strings.where(n >= 2).select(F.explode(pairs).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


def _bigram(a: Column, b: Column) -> Column:
    return (F.ascii(a) - _LOW) * _SIZE + F.ascii(b) - _LOW


@dataclass
class Model:
    """Log-likelihood ratio of each bigram, random over ordinary (a fixed 8,836 numbers), and the mean from which a run is random."""

    ratios: list[float]
    threshold: float


def _random_strings(spark) -> DataFrame:
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    coded = F.regexp_replace(F.base64(digest), "[=\r\n]", "")
    kinds = [F.lower(F.hex(digest)), coded, F.regexp_replace(coded, "[+/]", "")]
    return spark.range(SAMPLE_DIGESTS).select(F.substring(F.get(F.array(*kinds), (F.col("id") % 3).cast("int")), F.lit(1), (16 + F.col("id") % 28).cast("int")).alias("s"))


def _ordinary_strings(sample: DataFrame) -> DataFrame:
    """Words of the sample, runs of two to four of them joined, and numbers."""
    words = F.filter(F.regexp_extract_all("text", F.lit(ORDINARY), 0), lambda x: (F.length(x) < 16) | ~x.rlike("[0-9]"))
    starts = F.when(F.size("words") > 4, F.sequence(F.lit(1), F.size("words") - 4, F.lit(5))).otherwise(F.array().cast("array<int>"))

    def joined(i: Column) -> Column:
        own = F.slice("words", i, 2 + i % 3)
        camel = F.array_join(F.transform(own, F.initcap), "")
        return F.when(i % 4 == 0, camel).when(i % 4 == 1, F.array_join(own, "_")).when(i % 4 == 2, F.array_join(own, "-")).otherwise(F.array_join(own, "/"))

    named = sample.select(words.alias("words"))
    digits = F.substring(F.regexp_replace(F.sha2(F.concat(F.lit("n"), F.col("id").cast("string")), 256), "[a-f]", ""), F.lit(1), (8 + F.col("id") % 12).cast("int"))
    numbers = sample.sparkSession.range(SAMPLE_DIGESTS).select(F.when(F.col("id") % 2 == 0, digits).otherwise(F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1-")).alias("s"))
    return named.select(F.explode("words").alias("s")).unionByName(named.select(F.explode(F.transform(starts, joined)).alias("s"))).unionByName(numbers)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The two models as one table of ratios, and the threshold fitted on strings that they have not seen."""
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    sample = _texts(docs, id_col, text_col).join(F.broadcast(ids), "doc_id")
    values = F.concat(F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), 2), lambda x: F.length(x) >= 16), F.regexp_extract_all("text", F.lit(ACCESS), 0), F.regexp_extract_all("text", F.lit(HEX), 0))
    matched = sample.where(F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX)).select(F.explode(values).alias("s"))
    plain = lambda df: df.where(~F.col("s").rlike(r"[^\x21-\x7E]")).withColumn("fit", F.crc32(F.col("s").cast("binary")) % 2 == 0)
    with Scratch() as scratch:
        labelled = plain(_random_strings(docs.sparkSession).unionByName(matched)).withColumn("random", F.lit(True)).unionByName(plain(_ordinary_strings(sample)).withColumn("random", F.lit(False)))
        labelled = scratch.table(labelled, "labelled-strings")
        counts = []
        for kind in (True, False):
            table = [SMOOTHING] * (_SIZE * _SIZE)
            for bigram, n in _bigrams(labelled.where((F.col("random") == kind) & ~F.col("fit")), "s").collect():
                table[bigram] += n
            counts.append(table)
        ratios = []
        for a in range(_SIZE):
            rows = [t[a * _SIZE : (a + 1) * _SIZE] for t in counts]
            totals = [sum(r) for r in rows]
            ratios += [math.log(x / totals[0]) - math.log(y / totals[1]) for x, y in zip(*rows)]
        runs = labelled.where(F.col("fit") & F.col("s").rlike(f"^{RUN}$"))
        bins = runs.groupBy("random", F.floor(_mean_ratio(F.col("s"), _table(ratios)) / STEP).alias("bin")).agg(F.count("*").alias("n")).collect()
    return Model(ratios, _threshold({(r["random"], r["bin"]): r["n"] for r in bins}))


def _threshold(bins: dict[tuple[bool, int], int]) -> float:
    """The step from which runs count as random: fewest errors, the middle of equally good steps; none without both classes."""
    total = {kind: sum(n for (k, _), n in bins.items() if k == kind) for kind in (True, False)}
    if not total[True] or not total[False]:
        return math.inf
    edges = sorted({b for _, b in bins})
    cost = {}
    for cut in range(edges[0], edges[-1] + 2):
        missed = sum(n for (k, b), n in bins.items() if k and b < cut) / total[True]
        false = sum(n for (k, b), n in bins.items() if not k and b >= cut) / total[False]
        cost[cut] = missed + FALSE_COST * false
    best = [c for c, x in cost.items() if x <= min(cost.values()) + 1e-12]
    return STEP * best[len(best) // 2]


def _table(ratios: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")


def _mean_ratio(s: Column, table: Column) -> Column:
    chars = F.split(s, "")
    n = F.length(s)
    scores = F.zip_with(F.slice(chars, F.lit(1), n - 1), F.slice(chars, F.lit(2), n - 1), lambda a, b: F.get(table, _bigram(a, b)))
    return F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x) / (n - 1)


def _matches(kind: int, pattern: str, good, group: int = 0) -> Column:
    """Array of (kind, at, before, length, good) of a pattern's matches; before is the length of the piece in front."""
    text = F.col("text")
    columns = [F.transform(F.split(text, pattern, -1), F.length).alias("before"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("whole")]
    if group:
        columns.append(F.regexp_extract_all(text, F.lit(pattern), group).alias("value"))
    rows = F.filter(F.arrays_zip(*columns), lambda x: x["whole"].isNotNull())
    rows = F.transform(rows, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x["before"].alias("before"), F.length(x["whole"]).alias("length"), good(x["value" if group else "whole"]).alias("good")))
    none = F.array().cast("array<struct<kind:int,at:int,before:int,length:int,good:boolean>>")
    return F.when(text.rlike(pattern), rows).otherwise(none)


def scan(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of pattern spans by kind, their digest, and all spans."""
    yes = lambda x: F.lit(True)
    found = [_matches(0, ASSIGN, lambda x: F.length(x) >= 6, 2), _matches(1, ACCESS, lambda x: F.length(x) >= 20), _matches(2, HEX, yes)]
    if model is not None and model.threshold < math.inf:
        found.append(_matches(3, RUN, lambda x: _mean_ratio(x, _table(model.ratios)) >= model.threshold))
    named = _texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    rows = named.select("row", "doc_id", F.explode_outer(F.concat(*found)).alias("m")).select("row", "doc_id", "m.kind", "m.at", "m.before", "m.length", "m.good").repartition("row")
    so_far = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("length")).over(so_far)
    rows = rows.select("row", "doc_id", "kind", "good", (end - F.col("length")).alias("start"), end.alias("end"))
    rows = rows.select("row", "doc_id", *(F.when(F.col("good"), F.col(c)).alias(c) for c in ("kind", "start", "end")))
    order = Window.partitionBy("row").orderBy(F.col("start").asc_nulls_last(), "kind")
    pattern = F.col("kind") < 3
    before = F.max(F.when(pattern, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(pattern, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    clear = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    rows = rows.withColumns({"pattern": F.coalesce(pattern, F.lit(False)), "clear": clear})
    span = F.struct("start", "kind", "end")
    names = F.array(*map(F.lit, KINDS))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    out = rows.groupBy("row", "doc_id").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.collect_list(F.when(F.col("pattern"), span)).alias("base"),
        F.collect_list(F.when(F.col("pattern") | F.col("clear"), span)).alias("all"),
    )
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def op4_markov_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))
