"""Quality rules: a ledger of failure bits and measurements, then policies over it.

Every rule is evaluated once per text.  What it measured and one bit per failed
rule go into the ledger; a policy is a versioned bit mask, so a change of policy
or an ablation is a bitwise expression over the ledger and never a second pass
over the texts.

Defined results: a null text counts as empty (no words, fails ``few_words``); an
empty table gives an empty ledger; a very long text is measured whole; repeated rows
each get their own ledger row;
extra columns of the input are ignored by ``ledger`` and carried through
unchanged, whatever their names, by ``filter_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm import textbatch as tb

#: Bit i of fail_bits is RULES[i].
RULES = ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length", "capitals", "exclamations")
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_exclaim")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", fail_bits long"


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)

    def kept(self, bits: Column) -> Column:
        return bits.bitwiseAND(F.lit(self.mask)) == 0


POLICIES = {
    "base": Policy("base", ("few_words", "repeated_words")),
    "v1": Policy("v1", ("few_words", "repeated_words", "symbols", "duplicate_lines", "capitals", "exclamations")),
    "strict": Policy("strict", RULES),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to another key, equal to a key further up) for each key."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    later[order[1:][same]] = True
    return any_, later


def measure(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """All measurements of a slice of texts."""
    n = len(offsets) - 1
    black = ~tb.WHITE[data]
    starts, ends = tb.words(data, offsets)
    text = tb.owner(starts, offsets)
    hashed = tb.SpanHash(data)
    out = {
        "n_words": np.bincount(text, minlength=n),
        "word_chars": tb.per_text(black & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": tb.per_text(_SYMBOL[data], offsets),
        "n_upper": tb.per_text(_UPPER[data], offsets),
        "n_lower": tb.per_text(_LOWER[data], offsets),
        "n_exclaim": tb.per_text(data == 33, offsets),
    }
    first, last, line_text = tb.lines(data, offsets)
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(black, out=seen[1:])
    full = seen[last] > seen[first]
    first, last, line_text = first[full], last[full], line_text[full]
    salt = tb.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    _, later = _repeats(hashed(first, last) + salt[line_text])
    out["n_lines"] = np.bincount(line_text, minlength=n)
    out["n_dup_lines"] = np.bincount(line_text[later], minlength=n)
    covered = np.zeros(len(starts) + 1, np.int64)
    grams = tb.windows(hashed(starts, ends), window)
    whole = np.flatnonzero(text[: len(grams)] == text[window - 1 :]) if len(grams) else np.empty(0, np.int64)
    twice, _ = _repeats(grams[whole] + salt[text[whole]])
    at = whole[twice]
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    out["n_repeat_words"] = np.bincount(text[np.cumsum(covered)[:-1] > 0], minlength=n)
    return out


def fail_bits(m: dict[str, np.ndarray]) -> np.ndarray:
    words, letters = m["n_words"], m["n_upper"] + m["n_lower"]
    failed = {
        "few_words": words < 10,
        "repeated_words": 100 * m["n_repeat_words"] > 20 * words,
        "symbols": 10 * m["n_symbols"] > 3 * words,
        "duplicate_lines": (10 * m["n_dup_lines"] > 3 * m["n_lines"]) & (m["n_dup_lines"] >= 3),
        "word_length": (m["word_chars"] < 2 * words) | (m["word_chars"] > 20 * words),
        "capitals": 10 * m["n_upper"] > 6 * letters,
        "exclamations": 2 * m["n_exclaim"] > words,
    }
    return sum(failed[r].astype(np.int64) << i for i, r in enumerate(RULES))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, every measurement, and the failure bits."""

    def run(batches):
        for batch in batches:
            for part in tb.slices(batch, 1):
                m = measure(*tb.flatten(part.column(1)))
                cols = [part.column(0), *(pa.array(m[k].astype(np.int64)) for k in MEASURES), pa.array(fail_bits(m))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *MEASURES, "fail_bits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with the verdict of one policy."""
    return rows.withColumns({"policy": F.lit(policy.version), "kept": policy.kept(F.col("fail_bits"))})


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule: rows that fail it, rows that only it rejects, rows kept without it.

    Bits are first counted by their combination (at most 2**rules groups, combined
    before the shuffle); the rules are then read off those few groups.
    """
    groups = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in policy.rules)))
    each = groups.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def filter_documents(docs: DataFrame, policy: Policy, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all columns unchanged; no shuffle."""
    at, mask = docs.columns.index(text_col), policy.mask

    def run(batches):
        for batch in batches:
            for part in tb.slices(batch, at):
                keep = (fail_bits(measure(*tb.flatten(part.column(at)))) & mask) == 0
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = ~POLICIES["base"].kept(F.col("fail_bits"))
    return apply_policy(ledger(docs), POLICIES["v1"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept",
        "policy", "fail_bits", "n_lines", "n_upper", "n_lower", "n_exclaim",
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT rid, gram FROM g GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM g JOIN r USING (rid, gram), range(0, 5) AS o(k) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
k AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(k.n_dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines,
  CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(t, '[^a-z]', '', 'g')) AS BIGINT) AS n_lower,
  CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclaim
  FROM d JOIN w USING (rid) LEFT JOIN c USING (rid) LEFT JOIN k USING (rid)),
b AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 3 THEN 8 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
  + CASE WHEN 10 * n_upper > 6 * (n_upper + n_lower) THEN 32 ELSE 0 END + CASE WHEN 2 * n_exclaim > n_words THEN 64 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 111) = 0 AS kept,
  'v1' AS policy, fail_bits, n_lines, n_upper, n_lower, n_exclaim FROM b
"""
