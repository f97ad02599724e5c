"""Line deduplication with a log-template tree, in DataFrame functions only.

Lines are parsed to a fixed depth: number of tokens, then the first ``DEPTH`` tokens,
tokens that hold a digit standing for variable fields.  A line with fewer constant
tokens than ``SIMILARITY`` of all, such as a row of numbers, has no template and always
stays.  A leaf is recurring if lines
of at least ``MIN_DOCS`` documents reach it.  In it, a masked line that recurs by
itself is its own template; the other lines are generalised.  A token's level is the
number of documents that have it at its place in the leaf.  For each level of a line
from ``MIN_DOCS`` up, the tokens of at least that level are constants and all else is
variable; a line whose tokens are constant to at least ``SIMILARITY`` belongs to the
template of these constants.  So a field's values may be as frequent as they like:
at a level above theirs they are variable.  Lines that recur by themselves count as
members too.  A line is cut by the template of its lowest level that recurs.
Templates in at least ``MIN_DOCS`` documents (a parameter; absolute, as for exact line
deduplication) are boilerplate: their lines are dropped from every document but the
first (smallest doc_id).  Each template thus stays in the corpus once; the values that
its variable fields have in the lines that are cut leave it.

Counts are combined before every shuffle, so a very common line is one row a task.
Only distinct lines are joined by leaf and token; a leaf with very many of them is a
skewed key of that join, which adaptive execution splits.  Texts are moved twice: to
look at the lines of recurring leaves that do not recur by themselves, and to cut lines
out.

Defined results: a null text stays null and has no line; blank lines are never
templates; rows of one doc_id with different texts are different documents, equal
rows are one document; a null doc_id counts as smaller than any other; a very long text
is split like any other; an empty table gives an empty result; other columns, whatever
their names, pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.shared import Scratch, Table

DEPTH, MIN_DOCS, SIMILARITY = 3, 6, 0.5
VARIABLE = "<*>"
_NO_ID = -(1 << 63)
_KEY = ["doc", "version"]


def _plain(line: Column) -> Column:
    """A line with single spaces and none at its ends."""
    white = F.contains(line, F.lit("  ")) | F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\v")) | F.contains(line, F.lit("\f"))
    return F.trim(F.when(white, F.regexp_replace(line, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")).otherwise(line))


def masked(lines: Column) -> Column:
    """Lines with single spaces and a mark in place of each token that holds a digit."""
    return F.transform(F.transform(lines, _plain), lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", VARIABLE)).otherwise(x))


def _size(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))


def _parsed(documents: DataFrame) -> DataFrame:
    """(doc, version, line_no, leaf, line): hashes of the leaf and of the masked line, for lines with a word and enough constants.

    Lines are masked inside the generator, so that no filter on a line computes it again.
    """
    each = documents.select(*_KEY, F.posexplode(masked(_split(F.col("text")))).alias("line_no", "line")).where("line <> ''")
    variable = F.regexp_count("line", F.lit(r"(?<![^ ])<\*>(?![^ ])"))
    each = each.where(~F.contains("line", F.lit(VARIABLE)) | (_size(F.col("line")) - variable >= SIMILARITY * _size(F.col("line"))))
    return each.select(*_KEY, "line_no", F.xxhash64(_size(F.col("line")), F.substring_index("line", " ", DEPTH)).alias("leaf"), F.xxhash64("line").alias("line"))


def templates(documents: DataFrame, lines: DataFrame, scratch: Scratch, min_docs: int) -> DataFrame:
    """(leaf, line, doc, version): masked lines to drop, and the document that keeps them."""
    key = ["leaf", "line"]
    in_doc = scratch.table(lines.groupBy(*key, *_KEY).agg(F.min("line_no").alias("line_no")), "in-doc")
    counted = scratch.table(in_doc.groupBy(*key).agg(F.count("*").alias("docs"), F.min(F.struct(*_KEY, "line_no")).alias("first")), "masked-lines")
    itself = counted.where(F.col("docs") >= min_docs).select(*key, "first.doc", "first.version")
    leaves = counted.groupBy("leaf").agg(F.sum("docs").alias("n"), F.count("*").alias("k"), F.min("docs").alias("least")).where((F.col("n") >= min_docs) & (F.col("k") > 1) & (F.col("least") < min_docs)).select("leaf")
    wanted = counted.join(leaves, "leaf").groupBy(F.col("first.doc").alias("doc"), F.col("first.version").alias("version")).agg(F.collect_list(F.struct(*key, "docs", "first.line_no")).alias("wanted"))
    found = documents.where("text IS NOT NULL").join(wanted, _KEY).select(_split(F.col("text")).alias("lines"), "wanted")
    seen = found.select(F.explode(F.transform("wanted", lambda w: F.struct(w["leaf"].alias("leaf"), w["line"].alias("line"), w["docs"].alias("docs"), F.split(F.get(masked(F.array(F.get("lines", w["line_no"]))), 0), " ").alias("tokens")))).alias("w")).select("w.*")
    seen = scratch.table(seen.dropDuplicates(key), "generalised")
    tokens = seen.select(*key, "docs", F.size("tokens").alias("size"), F.posexplode("tokens").alias("at", "token"))
    common = tokens.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n")).where((F.col("n") >= min_docs) & (F.col("token") != VARIABLE)).select("leaf", "at", "token", F.col("n").alias("level"))
    constant = tokens.join(common, ["leaf", "at", "token"]).groupBy(*key, "size", "docs").agg(F.sort_array(F.collect_list(F.struct("at", "token", "level"))).alias("found"))
    constant = constant.select(*key, "size", "docs", "found", F.explode(F.array_distinct("found.level")).alias("level"))
    held = F.transform(F.filter("found", lambda x: x["level"] >= F.col("level")), lambda x: F.struct(x["at"].alias("at"), x["token"].alias("token")))
    constant = constant.select(*key, "size", "docs", "level", held.alias("constants")).where(F.size("constants") >= SIMILARITY * F.col("size")).select(*key, "docs", "level", F.xxhash64("leaf", "constants").alias("template"))
    constant = scratch.table(constant, "constants")
    members = in_doc.join(constant, key).select(*key, "template", *_KEY)
    recurring = members.groupBy("template").agg(F.countDistinct(*_KEY).alias("n")).where(F.col("n") >= min_docs).select("template")
    chosen = constant.where(F.col("docs") < min_docs).join(recurring, "template").groupBy(*key).agg(F.min(F.struct("level", "template")).alias("best")).select(*key, F.col("best.template").alias("template"))
    chosen = scratch.table(chosen, "general")
    first = in_doc.join(chosen, key).groupBy("template").agg(F.min(F.struct(*_KEY)).alias("first"))
    general = chosen.join(first, "template").select(*key, "first.doc", "first.version")
    return itself.unionByName(general)


def find_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, version, dropped): the numbers of the lines to drop from each document that loses any, written."""
    documents = _documents(docs, id_col, text_col)
    with Scratch() as scratch:
        lines = scratch.table(_parsed(documents), "lines")
        drop = templates(documents, lines, scratch, min_docs).select("leaf", "line", F.struct(*_KEY).alias("keeper"))
        hit = lines.join(drop, ["leaf", "line"]).where(F.struct(*_KEY) != F.col("keeper"))
        return Table(hit.groupBy(*_KEY).agg(F.collect_set("line_no").alias("dropped")), "dropped-lines").df


def _cut(docs: DataFrame, id_col: str, text_col: str, min_docs: int) -> DataFrame:
    """(row, text, n_lines, n_dropped): the other columns as a struct, and the text without its boilerplate lines."""
    found = find_lines(docs, id_col, text_col, min_docs)
    text = F.col(f"`{text_col}`").cast("string")
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    side = docs.select(rest.alias("row"), text.alias("text"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text).alias("version"))
    both = side.join(found, _KEY, "left")
    # what lies between the dropped lines, each stretch cut out once; lines and numbers are bound first, so that they are made once
    between = lambda s: F.flatten(F.zip_with(F.concat(F.array(F.lit(-1)), s["d"]), F.concat(s["d"], F.array(F.size(s["l"]))), lambda a, b: F.slice(s["l"], a + 2, b - a - 1)))
    bound = F.array(F.struct(_split(F.col("text")).alias("l"), F.array_sort("dropped").alias("d")))
    kept = F.array_join(F.get(F.transform(bound, between), F.lit(0)), "\n")
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return both.select("row", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(n_lines, F.lit(0)).alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with boilerplate lines cut out; the same rows and columns."""
    return _cut(docs, id_col, text_col, min_docs).select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op2_line_templates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lines, dropped = (F.when(F.col("text").isNull(), 0).otherwise(F.col(c)).cast("long").alias(c) for c in ("n_lines", "n_dropped"))
    return _cut(docs, "doc_id", "text", MIN_DOCS).select("row.doc_id", lines, dropped, F.sha2("text", 256).alias("kept_sha256"))


#: The tree in SQL; documents of distinct ids, ASCII white space.
ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, trim(regexp_replace(ls[i], '[\x20\x09-\x0D]+', ' ', 'g')) AS p FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT doc_id, i, CASE WHEN regexp_matches(p, '[0-9]') THEN regexp_replace(p, '[^ ]*[0-9][^ ]*', '<*>', 'g') ELSE p END AS m FROM l WHERE p <> ''),
o AS (SELECT * FROM (SELECT doc_id, i, m, string_split(m, ' ') AS ts FROM k) WHERE len(list_filter(ts, lambda x: x <> '<*>')) >= 0.5 * len(ts)),
od AS (SELECT DISTINCT doc_id, m FROM o),
counted AS (SELECT len(any_value(ts)) AS sz, array_to_string(any_value(ts)[1:3], ' ') AS head, m, any_value(ts) AS ts, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM o GROUP BY m),
leaves AS (SELECT sz, head FROM counted GROUP BY ALL HAVING sum(docs) >= 6 AND count(*) > 1 AND min(docs) < 6),
tok AS (SELECT sz, head, m, docs, j, ts[j] AS tok FROM (SELECT sz, head, m, docs, ts, unnest(range(1, len(ts) + 1)) AS j FROM counted JOIN leaves USING (sz, head))),
common AS (SELECT sz, head, j, tok, sum(docs) AS level FROM tok WHERE tok <> '<*>' GROUP BY ALL HAVING sum(docs) >= 6),
held AS (SELECT m, sz, head, docs, j, tok, level FROM tok JOIN common USING (sz, head, j, tok)),
lev AS (SELECT DISTINCT m, level FROM held),
cons AS (SELECT h.m, h.sz, h.head, h.docs, lev.level, string_agg(h.j || ':' || h.tok, ' ' ORDER BY h.j) AS template FROM lev JOIN held h ON h.m = lev.m AND h.level >= lev.level GROUP BY ALL HAVING count(*) >= 0.5 * h.sz),
recurring AS (SELECT sz, head, template FROM cons JOIN od USING (m) GROUP BY ALL HAVING count(DISTINCT doc_id) >= 6),
chosen AS (SELECT m, sz, head, arg_min(template, level) AS template FROM cons JOIN recurring USING (sz, head, template) WHERE docs < 6 GROUP BY m, sz, head),
firsts AS (SELECT sz, head, template, min(doc_id) AS first FROM chosen JOIN od USING (m) GROUP BY ALL),
cut AS (SELECT m, first FROM counted WHERE docs >= 6 UNION ALL SELECT m, first FROM chosen JOIN firsts USING (sz, head, template)),
gone AS (SELECT doc_id, list(i) AS g FROM o JOIN cut USING (m) WHERE doc_id <> first GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_dropped,
  sha256(array_to_string(CASE WHEN g IS NULL THEN ls ELSE list_filter(ls, lambda x, i: NOT list_contains(g, i)) END, chr(10))) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id)
"""
