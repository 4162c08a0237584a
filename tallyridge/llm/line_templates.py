"""Line dedup by a tree of log templates, in DataFrame functions alone.

The tree has a fixed depth: a line goes down by its number of tokens, then by its leading ``depth``
tokens, where a token with a digit counts as variable. In a leaf, a token at a later place stays where lines
of ``least`` documents have it and becomes variable elsewhere; what comes out is the line's template.

Recurring is what several documents share. A line of equal tokens in two distinct documents or more
stays in the first of them, the one of smallest id, alone. Among what then stays, a template that lines of ``least`` distinct documents
have, with at least ``constant`` of its tokens fixed, stays in its first document alone. So one copy of every
passage is kept, and what recurs within one document only is left as it is. (Support of a token at a place adds up over
a leaf's distinct lines, each with the number of documents that hold it first; supports of templates count distinct documents.)

Lines of fewer than ``min_tokens`` tokens stay, blank ones too. Lines are parsed once, into a table. A leaf of one line needs no comparison, so only
lines of leaves with several are compared token by token; all else moves as hashes. Joins by a leaf, or by what a leaf
holds, are dealt into SALTS parts, so that a hot leaf is split. Where texts are shuffled they are so at every
size, so that cost and plan do not turn with the number of recurring lines. The work on a document, and on a line, is linear in its length.

Null texts stay null and have no lines. Rows without an id come last in the order and count as one document
in it, as do rows that repeat an id. A document that loses all its lines of words keeps its blank lines, or an empty text. Other columns, of whatever
names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyridge.llm.common import BLANKS, Scratch

LEAST, DEPTH, MIN_TOKENS, CONSTANT = 3, 3, 4, 0.7
VARIABLE = "<*>"
WITH_DIGIT = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
NO_ID = (1 << 63) - 1
#: Parts into which rows of one leaf, line or template are dealt in joins.
SALTS = 16


def tokens(line: Column) -> Column:
    """Its words; those with a digit are variable."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, WITH_DIGIT, VARIABLE)).otherwise(line)
    return F.array_remove(F.split(masked, BLANKS), "")


def leaf_hash(words: Column, depth: int) -> Column:
    """The place in the tree: number of tokens, then leading tokens."""
    return F.xxhash64(F.size(words), F.slice(words, 1, depth))


def parsed(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """``(id, text_hash, at, leaf, line, exact, n, vary, raw)`` of each line with ``min_tokens`` tokens or more; ``docs`` has id and text."""
    # the text is hashed and split before it is exploded, or else once for each of its lines
    split = docs.select("id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines"))
    lines = split.select("id", "text_hash", F.posexplode("lines").alias("at", "raw"))
    words = lines.withColumn("words", tokens(F.col("raw"))).where(F.size("words") >= min_tokens)
    line = F.xxhash64("words")
    # where no token varies the line's own tokens are those of the template
    exact = F.when(F.array_contains("words", VARIABLE), F.xxhash64(F.array_remove(F.split("raw", BLANKS), ""))).otherwise(line)
    vary = F.size("words") - F.size(F.array_remove("words", VARIABLE))
    return words.select("id", "text_hash", "at", leaf_hash(F.col("words"), depth).alias("leaf"), line.alias("line"), exact.alias("exact"), F.size("words").alias("n"), vary.alias("vary"), "raw")


def salted_join(many: DataFrame, few: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``few``; rows of one key are dealt into SALTS parts by a hash of ``by``."""
    dealt = many.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies.hint("merge"), [*on, "__salt"], how).drop("__salt")


def dropped_lines(scratch: Scratch, lines: DataFrame, least: int, depth: int, constant: float) -> DataFrame:
    """``(leaf, line, exact, first)``: hashes of lines to drop, and the document that keeps them, of ``parsed`` lines."""
    found = lines.groupBy("leaf", "line", "exact").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("n").alias("n"), F.min("vary").alias("vary"))
    by_exact = scratch.table(found, "by_exact")
    by_line = scratch.table(by_exact.groupBy("leaf", "line").agg(F.count_distinct("first").alias("docs"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("n").alias("n"), F.min("vary").alias("vary")), "by_line")
    # where several lines, of more than one document, may make up a template
    leaves = by_line.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("docs").alias("docs"), F.min("first").alias("first"), F.max("last").alias("last"))
    several = scratch.table(leaves.where((F.col("lines") > 1) & (F.col("docs") >= least) & (F.col("first") != F.col("last"))).select("leaf"), "several")
    fixed_share = lambda stay: stay >= F.lit(constant) * F.col("n")
    # alone in its leaf, a line is its own template
    alone = salted_join(by_line.where((F.col("docs") >= least) & fixed_share(F.col("n") - F.col("vary"))), several, ["leaf"], "line", "left_anti").select("leaf", "line", "first")

    wanted = salted_join(by_line.select("leaf", "line", "docs", "n"), several, ["leaf"], "line", "left_semi")
    # dealt by line once, for both the choice of one text and the join
    texts = lines.select("leaf", "line", "raw").dropDuplicates(["leaf", "line"]).join(wanted.hint("merge"), ["leaf", "line"])
    texts = texts.select("leaf", "line", "docs", "n", tokens(F.col("raw")).alias("words"))
    leading = F.size(F.array_remove(F.slice("words", 1, depth), VARIABLE))
    texts = scratch.table(texts.select("leaf", "line", "docs", "n", leading.alias("leading"), "words"), "texts")
    places = texts.select("leaf", "line", "docs", "n", "leading", F.posexplode("words").alias("at", "word")).where(F.col("word") != VARIABLE)
    support = scratch.table(places.groupBy("leaf", "at", "word").agg(F.sum("docs").alias("all")).where(F.col("all") >= least).select("leaf", "at", "word"), "support")
    # a leaf and the tokens that stay behind the leading ones, whatever their order, are a template
    behind = F.col("at") >= depth
    token = lambda *more: F.bit_xor(F.when(behind, F.xxhash64("at", "word", *more)).otherwise(F.lit(0).cast("long")))
    templates = salted_join(places, support, ["leaf", "at", "word"], "line").groupBy("leaf", "line").agg(
        token().alias("one"), token(F.lit(1)).alias("two"), F.sum(behind.cast("long")).alias("behind"), F.min("leading").alias("leading"), F.min("n").alias("n")
    )
    templates = templates.select("leaf", "line", F.xxhash64("one", "two", "behind").alias("template"), (F.col("behind") + F.col("leading")).alias("stay"), "n")
    templates = scratch.table(templates.where(fixed_share(F.col("stay"))), "templates")
    held = scratch.table(salted_join(by_exact.select("leaf", "line", "exact", "first"), templates.select("leaf", "line", "template"), ["leaf", "line"], "exact"), "held")
    recurring = scratch.table(held.groupBy("leaf", "template").agg(F.count_distinct("first").alias("docs"), F.min("first").alias("keeps")).where(F.col("docs") >= least).drop("docs"), "recurring")
    together = salted_join(held, recurring, ["leaf", "template"], "exact").select("leaf", "line", "exact", F.col("keeps").alias("first"))
    alone = salted_join(by_exact.select("leaf", "line", "exact"), alone, ["leaf", "line"], "exact").select("leaf", "line", "exact", "first")
    literal = by_exact.where("first <> last").select("leaf", "line", "exact", "first")
    # a template's first document is that of its lines, or an earlier one
    return literal.unionByName(together).unionByName(alone).groupBy("leaf", "line", "exact").agg(F.min("first").alias("first"))


def without(text: Column, lost: Column) -> Column:
    """``text`` without the lines at the ascending places ``lost``: what stands between them, end to end, so that the work is linear in both."""
    count = F.size(lost)
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.element_at(lost, k) + 1)
    end = lambda k, lines: F.when(k < count, F.element_at(lost, F.least(k + 1, count))).otherwise(F.size(lines))
    between = lambda lines: F.flatten(F.transform(F.sequence(F.lit(0), count), lambda k: F.slice(lines, start(k) + 1, end(k, lines) - start(k))))
    # as the element of an array the lines are split once
    return F.array_join(F.element_at(F.transform(F.array(F.split(text, "\n")), between), 1), "\n")


def dedup(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, constant: float = CONSTANT, counts: bool = False) -> DataFrame:
    """``docs`` without recurring lines in ``text_col``; with ``counts`` also ``n_lines`` and ``n_dropped``."""
    scratch = Scratch(spark)
    own = "__lines_"
    identity = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(identity.alias("id"), F.col(text_col).alias("text"))
    lines = scratch.table(parsed(rows, depth, min_tokens), "lines")
    drop = scratch.table(dropped_lines(scratch, lines, least, depth, constant), "drop")
    scratch.drop("by_exact", "by_line", "several", "texts", "support", "templates", "held", "recurring")
    # rows of one id and one text lose the same lines
    lost = salted_join(lines.select("id", "text_hash", "at", "leaf", "line", "exact"), drop, ["leaf", "line", "exact"], "id").where("id <> first")
    lost = lost.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias(f"{own}lost")).withColumnsRenamed({"id": f"{own}id", "text_hash": f"{own}hash"})
    keyed = docs.withColumns({f"{own}id": identity, f"{own}hash": F.xxhash64(F.col(text_col))})
    joined = keyed.join(lost.hint("merge"), [f"{own}id", f"{own}hash"], "left")

    text = F.when(F.col(f"{own}lost").isNull(), F.col(text_col)).otherwise(without(F.col(text_col), F.col(f"{own}lost")))
    columns = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if counts:
        breaks = F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
        columns += [F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(f"{own}lost"), F.lit(0)).cast("long").alias("n_dropped")]
    return joined.select(*columns)


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row per document: its lines, how many were dropped, and the digest of what stays."""
    out = dedup(spark, docs.select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def oracle_sql(least: int = LEAST, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, constant: float = CONSTANT) -> str:
    """DuckDB SQL for ``digests``, on the lines themselves."""
    blanks = r"[\x20\x09-\x0D]+"
    split = lambda x: f"list_filter(regexp_split_to_array({x}, '{blanks}'), lambda w: w <> '')"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {NO_ID}) AS id, text FROM documents
), raw AS (
  SELECT r, id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL
), l AS (
  SELECT *, {split("line")} AS own, {split(f"regexp_replace(line, '{WITH_DIGIT}', '{VARIABLE}', 'g')")} AS words FROM raw
), by_exact AS (
  SELECT words, own, min(id) AS first, max(id) AS last FROM l WHERE len(words) >= {min_tokens} GROUP BY words, own
), by_line AS (
  SELECT words, len(words) AS n, words[1:{depth}] AS lead, count(DISTINCT first) AS docs, min(first) AS first FROM by_exact GROUP BY words
), leaves AS (
  SELECT n, lead FROM by_line GROUP BY ALL HAVING count(*) > 1
), open AS (
  SELECT by_line.* FROM by_line JOIN leaves USING (n, lead)
), places AS (
  SELECT n, lead, words, docs, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM open
), support AS (
  SELECT n, lead, pos, word FROM places WHERE word <> '{VARIABLE}' GROUP BY ALL HAVING sum(docs) >= {least}
), templates AS (
  SELECT p.n, p.lead, p.words, list(CASE WHEN s.word IS NOT NULL OR p.pos <= {depth} THEN p.word ELSE '{VARIABLE}' END ORDER BY p.pos) AS template,
         bool_or(s.word IS NOT NULL) AS any_fixed
  FROM places p LEFT JOIN support s ON p.n = s.n AND p.lead = s.lead AND p.pos = s.pos AND p.word = s.word GROUP BY p.n, p.lead, p.words
), held AS (
  SELECT n, lead, template, words, own, first FROM templates JOIN by_exact USING (words)
  WHERE any_fixed AND len(list_filter(template, lambda w: w <> '{VARIABLE}')) >= {constant} * n
), recurring AS (
  SELECT n, lead, template, min(first) AS keeps FROM held GROUP BY ALL HAVING count(DISTINCT first) >= {least}
), alone AS (
  SELECT words, first FROM by_line ANTI JOIN leaves USING (n, lead)
  WHERE docs >= {least} AND len(list_filter(words, lambda w: w <> '{VARIABLE}')) >= {constant} * n
), drops AS (
  SELECT own, min(first) AS first FROM (
    SELECT own, first FROM by_exact WHERE first <> last
    UNION ALL SELECT own, keeps FROM held JOIN recurring USING (n, lead, template)
    UNION ALL SELECT own, alone.first FROM by_exact JOIN alone USING (words)
  ) GROUP BY own
), marked AS (
  SELECT r, line, pos, coalesce(drops.first <> l.id, false) AS gone FROM l LEFT JOIN drops USING (own)
)
SELECT any_value(doc_id) AS doc_id, count(pos) AS n_lines, count(pos) FILTER (gone) AS n_dropped,
       CASE WHEN count(pos) > 0 THEN md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) END AS text_md5
FROM d LEFT JOIN marked USING (r) GROUP BY r
"""
