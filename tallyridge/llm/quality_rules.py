"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

A rule rejects a document when a share (in per cent) exceeds a cutoff: symbols and capitals among the characters of
words, lines that repeat among lines, and words in repeated windows among words. All rules go together along one ladder of
LEVELS steps, from cutoffs that hardly reject anything to strict ones. Labelled documents of quality 1 that pass the
base rules decide, within a stratum (a band of document length), how far: at each step the hypothesis is that more than
``risk`` of the stratum's good documents are rejected by any rule; the exact binomial tail of those that are must stay below the
stratum's part of ``error``. The first test that fails ends the ladder, and the step before it is used; with none the rules are off there. So, with probability
``1 - error``, no stratum loses more than ``risk`` of its good documents: a fixed sequence needs no
correction within itself, and over strata the parts are Holm's: a stratum that has gone all the way leaves its part to the others.

The base rules are: fewer than ``min_words`` words, or more than BASE_REPEATS per cent of words in repeated windows.

Null texts count as empty: no words, rejected by the base rules. Without labels only the base rules hold.
Of labels that repeat an id the lowest counts, and its rows in a stratum are one trial, rejected if one of them is. Null and repeated ids are kept, one result per row; ``keep`` leaves columns of any
names as they are. Work is linear in a text, whatever repeats in it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyridge.llm.common import BLANKS, Scratch

#: Name, part and whole of each rule, and its cutoffs in per cent at the first and the last step of the ladder.
RULES = (("symbols", "n_symbols", "word_chars", 60, 1), ("capitals", "n_capitals", "word_chars", 60, 10), ("lines", "n_dup_lines", "n_lines", 60, 30), ("repeats", "n_repeat_words", "n_words", 50, 25))
LEVELS = 10
#: Words from which the strata after the first begin.
BANDS = (200, 800, 3000)
RISK, ERROR = 0.05, 0.05
MIN_WORDS, BASE_REPEATS = 50, 50


def ladder(first: int, last: int) -> list[int]:
    """Whole cutoffs of all steps, in geometric progression."""
    return [round(first * (last / first) ** (k / (LEVELS - 1))) for k in range(LEVELS)]


def repeated_words(windows: Column) -> Column:
    """Words that lie in a window found twice or more: windows are sorted with their places, so that equal ones stand together."""
    placed = F.zip_with(windows, F.sequence(F.lit(0), F.size(windows) - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    pairs = lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    # one-element arrays bind what would else be evaluated again for each element
    again = F.transform(F.array(F.sort_array(placed)), lambda s: F.flatten(F.filter(pairs(s), lambda x: x.isNotNull())))[0]
    return F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(again), lambda i: F.array(i, i + 1, i + 2)))))


def with_metrics(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the counts that the rules use, named with ``prefix``."""
    name = lambda c: prefix + c
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.withColumn(name("words"), F.array_remove(F.split(text, BLANKS), ""))
    words = F.col(name("words"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = split.withColumns({name("hashes"): F.transform(words, lambda w: F.xxhash64(w)), name("lines"): lines})
    hashes = F.col(name("hashes"))
    most = F.greatest(F.size(hashes) - 2, F.lit(0))
    windows = F.zip_with(F.zip_with(F.slice(hashes, 1, most), F.slice(hashes, 2, most), lambda a, b: F.xxhash64(a, b)), F.slice(hashes, 3, most), lambda x, c: F.xxhash64(x, c))
    counted = split.withColumns(
        {
            name("n_words"): F.size(words).cast("long"),
            name("word_chars"): F.length(F.regexp_replace(text, BLANKS, "")).cast("long"),
            name("n_symbols"): F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            name("n_capitals"): (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long"),
            name("n_lines"): F.size(name("lines")).cast("long"),
            name("n_dup_lines"): (F.size(name("lines")) - F.size(F.array_distinct(name("lines")))).cast("long"),
            name("windows"): windows,
        }
    ).drop(name("words"), name("lines"))
    found = F.col(name("windows"))
    repeats = F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(repeated_words(found))
    return counted.withColumn(name("n_repeat_words"), repeats.cast("long")).drop(name("hashes"), name("windows"))


def stratum(n_words: Column) -> Column:
    return sum(((n_words >= b).cast("int") for b in BANDS), F.lit(0))


def base_failed(prefix: str = "", min_words: int = MIN_WORDS) -> Column:
    n, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < min_words) | (100 * repeats > BASE_REPEATS * n)


def rejected(level: Column | int, prefix: str = "") -> Column:
    """Whether any rule rejects at a step of the ladder."""
    over = F.lit(False)
    for _, a, b, first, last in RULES:
        cutoffs = ladder(first, last)
        cutoff = F.lit(cutoffs[level]) if isinstance(level, int) else F.get(F.array(*map(F.lit, cutoffs)), level)
        over = over | (100 * F.col(prefix + a) > cutoff * F.col(prefix + b))
    return over


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Logarithm of the probability of at most ``k`` successes in ``n`` trials."""
    first = n * F.lit(math.log1p(-p))
    odds = math.log(p) - math.log1p(-p)

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct(term.alias("term"), (state["total"] + F.log1p(F.exp(term - state["total"]))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), add, lambda s: s["total"])


def thresholds(metrics: DataFrame, labels: DataFrame, *, risk: float = RISK, error: float = ERROR, min_words: int = MIN_WORDS, id_col: str = "doc_id", label_col: str = "quality", prefix: str = "") -> DataFrame:
    """``(stratum, level, n)``: the last certain step of the ladder in each stratum (their number is fixed), null where the rules are off."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label")).where("__label = 1")
    good = metrics.where(~base_failed(prefix, min_words)).withColumn("__id", F.col(id_col)).join(known.select("__id"), "__id")
    good = good.select("__id", stratum(F.col(f"{prefix}n_words")).alias("stratum"), *(rejected(k, prefix).cast("long").alias(f"k{k}") for k in range(LEVELS)))
    # rows of one id are one trial, not several
    good = good.groupBy("__id", "stratum").agg(*(F.max(f"k{k}").alias(f"k{k}") for k in range(LEVELS)))
    counts = good.groupBy("stratum").agg(F.count("*").alias("n"), *(F.sum(f"k{k}").alias(f"k{k}") for k in range(LEVELS)))
    strata = len(BANDS) + 1
    # few enough to be rejected are tested; more cannot be certain
    tail = lambda k: F.when(k < F.col("n") * risk, log_binomial_tail(k, F.col("n"), risk)).otherwise(F.lit(0.0))
    rows = counts.select("stratum", "n", F.array(*(tail(F.col(f"k{k}")) for k in range(LEVELS))).alias("tails"), F.lit(0).cast("long").alias("done"))
    over_all = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row per stratum
    for _ in range(strata):
        bound = F.log(F.lit(error) / F.greatest(strata - F.col("done"), F.lit(1)))
        stop = F.array_position(F.transform("tails", lambda t: t > bound), True)
        rows = rows.withColumn("steps", F.when(stop == 0, F.lit(LEVELS)).otherwise(stop - 1)).withColumn("done", F.sum((F.col("steps") == LEVELS).cast("long")).over(over_all))
    return rows.select("stratum", F.when(F.col("steps") > 0, F.col("steps") - 1).cast("int").alias("level"), "n")


def with_verdict(metrics: DataFrame, cutoffs: DataFrame, prefix: str = "", min_words: int = MIN_WORDS) -> DataFrame:
    """``metrics`` with ``base_failed`` and ``kept``, named with ``prefix``."""
    own = cutoffs.select(F.col("stratum").alias(f"{prefix}stratum"), F.col("level").alias(f"{prefix}level"))
    # a row per stratum
    joined = metrics.withColumn(f"{prefix}stratum", stratum(F.col(f"{prefix}n_words"))).join(F.broadcast(own), f"{prefix}stratum", "left")
    failed = base_failed(prefix, min_words)
    kept = ~failed & ~F.coalesce(rejected(F.col(f"{prefix}level"), prefix), F.lit(False))
    return joined.withColumns({f"{prefix}base_failed": failed, f"{prefix}kept": kept}).drop(f"{prefix}stratum", f"{prefix}level")


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The contract's row per document."""
    scratch = Scratch(spark)
    metrics = scratch.table(with_metrics(docs.select("doc_id", "text")).drop("text"), "metrics")
    cutoffs = scratch.table(thresholds(metrics, labels, risk=risk, error=error), "cutoffs")
    return with_verdict(metrics, cutoffs).drop("n_capitals", "n_lines")


def keep(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, risk: float = RISK, error: float = ERROR, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. Counts are taken once and stored with the rows."""
    scratch, own = Scratch(spark), "__rule_"
    counted = scratch.table(with_metrics(docs, text_col, own), "counted")
    cutoffs = scratch.table(thresholds(counted, labels, risk=risk, error=error, min_words=min_words, id_col=id_col, prefix=own), "cutoffs")
    return with_verdict(counted, cutoffs, own, min_words).where(f"{own}kept").select(*docs.columns)


def oracle_sql(risk: float = RISK, error: float = ERROR) -> str:
    """DuckDB SQL for ``judge``."""
    blanks = r"[\x20\x09-\x0D]+"
    bands = " + ".join(f"(n_words >= {b})::INT" for b in BANDS)
    over = lambda k: " OR ".join(f"100 * {a} > {ladder(first, last)[k]} * {b}" for _, a, b, first, last in RULES)
    tests = " UNION ALL ".join(f"SELECT stratum, {k} AS level, count(DISTINCT doc_id) AS n, count(DISTINCT doc_id) FILTER ({over(k)}) AS k FROM good GROUP BY stratum" for k in range(LEVELS))
    strata, certain, done = len(BANDS) + 1, "", "0"
    for k in range(strata):
        certain += f""", open{k} AS (
  SELECT stratum, min(level) FILTER (tail > {error!r} / greatest({strata} - {done}, 1)) AS stop FROM tails GROUP BY stratum
)"""
        done = f"(SELECT count(*) FROM open{k} WHERE stop IS NULL)"
    verdict = " ".join(f"WHEN {k} THEN {over(k)}" for k in range(LEVELS))
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '{blanks}'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), g AS (
  SELECT r, i, words[i:i+2] AS v FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), rep AS (
  SELECT r, count(DISTINCT j) AS n FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS c FROM g) WHERE c > 1
  ) GROUP BY r
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{blanks}', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {bands} AS stratum FROM m
), good AS (
  SELECT f.* FROM f JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed
), tests AS ({tests}
), tails AS MATERIALIZED (
  SELECT *, CASE WHEN k < n * {risk!r} THEN (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r})))
    FROM (SELECT unnest(range(0, k + 1)) AS i)) ELSE 1 END AS tail
  FROM tests
){certain}, chosen AS (
  SELECT stratum, coalesce(stop, {LEVELS}) - 1 AS level FROM open{strata - 1}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(CASE level {verdict} END, false) AS kept
FROM f LEFT JOIN chosen USING (stratum)
"""
