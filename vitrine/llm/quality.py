"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations are bit operations.

``ledger()`` measures each document once and stores the failed rules as bits of one long beside the
measurements. A policy is a version and a mask of rules; applying one, or another, later, reads only the bits.
``ablations()`` aggregates the ledger to one count per distinct bit pattern, whatever the number of documents,
and answers from those counts what each rule rejects, alone or with others.

DataFrame functions only; one pass over the rows without a shuffle.

Defined results: a null or blank text has no words and fails ``few_words``; a text of one word or of white space
only has no windows and no repeated words; equal lines count from the second on; rows with a repeated doc_id are
judged each for itself; an empty table gives an empty ledger; further columns of the input, whatever their names,
are not read by ``ledger()`` and are kept by ``keep()``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import table, unused_prefix, words

#: name of the rule -> when a document fails it, over the measurements. The place in this table is the bit.
RULES = {
    "few_words": "n_words < 10",
    "repeat_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
    "dup_lines": "100 * n_dup_lines > 50 * n_lines",
    "echo_words": "100 * n_echo_words > 30 * n_words",
    "no_letters": "100 * n_letter_words < 40 * n_words",
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echo_words", "n_letter_words")
BASE = ("few_words", "repeat_words")
WINDOW = 5


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails none of the policy's rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


POLICIES = {p.version: p for p in (Policy("base", BASE), Policy("v1", ("few_words", "repeat_words", "symbols", "word_length", "dup_lines")), Policy("v2", tuple(RULES)))}
CURRENT = "v2"


def _repeat_words(w: Column) -> Column:
    """Words in windows that occur twice or more. No two equal hashes: no two equal windows; else the windows themselves are compared."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    placed = F.sort_array(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(WINDOW)]).alias("w"), i.alias("i"))))

    def covered(s: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(s, k)["w"] == F.get(s, j)["w"], F.lit(False))
        at = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1)), lambda k: F.get(s, k)["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    exact = F.get(F.transform(F.array(placed), covered), 0)
    repeated = F.get(F.transform(F.array(hashes), lambda h: F.size(F.array_distinct(h)) < F.size(h)), 0)
    return F.when(n < WINDOW, 0).when(~repeated, 0).otherwise(exact)


def measured(docs: DataFrame, p: str, text: str = "text") -> DataFrame:
    """The rows with a column for each of MEASURES, named with the prefix p, which no input column should have."""
    c = F.coalesce(F.col(text), F.lit(""))
    full = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # a generator of one row: no filter above can pull the words' expression into what is done for each word
    df = docs.select("*", F.inline(F.array(F.struct(words(text).alias(f"{p}w"), full.alias(f"{p}l")))))
    w, lines = F.col(f"{p}w"), F.col(f"{p}l")
    return df.withColumns(
        {
            f"{p}n_words": F.size(w).cast("long"),
            f"{p}word_chars": F.length(F.array_join(w, "")).cast("long"),
            f"{p}n_symbols": F.length(F.regexp_replace(c, r"[^#*$%&|<>]+", "")).cast("long"),
            f"{p}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            f"{p}n_repeat_words": _repeat_words(w).cast("long"),
            f"{p}n_lines": F.size(lines).cast("long"),
            f"{p}n_echo_words": F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))).cast("long"),
            f"{p}n_letter_words": F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long"),
        }
    ).drop(f"{p}w", f"{p}l")


def fail_bits(p: str) -> Column:
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        for m in sorted(MEASURES, key=len, reverse=True):
            rule = rule.replace(m, f"@{MEASURES.index(m)}@")
        for k, m in enumerate(MEASURES):
            rule = rule.replace(f"@{k}@", f"{p}{m}")
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the measurements and ``fail_bits`` of every row."""
    p = unused_prefix([key, text])
    df = measured(docs.select(F.col(key), F.col(text)), p, text)
    return df.select(key, *[F.col(p + m).alias(m) for m in MEASURES], fail_bits(p).alias("fail_bits"))


def failed(bits: Column, rules: tuple[str, ...]) -> Column:
    return bits.bitwiseAND(F.lit(Policy("", rules).mask).cast("long")) != 0


def decide(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """``kept`` and ``policy`` for ledger entries; no text is read again."""
    p = POLICIES[policy]
    return entries.withColumns({"kept": ~failed(F.col("fail_bits"), p.rules), "policy": F.lit(p.version)})


def ablations(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy keeps without it."""
    p = POLICIES[policy]
    spark = entries.sparkSession
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(p.mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = spark.createDataFrame([(r, 1 << list(RULES).index(r)) for r in p.rules], "rule string, bit long")
    per = patterns.select("n", "bits", F.explode(F.expr(f"from_json('{_json_rules(p)}', 'array<struct<rule:string,bit:bigint>>')")).alias("r")).select("n", "bits", "r.*")
    sums = per.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return F.broadcast(rules).join(sums, "rule", "left").select("rule", zero("n_failed"), zero("n_alone"), zero("n_kept_without"))


def _json_rules(p: Policy) -> str:
    return "[" + ",".join(f'{{"rule":"{r}","bit":{1 << list(RULES).index(r)}}}' for r in p.rules) + "]"


def keep(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows that a policy keeps, with the columns they came with."""
    p = unused_prefix(docs.columns)
    df = measured(docs, p, text).withColumn(f"{p}bits", fail_bits(p))
    return df.where(~failed(F.col(f"{p}bits"), POLICIES[policy].rules)).select(*docs.columns)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = decide(ledger(table(spark, sf_dir, "documents")))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed(F.col("fail_bits"), BASE).alias("base_failed"), "kept", "fail_bits")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, u.i AS i, array_to_string(w[u.i + 1 : u.i + 5], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 0))) AS i FROM w) u),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         len(l) AS n_lines, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echo,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (word_chars < 2 * n_words OR word_chars > 12 * n_words)::BIGINT + 16 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
    + 32 * (100 * n_echo > 30 * n_words)::BIGINT + 64 * (100 * n_letter < 40 * n_words)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits FROM b
"""
