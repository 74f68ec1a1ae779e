"""Search vocabulary: lists are parsed, normalised and compiled into rules by Column expressions.

Lists are a table (list, line, text). A rule that can't be read becomes an error row; nothing is dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.text import clean_term, fold, lists_signature, split_terms

#: The lists, in the order in which they are read, and their limits.
LISTS = ("synonyms", "variants", "corrections", "stopwords")
MAX_RULES, MAX_STOPWORDS, MAX_TERM = 20_000, 2_000, 80
ERRORS_SHOWN = 200


def lines(lists: DataFrame) -> DataFrame:
    """Of (list, text): its lines that are no comments, numbered from 1."""
    plain = F.regexp_replace("text", "\r\n?", "\n")
    out = lists.select("list", F.posexplode(F.split(plain, "\n")).alias("line", "text"))
    return out.select("list", (F.col("line") + 1).alias("line"), F.trim("text", F.lit(" \t")).alias("text")).where((F.col("text") != "") & ~F.startswith("text", F.lit("#")))


def _union(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(a, b))


def parse(rows: DataFrame) -> DataFrame:
    """Of lines: type map or equiv, left, right, or an error. Corrections keep what was typed on the right as well."""
    arrow = F.regexp_replace(F.regexp_replace("text", "→", "=>"), "->", "=>")
    has = F.contains(arrow, F.lit("=>"))
    left = split_terms(F.when(has, F.substring_index(arrow, "=>", 1)).otherwise(arrow))
    right = F.when(has, split_terms(F.substr(arrow, F.instr(arrow, "=>") + 2))).otherwise(F.array().cast("array<string>"))
    df = rows.where("list <> 'stopwords'").withColumns({"has": has, "left": left, "typed": right})
    df = df.withColumn("right", F.when(F.col("has") & (F.col("list") == "corrections"), _union(F.col("left"), F.col("typed"))).otherwise(F.col("typed")))
    long = F.exists(F.concat("left", "typed"), lambda t: F.char_length(t) > MAX_TERM)
    same = (F.size(F.array_except("left", "right")) == 0) & (F.size(F.array_except("right", "left")) == 0)
    error = (
        F.when(long, "long term")
        .when(F.col("has") & ((F.size("left") == 0) | (F.size("typed") == 0)), "a side is empty")
        .when(F.col("has") & same, "sides are equal")
        .when(~F.col("has") & (F.col("list") == "corrections"), "arrow required")
        .when(~F.col("has") & (F.size("left") < 2), "fewer than two terms")
    )
    return df.select("list", "line", "text", F.when(F.col("has"), "map").otherwise("equiv").alias("type"), "left", "right", error.alias("error"))


def rules(parsed: DataFrame) -> DataFrame:
    """Rules without errors, the first of equal ones across lists."""
    order = F.array_position(F.array(*map(F.lit, LISTS)), F.col("list"))
    sides = [F.array_join("left", ","), F.array_join("right", ",")]
    first = F.row_number().over(Window.partitionBy("type", *sides).orderBy(order, "line"))
    return parsed.where("error IS NULL").withColumn("n", first).where("n = 1").drop("n", "error")


def stopwords(rows: DataFrame) -> DataFrame:
    """word (folded) and error of the stop-word list: one word at a time."""
    each = rows.where("list = 'stopwords'").select("line", F.explode(F.split("text", r"[,;\t]+")).alias("w")).select("line", clean_term("w").alias("w")).where("w <> ''")
    spaced = F.contains("w", F.lit(" "))
    return each.select(F.when(~spaced, fold("w")).alias("word"), F.when(spaced, "one word only").alias("error"), "line").groupBy("word", "error").agg(F.min("line").alias("line"))


def report(parsed: DataFrame) -> DataFrame:
    """rules, duplicates and errors by list."""
    kept = rules(parsed).groupBy("list").agg(F.count(F.lit(1)).alias("rules"))
    counts = parsed.groupBy("list").agg(F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("error").isNull()).alias("good"))
    return counts.join(kept, "list", "left").select("list", F.coalesce("rules", F.lit(0)).alias("rules"), (F.col("good") - F.coalesce("rules", F.lit(0))).alias("duplicates"), "errors")


def normalize(term: Column, stop: tuple[str, ...] = ()) -> Column:
    """A term as the search sees it: folded words without stop words, joined by blanks."""
    found = F.regexp_extract_all(fold(term), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.filter(found, lambda w: ~w.isin(*stop)) if stop else found, " ")


def compiled(kept: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """list, line, rule (``a, b`` or ``a => b``) and note of what normalising dropped; a rule without effect has no rule text."""
    fixed = lambda c: F.array_distinct(F.filter(F.transform(c, lambda t: normalize(t, stop)), lambda t: t != ""))
    df = kept.withColumns({"l": fixed("left"), "r": fixed("right")})
    usable = F.when(F.col("type") == "equiv", F.size("l") >= 2).otherwise((F.size("l") > 0) & (F.size("r") > 0) & (F.col("l") != F.col("r")))
    text = F.when(F.col("type") == "equiv", F.array_join("l", ", ")).otherwise(F.concat(F.array_join("l", ", "), F.lit(" => "), F.array_join("r", ", ")))
    lost = F.exists(F.concat("left", "right"), lambda t: normalize(t, stop) == "")
    note = F.when(~usable, "no effect").when(lost, "term of stop words dropped")
    return df.select("list", "line", F.when(usable, text).alias("rule"), note.alias("note"))


def pending(lists: dict[str, str], applied_hash: str | None, spark) -> bool:
    """Whether the lists differ from what was applied; empty lists that were never applied do not."""
    row = spark.createDataFrame([tuple(lists.get(k, "") for k in LISTS)], [*LISTS]).select(lists_signature(*LISTS).alias("h")).first()
    return row["h"] != applied_hash if applied_hash else any(v.strip() for v in lists.values())


def apply(lists: DataFrame, stop: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Compiled rules and stop words, or ValueError with the errors, nothing being changed then."""
    parsed = parse(lines(lists))
    words = stopwords(lines(lists))
    bad = [f"{r['list']}:{r['line']} {r['error']}" for r in parsed.where("error IS NOT NULL").limit(ERRORS_SHOWN).collect()]
    bad += [f"stopwords:{r['line']} {r['error']}" for r in words.where("error IS NOT NULL").limit(ERRORS_SHOWN).collect()]
    kept = rules(parsed)
    if kept.limit(MAX_RULES + 1).count() > MAX_RULES:
        bad.append(f"more than {MAX_RULES} rules")
    if words.limit(MAX_STOPWORDS + 1).count() > MAX_STOPWORDS:
        bad.append(f"more than {MAX_STOPWORDS} stop words")
    if bad:
        raise ValueError("; ".join(bad[:ERRORS_SHOWN]))
    own = tuple(r["word"] for r in words.collect())  # at most MAX_STOPWORDS
    return compiled(kept, (*stop, *own)).where("rule IS NOT NULL"), words.select("word")
