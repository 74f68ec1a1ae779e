"""Full text by scan: words of a query against the words of a field, row by row, without a shuffle. See ``textindex`` for an index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import text as tx


def analyze(text: str, stop: frozenset[str] = frozenset(), fold: bool = True) -> list[tuple[int, str]]:
    """(position, token) of a query; stop words leave gaps."""
    return [(i, t) for i, t in enumerate(tx.tokens_str(tx.fold_str(text) if fold else text)) if t not in stop]


def analyzed(c: str | Column, fold: bool = True, keep_original: bool = False) -> Column:
    """The tokens of a field. keep_original: both the folded and the written form of each."""
    if keep_original:
        return F.array_distinct(F.concat(tx.tokens(c), tx.folded_tokens(c)))
    return tx.folded_tokens(c) if fold else tx.tokens(c)


def group_tokens(rows: DataFrame) -> DataFrame:
    """Of (pos, token, seq) rows: the distinct forms at each position in the order in which they are met, in order of position."""
    first = rows.groupBy("pos", "token").agg(F.min("seq").alias("seq"))
    forms = F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda x: x["token"])
    return first.groupBy("pos").agg(F.array_join(forms, "|").alias("forms")).orderBy("pos")


def has_all(tokens: Column, terms: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, terms)), tokens)) == 0


def match_all(items: DataFrame, text: str, fields: tuple[str, ...] = ("title", "content")) -> DataFrame:
    """Items with every word of the query in one field; a query of no words matches nothing."""
    terms = list(dict.fromkeys(t for _, t in analyze(text)))
    if not terms:
        return items.where(F.lit(False))
    return items.where(reduce(Column.__or__, [F.coalesce(has_all(tx.folded_tokens(f), terms), F.lit(False)) for f in fields]))


def phrase(c: str | Column, text: str) -> Column:
    """The words of the query one after another. Words have no blanks, so joined words compare as strings."""
    wanted = " ".join(t for _, t in analyze(text))
    if not wanted:
        return F.lit(False)
    return F.contains(F.concat(F.lit(" "), F.array_join(tx.folded_tokens(c), " "), F.lit(" ")), F.lit(f" {wanted} "))
