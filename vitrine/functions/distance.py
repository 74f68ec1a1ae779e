"""Edit distance with swaps of neighbours, as expressions, and words found by the letters that edits leave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import col

WHOLE, HALVED = 8, 6  # letters up to which a word is found whole, and from which by its halves


def damerau(a: str, b: str) -> int:
    """Insertions, deletions, replacements, and swaps of neighbours, no letter edited twice. On the driver, for tests."""
    two, one = [], list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            cost = a[i - 1] != b[j - 1]
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + cost)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def one_edit(a: str | Column, b: str | Column) -> Column:
    """Whether two words are one edit apart, a swap of neighbours being one."""
    a, b = col(a), col(b)
    n = F.char_length(a)
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.left(a, i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)
    return (a != b) & ((F.levenshtein(a, b) == 1) | ((n == F.char_length(b)) & (F.levenshtein(a, b) == 2) & swapped))


def distance(a: str | Column, b: str | Column) -> Column:
    """The distance of two words that aren't empty: a row of the table of prefixes for each letter, the last two kept."""
    a, b = col(a), col(b)
    letter = lambda w, i: F.substr(w, i, F.lit(1))

    def row(acc: Column, i: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            plain = F.least(F.get(acc["one"], j) + 1, F.get(done, j - 1) + 1, F.get(acc["one"], j - 1) + F.when(letter(a, i) == letter(b, j), 0).otherwise(1))
            swap = (i > 1) & (j > 1) & (letter(a, i) == letter(b, j - 1)) & (letter(a, i - 1) == letter(b, j))
            return F.concat(done, F.array(F.when(swap, F.least(plain, F.get(acc["two"], j - 2) + 1)).otherwise(plain)))

        return F.struct(acc["one"].alias("two"), F.aggregate(F.sequence(F.lit(1), F.char_length(b)), F.array(i), cell).alias("one"))

    first = F.struct(F.array().cast("array<int>").alias("two"), F.sequence(F.lit(0), F.char_length(b)).alias("one"))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(a)), first, row, lambda acc: F.get(acc["one"], F.char_length(b)))


def shared_rows(words: DataFrame, word: str = "key") -> DataFrame:
    """(d, word): what each word is found by, without some of its letters.

    Up to WHOLE letters: its first letter with the rest, whole and without each of its letters, for one edit. From HALVED
    letters: the same of either half, with the word's length: of two edits one half has one at most."""
    w = F.col(word)
    n, first = F.char_length(w), F.substring(w, 1, 1)
    h = F.floor(n / 2).cast("int")
    sized = lambda side: F.concat(F.lit(side), n.cast("string"), F.lit(":"), first)
    parts = [
        words.where(n <= WHOLE).select(word, first.alias("head"), F.substr(w, F.lit(2)).alias("rest")),
        words.where(n >= HALVED).select(word, sized("<").alias("head"), F.substr(w, F.lit(2), h - 1).alias("rest")),
        words.where(n >= HALVED).select(word, sized(">").alias("head"), F.substr(w, h + 1).alias("rest")),
    ]
    each = reduce(DataFrame.unionByName, parts).select(word, "head", "rest", F.explode(F.sequence(F.lit(0), F.char_length("rest"))).alias("i"))
    less = F.when(F.col("i") == 0, F.col("rest")).otherwise(F.concat(F.left("rest", F.col("i") - 1), F.substr("rest", F.col("i") + 1)))
    return each.select(F.concat("head", less).alias("d"), word)


def _less(word: str) -> set[str]:
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def keys_of(word: str, edits: int) -> list[str]:
    """Under which keys the words lie that are so many edits from one, its first letter kept: one edit for up to WHOLE - 1 letters, two from HALVED + 2 on."""
    if edits < 2:
        return sorted({word[0] + d for d in _less(word[1:])} if edits else {word[0] + word[1:]})
    out = set()
    for n in range(len(word) - 2, len(word) + 3):  # letters of the other word, whose halves are known then
        h = n // 2
        for shift in (-1, 0, 1):  # one edit moves the half's end by one at most
            out |= {f"<{n}:{word[0]}{d}" for d in _less(word[1 : max(1, h + shift)])}
            out |= {f">{n}:{word[0]}{d}" for d in _less(word[max(1, len(word) - (n - h) - shift) :])}
    return sorted(out)
