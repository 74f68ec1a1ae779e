"""Item filters as id-set algebra: AND is a semi join, NOT an anti join, OR a union of ids.

Conditions on items stay plain predicates and reach the scan; conditions on entries select entry rows first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import text as tx
from vitrine.plans.spec import Group, Meta, QuerySpec, Tax, Unsupported, numeric
from vitrine.sources.catalogue import Catalogue

NEGATED = {"!=": "=", "NOT IN": "IN", "NOT EXISTS": "EXISTS"}


def _values(value: object) -> list[str]:
    return [str(v) for v in (value if isinstance(value, (list, tuple)) else [value])]


def meta_match(c: Meta) -> Column:
    """Which entry rows a positive clause matches."""
    own = F.col("metadatum_id") == int(c.key)
    if c.compare == "EXISTS":
        return own
    if c.compare in ("=", "IN"):
        values = _values(c.value)
        hit = F.arrays_overlap("value_keyword", F.array(*map(F.lit, values)))
        ids = [int(v) for v in values if v.isascii() and v.isdigit()]
        if ids:
            hit = F.coalesce(hit, F.lit(False)) | F.coalesce(F.arrays_overlap("value_ids", F.array(*[F.lit(i).cast("long") for i in ids])), F.lit(False))
        return own & hit
    if c.compare == "LIKE":
        phrase = " " + " ".join(tx.tokens_str(tx.fold_str(str(c.value)))) + " "
        return own & F.contains(F.concat(F.lit(" "), F.array_join(tx.folded_tokens("value_text"), " "), F.lit(" ")), F.lit(phrase))
    if c.compare == "BETWEEN":
        low, high = map(numeric, c.value)  # type: ignore[arg-type]
        return own & F.col("value_number").between(low, high)
    operand = F.lit(numeric(c.value))
    number = F.col("value_number")
    return own & {">": number > operand, ">=": number >= operand, "<": number < operand, "<=": number <= operand}[c.compare]


def tax_match(c: Tax, terms: tuple | None = None) -> Column:
    own = F.col("slug") == c.taxonomy
    if c.operator in ("EXISTS", "NOT EXISTS"):
        return own
    some = c.terms if terms is None else terms
    if c.by == "name":
        return own & F.arrays_overlap("terms", F.array(*[F.lit(str(t)) for t in some]))
    return own & F.arrays_overlap("term_ids", F.array(*[F.lit(int(t)).cast("long") for t in some]))


def _ids(entries: DataFrame | None, match: Column) -> DataFrame:
    if entries is None:
        raise Unsupported("no such entries")
    return entries.where(match).select("item_id")


def by_meta(items: DataFrame, metadata: DataFrame | None, c: Meta) -> DataFrame:
    positive = Meta(c.key, c.value, NEGATED.get(c.compare, c.compare))
    return items.join(_ids(metadata, meta_match(positive)), "item_id", "left_anti" if c.compare in NEGATED else "left_semi")


def by_tax(items: DataFrame, taxonomies: DataFrame | None, c: Tax) -> DataFrame:
    if c.operator == "AND":  # each term in some entry of the item
        return reduce(lambda df, t: df.join(_ids(taxonomies, tax_match(c, (t,))), "item_id", "left_semi"), c.terms, items)
    return items.join(_ids(taxonomies, tax_match(c)), "item_id", "left_anti" if c.operator in ("NOT IN", "NOT EXISTS") else "left_semi")


def by_group(items: DataFrame, entries: DataFrame | None, g: Group) -> DataFrame:
    def one(df: DataFrame, c: object) -> DataFrame:
        if isinstance(c, Group):
            return by_group(df, entries, c)
        return by_meta(df, entries, c) if isinstance(c, Meta) else by_tax(df, entries, c)  # type: ignore[arg-type]

    if g.relation == "AND":
        return reduce(one, g.clauses, items)
    ids = reduce(lambda a, b: a.union(b), [one(items.select("item_id"), c) for c in g.clauses])
    return items.join(ids.distinct(), "item_id", "left_semi")


MANY = 1000  # ids beyond which a list is joined instead of written into the predicate


def by_ids(items: DataFrame, ids: tuple[int, ...], include: bool = True) -> DataFrame:
    if not ids:
        return items
    if len(ids) <= MANY:
        hit = F.col("item_id").isin(list(ids))
        return items.where(hit if include else ~hit)
    rows = items.sparkSession.createDataFrame([(i,) for i in ids], "item_id bigint")
    return items.join(rows, "item_id", "left_semi" if include else "left_anti")


def apply(catalogue: Catalogue, q: QuerySpec) -> DataFrame:
    """The items that a specification matches, its text left to the search operators."""
    items = catalogue.items.where(F.col("post_type").isin(list(q.post_types)) & F.col("post_status").isin(list(q.statuses)))
    items = by_ids(by_ids(items, q.ids), q.not_ids, include=False)
    if q.author is not None:
        items = items.where(F.col("author_id") == q.author)
    if q.meta:
        items = by_group(items, catalogue.metadata, q.meta)
    if q.tax:
        items = by_group(items, catalogue.taxonomies, q.tax)
    return items


def referrers(metadata: DataFrame, item: int, most: int | None = None) -> DataFrame:
    """Items that refer to an item, itself left out: all of them, or those of the smallest ids, with one row more than asked where there are more."""
    found = metadata.where(F.array_contains("value_ids", F.lit(item).cast("long")) & (F.col("item_id") != item)).select("item_id").distinct()
    return found if most is None else found.orderBy("item_id").limit(most + 1)


def item_type(items: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose type has an item type's form and is known."""
    return items.where(F.col("post_type").rlike(r"^tnc_col_\d+_item$")).join(known.select("post_type"), "post_type", "left_semi")
