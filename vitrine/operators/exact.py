"""The exact route over the catalogue's tables. See ``plans.exact`` for its rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import text as tx
from vitrine.operators import filters, listing
from vitrine.operators.textindex import Options, TextIndex
from vitrine.plans.exact import DatePart, DateRange, ExactSpec, Terms, Value
from vitrine.plans.spec import Group, QuerySpec, Unsupported
from vitrine.sources.catalogue import Catalogue

OWN_FIELDS = ("title", "description", "content")


def _typed(v: Column, kind: str) -> Column:
    return {"text": tx.fold, "binary": lambda c: c, "number": lambda c: c.try_cast("double"), "date": lambda c: c.try_cast("date"), "time": lambda c: c.try_cast("timestamp")}[kind](v)


def _holds(v: Column, c: Value) -> Column:
    """Whether a single value fulfils a comparison that isn't about absence."""
    own, lit = _typed(v, c.kind), [_typed(F.lit(str(x)), c.kind) for x in c.values]
    if c.compare in ("LIKE", "NOT LIKE"):
        hit = F.contains(tx.fold(v), tx.fold(F.lit(str(c.values[0]))))
    elif c.compare in ("REGEXP", "RLIKE", "NOT REGEXP"):
        hit = v.rlike(f"(?i){c.values[0]}")
    elif c.compare in ("BETWEEN", "NOT BETWEEN"):
        hit = own.between(*lit)
    elif c.compare in ("IN", "NOT IN", "=", "!="):
        hit = reduce(Column.__or__, [own == x for x in lit])
    else:
        return {">": own > lit[0], ">=": own >= lit[0], "<": own < lit[0], "<=": own <= lit[0]}[c.compare]
    return ~hit if c.compare.startswith("NOT") or c.compare == "!=" else hit


def by_value(items: DataFrame, metadata: DataFrame | None, c: Value) -> DataFrame:
    """Items with some value of the metadatum that fulfils the clause; of NOT EXISTS those without the metadatum."""
    if metadata is None:
        raise Unsupported("no metadata")
    rows = metadata.where(F.col("metadatum_id") == c.key)
    if c.compare in ("EXISTS", "NOT EXISTS"):
        return items.join(rows.select("item_id"), "item_id", "left_anti" if c.compare == "NOT EXISTS" else "left_semi")
    hit = rows.where(F.exists("value_keyword", lambda v: F.coalesce(_holds(v, c), F.lit(False))))
    return items.join(hit.select("item_id"), "item_id", "left_semi")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(tx.fold(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def by_terms(items: DataFrame, taxonomies: DataFrame | None, c: Terms) -> DataFrame:
    if taxonomies is None:
        raise Unsupported("no taxonomies")
    rows = taxonomies.where(F.col("slug") == c.taxonomy)
    if c.operator in ("EXISTS", "NOT EXISTS"):
        return items.join(rows.select("item_id"), "item_id", "left_semi" if c.operator == "EXISTS" else "left_anti")
    terms = {"name": lambda: F.transform("terms", tx.fold), "slug": lambda: F.transform("terms", slug)}.get(c.by, lambda: F.transform("term_ids", lambda t: t.cast("string")))()
    wanted = [(slug if c.by == "slug" else tx.fold)(F.lit(str(t))) if c.by in ("name", "slug") else F.lit(str(int(t))) for t in c.terms]
    if c.operator == "AND":
        return reduce(lambda df, t: df.join(rows.where(F.array_contains(terms, t)).select("item_id"), "item_id", "left_semi"), wanted, items)
    hit = rows.where(F.arrays_overlap(terms, F.array(*wanted))).select("item_id")
    return items.join(hit, "item_id", "left_anti" if c.operator == "NOT IN" else "left_semi")


def _group(items: DataFrame, g: Group, one) -> DataFrame:
    step = lambda df, c: _group(df, c, one) if isinstance(c, Group) else one(df, c)
    if g.relation == "AND":
        return reduce(step, g.clauses, items)
    ids = reduce(DataFrame.union, [step(items.select("item_id"), c) for c in g.clauses])
    return items.join(ids.distinct(), "item_id", "left_semi")


def date_match(c: Group | DatePart | DateRange) -> Column:
    """A predicate of the items' own columns: ranges reach the scan."""
    if isinstance(c, Group):
        return reduce(Column.__and__ if c.relation == "AND" else Column.__or__, map(date_match, c.clauses))
    at = F.col(c.column)
    if isinstance(c, DateRange):
        parts = ([at >= F.lit(c.start)] if c.start else []) + ([at < F.lit(c.end)] if c.end else [])
        return reduce(Column.__and__, parts)
    part = {"year": F.year, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "dayofweek": F.dayofweek, "dayofyear": F.dayofyear}[c.part](at)
    first = c.values[0]
    plain = {"=": part == first, "!=": part != first, ">": part > first, ">=": part >= first, "<": part < first, "<=": part <= first}
    if c.compare in plain:
        return plain[c.compare]
    hit = part.between(*c.values) if "BETWEEN" in c.compare else part.isin(*c.values)
    return ~hit if c.compare.startswith("NOT") else hit


def apply(catalogue: Catalogue, q: ExactSpec) -> DataFrame:
    """The items that a specification matches."""
    items = filters.apply(catalogue, q.base)
    if q.dates:
        items = items.where(date_match(q.dates))
    if q.title is not None:
        items = items.where(tx.fold("title") == tx.fold(F.lit(q.title)))
    if q.authors:
        items = items.where(F.col("author_id").isin(list(q.authors)))
    if q.not_authors:
        items = items.where(~F.col("author_id").isin(list(q.not_authors)))
    for w in q.words:
        folded = tx.fold(F.lit(w))
        some = [(tx.fold(f) == folded) if q.whole else F.contains(tx.fold(f), folded) for f in OWN_FIELDS]
        items = items.where(reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for c in some]))
    if q.meta:
        items = _group(items, q.meta, lambda df, c: by_value(df, catalogue.metadata, c))
    if q.tax:
        items = _group(items, q.tax, lambda df, c: by_terms(df, catalogue.taxonomies, c))
    return items


def page(catalogue: Catalogue, q: ExactSpec) -> DataFrame:
    """The ids of a page. A metadatum sorts by its least value upwards and its greatest downwards."""
    items, order = apply(catalogue, q), []
    for name, ascending in q.sort:
        kind, _, key = name.partition(":")
        if not key:
            order.append((name, ascending))
            continue
        values = catalogue.metadata.where(F.col("metadatum_id") == int(key)).select("item_id", F.explode("value_keyword").alias("v"))  # type: ignore[union-attr]
        least = (F.min if ascending else F.max)(F.col("v").try_cast("double") if kind == "number" else tx.fold("v"))
        items = items.join(values.groupBy("item_id").agg(least.alias(name)), "item_id", "left")
        order.append((name, ascending))
    items = items.orderBy(*listing.sort_columns(tuple(order)))
    if q.base.offset:
        items = items.offset(q.base.offset)
    return (items.limit(q.base.size) if q.base.size > 0 else items).select("item_id")


def answer(catalogue: Catalogue, q: QuerySpec | ExactSpec, index: TextIndex | None = None, options: Options = Options()) -> DataFrame:
    """The page of either route."""
    return page(catalogue, q) if isinstance(q, ExactSpec) else listing.page(catalogue, q, index, options)
