"""Queries of the exact route: listings that an index refuses."""

from __future__ import annotations

from vitrine.operators import exact
from vitrine.operators.textindex import TextIndex
from vitrine.plans import exact as plan
from vitrine.plans.listings import CURATOR, STATUS_SQL, meta
from vitrine.plans.registry import query
from vitrine.sources import catalogue as c

_FOLD = "replace(strip_accents(lower({})), 'ß', 'ss')"


def _orders(spark, sf, ids=True, **args):
    q = plan.plan(args, ("col_orders",), CURATOR)
    if not isinstance(q, plan.ExactSpec):
        raise TypeError("the index answers this")
    return exact.apply(c.orders(spark, sf), q).select("item_id") if ids else exact.page(c.orders(spark, sf), q)


def _parts(spark, sf, ids=True, **args):
    q = plan.plan(args, ("col_part",))
    if not isinstance(q, plan.ExactSpec):
        raise TypeError("the index answers this")
    return exact.apply(c.parts(spark, sf), q).select("item_id") if ids else exact.page(c.parts(spark, sf), q)


@query("exact_regexp", "SELECT p_partkey AS item_id FROM part WHERE regexp_matches(p_brand, 'brand#[1-3]?5$', 'i') AND NOT regexp_matches(p_type, '^(eco|promo)', 'i')")
def exact_regexp(spark, sf):
    return _parts(spark, sf, meta_query=[meta(c.BRAND, "brand#[1-3]?5$", "REGEXP"), meta(c.TYPE, "^(eco|promo)", "NOT REGEXP")])


@query("exact_not_like", "SELECT DISTINCT o_orderkey AS item_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority NOT ILIKE '%specified%' AND l_returnflag NOT ILIKE '%r%'")
def exact_not_like(spark, sf):
    """Some value that isn't like it; items without the metadatum don't count."""
    return _orders(spark, sf, post_status="any", meta_query=[meta(c.PRIORITY, "SPECIFIED", "NOT LIKE"), meta(c.FLAGS, "R", "NOT LIKE")])


@query("exact_not_between", "SELECT o_orderkey AS item_id FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice NOT BETWEEN 20000 AND 400000 OR o_custkey IN (1, 2, 3))")
def exact_not_between(spark, sf):
    clauses = [meta(c.TOTAL, [20000, 400000], "NOT BETWEEN") | {"type": "DECIMAL(12,2)"}, meta(c.CUSTOMER, "1, 2, 3", "IN")]
    return _orders(spark, sf, meta_query={"relation": "OR", "clauses": clauses})


@query("exact_slug", "SELECT p_partkey AS item_id FROM part WHERE list_contains(string_split(p_name, ' '), 'gear') AND NOT list_has_any(string_split(p_name, ' '), ['red', 'blue'])")
def exact_slug(spark, sf):
    by = {"taxonomy": "name_words", "field": "slug"}
    return _parts(spark, sf, tax_query=[by | {"terms": ["Gear"]}, by | {"terms": ["red", "blue"], "operator": "NOT IN"}])


@query(
    "exact_date_query",
    """SELECT o_orderkey AS item_id FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-07-01'
    AND (month(o_orderdate) IN (3, 4) OR dayofmonth(o_orderdate) BETWEEN 10 AND 12)""",
)
def exact_date_query(spark, sf):
    parts = {"relation": "OR", "clauses": [{"month": [3, 4], "compare": "IN"}, {"day": [10, 12], "compare": "BETWEEN"}]}
    return _orders(spark, sf, post_status="any", date_query={"relation": "AND", "clauses": [{"after": "1995-12-31", "before": "1998-07"}, parts]})


@query("exact_date_parts", "SELECT o_orderkey AS item_id FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1997 AND month(o_orderdate) = 5 AND dayofmonth(o_orderdate) > 0 AND o_custkey NOT IN (5, 6)")
def exact_date_parts(spark, sf):
    return _orders(spark, sf, m="199705", author__not_in=[5, 6])


@query("exact_meta_sort", "SELECT o_orderkey AS item_id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 30 OFFSET 5")
def exact_meta_sort(spark, sf):
    return _orders(spark, sf, ids=False, meta_key=c.TOTAL, orderby="meta_value_num", order="DESC", posts_per_page=30, offset=5)


@query(
    "exact_meta_sort_many",
    """SELECT o_orderkey AS item_id FROM orders JOIN (SELECT l_orderkey, min(lower(l_returnflag)) AS v FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    WHERE o_orderstatus = 'F' ORDER BY v ASC, o_custkey DESC, o_orderkey DESC LIMIT 40""",
)
def exact_meta_sort_many(spark, sf):
    """By the least of several values; items without any are left out."""
    return _orders(spark, sf, ids=False, meta_key=c.FLAGS, orderby={"meta_value": "ASC", "author": "DESC"}, posts_per_page=40)


@query("exact_deep_page", f"SELECT o_orderkey AS item_id FROM (SELECT *, {STATUS_SQL} AS s FROM orders) ORDER BY o_orderkey DESC LIMIT 500 OFFSET 11000")
def exact_deep_page(spark, sf):
    """Beyond the index's window of 10,000."""
    return _orders(spark, sf, ids=False, post_status="any", orderby="id", posts_per_page=500, offset=11000)


@query("exact_title", "SELECT p_partkey AS item_id FROM part WHERE lower(p_name) = 'red gear'")
def exact_title(spark, sf):
    return _parts(spark, sf, title="Red GEAR")


@query("exact_sentence", f"SELECT doc_id AS item_id FROM documents WHERE contains({_FOLD.format('text')}, 'cense, ver')")
def exact_sentence(spark, sf):
    """A text as it stands, inside words too."""
    types = tuple(r["post_type"] for r in c.known_post_types(c.texts(spark, sf).items).collect())
    q = plan.plan({"s": "CENSE, Ver", "sentence": True}, types)
    return exact.apply(c.texts(spark, sf), q).select("item_id")  # type: ignore[arg-type]


@query("route_answer", "SELECT p_partkey AS item_id FROM part WHERE p_size > 40 ORDER BY p_partkey DESC LIMIT 20")
def route_answer(spark, sf):
    """What the index can answer goes to it."""
    cat = c.parts(spark, sf)
    q = plan.plan({"meta_query": [meta(c.SIZE, "40", ">")], "orderby": "id", "posts_per_page": 20}, ("col_part",))
    return exact.answer(cat, q, TextIndex.build(cat))
