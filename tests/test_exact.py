"""The exact route's arguments and its edges; its queries are held against SQL in test_queries."""

import datetime as dt

import pytest

from vitrine.operators import exact
from vitrine.plans.exact import ExactSpec, build, plan
from vitrine.plans.spec import QuerySpec, Unsupported
from vitrine.sources import catalogue as c


def ids(df):
    return sorted(r["item_id"] for r in df.select("item_id").collect())


@pytest.fixture(scope="module")
def cat(spark):
    at = lambda *a: dt.datetime(*a)
    items = [(1, "a", "publish", "Ação", None, "Arte do Río", 5, at(2020, 1, 1), None), (2, "a", "publish", "x", "artes", None, 6, at(2020, 1, 31, 23, 59, 59), at(2021, 1, 1)), (3, "a", "publish", None, None, "", 7, at(2020, 2, 1), None), (4, "a", "publish", "y", None, None, 8, None, None)]
    meta = [(1, 7, "", ["10", "9"], None, None), (2, 7, "", ["Éa"], None, None), (3, 7, "", [], None, None), (1, 8, "", ["2020-05-01"], None, None), (2, 8, "", ["2020-06-01"], None, None)]
    tax = [(1, "t", ["Belas Artes"], [1]), (1, "t", ["b"], [2]), (2, "t", ["b"], [2])]
    return c.Catalogue(spark.createDataFrame(items, c.ITEM), spark.createDataFrame(meta, c.METADATA), spark.createDataFrame(tax, c.TAXONOMIES))


def got(cat, **args):
    return ids(exact.apply(cat, build(args, ("a",))))


def m(key, value=None, compare=None, kind=None):
    return [{k: v for k, v in (("key", key), ("value", value), ("compare", compare), ("type", kind)) if v is not None}]


def test_values(cat):
    assert got(cat, meta_query=m(7, "ea", "LIKE")) == [2] and got(cat, meta_query=m(7, "ea", "NOT LIKE")) == [1]
    assert got(cat, meta_query=m(7, "^1", "REGEXP")) == [1] and got(cat, meta_query=m(7, "^1", "NOT REGEXP")) == [1, 2]
    assert got(cat, meta_query=m(7, "9", ">", "NUMERIC")) == [1] and got(cat, meta_query=m(7, "95", ">")) == [2]  # as texts "10" and "9" come before "95"
    assert got(cat, meta_query=m(7, [1, 9.5], "BETWEEN", "NUMERIC")) == [1] and got(cat, meta_query=m(7, "9,10", "NOT BETWEEN", "NUMERIC")) == []
    assert got(cat, meta_query=m(7, "10", "!=")) == [1, 2] and got(cat, meta_query=m(7, ["10", "9"], "NOT IN")) == [2]
    assert got(cat, meta_query=m(7)) == [1, 2, 3] and got(cat, meta_query=m(7, compare="NOT EXISTS")) == [4]
    assert got(cat, meta_query=m(8, "2020-05-15", "<", "DATE")) == [1] and got(cat, meta_query=m(7, "2020-05-15", "<", "DATE")) == []
    assert got(cat, meta_key=7, meta_value="éA") == [2] and got(cat, meta_key=7, meta_value_num=9) == [1]


def test_terms(cat):
    t = lambda **k: [{"taxonomy": "t", **k}]
    assert got(cat, tax_query=t(terms="belas-artes", field="slug")) == [1] and got(cat, tax_query=t(terms=["belas artes"], field="name")) == [1]
    assert got(cat, tax_query=t(terms=["belas-artes", "b"], field="slug", operator="AND")) == [1]
    assert got(cat, tax_query=t(terms=[2], operator="NOT IN")) == [3, 4] and got(cat, tax_query=t(operator="NOT EXISTS")) == [3, 4]


def test_dates(cat):
    assert got(cat, date_query=[{"after": "2020-01"}]) == [3] and got(cat, date_query=[{"after": "2020-01", "inclusive": True}]) == [1, 2, 3]
    assert got(cat, date_query=[{"before": "2020-01-31"}]) == [1] and got(cat, date_query=[{"before": "2020-01-31", "inclusive": True}]) == [1, 2]
    assert got(cat, date_query=[{"after": "2020-01-31 23:59:59"}]) == [3] and got(cat, date_query=[{"year": 2020, "month": 1, "compare": "!="}]) == []
    assert got(cat, date_query=[{"column": "post_modified", "year": 2021}]) == [2] and got(cat, m="20200131") == [2] and got(cat, year=2020, monthnum=2) == [3]
    assert got(cat, date_query={"relation": "OR", "clauses": [{"month": 2}, {"day": [1, 1], "compare": "NOT BETWEEN"}]}) == [2, 3]


def test_words(cat):
    assert got(cat, s="ART rio", title=None) == [1] and got(cat, s="arte") == [1, 2] and got(cat, s="arte do", sentence=True) == [1]
    assert got(cat, s="ACAO", exact=True) == [1] and got(cat, s="aca", exact=True) == [] and got(cat, title="acao") == [1]
    assert got(cat, author__in=[5, 7]) == [1, 3] and got(cat, author__not_in=[5]) == [2, 3, 4]


def test_pages(cat):
    page = lambda **a: [r["item_id"] for r in exact.page(cat, build(a, ("a",))).collect()]
    assert page(meta_key=7, orderby="meta_value_num", order="ASC") == [1, 3, 2]  # no number comes last, no such metadatum not at all
    assert page(meta_key=7, orderby={"meta_value": "DESC"}) == [2, 1, 3]
    assert page(orderby="id", order="ASC", posts_per_page=-1) == [1, 2, 3, 4] and page(orderby="id", order="ASC", posts_per_page=2, offset=20_000) == []
    assert page(s="arte") == [2, 1]  # newest first: there is no relevance


def test_routes():
    assert isinstance(plan({"orderby": "id"}, ("a",)), QuerySpec)
    for args in ({"posts_per_page": 100, "offset": 10_000}, {"meta_query": m(7, "x", "REGEXP")}, {"tax_query": [{"taxonomy": "t", "terms": "x", "field": "slug"}]}, {"orderby": "meta_value", "meta_key": 7}, {"date_query": [{"year": 2020}]}, {"nopaging": True}):
        assert isinstance(plan(args, ("a",)), ExactSpec)
    for args in ({"post_parent": 5}, {"meta_query": m("title", "x")}, {"meta_query": m(7, "x", "SOUNDS LIKE")}, {"orderby": "rand"}, {"date_query": [{"after": "soon"}]}, {"orderby": "meta_value"}):
        with pytest.raises(Unsupported):
            plan(args, ("a",))
