"""Driver-side rules: arguments, statuses, sorting, windows, routes."""

import pytest

from vitrine.plans import spec
from vitrine.plans.spec import Unsupported, Viewer

TYPES = ("col_a", "col_b")
CURATOR, MEMBER = Viewer(True, frozenset(TYPES)), Viewer(True)


@pytest.mark.parametrize(
    ("requested", "perm", "viewer", "expected"),
    [
        ("", "", MEMBER, ("publish",)),
        (None, "readable", spec.ANONYMOUS, ("publish",)),
        (None, "readable", CURATOR, ("publish", "private")),
        (None, "readable", MEMBER, Unsupported),
        ("any", "", CURATOR, ("publish", "private", "draft")),
        (["trash"], "", CURATOR, Unsupported),
        (["publish", "pending"], "", CURATOR, Unsupported),
        ("publish", "", MEMBER, ("publish",)),
        (["private"], "", spec.ANONYMOUS, ("publish",)),
        (["private"], "", MEMBER, Unsupported),
        (["draft", "private", "draft"], "", CURATOR, ("draft", "private")),
        ("any", "", spec.ANONYMOUS, ("publish",)),
    ],
)
def test_status_table(requested, perm, viewer, expected):
    if expected is Unsupported:
        with pytest.raises(Unsupported):
            spec.resolve_statuses(requested, perm, TYPES, viewer)
    else:
        assert spec.resolve_statuses(requested, perm, TYPES, viewer) == expected


def test_private_needs_every_type():
    with pytest.raises(Unsupported):
        spec.resolve_statuses("private", "", TYPES, Viewer(True, frozenset({"col_a"})))


@pytest.mark.parametrize("args", [{"date_query": {"year": 2020}}, {"title": "0"}, {"has_password": False}, {"s": "  "}, {"s": "x", "sentence": 1}, {"author__in": [1, 2], "author": 1}])
def test_unmodelled_refused(args):
    with pytest.raises(Unsupported):
        spec.build(args, TYPES)


@pytest.mark.parametrize("args", [{"m": 0}, {"year": "0"}, {"sentence": 1}, {"author__in": [3], "author": 3}, {"title": ""}])
def test_unset_passes(args):
    assert spec.build(args, TYPES).post_types == TYPES


def test_strict_refuses_unknown():
    assert spec.build({"unknown": 1}, TYPES)
    with pytest.raises(Unsupported):
        spec.build({"unknown": 1}, TYPES, strict=True)
    assert spec.build({"unknown": "", "fields": "ids"}, TYPES, strict=True)
    with pytest.raises(Unsupported):
        spec.build({}, ())


@pytest.mark.parametrize(
    "clause",
    [
        {"key": "color", "value": 1}, {"key": 1}, {"key": 1, "value": [], "compare": "IN"}, {"key": 1, "value": "x", "compare": "REGEXP"}, {"key": 1, "value": "x", "compare": ">"},
        {"key": 1, "value": [1], "compare": "BETWEEN"}, {"key": 1, "value": [1, "x"], "compare": "BETWEEN"}, {"key": 1, "value": " ", "compare": "LIKE"}, {"key": 1, "value": "x", "compare": "NOT LIKE"},
    ],
)
def test_meta_refused(clause):
    with pytest.raises(Unsupported):
        spec.build({"meta_query": [{"key": 2, "value": 3}, clause]}, TYPES)


@pytest.mark.parametrize("clause", [{"taxonomy": ""}, {"taxonomy": "t", "terms": [1], "field": "slug"}, {"taxonomy": "t", "terms": [1], "field": "term_taxonomy_id"}, {"taxonomy": "t"}, {"taxonomy": "t", "terms": [1], "operator": "LIKE"}])
def test_tax_refused(clause):
    with pytest.raises(Unsupported):
        spec.build({"tax_query": [clause]}, TYPES)


def test_groups():
    assert spec.build({"meta_query": [{"value": 1}, "x"]}, TYPES).meta is None
    with pytest.raises(Unsupported):
        spec.build({"meta_query": {"relation": "XOR", "clauses": [{"key": 1, "value": 1}]}}, TYPES)
    g = spec.build({"meta_query": {"relation": "or", "clauses": [{"key": 1, "value": 1}, {"relation": "AND", "clauses": [{"key": "2", "compare": "exists"}]}]}}, TYPES).meta
    assert g.relation == "OR" and g.clauses[1].clauses[0] == spec.Meta(2, None, "EXISTS")


def test_sort_shapes():
    assert spec.resolve_sort() == (("date_created", False),)
    assert spec.resolve_sort(has_text=True) == (("score", False),)
    assert spec.resolve_sort("title ID", "asc") == (("title", True), ("item_id", True))
    assert spec.resolve_sort({"date": "DESC", "ID": "up"}, "ASC") == (("date_created", False), ("item_id", True))
    assert spec.resolve_sort("relevance", "ASC") == (("score", False),)
    for bad in ("rand", "title meta_value", " "):
        with pytest.raises(Unsupported):
            spec.resolve_sort(bad)


def test_window():
    assert spec.resolve_window({}) == (0, 10)
    assert spec.resolve_window({"posts_per_page": 20, "paged": 3}) == (40, 20)
    assert spec.resolve_window({"posts_per_page": 20, "paged": 3, "offset": 5}) == (5, 20)
    for bad in ({"posts_per_page": -1}, {"nopaging": True}, {"posts_per_page": 10, "offset": 9991}):
        with pytest.raises(Unsupported):
            spec.resolve_window(bad)
    assert spec.resolve_window({"posts_per_page": -1}, "exact") == (0, -1)
    assert spec.resolve_window({"posts_per_page": 10, "offset": 20_000}, "exact") == (20_000, 10)


def test_route():
    known = ("col_a", "col_b")
    assert spec.route({"post_type": "col_a"}, known) == "indexed"
    for args in ({"post_type": "any"}, {}, {"post_type": ["col_a", "page"]}, {"post_type": "col_a", "p": 7}, {"post_type": "col_a", "fields": "id=>parent"}, {"post_type": "col_a", "suppress_filters": True}):
        assert spec.route(args, known) == "exact"
    assert spec.route({"post_type": "col_a"}, known, searching=False) == "exact"


@pytest.mark.parametrize("key", ["1.5", "nan", "inf", "x"])
def test_keys_that_are_no_ids(key):
    with pytest.raises(Unsupported):
        spec.build({"meta_query": [{"key": key, "value": 1}]}, TYPES)


@pytest.mark.parametrize("route", ["indexed", "exact"])
def test_filters_that_nothing_applies(route):
    with pytest.raises(Unsupported):
        spec.build({"date_query": [{"year": 2020}]}, TYPES, route=route)
