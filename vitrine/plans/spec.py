"""What a listing asks for, checked on the driver: arguments in, a specification or Unsupported out.

Two routes answer a specification. ``indexed`` takes only what a search index reproduces exactly and raises
Unsupported for the rest; ``exact`` has no result window and pages without end. Arguments that nothing here applies are
Unsupported on both.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

#: Statuses that the index holds.
INDEXED_STATUSES = ("publish", "private", "draft")
#: Arguments that narrow a result and are not modelled.
UNMODELLED = (
    "meta_key meta_value meta_value_num date_query m year monthnum day w hour minute second post_parent post_parent__in post_parent__not_in title author_name "
    "author__not_in cat category_name category__in category__and category__not_in tag tag_id tag__in tag__and tag__not_in tag_slug__in tag_slug__and sentence exact "
    "has_password post_password comment_count menu_order post_mime_type search_columns"
).split()
#: Of those, the ones that 0 leaves unset.
ZERO_IS_UNSET = "m year monthnum day w hour minute second post_parent cat tag_id".split()
#: Arguments that are modelled, and those that change only order, window or shape.
HANDLED = "post_type post_status perm s meta_query tax_query author post__in post__not_in".split()
IGNORABLE = (
    "fields paged offset number perpage posts_per_page posts_per_archive_page nopaging no_found_rows order orderby cache_results update_post_meta_cache "
    "update_post_term_cache lazy_load_term_meta suppress_filters ignore_sticky_posts"
).split()
SORT_KEYS = {
    "relevance": "score", "date": "date_created", "post_date": "date_created", "modified": "date_modified", "post_modified": "date_modified",
    "id": "item_id", "post_id": "item_id", "author": "author_id", "title": "title", "post_title": "title",
}
RESULT_WINDOW = 10_000
PER_PAGE = 10


class Unsupported(Exception):
    """The index can't reproduce this; the exact route may."""


@dataclass(frozen=True)
class Viewer:
    logged_in: bool = False
    reads_private: frozenset[str] = frozenset()

    def may_read_private(self, post_types: tuple[str, ...]) -> bool:
        return bool(post_types) and self.logged_in and set(post_types) <= self.reads_private


ANONYMOUS = Viewer()


@dataclass(frozen=True)
class Meta:
    key: int | str
    value: object = None
    compare: str = "="


@dataclass(frozen=True)
class Tax:
    taxonomy: str
    terms: tuple = ()
    by: str = "term_id"
    operator: str = "IN"


@dataclass(frozen=True)
class Group:
    clauses: tuple = ()
    relation: str = "AND"


@dataclass(frozen=True)
class QuerySpec:
    post_types: tuple[str, ...]
    statuses: tuple[str, ...] = ("publish",)
    text: str = ""
    meta: Group | None = None
    tax: Group | None = None
    ids: tuple[int, ...] = ()
    not_ids: tuple[int, ...] = ()
    author: int | None = None
    sort: tuple[tuple[str, bool], ...] = (("date_created", False),)  # column, ascending
    offset: int = 0
    size: int = PER_PAGE
    options: dict = field(default_factory=dict, compare=False)


def _unset(value: object) -> bool:
    return value is None or value == "" or (isinstance(value, (list, tuple, dict)) and not value)


def numeric(x: object) -> float | None:
    if isinstance(x, bool) or x is None:
        return None
    try:
        return float(str(x))
    except ValueError:
        return None


def check_unmodelled(args: dict) -> None:
    """Refuse arguments that would narrow the result but are not passed on."""
    text = args.get("s")
    if isinstance(text, str) and text != "" and not text.strip():
        raise Unsupported("blank search")
    for name in UNMODELLED:
        value = args.get(name)
        if _unset(value) or (name in ZERO_IS_UNSET and str(value) == "0"):
            continue
        if name in ("sentence", "exact") and not (text or "").strip():
            continue
        raise Unsupported(name)
    only = args.get("author__in")
    if only and [int(x) for x in only] != [int(args.get("author") or 0)]:
        raise Unsupported("author__in")


def resolve_statuses(requested: object, perm: str = "", post_types: tuple[str, ...] = (), viewer: Viewer = ANONYMOUS) -> tuple[str, ...]:
    """The statuses that this viewer gets."""
    readable = viewer.may_read_private(post_types)
    if _unset(requested):
        if not str(perm or "").strip() or not viewer.logged_in:
            return ("publish",)
        if readable:
            return ("publish", "private")
        raise Unsupported("own private items")
    asked = [requested] if isinstance(requested, str) else [str(x) for x in requested]
    if "any" in asked:
        asked = list(INDEXED_STATUSES)
    if other := [x for x in asked if x not in INDEXED_STATUSES]:
        raise Unsupported(f"status {other[0]}")
    asked = list(dict.fromkeys(asked))
    if set(asked) == {"publish"}:
        return ("publish",)
    if not viewer.logged_in:
        return ("publish",)
    if not readable:
        raise Unsupported("own private items")
    return tuple(asked)


def _group(raw: object, leaf) -> Group | None:
    """Of nested {relation, clauses} dicts or plain lists; clauses without a key are passed over."""
    if not raw:
        return None
    clauses = raw.get("clauses", []) if isinstance(raw, dict) else list(raw)
    relation = str(raw.get("relation", "AND")).upper() if isinstance(raw, dict) else "AND"
    if relation not in ("AND", "OR"):
        raise Unsupported(f"relation {relation}")
    out = []
    for c in clauses:
        if isinstance(c, dict) and ("clauses" in c or "relation" in c):
            if (g := _group(c, leaf)) and g.clauses:
                out.append(g)
        elif isinstance(c, dict) and (made := leaf(c)) is not None:
            out.append(made)
    return Group(tuple(out), relation) if out else None


def _meta(c: dict) -> Meta | None:
    if "key" not in c:
        return None
    made = Meta(c["key"], c.get("value"), str(c.get("compare", "=")).strip().upper())
    check_meta(made)
    return Meta(int(numeric(made.key)), made.value, made.compare)


def check_meta(c: Meta) -> None:
    """What the index can't answer of a metadata clause."""
    number = numeric(c.key)
    if number is None or not math.isfinite(number) or number != int(number):
        raise Unsupported("raw key")
    values = c.value if isinstance(c.value, (list, tuple)) else [c.value]
    if c.compare in ("=", "IN", "!=", "NOT IN"):
        if c.value is None or not values:
            raise Unsupported("no value")
    elif c.compare == "LIKE":
        if isinstance(c.value, (list, tuple, dict)) or not str(c.value or "").strip():
            raise Unsupported("blank LIKE")
    elif c.compare in (">", ">=", "<", "<="):
        if numeric(c.value) is None:
            raise Unsupported("range of no number")
    elif c.compare == "BETWEEN":
        if not isinstance(c.value, (list, tuple)) or len(values) != 2 or None in map(numeric, values):
            raise Unsupported("BETWEEN of no two numbers")
    elif c.compare not in ("EXISTS", "NOT EXISTS"):
        raise Unsupported(f"compare {c.compare}")


def _tax(c: dict) -> Tax | None:
    if "taxonomy" not in c:
        return None
    terms = c.get("terms", ())
    made = Tax(str(c["taxonomy"]), tuple(terms) if isinstance(terms, (list, tuple)) else (terms,), str(c.get("field", "term_id")).strip().lower(), str(c.get("operator", "IN")).strip().upper())
    check_tax(made)
    return made


def check_tax(c: Tax) -> None:
    if not c.taxonomy:
        raise Unsupported("no taxonomy")
    if c.operator in ("EXISTS", "NOT EXISTS"):
        return
    if c.by not in ("term_id", "id", "name"):
        raise Unsupported(f"terms by {c.by}")
    if not c.terms or c.terms == (None,):
        raise Unsupported("no terms")
    if c.operator not in ("IN", "NOT IN", "AND"):
        raise Unsupported(f"operator {c.operator}")


def resolve_sort(orderby: object = None, order: str = "", has_text: bool = False) -> tuple[tuple[str, bool], ...]:
    """Sort columns with their directions. A string of keys shares one direction; a map has one for each."""
    up = str(order or "").strip().upper() == "ASC"
    if not orderby:
        orderby = "relevance" if has_text else "date"
    pairs = [(k, {"ASC": True, "DESC": False}.get(str(d).strip().upper(), up)) for k, d in orderby.items()] if isinstance(orderby, dict) else [(k, up) for k in str(orderby).split()]
    out = []
    for key, ascending in pairs:
        if (column := SORT_KEYS.get(str(key).strip().lower())) is None:
            raise Unsupported(f"order by {key}")
        out.append((column, ascending and column != "score"))
    if not out:
        raise Unsupported("no order")
    return tuple(out)


def resolve_window(args: dict, route: str = "indexed") -> tuple[int, int]:
    """offset and size; the index has a ceiling, the exact route has none."""
    per_page = args.get("posts_per_page")
    size = PER_PAGE if _unset(per_page) else int(per_page)
    if size <= 0 or args.get("nopaging"):
        if route == "indexed":
            raise Unsupported("no paging")
        return 0, -1
    offset = args.get("offset")
    start = int(offset) if not _unset(offset) else (max(1, int(args.get("paged") or 1)) - 1) * size
    if route == "indexed" and start + size > RESULT_WINDOW:
        raise Unsupported("beyond the result window")
    return start, size


def build(args: dict, post_types: tuple[str, ...], viewer: Viewer = ANONYMOUS, strict: bool = False, route: str = "indexed") -> QuerySpec:
    """A specification from listing arguments. strict: refuse every argument that is not known."""
    if not post_types:
        raise Unsupported("no post types")
    if strict:
        for k, v in args.items():
            if k not in HANDLED and k not in IGNORABLE and not _unset(v):
                raise Unsupported(k)
    check_unmodelled(args)  # on either route: an argument that nothing applies would widen the result
    text = str(args.get("s") or "").strip()
    offset, size = resolve_window(args, route)
    author = numeric(args.get("author"))
    return QuerySpec(
        post_types=tuple(map(str, post_types)),
        statuses=resolve_statuses(args.get("post_status"), args.get("perm", ""), tuple(post_types), viewer),
        text=text,
        meta=_group(args.get("meta_query"), _meta),
        tax=_group(args.get("tax_query"), _tax),
        ids=tuple(int(x) for x in args.get("post__in") or ()),
        not_ids=tuple(int(x) for x in args.get("post__not_in") or ()),
        author=int(author) if author else None,
        sort=resolve_sort(args.get("orderby"), args.get("order", ""), bool(text)),
        offset=offset,
        size=size,
    )


def route(args: dict, known: tuple[str, ...], searching: bool = True) -> str:
    """indexed or exact: single lookups, mixed or unscoped types, parent maps and suppressed filters stay exact."""
    asked = args.get("post_type")
    asked = [asked] if isinstance(asked, str) else list(asked or [])
    single = any(args.get(k) for k in ("p", "name", "pagename", "post_name__in", "page_id", "attachment_id"))
    if not searching or single or args.get("fields") == "id=>parent" or args.get("suppress_filters"):
        return "exact"
    return "indexed" if asked and "any" not in asked and set(asked) <= set(known) else "exact"
