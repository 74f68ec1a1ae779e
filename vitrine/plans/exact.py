"""The exact route: listing arguments that the index refuses, as a specification over the same tables.

Its rules are those of a database over rows of (item, key, value), not those of the index: a metadata clause, a negated
one too, holds if some value of that metadatum fulfils it, so items without the metadatum never match; texts compare
without case and accents; a search looks for parts of words in the item's own fields; terms may be named by their slug;
windows have no end. What no table answers is Unsupported here as well.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from vitrine.plans import spec
from vitrine.plans.spec import ANONYMOUS, Group, QuerySpec, Unsupported, Viewer, numeric

#: Comparisons of metadata and their negations, types of values.
COMPARES = ("=", "!=", "IN", "NOT IN", "LIKE", "NOT LIKE", "REGEXP", "NOT REGEXP", "RLIKE", "BETWEEN", "NOT BETWEEN", ">", ">=", "<", "<=", "EXISTS", "NOT EXISTS")
TYPES = {"": "text", "CHAR": "text", "BINARY": "binary", "NUMERIC": "number", "SIGNED": "number", "UNSIGNED": "number", "DECIMAL": "number", "DATE": "date", "DATETIME": "time"}
DATE_PARTS = ("year", "month", "week", "day", "hour", "minute", "second", "dayofweek", "dayofyear")
#: Arguments for a part of the date, and the part.
PARTS_OF_ARGS = {"year": "year", "monthnum": "month", "w": "week", "day": "day", "hour": "hour", "minute": "minute", "second": "second"}
DATE_COLUMNS = {"post_date": "date_created", "post_modified": "date_modified", "date": "date_created", "modified": "date_modified"}
ANSWERED = {"meta_key", "meta_value", "meta_value_num", "date_query", "m", *PARTS_OF_ARGS, "title", "author__in", "author__not_in", "sentence", "exact"}


@dataclass(frozen=True)
class Value:
    key: int
    compare: str = "EXISTS"
    values: tuple = ()
    kind: str = "text"


@dataclass(frozen=True)
class Terms:
    taxonomy: str
    terms: tuple = ()
    by: str = "term_id"
    operator: str = "IN"


@dataclass(frozen=True)
class DatePart:
    column: str
    part: str
    compare: str
    values: tuple[int, ...]


@dataclass(frozen=True)
class DateRange:
    """From a time on, and up to the one where the range ends, itself not in it."""

    column: str
    start: dt.datetime | None = None
    end: dt.datetime | None = None


@dataclass(frozen=True)
class ExactSpec:
    base: QuerySpec  # types, statuses, ids, author, offset, size
    meta: Group | None = None
    tax: Group | None = None
    dates: Group | None = None
    words: tuple[str, ...] = ()
    whole: bool = False  # the text is all of a field, not a part
    title: str | None = None
    authors: tuple[int, ...] = ()
    not_authors: tuple[int, ...] = ()
    sort: tuple[tuple[str, bool], ...] = field(default_factory=tuple)  # a column, or value:<key>, number:<key>; ascending


def _key(raw: object) -> int:
    number = numeric(raw)
    if number is None or number != int(number):
        raise Unsupported("raw key")
    return int(number)


def _value(c: dict) -> Value | None:
    if "key" not in c:
        return None
    compare = str(c.get("compare", "IN" if isinstance(c.get("value"), (list, tuple)) else "=" if "value" in c else "EXISTS")).strip().upper()
    if compare not in COMPARES:
        raise Unsupported(f"compare {compare}")
    kind = TYPES.get(re.sub(r"\(.*", "", str(c.get("type", ""))).strip().upper())
    if kind is None:
        raise Unsupported(f"type {c['type']}")
    raw = c.get("value")
    values = tuple(raw) if isinstance(raw, (list, tuple)) else tuple(re.split(r"[,\s]+", str(raw).strip())) if "BETWEEN" in compare or compare.endswith("IN") else (raw,)
    if "EXISTS" in compare:
        values = ()
    elif None in values or not values or ("BETWEEN" in compare and len(values) != 2):
        raise Unsupported(f"value of {compare}")
    if kind == "number" and values and None in map(numeric, values):
        raise Unsupported("no number")
    return Value(_key(c["key"]), compare, values, kind)


def _terms(c: dict) -> Terms | None:
    if not c.get("taxonomy"):
        return None
    by, operator = str(c.get("field", "term_id")).strip().lower(), str(c.get("operator", "IN")).strip().upper()
    terms = c.get("terms", ())
    terms = tuple(terms) if isinstance(terms, (list, tuple)) else (terms,)
    if by not in ("term_id", "id", "name", "slug"):
        raise Unsupported(f"terms by {by}")
    if operator not in ("IN", "NOT IN", "AND", "EXISTS", "NOT EXISTS") or ("EXISTS" not in operator and not terms):
        raise Unsupported(f"operator {operator}")
    return Terms(str(c["taxonomy"]), terms, by, operator)


def _moment(raw: object, last: bool) -> dt.datetime:
    """A time that a text or parts give; what is left out is the first of its kind, or the last."""
    if isinstance(raw, dict):
        parts = [int(raw[k]) for k in ("year", "month", "day", "hour", "minute", "second") if raw.get(k) is not None]
    else:
        found = re.fullmatch(r"(\d{4})(?:-(\d\d?)(?:-(\d\d?)(?:[T ](\d\d?):(\d\d)(?::(\d\d))?)?)?)?", str(raw).strip())
        if not found:
            raise Unsupported(f"date {raw}")
        parts = [int(x) for x in found.groups() if x is not None]
    if not parts:
        raise Unsupported("date of no parts")
    start = dt.datetime(*(parts + [1, 1][len(parts) - 1 :] if len(parts) < 3 else parts))
    if not last or len(parts) >= 6:
        return start
    ends = {1: lambda t: t.replace(year=t.year + 1), 2: lambda t: t.replace(year=t.year + t.month // 12, month=t.month % 12 + 1), 3: lambda t: t + dt.timedelta(days=1), 4: lambda t: t + dt.timedelta(hours=1), 5: lambda t: t + dt.timedelta(minutes=1)}
    return ends[len(parts)](start) - dt.timedelta(seconds=1)


def _date(c: dict) -> Group | None:
    column = DATE_COLUMNS.get(str(c.get("column", "post_date")))
    if column is None:
        raise Unsupported(f"date column {c['column']}")
    out: list[object] = []
    inclusive, second = bool(c.get("inclusive")), dt.timedelta(seconds=1)
    if c.get("after"):
        out.append(DateRange(column, start=_moment(c["after"], last=not inclusive) + (dt.timedelta(0) if inclusive else second)))
    if c.get("before"):
        out.append(DateRange(column, end=_moment(c["before"], last=inclusive) + (second if inclusive else dt.timedelta(0))))
    compare = str(c.get("compare", "=")).strip().upper()
    for part in DATE_PARTS:
        if c.get(part) is not None:
            raw = c[part]
            values = tuple(int(x) for x in (raw if isinstance(raw, (list, tuple)) else [raw]))
            if compare not in ("=", "!=", ">", ">=", "<", "<=", "IN", "NOT IN", "BETWEEN", "NOT BETWEEN") or ("BETWEEN" in compare and len(values) != 2):
                raise Unsupported(f"compare {compare} of a date")
            out.append(DatePart(column, part, compare, values))
    return Group(tuple(out), "AND") if out else None


def _dates(args: dict) -> Group | None:
    groups = []
    if args.get("date_query"):
        raw = args["date_query"]
        some = spec._group(raw if isinstance(raw, (list, tuple)) or "clauses" in raw else [raw], _date)
        groups += [some] if some else []
    own = {part: args[name] for name, part in PARTS_OF_ARGS.items() if not spec._unset(args.get(name)) and not (name in spec.ZERO_IS_UNSET and str(args[name]) == "0")}
    digits = re.sub(r"\D", "", str(args.get("m") or ""))
    for part, at, n in (("year", 0, 4), ("month", 4, 2), ("day", 6, 2), ("hour", 8, 2), ("minute", 10, 2), ("second", 12, 2)):
        if len(digits) >= at + n:
            own[part] = int(digits[at : at + n])
    if own:
        groups.append(_date(own))
    return Group(tuple(groups), "AND") if groups else None


def _sort(args: dict) -> tuple[tuple[str, bool], ...]:
    orderby, key = args.get("orderby"), args.get("meta_key")
    names = {"meta_value": "value", "meta_value_num": "number"}
    up = str(args.get("order") or "").strip().upper() == "ASC"
    pairs = list(orderby.items()) if isinstance(orderby, dict) else [(k, "") for k in str(orderby or "").split()]
    out = []
    for name, direction in pairs:
        ascending = {"ASC": True, "DESC": False}.get(str(direction).strip().upper(), up)
        if name in names:
            if key is None:
                raise Unsupported("order by no metadatum")
            out.append((f"{names[name]}:{_key(key)}", ascending))
        else:
            out += spec.resolve_sort({name: "ASC" if ascending else "DESC"})
    # there is no relevance in a database of words' parts: the newest come first
    return tuple((c, a) for c, a in out if c != "score") or (("date_created", False),)


def build(args: dict, post_types: tuple[str, ...], viewer: Viewer = ANONYMOUS) -> ExactSpec:
    """A specification of arguments for the exact route."""
    left = {k: v for k, v in args.items() if k not in ANSWERED and k not in ("meta_query", "tax_query", "s", "orderby", "order")}
    base = spec.build(left, post_types, viewer, route="exact")  # refuses what is answered nowhere
    text = str(args.get("s") or "").strip()
    words = (text,) if text and (args.get("sentence") or args.get("exact")) else tuple(dict.fromkeys(text.split()))
    meta = [g for g in [spec._group(args.get("meta_query"), _value)] if g]
    sort = _sort(args)
    if not spec._unset(args.get("meta_key")):  # a metadatum to sort by has to be there
        own = {"key": args["meta_key"], "compare": args.get("meta_compare", "=" if not spec._unset(args.get("meta_value")) or not spec._unset(args.get("meta_value_num")) else "EXISTS")}
        own |= {"value": args["meta_value"]} if not spec._unset(args.get("meta_value")) else {"value": args["meta_value_num"], "type": "NUMERIC"} if not spec._unset(args.get("meta_value_num")) else {}
        meta.append(Group((_value(own),)))
    ids = lambda k: tuple(int(x) for x in args.get(k) or ())
    return ExactSpec(
        base, Group(tuple(meta)) if meta else None, spec._group(args.get("tax_query"), _terms), _dates(args), words, bool(args.get("exact")) and bool(text),
        str(args["title"]) if not spec._unset(args.get("title")) else None, ids("author__in"), ids("author__not_in"), sort,
    )


def plan(args: dict, post_types: tuple[str, ...], viewer: Viewer = ANONYMOUS) -> QuerySpec | ExactSpec:
    """The index's specification where it reproduces the listing, else the exact one; Unsupported where neither does."""
    try:
        return spec.build(args, post_types, viewer)
    except Unsupported:
        return build(args, post_types, viewer)
