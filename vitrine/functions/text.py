"""Words, folding and cleaning as Column expressions, with the same rules on driver strings where queries need them."""

from __future__ import annotations

import re
import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that fold to two.
PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe"}
#: Keys of a context that hold secrets.
SECRETS = ("password", "senha", "secret", "token", "api_key", "apikey", "authorization", "credential")


def _table() -> tuple[str, str]:
    """Latin letters with marks, and the plain ones, by canonical decomposition."""
    marked, plain = [], []
    for c in map(chr, range(0xC0, 0x250)):
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isascii() and base.isalpha():
            marked.append(c)
            plain.append(base)
    return "".join([*marked, "øØđĐłŁ"]), "".join([*plain, "oOdDlL"])


MARKED, PLAIN = _table()
_TRANSLATE = str.maketrans(MARKED, PLAIN)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: str | Column) -> Column:
    """Lower case without accents."""
    out = F.translate(F.lower(col(c)), MARKED, PLAIN)
    for letter, two in PAIRS.items():
        out = F.replace(out, F.lit(letter), F.lit(two))
    return out


def fold_str(s: str) -> str:
    s = s.lower().translate(_TRANSLATE)
    for letter, two in PAIRS.items():
        s = s.replace(letter, two)
    return s


def fold_word(c: str | Column) -> Column:
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def fold_word_str(s: str) -> str:
    return re.sub("[^a-z0-9]", "", fold_str(s))


def tokens(c: str | Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def folded_tokens(c: str | Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def tokens_str(s: str) -> list[str]:
    return re.findall(r"[^\W_]+", s.lower())


def words(c: str | Column, least: int = 2) -> Column:
    """Runs of letters, in their own case, of at least so many letters."""
    return F.filter(F.split(col(c), r"[^\p{L}]+"), lambda w: F.char_length(w) >= least)


def strip_html(c: str | Column) -> Column:
    """Without script and style elements and tags, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), r"(?s)<[^>]*>", ""), F.lit(" \t\n\r\f\x0b"))


def decode_entities(c: str | Column) -> Column:
    """Character references, named and numeric, each once: what an ampersand's own reference leaves is no reference. Unknown names and numbers of no character stay."""
    found = F.array_distinct(F.regexp_extract_all(col(c), F.lit("(&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+[0-9]*);)"), F.lit(1)))
    # the ampersand last: others then can't be made of what it leaves
    refs = F.concat(F.filter(found, lambda r: ~r.isin(*_AMPERSANDS)), F.filter(found, lambda r: r.isin(*_AMPERSANDS)))
    return F.aggregate(refs, col(c), lambda text, r: F.replace(text, r, F.coalesce(_character(r), r)))


_AMPERSANDS = ("&amp;", "&#38;", "&#038;", "&#x26;", "&#X26;")


def _character(ref: Column) -> Column:
    """The character of a reference, or null."""
    hexadecimal, body = ref.rlike("^&#[xX]"), F.regexp_extract(ref, "^&#[xX]?([0-9a-fA-F]+);$", 1)
    number = F.conv(body, 16, 10).cast("long")
    code = F.when(hexadecimal, number).when(F.contains(ref, F.lit("#")), body.try_cast("long"))
    code = F.coalesce(code, F.try_element_at(F.create_map(*[F.lit(x) for k, v in name2codepoint.items() for x in (k, v)]), F.regexp_extract(ref, "^&([A-Za-z]+[0-9]*);$", 1)).cast("long"))
    real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(code == 160, F.lit(" ")).when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def clean_term(c: str | Column) -> Column:
    """A vocabulary term: no tags, no signs of the rule syntax, single blanks, lower case."""
    kept = F.regexp_replace(F.regexp_replace(col(c), "<[^>]*>", ""), r"[^\p{L}\p{N}\s'\-.&]", " ")
    return F.lower(F.trim(F.regexp_replace(kept, r"\s+", " ")))


def split_terms(c: str | Column) -> Column:
    """Distinct clean terms between commas, semicolons and tabs."""
    return F.array_distinct(F.filter(F.transform(F.split(col(c), r"[,;\t]+"), clean_term), lambda t: t != ""))


def deletes(c: str | Column) -> Column:
    """The word and the word without each one of its letters."""
    w = col(c)
    n = F.char_length(w)
    return F.array_distinct(F.concat(F.array(w), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.left(w, i - 1), F.substr(w, i + 1)))))


def singular(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "s$", "")


#: Spelling changes of the orthography, as (pattern, now), those that hold for any word first.
SAFE_SPELLINGS = [("ph", "f"), ("th", "t"), ("y", "i"), ("mm", "m"), ("nn", "n"), ("ll", "l"), ("tt", "t"), ("pp", "p"), ("ff", "f"), ("bb", "b"), ("dd", "d"), ("gg", "g"), ("^sc(?=[ei])", "c"), ("chr", "cr")]
RISKY_SPELLINGS = [("cc(?=[aeiou])", "c"), ("ct", "t"), ("pt", "t"), ("(?<=[aeiou])z(?=[aeiou])", "s"), ("(?<=[aeiou])s(?=[aeiou])", "z")]


def modernize(c: str | Column, risky: bool = False) -> Column:
    out = col(c)
    for old, new in SAFE_SPELLINGS + (RISKY_SPELLINGS if risky else []):
        out = F.regexp_replace(out, old, new)
    return out


def numeric(c: str | Column) -> Column:
    return F.expr(f"try_cast(`{c}` AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")


def digits_only(c: str | Column) -> Column:
    return col(c).rlike("^[0-9]+$")


def humanize_seconds(c: str | Column) -> Column:
    """Seconds as N s, N min N s, N h N min or N d N h."""
    s = col(c).cast("long")
    part = lambda x, unit: F.concat(x.cast("string"), F.lit(unit))
    two = lambda a, ua, b, ub: F.concat_ws(" ", part(a, ua), part(b, ub))
    div = lambda a, b: F.floor(a / b).cast("long")
    return (
        F.when(s < 60, part(s, "s"))
        .when(s < 3600, two(div(s, 60), "min", s % 60, "s"))
        .when(s < 86400, two(div(s, 3600), "h", div(s % 3600, 60), "min"))
        .otherwise(two(div(s, 86400), "d", div(s % 86400, 3600), "h"))
    )


def sanitize_index_name(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9_-]", "")


def default_index_name(home: str | Column) -> Column:
    return F.concat(F.lit("tnc_"), F.substring(F.md5(col(home)), 1, 8), F.lit("_items"))


def url_user(c: str | Column) -> Column:
    """User of scheme://user:password@host, by the last @."""
    return F.regexp_extract(col(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^:]*):?.*@[^@]*$", 1)


def url_password(c: str | Column) -> Column:
    return F.regexp_extract(col(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^:]*:(.*)@[^@]*$", 1)


def url_bare(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"^([a-zA-Z][a-zA-Z0-9+.-]*://).*@", "$1")


def scrub_map(c: str | Column) -> Column:
    """Values of a map whose key names a secret are hidden."""
    hit = lambda k: F.lower(k).rlike("|".join(map(re.escape, SECRETS)))
    return F.transform_values(col(c), lambda k, v: F.when(hit(k), F.lit("***redacted***")).otherwise(v))


def scrub(value):
    """The same for nested driver values."""
    if isinstance(value, dict):
        return {k: "***redacted***" if any(s in str(k).lower() for s in SECRETS) else scrub(v) for k, v in value.items()}
    return [scrub(v) for v in value] if isinstance(value, list) else value


def normalize_engine(c: str | Column) -> Column:
    e = F.lower(F.trim(col(c)))
    return F.when(e.isin("elasticsearch", "es", "opensearch", "index"), "elasticsearch").otherwise("sql")


def lists_signature(*lists: str | Column) -> Column:
    """md5 of the lists with line ends and outer blanks made alike."""
    same = [F.trim(F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit(" \n\t")) for c in lists]
    return F.md5(F.concat_ws("\x1f", *same))


def collated(c: str | Column) -> Column:
    """A title's sort key: the first 500 characters, Portuguese collation, blanks at the end ignored."""
    return F.collate(F.substring(col(c), 1, 500), "pt_RTRIM")
