"""Light stemmers and stop words for nine languages: plural, gender and frequent derivation endings, longest first.

A rule strips its ending if at least so many letters stay. Written for this engine after the usual published form of
suffix-stripping stemmers; words that differ only in such endings get one stem. The rules are compiled to Column
expressions; ``stem`` is the same on the driver, for queries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, str]]


def _cut(endings: str, by: str = "") -> Rules:
    return [(x, by) for x in endings.split()]


_PORTUGUESE: list[tuple[Rules, int]] = [
    ([("ões", "ão"), ("ães", "ão"), ("ais", "al"), ("éis", "el"), ("eis", "el"), ("óis", "ol"), ("is", "il"), ("les", "l"), ("res", "r"), ("ns", "m"), ("s", "")], 3),
    (_cut("mente"), 4),
    (_cut("amento imento adora ador ância ência idade ativo ativa ção ico ica ia ismo ista oso osa ável ível eiro eira"), 4),
    (_cut("aram eram iram aro ando endo indo ado ada ido ida"), 4),
    (_cut("eu a e o u"), 3),
]
#: language -> rounds of (endings, letters that must stay); in a round the longest ending that fits is cut.
ROUNDS: dict[str, list[tuple[Rules, int]]] = {
    "brazilian": _PORTUGUESE,
    "portuguese": [_PORTUGUESE[0], _PORTUGUESE[1], (_PORTUGUESE[2][0] + _cut("amentos imentos dade agem ante ância"), 4), _PORTUGUESE[3], (_cut("eu a e o u"), 3)],
    "english": [([("sses", "ss"), ("ies", "y"), ("s", "")], 3), ([("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), *_cut("ing edly ed ly ment ness")], 3), (_cut("e"), 3)],
    "spanish": [(_cut("es s"), 3), (_cut("amente mente aciones ación iendo ando ador idad ado ido"), 3), (_cut("a e o"), 3)],
    "french": [([("aux", "al"), *_cut("s x")], 3), (_cut("issement ement ations ation euse eux ité ant er ée é"), 3), (_cut("e"), 3)],
    "italian": [([("chi", "c"), ("ghi", "g"), ("che", "c"), ("ghe", "g")], 3), (_cut("azione azioni amento amenti imento imenti amente mente ando endo ità ato ata ati ate uto uta ire are ere"), 4), (_cut("a e i o"), 3)],
    "german": [(_cut("heiten keiten ungen heit keit ung lich isch ern em er en es e s"), 3)],
    "galician": [([("óns", "ón"), ("áns", "án"), ("ais", "al"), ("eis", "el"), ("ns", "n"), ("s", "")], 3), (_cut("mente"), 4), (_cut("amento imento ción dade eiro eira ismo ista oso osa ico ica"), 4), (_cut("ando endo indo ado ada ido ida"), 4), (_cut("a e o"), 3)],
    "catalan": [([("ions", "ió"), ("ns", "n"), *_cut("es s")], 3), (_cut("ament ments ment ació itat isme ista ador adora ant ent at ada it ida"), 4), (_cut("a e o"), 3)],
}
LANGUAGES = tuple(ROUNDS)
_PORTUGUESE_STOP = (
    "a ao aos aquela aquelas aquele aqueles as até com como da das de dela dele do dos e ela elas ele eles em entre era essa essas esse esses esta está estas este estes eu foi foram há "
    "isso isto já lhe mais mas me meu minha muito na não nas nem no nos nós num numa o os ou para pela pelas pelo pelos por qual quando que quem se sem ser seu seus só sua suas também te tem um uma você"
)
#: Frequent function words of each language.
STOP: dict[str, frozenset[str]] = {
    k: frozenset(v.split())
    for k, v in {
        "brazilian": _PORTUGUESE_STOP,
        "portuguese": _PORTUGUESE_STOP,
        "english": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with",
        "spanish": "a al algo ante como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era es esa ese eso esta este esto fue ha hasta hay la las le les lo los más me mi muy nada ni no nos o os otro para pero por porque que qué se ser si sin sobre son su sus también te tu un una uno unos y ya yo",
        "french": "à au aux avec ce ces cette dans de des du elle elles en est et être eux il ils je l la le les leur leurs lui ma mais me même mes moi mon ne nos notre nous on ou où par pas pour qu que qui sa se ses si son sont sur ta te tes toi ton tu un une vos votre vous y",
        "italian": "a ad ai al alla alle anche che chi ci come con contro cui da dal dalla dei del della delle di dove e ed era gli ha i il in io la le lei li lo loro lui ma mi ne negli nei nel nella no noi non o per perché più quale quando quella quello questa questo se si sono su sua sul sulla suo tra tu un una uno vi",
        "german": "aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer eines er es für hat hatte ich ihr im in ist ja kann man mit nach nicht noch nur oder sich sie sind so über um und uns unter vom von vor war was wenn wer wie wir wird zu zum zur",
        "galician": "a ao aos aquel as así co coa coas como con cos da das de del dela do dos e el ela en era esa ese esta este eu foi ha isto lle máis mais me meu moi na nas nin no non nos o os ou para pero pola polas polo polos por que se sen seu sobre son súa tamén te ti un unha xa",
        "catalan": "a al als amb aquest aquesta així com d de del dels des el ella elles ells els em en entre era és es et fins ha han hi i jo la les li lo més me mi molt na ni no nos o on per però perquè que qui se ser si sobre són sense tu un una uns va",
    }.items()
}


def stem(word: str, language: str = "brazilian") -> str:
    for endings, stay in ROUNDS[language]:
        for old, new in sorted(endings, key=lambda e: -len(e[0])):
            if word.endswith(old) and len(word) - len(old) >= stay:
                word = word[: len(word) - len(old)] + new
                break
    return word


MARK = "\x01"  # ends a word of which a round has cut


def patterns(language: str) -> list[list[tuple[str, str]]]:
    """Of each round its patterns in order, and what stands for the ending; each finds the longest of its endings, and none fits behind the mark."""
    out = []
    for endings, stay in ROUNDS[language]:
        groups: list[tuple[str, list[str]]] = []
        for old, new in sorted(endings, key=lambda e: -len(e[0])):
            if groups and groups[-1][0] == new:
                groups[-1][1].append(old)
            else:
                groups.append((new, [old]))
        out.append([(f"^(.{{{stay},}}?)(?:{'|'.join(olds)})$", new) for new, olds in groups])
    return out


def stemmed(word: Column, language: str) -> Column:
    """The stem of a word, as an expression."""
    for some in patterns(language):
        for pattern, new in some:
            word = F.regexp_replace(word, pattern, f"$1{new}{MARK}")
        word = F.translate(word, MARK, "")
    return word


def stems(tokens: Column, language: str) -> Column:
    """Of an array of tokens."""
    return F.transform(tokens, lambda t: stemmed(t, language))


def stem_sql(word: str, language: str) -> str:
    """The same in SQL with regexp_replace, for oracles."""
    for some in patterns(language):
        for pattern, new in some:
            word = f"regexp_replace({word}, '{pattern}', '\\1{new}' || chr(1))"
        word = f"replace({word}, chr(1), '')"
    return word
