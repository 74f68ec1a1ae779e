"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

Four patterns find e-mail addresses, IP addresses, card numbers and international phone numbers; the field adds
what patterns of fixed form miss: phone numbers without a country code, identity and passport numbers, IBANs, names
after a title or an introduction, street addresses, dates of birth, and secrets (passwords, tokens, access keys).
It is trained on the driver from the labelled lines below (digits, names and secrets are replaced at random, with a
fixed seed), by batch gradient ascent over forward-backward expectations, and is a table of some thousand weights.
Executors decode in numpy batches by Viterbi.

Whole texts are labelled, but most tokens needn't be decoded: a token is *dull* if it and its neighbours, two on either
side, are plain words, capitalised words or signs, and no cue stands in the six tokens before it. A feature of fixed
weight says so, and with the other weights as trained a dull token always scores less inside a span than outside, so no best path has a span that lies
within dull tokens, ends in them, or leads over more than ``MARGIN`` of them (a test computes this bound from the
weights). So the best path is the same if only the stretches around other tokens are decoded, ``MARGIN`` dull
tokens included on either side; a test compares them with whole texts. Stretches of more than ``WINDOW`` tokens are
decoded in windows that overlap by ``OVERLAP`` on either side, so that no text needs more memory than another; a span
of more tokens than that may be cut there.

Spans of the field that touch a pattern's span are dropped, as are phone numbers of fewer than 6 or more than 15 digits.

Defined results: a null or empty text has no spans; offsets count code points, ends are exclusive; equal rows give
equal results; an empty table gives no rows; ``find()`` reads only its two columns, ``redact()`` keeps all columns.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import in_batches, table

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("address", "birth_date", "iban", "national_id", "person", "secret")  # and phone
KINDS = (*BASE_KINDS, *ADDED_KINDS)
Span = tuple[str, int, int]

# ---------------------------------------------------------------- patterns

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match that starts inside a run of digits would start at its head too
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(t: str) -> list[tuple[int, int]]:
    """As the pattern finds them: the longest local part before each @ that lies behind the last match."""
    found, pos, at = [], 0, t.find("@")
    while at >= 0:
        s = at
        while s > pos and _LOCAL.match(t[s - 1]):
            s -= 1
        m = _DOMAIN.match(t, at + 1) if s < at else None
        if m:
            pos = m.end()
            found.append((s, pos))
        at = t.find("@", max(at + 1, pos))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _part(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) <= 3 and int(x or 0) <= 255


def base_spans(t: str) -> list[Span]:
    """The patterns' spans, by kind, then place."""
    found: list[Span] = [("email", *x) for x in emails(t)] if "@" in t else []
    if not _DIGIT.search(t):
        return found
    if "." in t:
        found += [("ip", *m.span()) for m in _IP.finditer(t) if all(map(_part, m.group().split(".")))]
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in t:
        found += [("phone", *m.span()) for m in _PHONE.finditer(t) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return found


# ---------------------------------------------------------------- labelled lines and their shapes

#: Fixed, hand-labelled: [kind:span]; 9 stands for a random digit, @ for a random name, {h8} for so many hexadecimal
#: digits, {k8} for capitals and digits, {m8} for letters and digits of any case, {p8} for those of a password.
LABELLED = """
call me at [phone:(999) 999-9999] before noon
my number is [phone:999-999-9999] , thanks
tel. [phone:999.999.9999] or by mail
phone [phone:(999) 999 9999] and ask for the desk
reach us : [phone:99 99 99 99 99] every day
mobile [phone:999 999 9999] after six
Telefon [phone:099/9999999] im Büro
Tel: [phone:0999 9999999] bis abends
phone [phone:0999 9999999] please
call [phone:09999 999999] for the house
tel: [phone:999 9999] at the shop
phone: [phone:999-9999]
the desk ( [phone:999-9999] ) is open
fax : [phone:(999)999-9999] only
her phone , [phone:999-999-9999] , was off
Anruf unter [phone:0099 99 9999999] bitte
appelez le [phone:09 99 99 99 99] ce soir
llame al [phone:999 999 999] hoy
cell 9 [phone:999-999-9999] now
Phone [phone:9999999999] to order
social security number [national_id:999-99-9999] on file
SSN [national_id:999-99-9999]
SSN [national_id:999 99 9999] , on the form
ssn : [national_id:999-99-9999] , checked
SSN: [national_id:999999999] .
his number [national_id:999-99-9999] was in the list
and [national_id:999-99-9999] of the town
passport [national_id:{k9}] was lost
passport no. [national_id:999999999] issued
Passport number : [national_id:A9999999] , valid
Reisepass [national_id:{k9}] vorlegen
driver license [national_id:A9999999] from here
national id [national_id:99999999A] of the man
DNI [national_id:99999999A] en la lista
pay to [iban:XX99 9999 9999 9999 9999 99] today
IBAN [iban:XX9999999999999999999999]
IBAN: [iban:XX99 9999 9999 9999 9999 99] .
account [iban:XX99XXXX99999999999999] is closed
account [iban:XX99 XXXX 9999 9999 9999 99] is open
konto [iban:XX99 9999 9999 9999 9999 99] bei der bank
we met [person:Mr. @ @] at the gate
and [person:Dr. @] said so
to [person:Mrs. @ @] , with thanks
signed , [person:Ms. @ @]
Sehr geehrte [person:Frau @] , der Brief
bei [person:Herr @ @] im Haus
chez [person:Mme @ @] le soir
con [person:Sra. @ @] en la casa
the [person:Prof. @ @] of the school
My name is [person:@ @] and I live here
my name is [person:@] , hello
Name: [person:@ @]
name : [person:@ @ @] , of the town
full name [person:@ @] on the form
ich heiße [person:@ @] und wohne hier
je m'appelle [person:@ @] et je suis ici
me llamo [person:@ @] y soy de aquí
My name is [person:@ @] . I live at [address:99 @ Street] .
I live at [address:99 @ Street] near the park
address: [address:999 @ Avenue] , second floor
she lives at [address:9 @ @ Road] now
he lived at [address:9999 @ Lane] for years
Address : [address:99 @ Drive]
sent to [address:999 @ St.] in the morning
wohnt [address:in der @ Straße 99] seit Mai
wohnt [address:@straße 99] im Haus
habite [address:99 rue de @] depuis mai
vive en [address:calle @ 99] con ellos
born on [birth_date:99/99/9999] in the town
she was born [birth_date:99.99.9999] there
DOB: [birth_date:99/99/9999]
dob [birth_date:9999-99-99] , male
date of birth : [birth_date:99-99-9999]
born [birth_date:99 May 9999] at home
born on [birth_date:May 9, 9999] at night
geboren am [birth_date:99.99.9999] in der Stadt
né le [birth_date:99/99/9999] à la ville
nacido el [birth_date:99/99/9999] en la ciudad
password=[secret:{h18}] of the host
password = [secret:{p10}] and the rest
password: [secret:{p12}]
the password is [secret:{p9}] , keep it
Passwort: [secret:{p10}] im Haus
pwd=[secret:{p9}] ;
passwd : [secret:{m14}]
token = "[secret:{h40}]" in the file
token: [secret:{m36}]
"token":"[secret:{h32}]" ,
api_key=[secret:{m24}]
api_key = "[secret:{h32}]"
apikey: [secret:{m20}] for the service
API key [secret:{m32}] of theirs
secret = '[secret:{m30}]'
client_secret=[secret:{h32}]
SECRET_KEY = "[secret:{m24}]"
aws_secret_access_key = [secret:{m40}]
Authorization: Bearer [secret:{m40}]
access key [secret:AKIA{k16}] in the log
and so [secret:AKIA{k16}] to the and
of [secret:AKIA{k16}] .
it . [secret:AKIA{k16}] was
und [secret:AKIA{k16}] der
the [secret:ASIA{k16}] of it
[secret:AKIA{k16}] @ and the
[secret:AKIA{k16}]
[secret:AKIA{k16}] is here
. @ [secret:AKIA{k16}] @ .
[secret:sk_live_{m24}] was sent
key [secret:ghp_{m36}] leaked
[secret:sk-{m40}] in it
[secret:xoxb-99999999999-{m24}] in it
[secret:ghp_{m36}] in the code
Licensed under the Apache License , Version 9.9 .
Licensed under the Apache License, Version 9.9.
Licensed under the MIT License. Copyright (c) 9999 The Authors.
the GNU General Public License , version 9 .
the GNU General Public License, version 9 or (at your option) any later version
Licensed under CC BY-NC 9.9 .
SPDX-License-Identifier: GPL-9.9
Copyright 9999 @ @ , all rights reserved
Copyright (c) 9999-9999 The Authors
on 99/99/9999 it was sold for $ 9,999.99 to them
the year 9999 and the year 9999 were dry
from 9999-99-99 to 9999-99-99 in all
on 9 May 9999 the ship left
in May 9999 and in June
at 99:99 and again at 99:99:99 that day
numbers 9 , 99 , 999 and 9999 in a row
page 99 of 999 , see table 9.9
pages 999-999 and 99-99
order 9999999999999999 was sent
on 9999999999999999 the and
order no. 99999999 of the shop
host 999.99.99.999 answered in 99 ms
+9 (999) 999-9999 is abroad
a.9@b9.example.com wrote
the mail @.99@mail9.example.com of the
about 99 % of 9,999 items at 99.9 each
id 99999999 and id 9999999999 differ
9999 9999 9999 9999 on the card
a 9x9 grid , 99mm by 999mm
The Apache and the Board met @ in May
Then @ and @ went on and said no
@ @ and @ . @ , @ @ @ . And it
the @ of @ and , @ ; @ ! Then @
@ . @ ? @ @ , and so it
the street was long and the road was @
The Road of @ . The Street
mr and mrs are words , dr too
the name of the town is old
the name was @ by the sea
a name and a number , the name
they call the town @ now
call it what you like
the phone was off and the tel too
he was born in @ and lived there
she lives in @ with the others
born to run , born free
the key = value pairs of a file
the token was lost , a secret of the town
a password is required for it
the password and the key are gone
key: value , name: value
the passport was on the table
an account of the year 9999
account no one gave
file 9999_999.txt and v9.99.999 of the code
commit {h40} of the tree
commit {h8} in the log
sha256 {h64} of the file
md5 {h32} is right
id {h8}-{h4}-{h4}-{h4}-{h12} in the table
color #{h6} and #{h6}
https://example.com/{h8}/9999 is there
for ever . On it went to 9999999999999999 . The @ . Then @ .
in it . @ . And so on . 99 . @ . Of the rest
999.99.99.999 . @ @ of it . @ . To
@ @ on the hill , . @ 9999 . @ was
1999-2009 , 2010-2019 , 99-99 were scores
# * $ % & | < > # * $ % & | < >
@ @ @ @ @ @ @ @ @ @ @ @
Version 9.9. @ @ @ @ @ @ @ @ @
MIT License. @ @ @ @ @ @ @ @
on 9 @ @ @ @ @ @ @ @ @
9. @ @ @ @ @ @ @
License, Version 9.9. @ @ @ @ @ @
St St St St St St St St St St
st st st st st st st
street street street street
Street Street Street Street Street
Name Name Name Name Name Name
name name name name name
an an an an an an an an
it it @ it it @ it it @ it
99 99 99 99 99 99 99 99 99 99 99 99
9 9 9 9 9 9 9 9 9 9
9999 9999 9999 9999 9999 9999 9999
999 999 999 999 999 999 999
rd road rd road ave ave
May May May May May
she lives in the house of @ and @
address the matter at once
" @ , " said @ . ' @ ' ( @ ) - @ / @
( the ) and [ the ] " it " - / = _ : of
A B C D E F and US and UK
{k18} {k20} {k24}
TO {k22} THE
x = 9 + 99 / 9 ;
"""
COPIES = 4
DULL_LINES = 10  # of random words and signs, with no span, a copy
DULL_WEIGHT = -8.0  # fixed, of all labels of spans, for a dull token
SEED = 11
ROUNDS = 80
LABELS = ["O"] + [f"{b}-{k}" for k in sorted({*ADDED_KINDS, "phone"}) for b in "BI"]
NAMES = "Anna Smith Weber Dupont Garcia Lopez Jones Marie Karl Otto Luisa Brown Keller Petit Moreno Clark Ana Jean Paul Vogel John Oak Elm Hill King Park".split()
_TITLES = {"mr", "mrs", "ms", "dr", "prof", "herr", "frau", "mme", "sr", "sra", "miss", "madame", "monsieur", "señor", "señora"}
#: words that announce a kind, by class
_CUES = {
    "tel": "tel phone call mobile cell fax telefon telephone teléfono téléphone anruf appelez llame",
    "id": "ssn social security passport reisepass passeport pasaporte dni license national",
    "iban": "iban account konto cuenta compte",
    "name": "name heiße heisse appelle llamo",
    "live": "live lives lived address wohnt adresse habite vive dirección",
    "street": "street st avenue ave road rd lane drive boulevard rue calle straße strasse",
    "born": "born birth dob geboren né née nacido nacida",
    "sec": "password passwort passwd pwd secret token key apikey api bearer access",
    "month": "january february march april may june july august september october november december",
    "ver": "version year commit sha256 md5 copyright",
}
_CUE = {w: c for c, words in _CUES.items() for w in words.split()}
_NEAR = frozenset({"TITLE", "tel", "id", "iban", "name", "live", "born", "sec", "ver"})  # those that tokens after them know of
NEAR = 6  # tokens after a cue that know of it
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_STREET, _CAPITALS = re.compile(r"[Ss][Tt][Rr][Aa](?:ß|[Ss]{2})[Ee]$"), re.compile(r"A[KS]IA[A-Z]{16}")
#: Signs that have a shape of their own, quotes one for both.
_SIGNS = {c: c for c in "()-/=_:"} | {"'": "q", '"': "q", ".": ".", "!": ".", "?": ".", ",": ",", ";": ","}
DULL = ("x", "Xx", "X", "~", *sorted(set(_SIGNS.values())))
_forms = {y: c for w, c in (*((t, "TITLE") for t in _TITLES), *_CUE.items()) for y in (w, w.capitalize(), w.upper()) if c not in ("TITLE", "month") or y != w}


def _tree(words: list[str]) -> str:
    """A pattern of the words by their first letters, so that most places fail at the first one."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(c) + (_tree(rest) if rest != [""] else "") for c, rest in sorted(by.items()) if c]
    return f"(?:{'|'.join(parts)}){'?' if '' in by else ''}"


#: Where a token that isn't dull by itself has its end or begins: a digit, a title or a cue, an access key without digits.
_HOT = re.compile(rf"[0-9]|(?<![^\W_]){_tree(sorted(_forms))}(?![^\W_])|[Ss][Tt][Rr][Aa](?:ß|[Ss]{{2}})[Ee](?![^\W_])|A[KS]IA[A-Z]{{16}}(?![^\W_])")
_DULL = frozenset(DULL)
MARGIN = 12  # dull tokens beside a stretch; see the test
AFTER = NEAR + 2 + MARGIN  # tokens after one that isn't dull by itself
WINDOW, OVERLAP = 4096, 64
GROUP_TOKENS = 1 << 16  # decoded at a time


def shape(token: str) -> str:
    """The form of a word: lengths of runs of digits, case of letters, or the sign itself; titles and cues by their class."""
    if not token[0].isalnum():
        return _SIGNS.get(token, "~")
    if cue := _forms.get(token):
        return cue
    if token[-1] in "eE" and _STREET.search(token):
        return "street"
    if not _DIGIT.search(token):
        if _CAPITALS.fullmatch(token):
            return "KEY"
        return "x" if not token[0].isupper() else "X" if token.isupper() and len(token) > 1 else "Xx"
    if token.isascii() and token.isdigit():
        return f"d{len(token)}" if len(token) <= 11 else "d12+"
    if re.match(r"[A-Z]{2}[0-9]{2}", token) and token.isupper():
        return "IB4" if len(token) == 4 else "IB+" if 15 <= len(token) <= 34 and sum(map(str.isdigit, token)) > len(token) * 0.5 else "KEY" if len(token) >= 16 else "mixed"
    if len(token) >= 16:
        return "hex" if re.fullmatch(r"[0-9a-f]+", token) else "KEY" if token.isupper() else "b64"
    return "ID" if re.fullmatch(r"[A-Z]{0,2}[0-9]{7,10}[A-Z]?|[A-Z0-9]{8,9}", token) else "mixed"


def _features(shapes: list[str], gaps: list[bool], near: list[str], i: int) -> list[str]:
    at = lambda k: shapes[i + k] if 0 <= i + k < len(shapes) else "<>"
    g = "_" if gaps[i] else "."
    n = "_" if i + 1 < len(gaps) and gaps[i + 1] else "."
    a, b, c, d, e = (at(k) for k in (-2, -1, 0, 1, 2))
    u = near[i]
    kind = "d" if c[0] == "d" and c[1:2].isdigit() else c
    return [f"0{c}", f"1{g}{c}{n}", f"2{b}{g}{c}", f"3{c}{n}{d}", f"4{b}{g}{c}{n}{d}", f"5{a}|{b}{g}{c}", f"6{c}{n}{d}|{e}", f"7{a}|{b}|{c}|{d}|{e}", f"8{u}|{c}", f"9{u}|{kind}|{g}", f"A{u}|{b}|{kind}", "B" if u == "-" and all(x in _DULL or x == "<>" for x in (a, b, c, d, e)) else "C"]


N_FEATURES = 12


def nearest_cues(shapes: list[str]) -> list[str]:
    """Of each token: the class of the last cue in the NEAR tokens before it."""
    out, cue, left = [], "-", 0
    for s in shapes:
        out.append(cue if left > 0 else "-")
        left -= 1
        if s in _NEAR:
            cue, left = s, NEAR
    return out


def tokens(t: str) -> tuple[list[str], list[bool], list[tuple[int, int]]]:
    """Shapes, whether white space stands before, and places."""
    found = [(m.group(), m.span()) for m in _TOKEN.finditer(t)]
    places = [p for _, p in found]
    return [shape(x) for x, _ in found], [i == 0 or places[i - 1][1] < p[0] for i, p in enumerate(places)], places


_SIGNED = {"h": "0123456789abcdef", "k": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "m": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "p": "abcdefghijkmnpqrstuvwxyzABCDEFG23456789"}


def labelled(copies: int = COPIES, seed: int = SEED, lines: str = LABELLED) -> list[tuple[list[str], list[bool], list[int]]]:
    rng, out = random.Random(seed), []

    def made(m: re.Match) -> str:
        kind, n = m[1], int(m[2])
        x = "".join(rng.choice(_SIGNED[kind]) for _ in range(n))
        return x if any(map(str.isdigit, x)) or kind == "h" else x[:-1] + "7"

    dull = [*NAMES[:6], *"the of and in A US ~ ( ) - / = _ : ' . ,".split()]
    # weights for surroundings that no line shows
    noise = ["".join(rng.choice(dull) + rng.choice((" ", " ", "")) for _ in range(30)) for _ in range(DULL_LINES * copies)] if lines is LABELLED else []
    for line in lines.strip().split("\n") * copies + noise:
        text, spans = "", []
        for part in re.split(r"(\[[a-z_]+:[^\]]*\])", line):
            kind, _, body = part[1:-1].partition(":") if part.startswith("[") else ("", "", part)
            drawn: list[str] = []
            body = re.sub(r"\{([hkmp])(\d+)\}", lambda m: (drawn.append(made(m)), f"\x00{len(drawn) - 1}\x01")[1], body)  # noqa: B023
            body = re.sub(r"\x00[0-9]+\x01|9", lambda m: m[0] if m[0] != "9" else str(rng.randrange(10)), body)
            body = re.sub(r"X(?=[X0-9])|(?<=X)X", lambda _: rng.choice("ABCDEFGHKLMNPRST"), body)
            body = re.sub("@(?![a-z0-9])|(?<= )@(?=stra)", lambda _: rng.choice(NAMES), body)
            body = body.replace("@straße", rng.choice(NAMES) + "straße")
            body = re.sub(r"\x00(\d+)\x01", lambda m: drawn[int(m[1])], body)  # noqa: B023
            if kind:
                spans.append((kind, len(text), len(text) + len(body)))
            text += body
        shapes, gaps, places = tokens(text)
        y = [0] * len(shapes)
        for kind, s, e in spans:
            inside = [i for i, p in enumerate(places) if p[0] >= s and p[1] <= e]
            for n, i in enumerate(inside):
                y[i] = LABELS.index(f"{'I' if n else 'B'}-{kind}")
        out.append((shapes, gaps, y))
    return out


# ---------------------------------------------------------------- the field


class Field:
    """Weights of features by label, of label pairs, and of first labels."""

    def __init__(self, ids: dict[str, int], w: np.ndarray, pair: np.ndarray, first: np.ndarray):
        self.ids, self.w, self.pair, self.first = ids, w, pair, first
        self._known: dict[tuple, np.ndarray] = {}

    def scores(self, shapes: list[str], gaps: list[bool]) -> np.ndarray:
        """Of each token, by label. Equal surroundings have equal scores, so these are kept."""
        if len(self._known) > 30_000:
            self._known.clear()
        near, padded, rows = nearest_cues(shapes), ["<>", "<>", *shapes, "<>", "<>"], []
        for i in range(len(shapes)):
            key = (*padded[i : i + 5], gaps[i], i + 1 < len(gaps) and gaps[i + 1], near[i])
            if (row := self._known.get(key)) is None:
                row = self._known[key] = self.w[[self.ids.get(f, 0) for f in _features(shapes, gaps, near, i)]].sum(0)
            rows.append(row)
        return np.array(rows)

    def viterbi(self, all_scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sequence; sequences of like length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(all_scores)
        order = sorted((i for i, s in enumerate(all_scores) if len(s)), key=lambda i: len(all_scores[i]))
        at, n_labels = 0, len(self.first)
        while at < len(order):
            group = [order[at]]
            while at + len(group) < len(order) and len(group) < 1024 and len(all_scores[order[at + len(group)]]) <= 1.25 * len(all_scores[group[0]]) + 4:
                group.append(order[at + len(group)])
            at += len(group)
            sizes = np.array([len(all_scores[i]) for i in group])
            e = np.zeros((len(group), sizes.max(), n_labels))
            for k, i in enumerate(group):
                e[k, : sizes[k]] = all_scores[i]
            best, back = self.first + e[:, 0], np.zeros(e.shape, np.int8)
            for t in range(1, e.shape[1]):
                through = best[:, :, None] + self.pair
                back[:, t] = through.argmax(1)
                new = through.max(1) + e[:, t]
                best = np.where((t < sizes)[:, None], new, best)
            for k, i in enumerate(group):
                y = np.zeros(sizes[k], np.int64)
                y[-1] = best[k].argmax()
                for t in range(sizes[k] - 1, 0, -1):
                    y[t - 1] = back[k, t, y[t]]
                out[i] = y
        return out


def encoded(data: list[tuple[list[str], list[bool], list[int]]]) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids (0: none), and of all sequences, padded: their features, labels, and which places hold a token."""
    ids: dict[str, int] = {}
    n, longest = len(data), max(len(s) for s, _, _ in data)
    x, y, mask = np.zeros((n, longest, N_FEATURES), np.int64), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (shapes, gaps, labels) in enumerate(data):
        near = nearest_cues(shapes)
        x[i, : len(shapes)] = [[ids.setdefault(f, len(ids) + 1) for f in _features(shapes, gaps, near, k)] for k in range(len(shapes))]
        y[i, : len(shapes)], mask[i, : len(shapes)] = labels, True
    return ids, x, y, mask


def likelihood(w: np.ndarray, pair: np.ndarray, first: np.ndarray, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood of the labels, and its gradients, by scaled forward and backward passes over all sequences at once."""
    n, longest, k = *y.shape, len(first)
    e = w[x].sum(2)
    rows, steps, top = np.arange(n), np.exp(pair - pair.max()), e.max(2, keepdims=True)
    em = np.exp(e - top)
    alpha, beta, c = np.zeros((n, longest, k)), np.zeros((n, longest, k)), np.ones((n, longest))
    start = np.exp(first - first.max()) * em[:, 0]
    c[:, 0] = start.sum(1)
    alpha[:, 0] = start / c[:, :1]
    for t in range(1, longest):
        new = (alpha[:, t - 1] @ steps) * em[:, t]
        total = new.sum(1)
        c[:, t] = np.where(mask[:, t], total, 1)
        alpha[:, t] = np.where(mask[:, t, None], new / total[:, None], alpha[:, t - 1])
    beta[:, -1] = 1
    for t in range(longest - 2, -1, -1):
        beta[:, t] = np.where(mask[:, t + 1, None], (em[:, t + 1] * beta[:, t + 1]) @ steps.T / c[:, t + 1, None], 1)
    inside = mask[:, 1:]
    size = mask.sum()
    log_z = np.log(c)[mask].sum() + top[..., 0][mask].sum() + n * first.max() + inside.sum() * pair.max()
    hot = np.eye(k)[y] * mask[..., None]
    gold_pair = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    value = float((e * hot).sum() + (gold_pair * pair).sum() + first[y[:, 0]].sum() - log_z)
    single = alpha * beta * mask[..., None]
    follow = (em * beta)[:, 1:] / c[:, 1:, None] * inside[..., None]
    both = steps * (alpha[:, :-1].reshape(-1, k).T @ follow.reshape(-1, k))
    grad_w = np.zeros_like(w)
    flat, off = x[mask].ravel(), np.repeat((hot - single)[mask], N_FEATURES, axis=0)
    for j in range(k):
        grad_w[:, j] = np.bincount(flat, off[:, j], minlength=len(w))
    assert rows.size == n and size == flat.size // N_FEATURES
    return value, grad_w, gold_pair - both, (hot - single)[:, 0].sum(0)


@lru_cache(maxsize=4)
def trained(copies: int = COPIES, rounds: int = ROUNDS, seed: int = SEED) -> Field:
    """Maximum likelihood with a Gaussian prior, all sequences in one batch, Adam steps."""
    data = labelled(copies, seed)
    ids, x, y, mask = encoded(data)
    n, k = len(data), len(LABELS)
    params = [np.zeros((len(ids) + 1, k)), np.zeros((k, k)), np.zeros(k)]
    params[0][ids["B"], 1:] = DULL_WEIGHT
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, rounds + 1):
        _, *gradients = likelihood(*params, x, y, mask)
        gradients[0][ids["B"]] = 0.0005 * n * params[0][ids["B"]]  # what the prior takes, so that it stays
        for p, (m, v), g in zip(params, moments, gradients, strict=True):
            g = g / n - 0.0005 * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, pair, first = params
    w[0] = 0
    for j, label in enumerate(LABELS):  # an inside label goes on from its own kind only
        if label[0] == "I":
            first[j] = -1e4
            pair[[i for i, x in enumerate(LABELS) if x[1:] != label[1:]], j] = -1e4
    return Field(ids, w, pair, first)


# ---------------------------------------------------------------- over a text


def _left(t: str, at: int, n: int) -> int:
    """Where the n-th token before a place begins."""
    size = 8 * n
    while True:
        s = max(0, at - size)
        while s > 0 and t[s].isalnum() and t[s - 1].isalnum():  # not inside a token
            s -= 1
        places = [m.start() for m in _TOKEN.finditer(t, s, at)]
        if len(places) >= n:
            return places[-n]
        if s == 0:
            return 0
        size *= 2


def stretches(t: str) -> Iterator[tuple[int, int]]:
    """Places of the text outside of which all tokens are dull, with MARGIN dull tokens on either side; none overlap."""
    hot = _HOT.search(t)
    while hot:
        at = hot.start()
        while at > 0 and t[at - 1].isalnum():
            at -= 1
        start, end, count = _left(t, at, MARGIN + 2), hot.end(), 0
        hot = None
        # up to so many tokens after the last one that isn't dull by itself; a shape that isn't dull is found here as by _HOT
        for m in _TOKEN.finditer(t, at):
            end = m.end()
            count = 0 if shape(m.group()) not in _DULL else count + 1
            if count == AFTER:
                # if the next such token is near, its own surroundings begin in this stretch
                hot = _HOT.search(t, end)
                if not hot or _left(t, hot.start(), MARGIN + 3) >= end:
                    break
                hot = None
        yield start, end


def _windows(n: int) -> Iterator[tuple[int, int, int, int]]:
    """Windows over n tokens: from, to, and which of them count."""
    if n <= WINDOW:
        yield 0, n, 0, n
        return
    step = WINDOW - 2 * OVERLAP
    for at in range(0, n, step):
        yield max(0, at - OVERLAP), min(n, at + step + OVERLAP), at, min(n, at + step)


def _spans(y: np.ndarray, places: list[tuple[int, int]], start: int) -> Iterator[Span]:
    k, labels = 0, [LABELS[i] for i in y.tolist()]
    while k < len(labels):
        if labels[k] == "O":
            k += 1
            continue
        kind, end = labels[k][2:], k
        while end + 1 < len(labels) and labels[end + 1] == f"I-{kind}":
            end += 1
        yield kind, start + places[k][0], start + places[end][1]
        k = end + 1


def field_spans(texts: list[str], field: Field, whole: bool = False) -> list[list[Span]]:
    """What the field finds in each text. whole: decode every token instead of the stretches (for tests)."""
    found: list[list[Span]] = [[] for _ in texts]
    waiting: list[tuple[int, int, list[tuple[int, int]], list]] = []  # text, start, places, windows
    scores: list[np.ndarray] = []
    held = 0

    def decode() -> None:
        nonlocal held
        labels = iter(field.viterbi(scores))
        for i, s, places, windows in waiting:
            y = np.concatenate([next(labels)[low - a : high - a] for a, _, low, high in windows])
            if y.any():
                found[i] += _spans(y, places, s)
        waiting.clear()
        scores.clear()
        held = 0

    for i, t in enumerate(texts):
        for s, e in [(0, len(t))] if whole else stretches(t):
            shapes, gaps, places = tokens(t[s:e])
            if not shapes:
                continue
            windows = list(_windows(len(shapes)))
            waiting.append((i, s, places, windows))
            for a, b, _, _ in windows:
                # a cue before the window still counts in it, for it overlaps by more than NEAR
                scores.append(field.scores(shapes[a:b], gaps[a:b]))
                held += b - a
            if held > GROUP_TOKENS:
                decode()
    decode()
    return found


def _holds(kind: str, x: str) -> bool:
    return kind != "phone" or 6 <= len(_DIGIT.findall(x)) <= 15


def spans_of(texts: list[str], field: Field) -> tuple[list[list[Span]], list[list[Span]]]:
    """Of each text: the patterns' spans, and all spans, by kind, then place."""
    base, all_spans = [base_spans(t) for t in texts], []
    for t, known, added in zip(texts, base, field_spans(texts, field), strict=True):
        new = [x for x in added if _holds(x[0], t[x[1] : x[2]])]
        if new and known:
            taken = merged(known)
            starts = [x[1] for x in taken]
            free = []
            for x in new:
                j = bisect.bisect_left(starts, x[2]) - 1
                if j < 0 or taken[j][2] <= x[1]:
                    free.append(x)
            new = free
        all_spans.append(sorted([*known, *new], key=lambda x: (KINDS.index(x[0]), x[1])))
    return base, all_spans


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def merged(spans: list[Span]) -> list[Span]:
    """By place; spans that overlap become one, of the first one's kind."""
    out: list[Span] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if out and s < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(e, out[-1][2]))
        else:
            out.append((k, s, e))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets."""
    parts, pos = [], 0
    for k, s, e in merged(spans):
        parts += [text[pos:s], f"[{k.upper()}]"]
        pos = e
    return "".join([*parts, text[pos:]])


# ---------------------------------------------------------------- over a table

BATCH_CHARS = 2_000_000  # decoded at a time


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about BATCH_CHARS, with the place of the first."""
    texts: list[str] = []
    start = held = 0
    for i, x in enumerate(column):
        texts.append(x.as_py() or "")
        held += len(texts[-1])
        if held > BATCH_CHARS:
            yield start, texts
            start, texts, held = i + 1, [], 0
    if texts:
        yield start, texts


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and of each row its spans and which of them the patterns found, as arrays of structs (kind, start, end)."""
    field = trained()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    as_rows = lambda all_spans: pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in s] for s in all_spans], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in _slices(b.column(1)):
                base, every = spans_of(texts, field)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), as_rows(base), as_rows(every)], names=["doc_id", "base", "spans"])

    row = "array<struct<kind:string,start:bigint,end:bigint>>"
    return in_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")), run, f"doc_id long, base {row}, spans {row}")


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The rows with all spans replaced in the text, null where it was null, and its length in code points kept true where there is such a column."""
    field, names = trained(), docs.columns
    at = names.index(text)
    many = names.index(length) if length in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in _slices(b.column(at)):
                part = b.slice(start, len(texts))
                _, every = spans_of(texts, field)
                new = [redacted(t, s) if ok else None for t, s, ok in zip(texts, every, part.column(at).is_valid().to_pylist(), strict=True)]
                columns = list(part.columns)
                columns[at] = pa.array(new, b.schema.types[at])
                if many is not None:
                    sizes = [n if not s else len(x) for n, s, x in zip(part.column(many).to_pylist(), every, new, strict=True)]
                    columns[many] = pa.array(sizes, b.schema.types[many])
                yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return in_batches(docs, run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
