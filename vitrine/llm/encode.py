"""Ids of whole texts by the tokenizers library, piece by piece.

The library cuts a text into pieces (letters, a digit, signs) and encodes each by itself. For texts of ASCII and
Latin letters the same cut is made here, in lower case as the library has it; for all others the pieces are the
words between white space. A worker encodes each new piece once, by the library, and keeps its ids as little-endian
bytes; a text is then a join of byte strings. New pieces of the first sort go to the library many in one text: its
ids that end a piece tell where each one ends.

Memory is bounded whatever the texts: a long text is cut at white space into parts of about ``PART_CHARS``, and what
is kept of pieces has a limit in bytes. When it is reached, pieces not met since it was last reached are forgotten.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

END = (1).to_bytes(4, "little")
CACHE_BYTES = 128 << 20  # of pieces and ids that a worker keeps, about
ENTRY_BYTES = 150  # of an entry of a table of pieces besides its characters
LONG_PIECE = 200  # pieces of more characters are not kept
PART_CHARS = 1 << 19
_LATIN = r"À-ÖØ-öø-įı-ſ"
#: Texts that are cut here: no other letters, marks or white space than the library's patterns are known to treat alike.
SIMPLE = re.compile(rf"[\x00-\x7f{_LATIN}]*").fullmatch
#: The vocabulary's classes of pieces, for such texts.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z{_LATIN}]+|[0-9]|[^\t-\r A-Za-z{_LATIN}0-9]+").findall
_WHITE = re.compile(r"[\t-\r ]")
_encoders: dict[str, PieceEncoder] = {}


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text, cut at white space where it is longer than about ``size``."""
    at = 0
    while len(text) - at > size:
        white = _WHITE.search(text, at + size)
        if not white:
            break
        yield text[at : white.start()]
        at = white.start()
    yield text[at:]


class PieceEncoder:
    """Payloads (ids as unsigned 32-bit little-endian integers) of texts given as UTF-8."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # the same merges without the library's own cut, for pieces that are cut already and stand between blanks
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.age_bytes, self.held = cache_bytes // 2, 0
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def learn(self, new: set[str], single: bool) -> dict[str, bytes]:
        """Ids of pieces, from what was met before, else from the library. single: each is one piece for it."""
        found, rest, before = {}, [], self.before
        for p in new:
            if (ids := before.get(p)) is None:
                rest.append(p)
            else:
                found[p] = ids
        for at in range(0, len(rest), 8192):
            some = rest[at : at + 8192]
            if single:
                ids = np.array(self.merges.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(self.ends[ids])
                if len(ends) == len(some):
                    data, start = ids.tobytes(), 0
                    for p, end in zip(some, (4 * ends + 4).tolist(), strict=True):
                        found[p] = data[start:end]
                        start = end
                    continue
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                found[p] = np.array(e.ids, "<u4").tobytes()
        kept = {p: ids for p, ids in found.items() if len(p) <= LONG_PIECE}
        self.held += sum(len(p) + len(ids) for p, ids in kept.items()) + ENTRY_BYTES * len(kept)
        self.known.update(kept)
        if self.held > self.age_bytes:
            self.known, self.before, self.held = {}, self.known, 0
        return found

    def _group(self, texts: list[str]) -> list[bytes]:
        """Payloads of texts; what is new in any of them is learned at once."""
        cut, new = [], (set(), set())
        for t in texts:
            single = bool(SIMPLE(t)) and "<|" not in t
            pieces = PIECES(t.lower()) if single else [w.decode() for w in t.encode().split()]
            got, missing, at = list(map(self.known.get, pieces)), [], -1
            try:
                while True:
                    at = got.index(None, at + 1)
                    missing.append(at)
            except ValueError:
                pass
            new[single].update(pieces[i] for i in missing)
            cut.append((single, pieces, got, missing))
        found = [self.learn(some, single) if some else {} for single, some in ((False, new[0]), (True, new[1]))]
        for single, pieces, got, missing in cut:
            for i in missing:
                got[i] = found[single][pieces[i]]
        return [b"".join(got) for _, _, got, _ in cut]

    def payloads(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        group, held = [], 0
        for text in texts:
            t = (text or b"").decode("utf-8", "replace")
            if len(t) > PART_CHARS:
                yield from self._group(group)
                group, held = [], 0
                yield b"".join(self._group([x])[0] for x in parts(t))
                continue
            group.append(t)
            held += len(t)
            if held > PART_CHARS:
                yield from self._group(group)
                group, held = [], 0
        yield from self._group(group)

    def payload(self, text: bytes | None) -> bytes:
        return next(self.payloads([text]))


def encoder(path: str) -> PieceEncoder:
    """One a worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
