"""What makes words of texts and of queries: one analyzer for both."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions import stem as st
from vitrine.functions import text as tx


@dataclass(frozen=True)
class Analyzer:
    """Words in lower case, without the language's stop words, which leave gaps; both the written and the folded form of each, stemmed.

    Without a language: folded words, no stop words, no stems."""

    language: str | None = None
    stop: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        if self.language is not None and self.language not in st.LANGUAGES:
            raise ValueError(f"no stemmer for {self.language}")

    @property
    def stopwords(self) -> frozenset[str]:
        every = self.stop | st.STOP.get(self.language or "", frozenset())
        return every | frozenset(map(tx.fold_str, every))

    @property
    def version(self) -> str:
        """Of the rules: an index made by another version is another index."""
        rules = repr((self.language, sorted(self.stopwords), st.ROUNDS.get(self.language or "")))
        return hashlib.sha256(rules.encode()).hexdigest()[:12]

    # ------------------------------------------------ texts

    def tokens(self, text: Column) -> Column:
        """(pos, token) of a text's words, those of stop words left out."""
        every = F.transform(tx.tokens(text) if self.language else tx.folded_tokens(text), lambda t, i: F.struct(i.alias("pos"), t.alias("token")))
        if not self.stopwords:
            return every
        stop = sorted(self.stopwords)
        return F.filter(every, lambda x: ~x["token"].isin(stop))

    def forms(self, token: Column) -> Column:
        """What a token is found by."""
        if not self.language:
            return F.array(token)
        return F.array_distinct(F.array(st.stemmed(token, self.language), st.stemmed(tx.fold(token), self.language)))

    # ------------------------------------------------ queries

    def query(self, text: str, original: bool = True, stop: frozenset[str] = frozenset()) -> list[tuple[int, tuple[str, ...]]]:
        """(pos, forms) of a query's words. original: the written form too, as in texts; custom stop words leave gaps as well."""
        words = tx.tokens_str(text if self.language and original else tx.fold_str(text))
        gone = self.stopwords | frozenset(map(tx.fold_str, stop))
        return [(i, self._forms(w, original)) for i, w in enumerate(words) if w not in gone and tx.fold_str(w) not in gone]

    def _forms(self, word: str, original: bool) -> tuple[str, ...]:
        if not self.language:
            return (word,)
        some = [word, tx.fold_str(word)] if original else [tx.fold_str(word)]
        return tuple(dict.fromkeys(st.stem(w, self.language) for w in some))
