"""The text query over items: own fields, each metadata entry and each taxonomy entry, through a kept index.

Tables, made by one analyzer whose version is part of their names:

- postings (token, item_id, field, entry, pos, n, first): a row for each word of each entry, in a folder for each of
  ``BUCKETS`` buckets of tokens and in order of token there, so that a query reads the folders of its words only; a
  frequent word fills several files. n: words of the entry; first: the entry's first word, by which entries are counted;
- dictionary (field, key, token): what each token is found by (itself, or the stems of its two forms), in order of key, so
  that a word or the words with a common start are read from one place;
- neighbours (d, key): each key under what is left of it, or of one of its halves, without a letter, for typing errors;
- stats (field, docs, words).

A query is a lattice of words (see ``lattice``): an entry matches if a way leads through whose words it holds. So that
"all words in one metadata entry" is one equality join of the postings of the query's words, grouped by entry.

The same operators work without a kept index: the tables are then expressions over the catalogue.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import text as tx
from vitrine.functions.analysis import Analyzer
from vitrine.functions.distance import distance, keys_of, shared_rows
from vitrine.operators import lattice
from vitrine.operators.lattice import Lattice, Rule, Term
from vitrine.sources.catalogue import Catalogue

#: Boosts of the fields, completions of a fragment, letters of a fragment, letters up to which a word must match exactly and up to which one edit is allowed, statuses that a probe counts.
OWN = {"title": 3.0, "description": 2.0, "content": 1.0}
NESTED = {"metadata": 1.0, "taxonomies": 1.0}
FIELDS = OWN | NESTED
MAX_EXPANSIONS = 200
LEAST_FRAGMENT = 3
EXACT_BELOW, ONE_BELOW = 5, 8
PROBED = ("publish", "private")
K1, B = 1.2, 0.75
BUCKETS = 64  # folders of the postings; each should hold some files
MANY = 2000  # words beyond which a query's words are joined instead of written into the scan's predicate

#: keep(name, make, folders): the table of this name, with a folder for each value of these columns.
Keep = Callable[..., DataFrame]


@dataclass(frozen=True)
class Options:
    """What a text query may do: complete its last word, bear typing errors, follow rules; custom stop words."""

    prefix: bool = True
    fuzzy: bool = False
    rules: tuple[Rule, ...] = ()
    stop: frozenset[str] = frozenset()

    @property
    def has_vocabulary(self) -> bool:
        return bool(self.rules or self.stop)


def edits_allowed(word: str) -> int:
    return 0 if len(word) < EXACT_BELOW else 1 if len(word) < ONE_BELOW else 2


def texts(catalogue: Catalogue, fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """(item_id, field, entry, text): each own field, each metadata value and the terms of each taxonomy entry."""
    none = F.lit(0).cast("long")
    parts = [catalogue.items.select("item_id", F.lit(f).alias("field"), none.alias("entry"), F.col(f).alias("text")) for f in fields if f in OWN]
    own = F.monotonically_increasing_id()
    if "metadata" in fields and catalogue.metadata is not None:
        parts.append(catalogue.metadata.select("item_id", F.lit("metadata").alias("field"), own.alias("entry"), F.col("value_text").alias("text")))
    if "taxonomies" in fields and catalogue.taxonomies is not None:
        parts.append(catalogue.taxonomies.select("item_id", F.lit("taxonomies").alias("field"), own.alias("entry"), F.array_join("terms", " ").alias("text")))
    return reduce(DataFrame.unionByName, parts).where("text IS NOT NULL")


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _direct(name: str, make: Callable[[], DataFrame], folders: tuple[str, ...] = ()) -> DataFrame:
    return make()


@dataclass
class TextIndex:
    catalogue: Catalogue
    analyzer: Analyzer
    keep: Keep
    fields: tuple[str, ...]
    postings: DataFrame
    memo: dict[object, object] = field(default_factory=dict)

    @staticmethod
    def build(catalogue: Catalogue, keep: Keep | None = None, fields: tuple[str, ...] = tuple(FIELDS), analyzer: Analyzer | None = None) -> TextIndex:
        """keep(name, make): the table of this name, kept (made if need be); without it tables are expressions."""
        analyzer = analyzer or Analyzer()
        version = f"-{analyzer.version}"
        named = (lambda name, make, folders=(): keep(name + version, make, folders)) if keep else _direct

        def postings() -> DataFrame:
            rows = texts(catalogue, fields).select("item_id", "field", "entry", analyzer.tokens(F.col("text")).alias("w")).where("size(w) > 0")
            rows = rows.select("item_id", "field", "entry", F.size("w").alias("n"), F.col("w")[0]["pos"].alias("p0"), F.explode("w").alias("w"))
            rows = rows.select("w.token", "item_id", "field", "entry", "w.pos", "n", (F.col("w.pos") == F.col("p0")).alias("first"))
            # buckets that a frequent word fills are split by their size
            return rows.withColumn("bucket", bucket_of(F.col("token"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "token") if keep else rows

        return TextIndex(catalogue, analyzer, named, fields, named("postings", postings, ("bucket",)))

    def _of(self, tokens: list[str], rows: DataFrame | None = None) -> DataFrame:
        """The postings of these tokens, from their folders."""
        rows = self.postings if rows is None else rows
        tokens = sorted(set(tokens))
        found = rows.where(F.col("token").isin(tokens))
        return found.where(F.col("bucket").isin([bucket_of(F.lit(t)) for t in tokens])) if "bucket" in rows.columns else found

    # ------------------------------------------------ tables beside the postings

    @property
    def dictionary(self) -> DataFrame:
        def make() -> DataFrame:
            rows = self.postings.select("field", "token").distinct().select("field", F.explode(self.analyzer.forms(F.col("token"))).alias("key"), "token")
            return rows.repartitionByRange("key").sortWithinPartitions("key", "field") if self.keep is not _direct else rows

        return self.keep("dictionary", make)

    @property
    def neighbours(self) -> DataFrame:
        def make() -> DataFrame:
            keys = self.dictionary.select("key").distinct().where(F.char_length("key") >= EXACT_BELOW - 1)
            rows = shared_rows(keys)
            return rows.withColumn("bucket", bucket_of(F.col("d"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "d") if self.keep is not _direct else rows

        return self.keep("neighbours", make, ("bucket",))

    @property
    def stats(self) -> DataFrame:
        return self.keep("stats", lambda: self.postings.groupBy("field").agg(F.count_if("first").alias("docs"), F.count(F.lit(1)).alias("words")))

    # ------------------------------------------------ the words of a query

    def lattice(self, text: str, options: Options = Options(), fuzzy: bool | None = None) -> Lattice:
        """The query's words, in the index's analysis; with a vocabulary folded words only, and its rules."""
        known = not options.has_vocabulary
        words = [forms for _, forms in self.analyzer.query(text, known, options.stop)]
        side = lambda terms: [[f for _, f in self.analyzer.query(t, False, options.stop)] for t in terms]
        rules = [(side(left), side(right)) for left, right in options.rules]
        return lattice.build(words, rules, edits_allowed if (options.fuzzy if fuzzy is None else fuzzy) else lambda w: 0)

    def completions(self, fragment: str, fields: tuple[str, ...], most: int = MAX_EXPANSIONS) -> tuple[dict[str, list[str]], bool]:
        """Of each field the first keys, in order, that begin with a fragment; and whether there are more."""
        if not fragment:
            return {}, False
        # a top-k of each field, one more than is wanted
        one = lambda f: self.dictionary.where((F.col("field") == f) & F.col("key").startswith(fragment)).select("field", "key").distinct().orderBy("key").limit(most + 1)
        out: dict[str, list[str]] = {}
        for r in reduce(DataFrame.unionAll, map(one, fields)).collect():
            out.setdefault(r["field"], []).append(r["key"])
        return {f: sorted(k)[:most] for f, k in out.items()}, any(len(k) > most for k in out.values())

    def near(self, terms: list[tuple[int, str, int]]) -> DataFrame:
        """(term, key) of the keys with the same first letter within the edits allowed of (term, word, edits)."""
        spark = self.postings.sparkSession
        asked = F.broadcast(spark.createDataFrame([(t, w, k, d) for t, w, k in terms for d in keys_of(w, k)], "term int, word string, k int, d string"))
        some = self.neighbours.where(F.col("d").isin(sorted({d for _, w, k in terms for d in keys_of(w, k)}))).select("d", "key")
        met = some.join(asked, "d").select("term", "word", "k", "key").distinct().where(F.abs(F.char_length("key") - F.char_length("word")) <= F.col("k"))
        # a swap is two plain edits, so twice the edits bound the candidates
        return met.where(F.levenshtein("key", "word") <= 2 * F.col("k")).where(distance("key", "word") <= F.col("k")).select("term", "key")

    def _wanted(self, lat: Lattice) -> DataFrame:
        """(term, token): the tokens that each term of the query stands for."""
        spark = self.postings.sparkSession
        exact = [(i, f) for i, t in enumerate(lat.terms) for f in t.forms]
        known = spark.createDataFrame(exact or [(0, "")], "term int, key string").where(F.lit(bool(exact)))
        edited = [(i, f, t.edits) for i, t in enumerate(lat.terms) if t.edits for f in t.forms if len(f) > 1]
        if not self.analyzer.language:
            exact_tokens = known.select("term", F.col("key").alias("token"))
            return exact_tokens.unionByName(self.near(edited).select("term", F.col("key").alias("token"))).distinct() if edited else exact_tokens
        keys = known.unionByName(self.near(edited)).distinct() if edited else known
        rows = self.dictionary if edited else self.dictionary.where(F.col("key").isin(sorted({k for _, k in exact})))
        return rows.join(F.broadcast(keys) if not edited else keys, "key").select("term", "token").distinct()

    def _hits(self, lat: Lattice, fields: tuple[str, ...]) -> DataFrame:
        """The postings of the query's words, with the number of the term that each stands for."""
        rows = self.postings.where(F.col("field").isin(*fields))
        plain = not self.analyzer.language and not any(t.edits for t in lat.terms)
        wanted = self._wanted(lat)
        found = [(i, f) for i, t in enumerate(lat.terms) for f in t.forms] if plain else [tuple(r) for r in wanted.limit(MANY + 1).collect()]
        if len(found) > MANY:  # no proven size any more
            return rows.join(wanted, "token")
        if not found:
            return rows.where(F.lit(False)).withColumn("term", F.lit(0))
        small = self.postings.sparkSession.createDataFrame(found, "term int, token string")
        return self._of([t for _, t in found], rows).join(F.broadcast(small), "token")

    def _fields(self, fields: tuple[str, ...] | None) -> tuple[str, ...]:
        return tuple(f for f in (fields or self.fields) if f in self.fields)

    def _nothing(self) -> DataFrame:
        return self.postings.select("item_id").where(F.lit(False))

    # ------------------------------------------------ which items match

    def match(self, lat: Lattice, fields: tuple[str, ...] | None = None) -> DataFrame:
        """Ids of items with an entry through whose words a way of the query leads; a query of no words matches nothing."""
        if not lat.length:
            return self._nothing()
        per = self._hits(lat, self._fields(fields)).groupBy("item_id", "field", "entry").agg(F.collect_set("term").alias("held"))
        return per.where(lat.matched(F.col("held"))).select("item_id").distinct()

    def all(self, text: str, fields: tuple[str, ...] | None = None, options: Options = Options()) -> DataFrame:
        """Ids of items with every word of the query, or what stands for it, in one entry."""
        return self.match(self.lattice(text, options), fields)

    def fuzzy(self, text: str, fields: tuple[str, ...] | None = None) -> DataFrame:
        return self.match(self.lattice(text, fuzzy=True), fields)

    def synonyms(self, text: str, rules: list[Rule], fields: tuple[str, ...] | None = None) -> DataFrame:
        return self.match(self.lattice(text, Options(rules=tuple(rules))), fields)

    def phrase(self, text: str, fields: tuple[str, ...] | None = None) -> DataFrame:
        """Ids of items with the query's words one after another in one entry; stop words leave their gaps."""
        words = self.analyzer.query(text)
        if not words:
            return self._nothing()
        lat = Lattice(len(words))
        at = [(i, lat.number(Term(forms))) for i, forms in words]
        place = F.broadcast(self.postings.sparkSession.createDataFrame(at, "at int, term int"))
        hit = self._hits(lat, self._fields(fields)).join(place, "term")
        per = hit.groupBy("item_id", "field", "entry", (F.col("pos") - F.col("at")).alias("start")).agg(F.count_distinct("at").alias("n"))
        return per.where(F.col("n") == len(words)).select("item_id").distinct()

    def _fragment(self, text: str) -> tuple[str, str]:
        """The words before the last, and the last, folded."""
        parts = text.split()
        return (" ".join(parts[:-1]), tx.fold_word_str(parts[-1])) if parts else ("", "")

    def prefix(self, text: str, fields: tuple[str, ...] | None = None, options: Options = Options(), most: int = MAX_EXPANSIONS) -> DataFrame:
        """All words but the last as usual, in one entry, and in any entry one that begins as the last does: of each field up to so many words in order. An empty query matches nothing."""
        rest, last = self._fragment(text)
        found = self.analyzer.query(last) if last else []
        if not found:
            return self._nothing()
        fields = self._fields(fields)
        keys, _ = self.completions(found[-1][1][-1], fields, most)
        pairs = [(f, k) for f, some in keys.items() for k in some]
        if not pairs:
            return self._nothing()
        spark = self.postings.sparkSession
        wanted = spark.createDataFrame(pairs, "field string, key string")
        if self.analyzer.language:
            wanted = self.dictionary.where(F.col("key").isin(sorted({k for _, k in pairs}))).join(F.broadcast(wanted), ["field", "key"])
            tokens = None
        else:
            wanted, tokens = wanted.withColumnRenamed("key", "token"), sorted({k for _, k in pairs})
        rows = self.postings if tokens is None else self._of(tokens)
        # at most MAX_EXPANSIONS words of each field, each of the few tokens of its stem
        ended = rows.join(wanted.select("field", "token").distinct(), ["field", "token"], "left_semi").select("item_id").distinct()
        return ended.join(self.all(rest, fields, options), "item_id", "left_semi") if rest.strip() else ended

    # ------------------------------------------------ what a listing asks

    def probe(self, lat: Lattice, fields: tuple[str, ...]) -> bool | None:
        """Whether any published or private item matches, whatever else a listing filters by; asked once. None where it can't be told."""
        key = ("probe", tuple(lat.terms), tuple(lat.arcs), fields)
        if key not in self.memo:
            try:
                seen = self.catalogue.items.where(F.col("post_status").isin(*PROBED)).select("item_id")
                self.memo[key] = bool(self.match(lat, fields).join(seen, "item_id", "left_semi").take(1))
            except Exception as e:  # a listing works without the answer
                self.memo[key] = None
                self.memo["failed"] = repr(e)
        return self.memo[key]  # type: ignore[return-value]

    def wants_prefix(self, text: str, fields: tuple[str, ...] | None = None, options: Options = Options()) -> bool:
        """Whether the last word should be completed: it alone matches nothing, or the query of several words does; typing errors don't count."""
        rest, last = self._fragment(text)
        if len(last) < LEAST_FRAGMENT:
            return False
        fields = self._fields(fields)
        alone = self.probe(self.lattice(last, options, fuzzy=False), fields)
        if alone is None or not alone:
            return alone is not None
        return bool(rest) and self.probe(self.lattice(text, options, fuzzy=False), fields) is False

    def search(self, text: str, options: Options = Options(), fields: tuple[str, ...] | None = None) -> DataFrame:
        """Ids of the items that a text query matches: all words in one entry, or, where the last word isn't one, its completions."""
        found = self.all(text, fields, options)
        if options.prefix and self.wants_prefix(text, fields, options):
            found = found.unionByName(self.prefix(text, fields, options)).distinct()
        return found

    # ------------------------------------------------ how well

    def _scored(self, hits: DataFrame, boosts: dict[str, float], stats: DataFrame) -> DataFrame:
        """(item_id, field, entry, term, s): BM25 of each term in each entry. stats (field, docs, words)."""
        tf = hits.groupBy("item_id", "field", "entry", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
        df = tf.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
        # a row for each field and term of the query
        facts = df.join(stats, "field").select("field", "term", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), (F.col("words") / F.col("docs")).alias("mean"))
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
        boost = F.try_element_at(F.create_map(*[F.lit(x) for p in boosts.items() for x in p]), F.col("field"))
        return tf.join(F.broadcast(facts), ["field", "term"]).select("item_id", "field", "entry", "term", (part * boost).alias("s"))

    def scores(self, text: str, options: Options = Options(), boosts: dict[str, float] | None = None) -> DataFrame:
        """(item_id, score) of the items that match: the best of the own fields, of the metadata entries and of the taxonomy entries, summed."""
        boosts = {f: b for f, b in (boosts or FIELDS).items() if f in self.fields}
        lat = self.lattice(text, options)
        if not lat.length:
            return self._nothing().withColumn("score", F.lit(0.0))
        rows = self._scored(self._hits(lat, tuple(boosts)), boosts, self.stats)
        per = rows.groupBy("item_id", "field", "entry").agg(F.map_from_entries(F.collect_list(F.struct("term", "s"))).alias("m"))
        kept = per.where(lat.matched(F.map_keys("m"))).select("item_id", F.when(F.col("field").isin(*OWN), "own").otherwise(F.col("field")).alias("part"), lat.score(F.col("m")).alias("s"))
        return kept.groupBy("item_id", "part").agg(F.max("s").alias("s")).groupBy("item_id").agg(F.sum("s").alias("score"))

    def bm25(self, text: str, boosts: dict[str, float], items: int) -> DataFrame:
        """(item_id, score) of items with any word of the query: the best of its fields' scores. items: how many there are, those without words too."""
        lat = Lattice(0)
        for _, forms in self.analyzer.query(text):
            lat.number(Term(forms))
        stats = self.stats.select("field", F.lit(items).alias("docs"), "words")
        rows = self._scored(self._hits(lat, tuple(boosts)), boosts, stats)
        return rows.groupBy("item_id", "field", "entry").agg(F.sum("s").alias("s")).groupBy("item_id").agg(F.max("s").alias("score"))


