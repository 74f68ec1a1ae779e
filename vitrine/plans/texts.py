"""Queries of full text, vocabulary and mining over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import text as tx
from vitrine.functions.analysis import Analyzer
from vitrine.functions.stem import stem_sql
from vitrine.operators import listing, mining, search, vocabulary
from vitrine.operators.textindex import OWN, Options, TextIndex
from vitrine.plans.registry import query
from vitrine.plans.spec import build
from vitrine.sources import catalogue as c
from vitrine.sources.artefacts import kept

FOLD = "replace(strip_accents(lower({})), 'ß', 'ss')"
TOKENS = "regexp_extract_all(" + FOLD.format("text") + ", '[\\p{L}\\p{N}]+')"


def _docs(spark, sf):
    return c.texts(spark, sf).items


def _ids(df):
    return df.select("item_id")


def _keep(spark, sf, name, *tables):
    """Tables of this name made from these tables, made once for each state of their files."""
    return lambda part, make, folders=(): kept(f"{name}-{part}", [f"{sf}/{t}.parquet" for t in tables], spark, make, folders)


def _index(spark, sf, language=None):
    """The text index of the documents' contents."""
    return TextIndex.build(c.Catalogue(_docs(spark, sf)), _keep(spark, sf, "documents", "documents"), ("content",), Analyzer(language))


def _titled(spark, sf):
    """Documents with their first three words as title."""
    docs = _docs(spark, sf)
    titled = docs.withColumn("title", F.array_join(F.slice(tx.folded_tokens("content"), 1, 3), " "))
    return TextIndex.build(c.Catalogue(titled), _keep(spark, sf, "titled", "documents"), ("title", "content"))


def _talks(spark, sf):
    """Conversations with all fields and entries, and their index."""
    found = c.talks(spark, sf)
    return found, TextIndex.build(found, _keep(spark, sf, "talks", "conversations"))


def _corpus(spark, sf):
    """The corpus' vocabulary, made once."""
    return kept("corpus", [f"{sf}/documents.parquet"], spark, lambda: mining.corpus(c.table(spark, sf, "documents")))


@query("text_and_match", f"SELECT doc_id AS item_id FROM documents WHERE list_has_all({TOKENS}, ['the', 'apache', 'license'])")
def text_and_match(spark, sf):
    return _index(spark, sf).all("Apache, the LICENSE")


@query("text_and_match_scan", f"SELECT doc_id AS item_id FROM documents WHERE list_has_all({TOKENS}, ['licensed', 'apache'])")
def text_and_match_scan(spark, sf):
    """Without an index, by one scan of the texts."""
    return _ids(search.match_all(_docs(spark, sf), "licensed apache", ("content",)))


@query("text_phrase", f"SELECT doc_id AS item_id FROM documents WHERE contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' under the apache license ')")
def text_phrase(spark, sf):
    return _index(spark, sf).phrase("under the Apache License")


@query("text_phrase_scan", f"SELECT doc_id AS item_id FROM documents WHERE contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' in the ')")
def text_phrase_scan(spark, sf):
    """Without an index, by one scan of the texts."""
    return _ids(_docs(spark, sf).where(search.phrase("content", "in the")))


@query(
    "text_prefix",
    f"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents),
    v AS (SELECT DISTINCT x AS token FROM (SELECT unnest(w) AS x FROM t) WHERE starts_with(x, 'licen') ORDER BY 1 LIMIT 200)
    SELECT doc_id AS item_id FROM t WHERE list_contains(w, 'the') AND list_has_any(w, (SELECT list(token) FROM v))""",
)
def text_prefix(spark, sf):
    return _index(spark, sf).prefix("the licen")


@query(
    "text_prefix_decision",
    f"""WITH t AS (SELECT {TOKENS} AS w FROM documents)
    SELECT q AS fragment, NOT bool_or(list_contains(w, q)) AS expands FROM t, (SELECT unnest(['apach', 'apache', 'zzzq']) AS q) GROUP BY q""",
)
def text_prefix_decision(spark, sf):
    index = _index(spark, sf)
    return spark.createDataFrame([(w, index.wants_prefix(w)) for w in ("apach", "apache", "zzzq")], "fragment string, expands boolean")


@query(
    "text_fuzzy",
    f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS w FROM documents),
    n AS (SELECT DISTINCT w, q FROM (SELECT DISTINCT w FROM t) v, (VALUES ('licnesed', 2), ('apahce', 1)) q(q, k)
          WHERE w[1] = q[1] AND damerau_levenshtein(w, q) <= k)
    SELECT doc_id AS item_id FROM t JOIN n USING (w) GROUP BY doc_id HAVING count(DISTINCT q) = 2""",
)
def text_fuzzy(spark, sf):
    return _index(spark, sf).fuzzy("licnesed apahce")


@query("text_synonym", f"SELECT doc_id AS item_id FROM documents WHERE list_has_all({TOKENS}, ['license', 'apache']) OR list_has_all({TOKENS}, ['license', 'gnu', 'general'])")
def text_synonym(spark, sf):
    return _index(spark, sf).synonyms("apache license", [(["apache", "gnu general"], [])])


@query(
    "text_synonym_graph",
    f"""WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents), q AS (SELECT unnest([['apache', 'license'], ['apache', 'version'], ['gnu', 'general', 'license'], ['gnu', 'general', 'version']]) AS q)
    SELECT DISTINCT doc_id AS item_id FROM w, q WHERE list_has_all(w, q)""",
)
def text_synonym_graph(spark, sf):
    """Two rules meet in one query."""
    return _index(spark, sf).synonyms("apache license", [(["apache", "gnu general"], []), (["license", "version"], [])])


@query("text_synonym_one_way", f"SELECT doc_id AS item_id FROM documents WHERE list_has_all({TOKENS}, ['mit', 'license'])")
def text_synonym_one_way(spark, sf):
    """The left side of a one-way rule is replaced."""
    return _index(spark, sf).synonyms("apache license", [(["apache"], ["mit"])])


@query(
    "text_bm25",
    f"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents),
    n AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'apache')) AS a, len(list_filter(w, lambda x: x = 'version')) AS b FROM t),
    s AS (SELECT count(*) AS items, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM n)
    SELECT doc_id AS item_id, round(ln(1 + (items - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean))
        + ln(1 + (items - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM n, s WHERE a + b > 0""",
)
def text_bm25(spark, sf):
    return _index(spark, sf).bm25("apache version", {"content": 1.0}, _docs(spark, sf).count()).select("item_id", F.round("score", 6).alias("score"))


@query(
    "text_bm25_boosted",
    f"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents),
    n AS (SELECT doc_id, 'content' AS field, 1.0::DOUBLE AS boost, w FROM t UNION ALL SELECT doc_id, 'title', 3.0, w[1:3] FROM t),
    l AS (SELECT field, sum(len(w)) / (SELECT count(*) FROM t) AS mean FROM n GROUP BY field),
    q AS (SELECT unnest(['the', 'apache']) AS q),
    f AS (SELECT n.*, q, len(list_filter(w, lambda x: x = q)) AS tf FROM n, q),
    d AS (SELECT field, q, count(*) AS df FROM f WHERE tf > 0 GROUP BY ALL),
    p AS (SELECT doc_id, f.field, boost, sum(ln(1 + ((SELECT count(*) FROM t) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))) AS part
          FROM f JOIN d ON f.field = d.field AND f.q = d.q JOIN l ON l.field = f.field WHERE tf > 0 GROUP BY doc_id, f.field, boost)
    SELECT doc_id AS item_id, round(max(part * boost), 6) AS score FROM p GROUP BY doc_id""",
)
def text_bm25_boosted(spark, sf):
    """The better of the title's score, thrice, and the content's."""
    found = _titled(spark, sf).bm25("the apache", {"title": OWN["title"], "content": 1.0}, _docs(spark, sf).count())
    return found.select("item_id", F.round("score", 6).alias("score"))


_LOWER = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_STOP = ", ".join(f"'{w}'" for w in sorted(Analyzer("english").stopwords))


@query(
    "text_stemmed",
    f"""WITH t AS (SELECT doc_id, unnest({_LOWER}) AS w FROM documents),
    s AS (SELECT w, {stem_sql("w", "english")} AS a, {stem_sql(FOLD.format("w"), "english")} AS b FROM (SELECT DISTINCT w FROM t) WHERE w NOT IN ({_STOP}) AND {FOLD.format("w")} NOT IN ({_STOP})),
    q AS (SELECT 0 AS i, 'licens' AS q UNION ALL SELECT 1, 'version')
    SELECT doc_id AS item_id FROM t JOIN s USING (w) JOIN q ON q IN (a, b) GROUP BY doc_id HAVING count(DISTINCT i) = 2""",
)
def text_stemmed(spark, sf):
    """All documents, in English analysis: stop words go, other words meet by their stems."""
    return _index(spark, sf, "english").all("of the Licensed Versions")


#: Entries of conversations: field, entry and words; the fields' boosts.
TALKS = f"""e AS (
  SELECT conv_id, 'own' AS part, 'title' AS field, 0 AS entry, 3.0::DOUBLE AS boost, {TOKENS.replace("text", "array_to_string(string_split(text, ' ')[1:3], ' ')")} AS w FROM conversations WHERE turn = 0
  UNION ALL SELECT conv_id, 'own', 'description', 0, 2.0, {TOKENS.replace("text", "array_to_string(string_split(text, ' ')[1:12], ' ')")} FROM conversations WHERE turn = 0
  UNION ALL SELECT conv_id, 'metadata', 'metadata', turn + 1, 1.0, {TOKENS} FROM conversations
  UNION ALL SELECT conv_id, 'taxonomies', 'taxonomies', 0, 1.0, list_distinct(list(role)) FROM conversations GROUP BY conv_id)"""


@query("listing_text", f"WITH {TALKS} SELECT conv_id AS item_id FROM e WHERE list_has_all(w, ['that', 'with', 'from']) GROUP BY conv_id ORDER BY conv_id LIMIT 25")
def listing_text(spark, sf):
    """Words that have to meet in one turn, or one title, description or term list."""
    found, index = _talks(spark, sf)
    return listing.page(found, build({"s": "That, WITH from", "orderby": "id", "order": "ASC", "posts_per_page": 25}, ("col_talks",)), index)


@query("listing_text_scan", f"WITH {TALKS} SELECT conv_id AS item_id FROM e WHERE list_has_all(w, ['assistant']) OR list_has_all(w, ['user']) GROUP BY conv_id ORDER BY conv_id DESC LIMIT 30")
def listing_text_scan(spark, sf):
    """Terms of taxonomies, a synonym, without an index."""
    return listing.page(c.talks(spark, sf), build({"s": "assistant", "orderby": "id", "posts_per_page": 30}, ("col_talks",)), options=Options(rules=((["assistant", "user"], []),)))


_TALK_SCORES = f"""{TALKS}, q AS (SELECT unnest(['the', 'of']) AS q),
  st AS (SELECT field, count(*) AS docs, sum(len(w)) AS words FROM e WHERE len(w) > 0 GROUP BY field),
  tf AS (SELECT conv_id, part, field, entry, boost, len(w) AS n, q, len(list_filter(w, lambda x: x = q)) AS tf FROM e, q),
  df AS (SELECT field, q, count(*) AS df FROM tf WHERE tf > 0 GROUP BY ALL),
  s AS (SELECT conv_id, part, tf.field, entry, count(*) AS held, sum(boost * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (words / docs)))) AS s
        FROM tf JOIN df ON tf.field = df.field AND tf.q = df.q JOIN st ON st.field = tf.field WHERE tf > 0 GROUP BY ALL),
  p AS (SELECT conv_id, part, max(s) AS s FROM s WHERE held = 2 GROUP BY ALL),
  r AS (SELECT conv_id AS item_id, sum(s) AS score FROM p GROUP BY conv_id)"""


@query("text_scores", f"WITH {_TALK_SCORES} SELECT item_id, round(score, 6) AS score FROM r")
def text_scores(spark, sf):
    """The best of the own fields, boosted, with the best turn and the best terms."""
    return _talks(spark, sf)[1].scores("the of").select("item_id", F.round("score", 6).alias("score"))


@query("listing_relevance", f"WITH {_TALK_SCORES} SELECT item_id FROM r ORDER BY CAST(score AS FLOAT) DESC, item_id DESC LIMIT 10")
def listing_relevance(spark, sf):
    found, index = _talks(spark, sf)
    return listing.page(found, build({"s": "the of"}, ("col_talks",)), index)


@query("listing_typing_errors", f"WITH {TALKS}, h AS (SELECT DISTINCT conv_id FROM e, LATERAL (SELECT unnest(w) AS x) WHERE x[1] = 'a' AND damerau_levenshtein(x, 'assitsant') <= 2) SELECT conv_id AS item_id FROM h ORDER BY conv_id LIMIT 40")
def listing_typing_errors(spark, sf):
    found, index = _talks(spark, sf)
    q = build({"s": "assitsant", "orderby": "id", "order": "ASC", "posts_per_page": 40}, ("col_talks",))
    return listing.page(found, q, index, Options(prefix=False, fuzzy=True))


@query("listing_completed", f"WITH {TALKS} SELECT DISTINCT conv_id AS item_id FROM e WHERE len(list_filter(w, lambda x: starts_with(x, 'assis'))) > 0 AND conv_id IN (SELECT conv_id FROM e WHERE list_has_all(w, ['the', 'of'])) ORDER BY 1 LIMIT 40")
def listing_completed(spark, sf):
    """Both words in one entry, and in any entry one that begins as the last does, which is no word."""
    found, index = _talks(spark, sf)
    return listing.page(found, build({"s": "the of assis", "orderby": "id", "order": "ASC", "posts_per_page": 40}, ("col_talks",)), index)


@query(
    "text_synonym_lattice",
    f"""WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents),
    a AS (SELECT unnest([['apache'], ['gnu', 'general', 'public'], ['mit']]) AS a), b AS (SELECT unnest([['license'], ['licensed'], ['version']]) AS b),
    c AS (SELECT b1.b || b2.b AS c FROM b b1, b b2 UNION ALL SELECT ['warranty'])
    SELECT DISTINCT doc_id AS item_id FROM w, a, c WHERE list_has_all(w, a) AND list_has_all(w, c)""",
)
def text_synonym_lattice(spark, sf):
    """Three rules that meet, one of them over two words that another one changes too."""
    rules = [(["apache", "gnu general public", "mit"], []), (["license", "licensed", "version"], []), (["version license", "warranty"], [])]
    return _index(spark, sf).synonyms("apache version license", rules)


@query(
    "analyze_groups",
    """WITH t AS (SELECT p_partkey AS seq, unnest(string_split(p_name, ' ')) AS token, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part),
    f AS (SELECT pos, token, min(seq) AS seq FROM t GROUP BY 1, 2) SELECT CAST(pos AS INT) AS pos, string_agg(token, '|' ORDER BY seq, token) AS forms FROM f GROUP BY pos""",
)
def analyze_groups(spark, sf):
    """The forms that stand at each place of the parts' names."""
    words = c.table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.posexplode(tx.folded_tokens("p_name")).alias("pos", "token"))
    return search.group_tokens(words)


@query("fold_word", "SELECT DISTINCT w, regexp_replace(" + FOLD.format("w") + ", '[^a-z0-9]', '', 'g') AS folded FROM (SELECT unnest(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+')) AS w FROM documents) WHERE w <> ''")
def fold_word(spark, sf):
    """Every word of every text, of any length, on either side of any white space."""
    w = c.table(spark, sf, "documents").select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''").distinct()
    return w.select("w", tx.fold_word("w").alias("folded"))


WORDS = "list_filter(regexp_split_to_array(text, '[^\\p{L}]+'), lambda w: length(w) >= 2)"
VOCAB = f"""w AS (SELECT doc_id, unnest({WORDS}) AS w FROM documents),
k AS (SELECT doc_id, w, lower(w) AS form, {FOLD.format("w")} AS key FROM w),
f AS (SELECT key, form, count(*) AS n FROM k WHERE form <> key GROUP BY 1, 2),
b AS (SELECT key, form, n FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, encode(form)) = 1),
v AS (SELECT key, CAST(count(*) AS BIGINT) AS tf, CAST(count(DISTINCT doc_id) AS BIGINT) AS df,
  round(count(*) FILTER (regexp_matches(w, '^\\p{{Lu}}')) / count(*), 2) AS cap FROM k GROUP BY key)"""


@query("corpus_vocab", f"WITH {VOCAB} SELECT key, tf, df, cap FROM v")
def corpus_vocab(spark, sf):
    return _corpus(spark, sf).select("key", "tf", "df", "cap")


@query("corpus_best_form", f"WITH {VOCAB} SELECT v.key, CASE WHEN 2 * b.n >= v.tf THEN b.form ELSE v.key END AS best FROM v LEFT JOIN b ON v.key = b.key")
def corpus_best_form(spark, sf):
    return _corpus(spark, sf).select("key", "best")


@query(
    "technical_stopwords",
    f"WITH documents AS (SELECT page_id AS doc_id, html AS text FROM pages), {VOCAB} SELECT key, df FROM v WHERE key IN ('https', 'http', 'www', 'gov', 'br', 'org', 'html', 'php', 'jpg', 'jpeg', 'png', 'pdf') AND df >= 0.01 * (SELECT count(*) FROM documents)",
)
def technical_stopwords(spark, sf):
    """Words of addresses and markup that pages are full of."""
    pages = c.table(spark, sf, "pages").select("page_id", F.col("html").alias("text"))
    found = kept("pages-corpus", [f"{sf}/pages.parquet"], spark, lambda: mining.corpus(pages))
    return mining.technical_stopwords(found, pages.count(), 0.01)


_NAMES = "string_split(p_name, ' ')"


@query(
    "acronyms",
    f"""WITH p AS (SELECT p_partkey, upper({_NAMES}[1][1]) || substr({_NAMES}[1], 2) AS a, upper({_NAMES}[2][1]) || substr({_NAMES}[2], 2) AS b FROM part)
    SELECT a[1] || b[1] AS acronym, a || CASE WHEN p_partkey % 4 = 1 THEN ' of the ' WHEN p_partkey % 4 = 2 THEN ' d' || chr(39) ELSE ' ' END || b AS expansion, count(*) AS n
    FROM p WHERE p_partkey % 4 < 3 GROUP BY 1, 2""",
)
def acronyms(spark, sf):
    """Over all documents, which define none, and a text for each part that defines one, a fourth of them wrongly."""
    a, b = (F.initcap(F.get(F.split("p_name", " "), F.lit(i))) for i in (0, 1))
    between = F.when(F.col("p_partkey") % 4 == 1, " of the ").when(F.col("p_partkey") % 4 == 2, " d'").otherwise(" ")
    initials = F.concat(F.substring(a, 1, 1), F.substring(b, 1, 1))
    named = F.concat(F.lit("it is the "), a, between, b, F.lit(" ("), F.when(F.col("p_partkey") % 4 == 3, F.concat(initials, initials)).otherwise(initials), F.lit(") of them (now)"))
    parts = c.table(spark, sf, "part").select(named.alias("text"))
    return mining.acronyms(c.table(spark, sf, "documents").select("text").unionByName(parts))


@query(
    "typo_candidates",
    f"""WITH {VOCAB}, d AS (SELECT key FROM v WHERE tf >= 30),
    p AS (SELECT r.key AS typo, r.tf, g.key AS good, g.tf AS good_tf FROM v r JOIN v g ON r.key[1] = g.key[1] AND abs(length(r.key) - length(g.key)) <= 1
      WHERE r.tf <= 3 AND length(r.key) >= 5 AND r.cap < 0.5 AND g.tf >= 30 AND length(g.key) >= 5 AND g.tf >= 20 * r.tf AND r.key NOT IN (SELECT key FROM d)
        AND regexp_replace(r.key, 's$', '') <> regexp_replace(g.key, 's$', '') AND damerau_levenshtein(r.key, g.key) = 1)
    SELECT typo, tf, good, good_tf FROM p QUALIFY row_number() OVER (PARTITION BY typo ORDER BY good_tf DESC, good) = 1""",
)
def typo_candidates(spark, sf):
    v = _corpus(spark, sf)
    return mining.typing_errors(v, v.where("tf >= 30").select("key"))


def _modern(expr: str, rules: list[tuple[str, str]]) -> str:
    for old, new in rules:
        if "(?" not in old:
            expr = f"regexp_replace({expr}, '{old}', '{new}', 'g')"
        elif old.startswith("^sc"):
            expr = f"regexp_replace({expr}, '^sc([ei])', 'c\\1')"
        elif old.startswith("cc"):
            expr = f"regexp_replace({expr}, 'cc([aeiou])', 'c\\1', 'g')"
        else:  # z and s between vowels: twice, for matches that share a vowel
            for _ in range(2):
                expr = f"regexp_replace({expr}, '([aeiou]){old[12]}([aeiou])', '\\1{new}\\2', 'g')"
    return expr


_SAFE = _modern("key", tx.SAFE_SPELLINGS)
_ALL = _modern("key", tx.SAFE_SPELLINGS + tx.RISKY_SPELLINGS)


@query("modernized_spelling", f"WITH {VOCAB} SELECT key, {_SAFE} AS safe, {_ALL} AS every FROM v")
def modernized_spelling(spark, sf):
    return _corpus(spark, sf).select("key", tx.modernize("key").alias("safe"), tx.modernize("key", risky=True).alias("every"))


@query(
    "spelling_variants",
    f"""WITH {VOCAB}, d AS (SELECT key FROM v WHERE tf >= 30),
    ways AS (SELECT *, 0 AS way, {_SAFE} AS m FROM v WHERE length(key) >= 4 AND tf >= 2 UNION ALL SELECT *, 1, {_ALL} FROM v WHERE length(key) >= 4 AND tf >= 2),
    j AS (SELECT ways.*, n.df AS m_df, n.cap AS m_cap, ways.key IN (SELECT key FROM d) AS old_word, ways.m IN (SELECT key FROM d) AS new_word FROM ways LEFT JOIN v n ON n.key = ways.m WHERE ways.m <> ways.key),
    x AS (SELECT *, NOT old_word AND new_word AND length(key) >= 5 AND length(m) >= 5 AS word FROM j),
    y AS (SELECT *, CASE WHEN word AND CASE WHEN way = 1 THEN coalesce(m_df >= 3 * df, false) ELSE m_df IS NOT NULL OR length(key) >= 6 END THEN 'word'
        WHEN NOT word AND m_df IS NOT NULL AND cap >= 0.7 AND m_cap >= 0.7 AND m_df >= 2 AND df >= 2 THEN 'name' END AS kind FROM x)
    SELECT key AS archaic, m AS modern, kind, df, CAST(coalesce(m_df, 0) AS BIGINT) AS modern_df FROM y WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY way) = 1""",
)
def spelling_variants(spark, sf):
    v = _corpus(spark, sf)
    none = spark.createDataFrame([], "key string")
    return mining.spelling_variants(v, v.where("tf >= 30").select("key"), none, none)


@query("strip_html", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<[^>]*>', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS digest FROM pages")
def strip_html(spark, sf):
    return c.table(spark, sf, "pages").select("page_id", F.md5(tx.strip_html("html")).alias("digest"))


def _lists(spark, sf):
    """Lines of the lists from the parts: a part is a line of each, of its name's two words and its brand."""
    p = c.table(spark, sf, "part").withColumns({"a": F.get(F.split("p_name", " "), F.lit(0)), "b": F.get(F.split("p_name", " "), F.lit(1)), "k": F.col("p_partkey")})
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    text = {
        "synonyms": F.when(F.col("k") % 5 == 0, F.concat("a", F.lit(" -> "), "b")).when(F.col("k") % 5 == 1, F.col("a")).otherwise(F.concat("a", F.lit(", "), "b", F.lit(";"), brand)),
        "variants": F.when(F.col("k") % 3 == 0, F.concat("a", F.lit(" → "), "a")).otherwise(F.concat(F.upper("b"), F.lit(", <i>"), "a", F.lit("</i>"))),
        "corrections": F.when(F.col("k") % 4 == 0, F.concat("a", F.lit(", "), "b")).otherwise(F.concat("a", F.lit(" => "), "b")),
        "stopwords": F.when(F.col("k") % 3 == 0, F.col("p_name")).otherwise(F.concat("a", F.lit(", "), F.upper("b"))),
    }
    return p.select(F.explode(F.array(*[F.struct(F.lit(n).alias("list"), (F.col("k") + 1).cast("int").alias("line"), t.alias("text")) for n, t in text.items()])).alias("r")).select("r.*")


PARSED = """p AS (SELECT p_partkey AS k, CAST(p_partkey + 1 AS INT) AS line, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, lower(replace(p_brand, '#', '')) AS brand FROM part),
x AS (SELECT 'synonyms' AS list, 1 AS place, line, CASE WHEN k % 5 = 0 THEN 'map' ELSE 'equiv' END AS type, CASE WHEN k % 5 < 2 THEN a ELSE a || ',' || b || ',' || brand END AS l, CASE WHEN k % 5 = 0 THEN b ELSE '' END AS r,
        CASE WHEN k % 5 = 1 THEN 'fewer than two terms' END AS error FROM p
  UNION ALL SELECT 'variants', 2, line, CASE WHEN k % 3 = 0 THEN 'map' ELSE 'equiv' END, CASE WHEN k % 3 = 0 THEN a ELSE b || ',' || a END, CASE WHEN k % 3 = 0 THEN a ELSE '' END, CASE WHEN k % 3 = 0 THEN 'sides are equal' END FROM p
  UNION ALL SELECT 'corrections', 3, line, CASE WHEN k % 4 = 0 THEN 'equiv' ELSE 'map' END, CASE WHEN k % 4 = 0 THEN a || ',' || b ELSE a END, CASE WHEN k % 4 = 0 THEN '' ELSE a || ',' || b END, CASE WHEN k % 4 = 0 THEN 'arrow required' END FROM p),
good AS (SELECT * FROM x WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY type, l, r ORDER BY place, line) = 1)"""


@query("vocab_parse", f"WITH {PARSED} SELECT list, line, type, l, r, error FROM x")
def vocab_parse(spark, sf):
    rows = vocabulary.parse(_lists(spark, sf))
    return rows.select("list", "line", "type", F.array_join("left", ",").alias("l"), F.array_join("right", ",").alias("r"), "error")


@query(
    "vocab_report",
    f"""WITH {PARSED}, g AS (SELECT list, count(*) AS rules FROM good GROUP BY 1)
    SELECT x.list, any_value(rules) AS rules, count(*) FILTER (error IS NULL) - any_value(rules) AS duplicates, count(*) FILTER (error IS NOT NULL) AS errors FROM x JOIN g ON g.list = x.list GROUP BY 1""",
)
def vocab_report(spark, sf):
    return vocabulary.report(vocabulary.parse(_lists(spark, sf)))


@query(
    "vocab_compile",
    f"""WITH {PARSED}, s AS (SELECT *, list_filter(string_split(l, ','), lambda t: t NOT IN ('red', 'gear')) AS ls, list_filter(string_split(r, ','), lambda t: t NOT IN ('red', 'gear', '')) AS rs FROM good),
    u AS (SELECT *, CASE WHEN type = 'equiv' THEN len(ls) >= 2 ELSE len(ls) > 0 AND len(rs) > 0 AND ls <> rs END AS usable FROM s)
    SELECT list, line, CASE WHEN usable THEN array_to_string(ls, ', ') || CASE WHEN type = 'map' THEN ' => ' || array_to_string(rs, ', ') ELSE '' END END AS rule,
    CASE WHEN NOT usable THEN 'no effect' WHEN len(ls) + len(rs) < len(string_split(l, ',')) + CASE WHEN r = '' THEN 0 ELSE len(string_split(r, ',')) END THEN 'term of stop words dropped' END AS note FROM u""",
)
def vocab_compile(spark, sf):
    return vocabulary.compiled(vocabulary.rules(vocabulary.parse(_lists(spark, sf))), ("red", "gear"))


@query(
    "vocab_stopwords",
    """WITH p AS (SELECT p_partkey % 3 AS m, string_split(p_name, ' ') AS w FROM part) SELECT DISTINCT unnest(w) AS word, NULL AS error FROM p WHERE m > 0
    UNION ALL SELECT DISTINCT NULL, 'one word only' FROM p WHERE m = 0""",
)
def vocab_stopwords(spark, sf):
    return vocabulary.stopwords(_lists(spark, sf)).select("word", "error")


_SWAPPED = "CASE WHEN p_partkey % 10 = 0 AND length(w2) >= 4 THEN w1 || ' ' || w2[1:2] || w2[4] || w2[3] || w2[5:] ELSE p_name END"


@query(
    "near_terms",
    f"""WITH p AS (SELECT *, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2 FROM part), d AS (SELECT DISTINCT w2 AS key FROM p),
    t AS (SELECT DISTINCT {_SWAPPED} AS n FROM p), s AS (SELECT n, string_split(n, ' ')[1] AS a, string_split(n, ' ')[2] AS b FROM t WHERE length(n) >= 5),
    j AS (SELECT CASE WHEN x.a <> y.a THEN x.a ELSE x.b END AS u, CASE WHEN x.a <> y.a THEN y.a ELSE y.b END AS v FROM s x JOIN s y ON x.n < y.n AND (x.a = y.a) <> (x.b = y.b) AND damerau_levenshtein(x.n, y.n) = 1),
    k AS (SELECT u, v, u IN (SELECT key FROM d) AS ku, v IN (SELECT key FROM d) AS kv FROM j WHERE length(u) >= 4 AND regexp_replace(u, 's$', '') <> regexp_replace(v, 's$', ''))
    SELECT CASE WHEN ku OR ku = kv THEN u ELSE v END AS good, CASE WHEN ku OR ku = kv THEN v ELSE u END AS bad, ku <> kv AS typo FROM k""",
)
def near_terms(spark, sf):
    """Names of parts, of every tenth with two letters swapped, against the second words as they should be."""
    p = c.table(spark, sf, "part").withColumns({"w1": F.get(F.split("p_name", " "), F.lit(0)), "w2": F.get(F.split("p_name", " "), F.lit(1))})
    swapped = F.concat("w1", F.lit(" "), F.left("w2", F.lit(2)), F.substring("w2", 4, 1), F.substring("w2", 3, 1), F.substr("w2", F.lit(5)))
    names = p.select(F.when((F.col("p_partkey") % 10 == 0) & (F.char_length("w2") >= 4), swapped).otherwise(F.col("p_name")).alias("name"))
    return mining.near_terms(names, p.select(F.col("w2").alias("key")).distinct()).select("good", "bad", "typo")


@query(
    "acronym_rules",
    f"""WITH p AS (SELECT p_partkey, upper({_NAMES}[1][1]) || substr({_NAMES}[1], 2) AS a, upper({_NAMES}[2][1]) || substr({_NAMES}[2], 2) AS b FROM part),
    f AS (SELECT a[1] || b[1] AS acronym, a || ' ' || b AS expansion, count(*) AS n FROM p GROUP BY 1, 2),
    t AS (SELECT * FROM f WHERE acronym NOT IN ({", ".join(f"'{x}'" for x in mining.STATES)}) QUALIFY row_number() OVER (PARTITION BY acronym ORDER BY n DESC, expansion) = 1)
    SELECT acronym, lower(expansion) AS expansion, n, n >= 2 AND lower(acronym) NOT IN (SELECT lower(n_name[1:2]) FROM nation) AS active FROM t""",
)
def acronym_rules(spark, sf):
    """Of the parts' names by their initials; the first two letters of nations count as words."""
    a, b = (F.initcap(F.get(F.split("p_name", " "), F.lit(i))) for i in (0, 1))
    found = c.table(spark, sf, "part").select(F.concat(F.left(a, F.lit(1)), F.left(b, F.lit(1))).alias("acronym"), F.concat_ws(" ", a, b).alias("expansion")).groupBy("acronym", "expansion").agg(F.count(F.lit(1)).alias("n"))
    return mining.acronym_rules(found, c.table(spark, sf, "nation").select(F.lower(F.left("n_name", F.lit(2))).alias("word")))


@query("thesaurus_groups", f"WITH {VOCAB} SELECT grp, count(*) AS present, max(df) AS df FROM (SELECT 1 AS grp, min(df) AS df FROM v WHERE key IN ('apache', 'license') HAVING count(*) = 2 UNION ALL SELECT 1, min(df) FROM v WHERE key IN ('gnu') HAVING count(*) = 1) GROUP BY grp")
def thesaurus_groups(spark, sf):
    groups = spark.createDataFrame([(1, "Apache License"), (1, "GNU"), (2, "zzzqqq palavra")], "grp int, term string")
    return mining.present_groups(groups, _corpus(spark, sf))


@query("known_errors", "SELECT * FROM (VALUES ('lisense, lisenze => license')) t(line)")
def known_errors(spark, sf):
    pairs = spark.createDataFrame([("license", "lisense"), ("license", "lisenze"), ("license", "licénse"), ("zzzqqq", "zzzqq")], "good string, bad string")
    return mining.known_errors(pairs, _corpus(spark, sf))


_STATE_ROWS = ", ".join(f"('{k.lower()}', '{v.lower()}', {str(k not in mining.AMBIGUOUS_STATES).lower()})" for k, v in mining.STATES.items())


@query("state_rules", f"WITH {VOCAB} SELECT acronym, name, active, df FROM (VALUES {_STATE_ROWS}) t(acronym, name, active) JOIN v ON v.key = acronym")
def state_rules(spark, sf):
    """The units whose acronym the corpus holds, and in how many items."""
    return mining.state_rules(spark).join(_corpus(spark, sf).select(F.col("key").alias("acronym"), "df"), "acronym")


@query("rendered_list", "WITH g AS (SELECT lower(p_type) || ', ' || lower(p_brand) AS line, count(*) AS n FROM part GROUP BY 1) SELECT line AS value FROM g UNION ALL SELECT '# Kinds (' || count(*) || ')' FROM g")
def rendered_list(spark, sf):
    lines = c.table(spark, sf, "part").groupBy(F.concat_ws(", ", F.lower("p_type"), F.lower("p_brand")).alias("line")).agg(F.count(F.lit(1)).alias("hits"))
    return mining.rendered(lines, "Kinds")


@query(
    "variant_groups",
    f"""WITH {VOCAB}, m AS (SELECT key, {_SAFE} AS modern, df, CASE length(key) % 3 WHEN 0 THEN 'word' WHEN 1 THEN 'name' ELSE 'review' END AS kind FROM v),
    c AS (SELECT key, kind, df, CASE WHEN kind = 'word' THEN regexp_replace(modern, 's$', '') ELSE modern END AS modern FROM m WHERE modern <> key AND kind <> 'review')
    SELECT modern, kind, string_agg(key, '|' ORDER BY encode(key)) AS archaic, CAST(sum(df) AS BIGINT) AS hits FROM c GROUP BY 1, 2""",
)
def variant_groups(spark, sf):
    """The corpus' words under their modernised spelling, whatever that is, the kind by their length."""
    n = F.char_length("key") % 3
    kind = F.when(n == 0, "word").when(n == 1, "name").otherwise("review")
    rows = _corpus(spark, sf).select(F.col("key").alias("archaic"), tx.modernize("key").alias("modern"), kind.alias("kind"), "df").where("archaic <> modern")
    return mining.variant_groups(rows).withColumn("archaic", F.array_join("archaic", "|"))
