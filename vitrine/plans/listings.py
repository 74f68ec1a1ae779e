"""Queries of listings, filters and facets over the fixture catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import facets, filters, ingest, listing
from vitrine.plans.registry import query
from vitrine.plans.spec import Viewer, build
from vitrine.sources import catalogue as c

CURATOR = Viewer(True, frozenset({"col_orders", "col_part"}))
STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'publish' WHEN 'O' THEN 'private' ELSE 'draft' END"


def _order_page(spark: SparkSession, sf: str, **args) -> DataFrame:
    return listing.page(c.orders(spark, sf), build(args, ("col_orders",), CURATOR))


def _part_ids(spark: SparkSession, sf: str, **args) -> DataFrame:
    cat = c.parts(spark, sf)
    return filters.apply(cat, build(args, ("col_part",))).select("item_id")


def _order_ids(spark: SparkSession, sf: str, **args) -> DataFrame:
    return filters.apply(c.orders(spark, sf), build(args, ("col_orders",), CURATOR)).select("item_id")


@query("listing_default", "SELECT o_orderkey AS item_id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 12 OFFSET 24")
def listing_default(spark, sf):
    return _order_page(spark, sf, posts_per_page=12, paged=3)


@query("listing_any_status", "SELECT o_orderkey AS item_id FROM orders ORDER BY o_custkey ASC, o_orderkey DESC LIMIT 25 OFFSET 10")
def listing_any_status(spark, sf):
    return _order_page(spark, sf, post_status="any", orderby={"author": "ASC"}, posts_per_page=25, offset=10)


@query("listing_total_pages", "SELECT count(*) AS found, CAST(ceil(count(*) / 12.0) AS BIGINT) AS pages FROM orders WHERE o_orderstatus IN ('F', 'O')")
def listing_total_pages(spark, sf):
    q = build({"perm": "readable", "posts_per_page": 12}, ("col_orders",), CURATOR)
    return listing.totals(filters.apply(c.orders(spark, sf), q), q.size)


@query("listing_title_collated", "SELECT p_partkey AS item_id FROM part ORDER BY icu_sort_key(rtrim(substr(p_name, 1, 500)), 'pt') ASC, p_partkey ASC LIMIT 100")
def listing_title_collated(spark, sf):
    return listing.page(c.parts(spark, sf), build({"orderby": "title", "order": "ASC", "posts_per_page": 100}, ("col_part",)))


@query("listing_keyset", "SELECT o_orderkey AS item_id FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 500")
def listing_keyset(spark, sf):
    return c.keyset_page(c.orders(spark, sf).items, 100, 500)


@query("scan_item_ids", "SELECT o_orderkey AS item_id FROM orders")
def scan_item_ids(spark, sf):
    return c.item_ids(c.orders(spark, sf).items)


@query("scan_collection_ids", "SELECT doc_id AS item_id FROM documents WHERE source = 'src3'")
def scan_collection_ids(spark, sf):
    return c.item_ids(c.texts(spark, sf).items, "col_src3")


@query("known_post_types", "SELECT DISTINCT 'col_' || source AS post_type FROM documents")
def known_post_types(spark, sf):
    return c.known_post_types(c.texts(spark, sf).items)


@query("root_count", "SELECT count(*) AS n FROM orders")
def root_count(spark, sf):
    return c.orders(spark, sf).items.agg(F.count(F.lit(1)).alias("n"))


@query("status_counts", f"SELECT {STATUS_SQL} AS post_status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf):
    return c.orders(spark, sf).items.groupBy("post_status").agg(F.count(F.lit(1)).alias("n"))


@query("single_item", "SELECT p_partkey AS item_id FROM part WHERE p_partkey = 7")
def single_item(spark, sf):
    return filters.by_ids(c.parts(spark, sf).items, (7,)).select("item_id")


@query("item_types", "SELECT CAST(doc_id AS BIGINT) AS item_id FROM documents WHERE source IN ('src1', 'src2')")
def item_types(spark, sf):
    docs = c.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.concat(F.lit("tnc_col_"), F.regexp_extract("source", "([0-9]+)", 1), F.lit("_item")).alias("post_type"))
    known = spark.createDataFrame([("tnc_col_1_item",), ("tnc_col_2_item",), ("page",)], "post_type string")
    return filters.item_type(docs, known).select("item_id")


def meta(key: int, value=None, compare: str = "=") -> dict:
    return {"key": key, "value": value, "compare": compare}


@query("meta_in", "SELECT p_partkey AS item_id FROM part WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#45')")
def meta_in(spark, sf):
    return _part_ids(spark, sf, meta_query=[meta(c.BRAND, ["Brand#11", "Brand#23", "Brand#45"], "IN")])


@query("meta_not_in", "SELECT p_partkey AS item_id FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#23')")
def meta_not_in(spark, sf):
    return _part_ids(spark, sf, meta_query=[meta(c.BRAND, ["Brand#11", "Brand#23"], "NOT IN")])


@query("meta_not_equal_passes_absent", "SELECT o_orderkey AS item_id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND o_orderstatus IN ('F', 'O', 'P')")
def meta_not_equal(spark, sf):
    return _order_ids(spark, sf, post_status="any", meta_query=[meta(c.FLAGS, "R", "!=")])


@query("meta_exists", "SELECT o_orderkey AS item_id FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def meta_exists(spark, sf):
    return _order_ids(spark, sf, post_status="any", meta_query=[meta(c.FLAGS, compare="EXISTS")])


@query("meta_not_exists", "SELECT o_orderkey AS item_id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def meta_not_exists(spark, sf):
    return _order_ids(spark, sf, post_status="any", meta_query=[meta(c.FLAGS, compare="NOT EXISTS")])


@query("meta_range", "SELECT p_partkey AS item_id FROM part WHERE p_size > 40")
def meta_range(spark, sf):
    return _part_ids(spark, sf, meta_query=[meta(c.SIZE, "40", ">")])


@query("meta_between", "SELECT o_orderkey AS item_id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 50000")
def meta_between(spark, sf):
    return _order_ids(spark, sf, meta_query=[meta(c.TOTAL, [1000, 50000], "BETWEEN")])


@query("meta_value_ids", "SELECT o_orderkey AS item_id FROM orders WHERE o_custkey IN (7, 77) AND o_orderstatus IN ('F', 'O', 'P')")
def meta_value_ids(spark, sf):
    return _order_ids(spark, sf, post_status="any", meta_query=[meta(c.CUSTOMER, [7, 77], "IN")])


@query("meta_like", "SELECT o_orderkey AS item_id FROM orders WHERE o_orderstatus = 'F' AND ' ' || array_to_string(regexp_extract_all(lower(o_orderpriority), '[\\p{L}\\p{N}]+'), ' ') || ' ' LIKE '% not specified %'")
def meta_like(spark, sf):
    return _order_ids(spark, sf, meta_query=[meta(c.PRIORITY, "Not Specified", "LIKE")])


@query("meta_or_nested", "SELECT p_partkey AS item_id FROM part WHERE p_brand = 'Brand#11' OR (p_size >= 45 AND p_brand <> 'Brand#23')")
def meta_or_nested(spark, sf):
    inner = {"relation": "AND", "clauses": [meta(c.SIZE, 45, ">="), meta(c.BRAND, "Brand#23", "!=")]}
    return _part_ids(spark, sf, meta_query={"relation": "OR", "clauses": [meta(c.BRAND, "Brand#11"), inner]})


TERMS = "string_split(p_name, ' ')"


def tax(terms=(), by: str = "name", operator: str = "IN") -> list[dict]:
    return [{"taxonomy": "name_words", "terms": terms, "field": by, "operator": operator}]


@query("tax_in", f"SELECT p_partkey AS item_id FROM part WHERE len(list_filter({TERMS}, lambda w: length(w) IN (3, 4))) > 0")
def tax_in(spark, sf):
    return _part_ids(spark, sf, tax_query=tax([3, 4], "term_id"))


@query("tax_name", f"SELECT p_partkey AS item_id FROM part WHERE list_contains({TERMS}, 'red') OR list_contains({TERMS}, 'blue')")
def tax_name(spark, sf):
    return _part_ids(spark, sf, tax_query=tax(["red", "blue"]))


@query("tax_and", f"SELECT p_partkey AS item_id FROM part WHERE list_has_all(list_transform({TERMS}, lambda w: length(w)), [4, 5])")
def tax_and(spark, sf):
    return _part_ids(spark, sf, tax_query=tax([4, 5], "term_id", "AND"))


@query("tax_not_in", f"SELECT p_partkey AS item_id FROM part WHERE NOT list_contains(list_transform({TERMS}, lambda w: length(w)), 5)")
def tax_not_in(spark, sf):
    return _part_ids(spark, sf, tax_query=tax([5], "term_id", "NOT IN"))


@query("tax_exists", "SELECT p_partkey AS item_id FROM part")
def tax_exists(spark, sf):
    return _part_ids(spark, sf, tax_query=tax(operator="EXISTS"))


@query("tax_not_exists", "SELECT p_partkey AS item_id FROM part WHERE p_partkey % 3 = 0")
def tax_not_exists(spark, sf):
    """Of every third part the terms are left out."""
    cat = c.parts(spark, sf)
    some = c.Catalogue(cat.items, cat.metadata, cat.taxonomies.where("item_id % 3 > 0"))
    return filters.apply(some, build({"tax_query": tax(operator="NOT EXISTS")}, ("col_part",))).select("item_id")


@query("tax_or_group", f"SELECT p_partkey AS item_id FROM part WHERE list_contains(list_transform({TERMS}, lambda w: length(w)), 3) OR NOT list_contains(list_transform({TERMS}, lambda w: length(w)), 5)")
def tax_or_group(spark, sf):
    return _part_ids(spark, sf, tax_query={"relation": "OR", "clauses": tax([3], "term_id") + tax([5], "term_id", "NOT IN")})


@query("ids_in_author", "SELECT o_orderkey AS item_id FROM orders WHERE o_orderkey BETWEEN 0 AND 199 AND o_orderkey NOT IN (5, 6, 7) AND o_orderstatus = 'F'")
def ids_in(spark, sf):
    return _order_ids(spark, sf, post__in=list(range(200)), post__not_in=[5, 6, 7])


@query("author_items", "SELECT o_orderkey AS item_id FROM orders WHERE o_custkey = 9")
def author_items(spark, sf):
    return _order_ids(spark, sf, post_status="any", author="9")


@query("referrers_of_item", "SELECT o_orderkey AS item_id FROM orders WHERE o_custkey = 7 AND o_orderkey <> 7")
def referrers_of_item(spark, sf):
    return filters.referrers(c.orders(spark, sf).metadata, 7)


FACET = "label, CAST(count(*) AS BIGINT) AS total_items"


@query("facet_brand", f"SELECT p_brand AS {FACET} FROM part GROUP BY p_brand")
def facet_brand(spark, sf):
    return facets.values(c.parts(spark, sf).metadata, c.BRAND)


@query("facet_filtered", f"SELECT p_brand AS {FACET} FROM part WHERE p_size > 25 AND list_contains(list_transform({TERMS}, lambda w: length(w)), 5) GROUP BY p_brand")
def facet_filtered(spark, sf):
    cat = c.parts(spark, sf)
    q = build({"meta_query": [meta(c.SIZE, 25, ">")], "tax_query": tax([5], "term_id")}, ("col_part",), strict=True)
    return facets.values(cat.metadata, c.BRAND, filters.apply(cat, q))


@query("facet_multi", f"SELECT l_returnflag AS label, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS total_items FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def facet_multi(spark, sf):
    cat = c.orders(spark, sf)
    return facets.values(cat.metadata, c.FLAGS, filters.apply(cat, build({"perm": "readable"}, ("col_orders",), CURATOR)))


@query("facet_several_entries", "SELECT CAST(l_suppkey AS VARCHAR) AS label, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS total_items FROM lineitem GROUP BY 1")
def facet_several_entries(spark, sf):
    lines = c.table(spark, sf, "lineitem")
    return facets.several_entries(c.entry(lines, "l_orderkey", 9, keywords=F.array(F.col("l_suppkey").cast("string"))), 9)


@query("facet_search", f"SELECT p_type AS {FACET} FROM part WHERE contains(lower(p_type), 'o') GROUP BY p_type")
def facet_search(spark, sf):
    return facets.search(facets.values(c.parts(spark, sf).metadata, c.TYPE), "O")


@query("facet_page", f"SELECT p_name AS {FACET} FROM part GROUP BY p_name ORDER BY icu_sort_key(p_name, 'pt'), p_name LIMIT 15 OFFSET 10")
def facet_page(spark, sf):
    p = c.table(spark, sf, "part")
    found = facets.values(c.entry(p, "p_partkey", 5, keywords=F.array("p_name")), 5)
    return facets.page(found, 10, 15)


@query("facet_totals", "SELECT count(DISTINCT p_brand) AS total, CAST(ceil(count(DISTINCT p_brand) / 10.0) AS BIGINT) AS pages FROM part")
def facet_totals(spark, sf):
    return facets.totals(facets.values(c.parts(spark, sf).metadata, c.BRAND), 10)


@query("facet_capped", f"SELECT p_brand AS {FACET} FROM part GROUP BY p_brand")
def facet_capped(spark, sf):
    return facets.capped(facets.values(c.parts(spark, sf).metadata, c.BRAND), 100)


@query("missing_items", "SELECT doc_id AS item_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_items(spark, sf):
    indexed = c.table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    return ingest.missing(c.texts(spark, sf).items, indexed)


@query("orphans", "SELECT doc_id AS item_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def orphans(spark, sf):
    live = c.table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), F.when(F.col("quality") == 1, "publish").otherwise("trash").alias("post_status"))
    return ingest.orphans(c.texts(spark, sf).items, live)


@query("referrers", "SELECT o_orderkey AS item_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey <> o_custkey")
def referrers(spark, sf):
    changed = c.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("item_id"))
    return ingest.referrer_pairs(c.orders(spark, sf).metadata.where(F.col("metadatum_id") == c.CUSTOMER), changed)


@query("related_label", "SELECT o_orderkey AS item_id, c_name AS label FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0 AND n_regionkey < 3")
def related_label(spark, sf):
    targets = c.table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("collection_id"), F.when(F.col("c_acctbal") > 0, "publish").otherwise("draft").alias("post_status"))
    collections = c.table(spark, sf, "nation").select(F.col("n_nationkey").alias("collection_id"), F.when(F.col("n_regionkey") < 3, "publish").otherwise("private").alias("status"))
    return ingest.related_labels(c.orders(spark, sf).metadata.where(F.col("metadatum_id") == c.CUSTOMER), targets, collections)


@query(
    "build_document",
    f"""SELECT o_orderkey AS item_id, c_name AS author_name, coalesce('Orders ' || nullif({STATUS_SQL}, 'draft'), '') AS collection_name, CAST(3 + (f.v IS NOT NULL)::INT AS BIGINT) AS n_entries, coalesce(f.v, '') AS flags,
      CASE WHEN o_orderkey % 4 > 0 THEN array_to_string(list_sort(list_distinct(string_split(lower(o_orderpriority), '-'))), '|') ELSE '' END AS terms
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey
    LEFT JOIN (SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ' | ') AS v FROM lineitem GROUP BY 1) f ON l_orderkey = o_orderkey""",
)
def build_document(spark, sf):
    """Orders with their collection by status (drafts have none that is known), author, metadata, and the parts of their priority as terms; of every fourth order the entry has no terms."""
    cat = c.orders(spark, sf)
    orders = c.table(spark, sf, "orders")
    statuses = orders.select(c.status_of("o_orderstatus").alias("status")).distinct()
    collections = statuses.where("status <> 'draft'").select(F.xxhash64("status").alias("collection_id"), F.concat(F.lit("Orders "), "status").alias("collection_name"))
    authors = c.table(spark, sf, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("author_name"))
    words = F.when(F.col("o_orderkey") % 4 > 0, F.array_sort(F.array_distinct(F.split(F.lower("o_orderpriority"), "-")))).otherwise(F.array().cast("array<string>"))
    terms = orders.select(F.col("o_orderkey").cast("long").alias("item_id"), F.lit("priority").alias("slug"), words.alias("terms"), F.lit(None).cast("array<bigint>").alias("term_ids"))
    docs = ingest.build_documents(cat.items.withColumn("collection_id", F.xxhash64("post_status")), collections, authors, cat.metadata, terms)
    flags = F.coalesce(F.get(F.filter("metadata", lambda m: m["metadatum_id"] == c.FLAGS), F.lit(0))["value_text"], F.lit(""))
    own = F.coalesce(F.array_join(F.get("taxonomies", F.lit(0))["terms"], "|"), F.lit(""))
    return docs.select("item_id", "author_name", "collection_name", F.size("metadata").cast("long").alias("n_entries"), flags.alias("flags"), own.alias("terms"))


@query(
    "flatten_metadata",
    """SELECT p_partkey AS item_id, array_to_string(v, '|') AS keywords, array_to_string(v || CASE WHEN p_size > 25 THEN [p_type] ELSE [] END, ' | ') AS value_text,
    CASE WHEN len(v) = 1 THEN TRY_CAST(v[1] AS DOUBLE) END AS value_number
    FROM (SELECT *, list_filter([trim(p_brand), CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END], lambda x: x <> '') AS v FROM part)""",
)
def flatten_metadata(spark, sf):
    p = c.table(spark, sf, "part")
    texts = F.array(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.lit(" ")))
    made = ingest.flatten_value(texts, F.array(F.when(F.col("p_size") > 25, F.col("p_type"))), entity=False)
    return p.select(F.col("p_partkey").alias("item_id"), F.array_join(made["value_keyword"], "|").alias("keywords"), made["value_text"].alias("value_text"), made["value_number"].alias("value_number"))


@query("upsert_items", "SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderpriority END AS title FROM orders")
def upsert_items(spark, sf):
    base = c.orders(spark, sf).items.select("item_id", "title")
    return c.upsert(base, base.where("item_id % 7 = 0").withColumn("title", F.lit("changed")))


@query("delete_items", "SELECT o_orderkey AS item_id FROM orders WHERE o_orderstatus <> 'P'")
def delete_items(spark, sf):
    items = c.orders(spark, sf).items
    return c.delete(items.select("item_id"), items.where("post_status = 'draft'"))


@query("term_counts", "SELECT w AS term, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w HAVING count(*) > 0")
def term_counts(spark, sf):
    terms = c.parts(spark, sf).taxonomies
    return terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n > 0")


@query(
    "corpus_texts",
    """SELECT p_partkey AS item_id, p_name || ' .  . ' || ' . ' || least(p_brand, p_type) || ' . ' || greatest(p_brand, p_type) || ' . ' || array_to_string(list_sort(string_split(p_name, ' ')), ' . ') AS text FROM part""",
)
def corpus_texts(spark, sf):
    cat = c.parts(spark, sf)
    return ingest.corpus_texts(cat.items, cat.metadata, cat.taxonomies)
