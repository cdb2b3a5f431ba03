"""Hash, serial and name matching, pairs, states."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import health as H
from ..operators import matching as M
from .registry import query


@query("""SELECT l_orderkey, l_linenumber, p_partkey, want IS NOT NULL AS confirmed FROM
(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INT AS q FROM lineitem) l
JOIN (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS want FROM part) p ON l_partkey = p_partkey AND (want IS NULL OR want = q)""")
def hash_join_residual(t):
    items = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("int").alias("size"))
    entries = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("size"))
    return M.hash_lookup(items, entries, "p_partkey", "size").select("l_orderkey", "l_linenumber", "p_partkey", "confirmed")


@query("""SELECT a.doc_id, b.doc_id AS first_id, md5(a.text) AS md5, sha1(a.text) AS sha1 FROM documents a
JOIN (SELECT text, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) b ON a.text = b.text""")
def content_hash_join(t):
    prints = t.documents.select("doc_id", F.sha1("text").alias("sha1"), F.md5("text").alias("md5"))
    first = prints.groupBy("sha1").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return prints.join(first, "sha1").select("doc_id", "first_id", "md5", "sha1")


LAYERS = """c AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN c.c_custkey IS NOT NULL AND c_mktsegment = 'BUILDING' THEN 1 WHEN o_orderpriority = '1-URGENT' THEN 2 END AS r,
CASE WHEN o_orderkey % 11 = 0 THEN 'v' || o_orderkey WHEN c_mktsegment = 'BUILDING' THEN c_name WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority END AS entry FROM orders LEFT JOIN customer c ON o_custkey = c_custkey)"""


@query(f"""WITH {LAYERS} SELECT key, CASE r WHEN 0 THEN 'verdict' WHEN 1 THEN 'hash' WHEN 2 THEN 'name' ELSE 'unmatched' END AS layer, CASE WHEN r IS NOT NULL THEN entry END AS entry FROM c""")
def layered_match_cascade(t):
    orders = t.orders.select(F.col("o_orderkey").alias("key"), "o_custkey", "o_orderpriority")
    verdict = orders.where("key % 11 = 0").select("key", F.concat(F.lit("v"), F.col("key").cast("string")).alias("entry"))
    hashed = orders.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select("key", F.col("c_name").alias("entry"))
    named = orders.where("o_orderpriority = '1-URGENT'").select("key", F.col("o_orderpriority").alias("entry"))
    return M.cascade(orders, "key", [("verdict", verdict), ("hash", hashed), ("name", named)])


@query("""WITH s AS (SELECT CASE WHEN n_chars < 100 THEN 'skipped' WHEN l.doc_id IS NULL THEN 'no evidence' WHEN quality = 1 THEN 'matched' ELSE 'unmatched' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT v.state, count(s.state) AS n FROM (VALUES ('matched'), ('unmatched'), ('no evidence'), ('skipped'), ('failed')) v(state) LEFT JOIN s ON s.state = v.state GROUP BY v.state""")
def match_state_tally(t):
    return M.tally(_states(t), "state", ["matched", "unmatched", "no evidence", "skipped", "failed"])


def _states(t):
    both = t.documents.select("doc_id", "n_chars", "lang").join(t.labels.withColumn("has", F.lit(1)), "doc_id", "left")
    return both.withColumn("state", F.when(F.col("n_chars") < 100, "skipped").when(F.col("has").isNull(), "no evidence").when(F.col("quality") == 1, "matched").otherwise("unmatched"))


@query("""WITH s AS (SELECT lang, CASE WHEN n_chars < 100 THEN 'skipped' WHEN l.doc_id IS NULL THEN 'no evidence' WHEN quality = 1 THEN 'matched' ELSE 'unmatched' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT lang, count(*) AS n, count(*) FILTER (state = 'matched') AS matched, count(*) FILTER (state IN ('matched', 'unmatched')) AS tried FROM s GROUP BY lang)
SELECT *, round(matched / n, 6) AS rate_of_all, round(CASE WHEN tried > 0 THEN matched / tried END, 6) AS rate_of_tried FROM g""")
def match_rates(t):
    return H.rates(_states(t), ["lang"], "state")


@query("""SELECT n, count(*) AS subjects FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1) GROUP BY n""")
def candidate_multiplicity(t):
    return H.candidate_multiplicity(t.orders, "o_custkey")


@query("""SELECT c_mktsegment, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS f, count(DISTINCT CASE WHEN o_orderstatus <> 'F' THEN o_custkey END) AS others, count(DISTINCT o_custkey) AS customers
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def count_distinct_case(t):
    # one row a customer first: each is in one segment, so flags can be counted without a distinct over orders
    flags = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("f"), F.max((F.col("o_orderstatus") != "F").cast("int")).alias("o"))
    return flags.join(t.customer, "c_custkey").groupBy("c_mktsegment").agg(F.sum("f").alias("f"), F.sum("o").alias("others"), F.count("*").alias("customers"))


_GRAMS = "CASE WHEN length({0}) = 1 THEN [{0}] ELSE list_transform(generate_series(1, length({0}) - 1), lambda i: substring({0}, i::INT, 2)) END"


_WORTH = """ WHERE (length(regexp_replace(x.k, '[^A-Za-z]', '', 'g')) >= 4 OR length(regexp_replace(x.k, '[^\\p{Han}\\p{Hiragana}\\p{Katakana}]', '', 'g')) >= 2) AND length(y.k) >= 2"""


def _scored(worth: str) -> str:
    return f"""p AS (SELECT x.id AS query_id, y.id AS name_id, max(CASE WHEN x.k = y.k THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * list_sum(list_transform(list_distinct(x.g), lambda v: least(len(list_filter(x.g, lambda w: w = v)), len(list_filter(y.g, lambda w: w = v))))) / (len(x.g) + len(y.g)) END) AS score
FROM q x JOIN n y ON x.a = y.a{worth} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name_id) AS rank FROM p WHERE score >= 0.85) SELECT query_id, name_id, score, rank::INT AS rank FROM r WHERE rank <= 3"""


_SCORED = _scored(_WORTH)


def _sql_names(rows: str) -> str:
    return f"(SELECT id, k, regexp_replace(k, '[^0-9A-Za-z]', '', 'g') AS a, {_GRAMS.format('k')} AS g FROM (SELECT DISTINCT id, k FROM ({rows}) WHERE k <> ''))"


_PLAIN_KEY = "regexp_replace(lower(p_name || p_type), '[^a-z0-9]', '', 'g')"
_PART_KEY = f"translate({_PLAIN_KEY}, 'aeiou', 'äëïöü')"


@query(f"""WITH q AS {_sql_names(f"SELECT 'q' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN {_PLAIN_KEY} WHEN p_partkey % 3 = 1 THEN {_PLAIN_KEY} || 'é' ELSE {_PART_KEY} END AS k FROM part")},
n AS {_sql_names(f"SELECT 'n' || p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN {_PART_KEY} WHEN 1 THEN replace({_PART_KEY}, 'ä', 'á') WHEN 2 THEN regexp_replace({_PART_KEY}, '[öü]', '') WHEN 3 THEN {_PLAIN_KEY} ELSE replace({_PART_KEY}, 'ë', '') END AS k FROM part UNION ALL SELECT 'n' || p_partkey, {_PLAIN_KEY} || 'à' FROM part WHERE p_partkey % 4 = 0")}, {_SCORED}""")
def fuzzy_dice_topk(t):
    """Names of parts, some with every vowel accented, against spellings that change, add or lose some; a fourth has two names."""
    plain = T.name_key(F.lower(F.concat("p_name", "p_type")))
    k = T.name_key(F.translate(F.lower(F.concat("p_name", "p_type")), "aeiou", "äëïöü"))
    keyed = t.part.select("p_partkey", plain.alias("plain"), k.alias("k"))
    third, fifth = F.col("p_partkey") % 3, F.col("p_partkey") % 5
    other = F.when(fifth == 0, F.col("k")).when(fifth == 1, F.replace("k", F.lit("ä"), F.lit("á"))).when(fifth == 2, F.expr("regexp_replace(k, '^([^öü]*)[öü]', '$1')")).when(fifth == 3, F.col("plain")).otherwise(F.replace("k", F.lit("ë"), F.lit("")))
    asked = F.when(third == 0, F.col("plain")).when(third == 1, F.concat("plain", F.lit("é"))).otherwise(F.col("k"))
    queries = keyed.select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("query_id"), asked.alias("query_key"))
    name_id = F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("name_id")
    names = keyed.select(name_id, other.alias("name_key")).union(keyed.where(F.col("p_partkey") % 4 == 0).select(name_id, F.concat("plain", F.lit("à"))))
    return M.fuzzy_lookup(queries, names)


_TITLE = "trim(regexp_extract(html, '<title>([^<]*)</title>', 1))"


_TITLES = f"""SELECT 'p' || page_id AS id, regexp_replace(lower(nfc_normalize({_TITLE})), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS k FROM pages
UNION ALL SELECT 'd' || doc_id, regexp_replace(lower(nfc_normalize(text)), '[^\\p{{L}}\\p{{N}}]', '', 'g') FROM documents"""


@query(f"""WITH q AS {_sql_names(_TITLES)}, n AS (SELECT * FROM q), {_scored("")}""")
def fuzzy_titles(t):
    """Titles of pages and whole texts of documents, in every language, against each other."""
    told = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string")).alias("id")
    titles = t.pages.select(told("p", "page_id"), F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
    keys = titles.union(t.documents.select(told("d", "doc_id"), "text")).select("id", T.name_key(F.col("title")).alias("k"))
    return M.fuzzy_lookup(keys.select(F.col("id").alias("query_id"), F.col("k").alias("query_key")), keys.select(F.col("id").alias("name_id"), F.col("k").alias("name_key")), gated=False)


@query("""SELECT a.s_suppkey AS supplier, b.c_custkey AS customer FROM (SELECT s_suppkey, floor(s_acctbal)::BIGINT AS x FROM supplier) a
JOIN (SELECT c_custkey, floor(c_acctbal)::BIGINT AS y FROM customer) b ON abs(a.x - b.y) <= 3""")
def band_join(t):
    a = t.supplier.select(F.col("s_suppkey").alias("supplier"), F.floor("s_acctbal").alias("x"))
    b = t.customer.select(F.col("c_custkey").alias("customer"), F.floor("c_acctbal").alias("y"))
    return M.band_join(a, b, "x", "y", 3).select("supplier", "customer")


_PAIRS = """k AS (SELECT DISTINCT left(c_name, 17) || c_nationkey AS key, c_custkey AS item FROM customer), s AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 8),
p AS (SELECT a.key, a.item AS a, b.item AS b FROM k a JOIN k b ON a.key = b.key AND a.item < b.item WHERE a.key IN (SELECT key FROM s))"""


def _pairs(t):
    keyed = t.customer.select("c_custkey", F.concat(F.substring("c_name", 1, 17), F.col("c_nationkey").cast("string")).alias("key"))
    return M.same_key_pairs(keyed, "key", "c_custkey")


@query(f"WITH {_PAIRS} SELECT * FROM p")
def same_key_pairs(t):
    return _pairs(t)


@query(f"WITH {_PAIRS} SELECT * FROM p WHERE (a + b) % 3 <> 0")
def dismissed_pairs(t):
    pairs = _pairs(t)
    dismissed = pairs.where("(a + b) % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return M.without_dismissed(pairs, dismissed)


@query("""SELECT CASE WHEN l.quality IS NULL OR l.toxic IS NULL THEN 'unknown' WHEN l.quality <> l.toxic THEN 'agree' ELSE 'conflict' END AS state, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def tri_state_check(t):
    both = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return both.groupBy(M.tri_state(F.col("quality"), F.col("toxic"), F.col("quality") != F.col("toxic")).alias("state")).agg(F.count("*").alias("n"))
