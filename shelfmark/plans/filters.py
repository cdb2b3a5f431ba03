"""Rules, selections, facets, pages and search."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import browse as B
from ..operators.rules import All, AnyOf, Clause, NoneOf, filter_by, rule_hits, select_rows, thin_clauses
from .registry import cents, query

RULE = All(AnyOf(Clause("o_orderstatus", "=", "F", "P"), Clause("o_totalprice", ">=", 400000.0)), NoneOf(Clause("c_mktsegment", "~", "build"), Clause("o_orderpriority", "^", "5")))


@query("""SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
WHERE (o_orderstatus IN ('F', 'P') OR o_totalprice >= 400000)
  AND NOT (contains(lower(c_mktsegment), 'build') OR starts_with(lower(o_orderpriority), '5'))""")
def rule_and_or_none(t):
    return filter_by(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), RULE).select("o_orderkey", "c_mktsegment")


@query("""SELECT d.doc_id, NOT coalesce(quality = 1, false) AS not_good, NOT coalesce(quality >= 1, false) AS none_high
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(toxic = 1, false)""")
def rule_missing_value(t):
    from ..operators.rules import compile_rule

    both = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    columns = {"quality": F.col("quality"), "toxic": F.col("toxic")}
    return filter_by(both, Clause("toxic", "!=", 1)).select("doc_id", compile_rule(Clause("quality", "!=", 1), columns).alias("not_good"), compile_rule(NoneOf(Clause("quality", ">=", 1)), columns).alias("none_high"))


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent
FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def rule_semi_membership(t):
    orders = t.orders
    held = t.customer.join(orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("urgent", F.lit(True))
    return held.join(urgent, "c_custkey", "left").select("c_custkey", F.coalesce("urgent", F.lit(False)).alias("urgent"))


@query("""SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') > 0 AS any_returned, count(*) FILTER (l_returnflag = 'N') = 0 AS none_kept
FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_quantity >= 49) > 0""")
def rule_multivalue_exists(t):
    from ..operators.rules import compile_rule

    facts = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"), F.collect_set("l_quantity").alias("quantities"))
    columns = {"flags": F.col("flags"), "quantities": F.col("quantities")}
    multi = {"flags", "quantities"}
    return filter_by(facts, Clause("quantities", ">=", 49.0), columns, multi).select("l_orderkey", compile_rule(Clause("flags", "=", "r"), columns, multi).alias("any_returned"), compile_rule(Clause("flags", "!=", "N"), columns, multi).alias("none_kept"))


RULES = {"brand": Clause("p_brand", "=", "brand#3", "brand#7"), "small": All(Clause("p_size", "<=", 5), Clause("p_type", "!=", "PROMO")), "ring": Clause("p_name", "$", "RING")}


@query("""SELECT p_partkey FROM part WHERE CASE WHEN p_partkey % 97 = 0 THEN true WHEN p_partkey % 89 = 0 THEN false
ELSE (p_brand IN ('Brand#3', 'Brand#7') OR (p_size <= 5 AND p_type <> 'PROMO') OR ends_with(p_name, 'ring')) END""")
def selection_rules_exceptions(t):
    part = t.part
    told = part.where("p_partkey % 97 = 0 or p_partkey % 89 = 0").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") % 97 == 0).alias("included"))
    return select_rows(part, "p_partkey", list(RULES.values()), told).select("p_partkey")


@query("""WITH f AS (SELECT p_retailprice::DECIMAL(18,2) AS price, (p_brand IN ('Brand#3', 'Brand#7'))::INT AS a, (p_size <= 5 AND p_type <> 'PROMO')::INT AS b, ends_with(p_name, 'ring')::INT AS c FROM part),
r AS (SELECT 'brand' AS rule, a AS hit, a + b + c AS n, price FROM f UNION ALL SELECT 'small', b, a + b + c, price FROM f UNION ALL SELECT 'ring', c, a + b + c, price FROM f)
SELECT rule, sum(hit)::BIGINT AS hits, sum(CASE WHEN n = 1 THEN hit ELSE 0 END)::BIGINT AS only_here, sum(CASE WHEN hit = 1 THEN price END)::DOUBLE AS total FROM r GROUP BY rule""")
def selection_rule_hits(t):
    part = t.part.withColumn("price", cents("p_retailprice"))
    return rule_hits(part, RULES, "price").withColumn("total", F.col("total").cast("double"))


@query("""SELECT 'quality' AS "column", count(*) FILTER (quality IS NULL) AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents""")
def thin_clause(t):
    return thin_clauses(t.documents.join(t.labels, "doc_id", "left"), All(Clause("quality", "=", 1), Clause("lang", "=", "en")))


@query("""SELECT p_partkey, contains(translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'wid') AS has, starts_with(lower(p_brand), 'brand#1') AS starts FROM part WHERE ends_with(lower(p_name), 'bolt') OR contains(lower(p_name), 'wid')""")
def ascii_fold_contains(t):
    name, brand = T.ascii_lower(F.col("p_name")), T.ascii_lower(F.col("p_brand"))
    return t.part.where(F.endswith(name, F.lit("bolt")) | F.contains(name, F.lit("wid"))).select("p_partkey", F.contains(name, F.lit("wid")).alias("has"), F.startswith(brand, F.lit("brand#1")).alias("starts"))


@query("""WITH j AS (SELECT o_orderstatus, o_orderpriority, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT 'status' AS facet, o_orderstatus AS value, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM j GROUP BY ALL
UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM j GROUP BY ALL UNION ALL SELECT 'nation', n_name, count(*) FROM j GROUP BY ALL""")
def facet_counts(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return B.facets(joined, {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "segment": F.col("c_mktsegment"), "nation": F.col("n_name")})


@query("""SELECT 'word' AS facet, w AS value, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS w FROM part) GROUP BY w ORDER BY n DESC, value LIMIT 12""")
def facet_csv_explode(t):
    return B.ranked(B.list_facet(t.part, "word", F.concat_ws(" ", "p_name", F.lower("p_type")), " "), 12)


@query("""SELECT 'unlabelled' AS value, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def facet_residual_state(t):
    return B.residual(t.documents, t.labels, "doc_id", "unlabelled")


@query("""SELECT l_suppkey, count(*) AS lines, count(DISTINCT l_partkey) AS parts, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY l_suppkey ORDER BY sum(l_extendedprice::DECIMAL(18,2)) DESC, l_suppkey LIMIT 20 OFFSET 10""")
def grouped_page(t):
    lines = t.lineitem.where("l_shipdate >= timestamp '1998-01-01'")
    out = B.grouped_page(lines, ["l_suppkey"], {"lines": F.count("*"), "parts": F.countDistinct("l_partkey"), "revenue": F.sum(cents("l_extendedprice"))}, [F.desc("revenue"), F.asc("l_suppkey")], 10, 20)
    return out.withColumn("revenue", F.col("revenue").cast("double"))


@query("""SELECT CASE WHEN quality IS NULL THEN 'k:' || d.doc_id ELSE 'g:' || quality END AS key, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def loose_group_key(t):
    both = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    return both.groupBy(B.loose_key(F.col("quality"), F.col("doc_id")).alias("key")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)""")
def group_total(t):
    return B.group_total(t.lineitem, ["l_partkey", "l_suppkey"])


@query("""WITH h AS (SELECT p_partkey AS key, CASE WHEN starts_with(lower(p_name), 'small') THEN 0 WHEN contains(lower(p_name), 'small') THEN 1 END AS r FROM part
UNION ALL SELECT p_partkey, CASE WHEN starts_with(lower(p_type), 'small') THEN 2 WHEN contains(lower(p_type), 'small') THEN 3 END FROM part
UNION ALL SELECT l_partkey, CASE WHEN contains(lower(l_returnflag), 'small') THEN 4 END FROM lineitem)
SELECT key, min(r) AS rank FROM h WHERE r IS NOT NULL GROUP BY key""")
def search_rank(t):
    names, aliases = t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("text")), t.part.select(F.col("p_partkey").alias("key"), F.col("p_type").alias("text"))
    return B.search(names, "Small", aliases, t.lineitem.select(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("text")))


@query("""SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality DESC NULLS LAST, n_chars DESC, d.doc_id LIMIT 50 OFFSET 25""")
def sort_nulls_last(t):
    both = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    return B.page(both, [F.col("quality").desc_nulls_last(), F.desc("n_chars"), F.asc("doc_id")], 25, 50).select("doc_id", "quality")
