"""Upkeep queries."""

from pyspark.sql import functions as F

from ..operators import upkeep as U
from .registry import query

_KEY = "'r' || (p_size % 4) || '/' || p_type || '/' || p_partkey"


def _entries(t):
    key = F.concat(F.lit("r"), (F.col("p_size") % 4).cast("string"), F.lit("/"), F.col("p_type"), F.lit("/"), F.col("p_partkey").cast("string"))
    return t.part.select(key.alias("key"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("len"), "p_brand", "p_partkey", "p_name")


@query("""SELECT 'r' || (p_size % 4) AS root, count(*) AS files, sum(CASE WHEN p_partkey % 7 <> 0 THEN p_size END)::BIGINT AS bytes, count(*) FILTER (p_partkey % 7 = 0) AS unreadable FROM part GROUP BY 1""")
def root_stats(t):
    return U.root_stats(_entries(t), "key", "len")


@query("""SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) FILTER (p_size % 4 <> 1) = 0""")
def groups_only_under(t):
    return U.only_under(_entries(t), "p_name", "key", "r1")


@query("""SELECT p_brand, count(*) FILTER (p_size % 4 = 2) AS lost, count(*) FILTER (p_size % 4 <> 2) AS "left" FROM part GROUP BY p_brand HAVING count(*) FILTER (p_size % 4 = 2) > 0""")
def selections_losing(t):
    return U.losing(_entries(t), "p_brand", "key", "r2")


@query("""SELECT DISTINCT p_type AS name FROM part WHERE p_size % 4 = 3 ORDER BY 1 LIMIT 4""")
def top_level_names(t):
    return U.top_level(_entries(t), "key", "r3", 4)


@query("""SELECT p_partkey FROM part WHERE NOT (p_size % 4 = 0 AND p_type = 'SMALL')""")
def subtree_removed(t):
    return U.without_subtree(_entries(t), "key", "r0/SMALL").select("p_partkey")


@query("""SELECT l_orderkey, count(*)::INT AS n, string_agg(l_partkey::VARCHAR, '|' ORDER BY l_linenumber, l_partkey) AS members FROM lineitem GROUP BY l_orderkey""")
def container_contents(t):
    return U.contents(t.lineitem, "l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def not_yet_run(t):
    return U.not_run(t.documents.select("doc_id"), t.labels, "doc_id")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS subjects FROM lineitem GROUP BY ALL""")
def field_counts(t):
    return U.valued(t.lineitem, "l_returnflag", "l_linestatus", ["l_orderkey"])


@query("""SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS fields FROM lineitem GROUP BY l_suppkey""")
def fields_present(t):
    return U.present_fields(t.lineitem, "l_suppkey", "l_returnflag")


@query("""SELECT md5(text) AS print, count(DISTINCT source) AS subjects FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""")
def shared_contents(t):
    return U.shared(t.documents.select(F.md5("text").alias("print"), "source"), "print", "source")


@query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) = 0""")
def all_from_sources(t):
    return U.all_from(t.orders, "o_custkey", F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING min((l_quantity >= 10)::INT) = 1""")
def groups_of_assets(t):
    return U.all_of(t.lineitem, "l_orderkey", F.col("l_quantity") >= 10)


@query("""SELECT lang, count(*) AS n, count(l.doc_id) AS with_value FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""")
def source_coverage(t):
    return U.covered(t.documents.select("doc_id", "lang"), t.labels, "doc_id", "lang")


@query("""SELECT source, cost::BIGINT AS cost, spent::BIGINT AS spent FROM (SELECT *, sum(cost) OVER (ORDER BY cost, source ROWS UNBOUNDED PRECEDING) AS spent FROM (SELECT source, sum(n_chars) AS cost FROM documents GROUP BY 1)) WHERE spent <= 400000""")
def within_budget(t):
    return U.within_budget(t.documents.groupBy("source").agg(F.sum("n_chars").alias("cost")), [F.asc("cost"), F.asc("source")], "cost", 400_000)


@query("""SELECT DISTINCT CASE p_brand WHEN 'Brand#1' THEN 'Brand#2' ELSE p_brand END AS p_brand, p_name FROM part""")
def collection_renamed(t):
    return U.renamed(t.part.select("p_brand", "p_name"), "p_brand", "p_name", "Brand#1", "Brand#2")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size = 50)""")
def standing_conclusions(t):
    members = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    return U.changed_members(t.orders.select("o_orderkey", "o_orderstatus"), members, t.part.where("p_size = 50"), "o_orderkey", "p_partkey")


@query("""SELECT 0 AS place, 'label' AS stage, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS "left" UNION ALL SELECT 1, 'ship', (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')""")
def stage_survey(t):
    return U.stages([("label", U.not_run(t.documents.select("doc_id"), t.labels, "doc_id")), ("ship", t.orders.where("o_orderstatus = 'P'"))])


@query("""SELECT p_type AS field, max(p_retailprice) FILTER (p_brand = 'Brand#1') AS a, max(p_retailprice) FILTER (p_brand = 'Brand#2') AS b FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') GROUP BY p_type
HAVING max(p_retailprice) FILTER (p_brand = 'Brand#1') IS DISTINCT FROM max(p_retailprice) FILTER (p_brand = 'Brand#2')""")
def merge_conflicts(t):
    return U.different_values(t.part.withColumnRenamed("p_type", "field"), "p_brand", "field", "p_retailprice", "Brand#1", "Brand#2")


@query("""SELECT p_brand, count(DISTINCT l_suppkey) AS keys FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1""")
def key_counts(t):
    return U.key_counts(t.part.select("p_partkey", "p_brand"), t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_suppkey"), "p_partkey", "l_suppkey", "p_brand")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def groups_without_members(t):
    return U.without_members(t.customer.select("c_custkey", "c_name"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT event_id, user_id, event_type FROM events WHERE NOT (user_id % 5 = 0 AND event_type = 'click')""")
def values_forgotten(t):
    values = t.events.select("event_id", "user_id", "event_type")
    return U.forgotten(values, values.where("user_id % 5 = 0 and event_type = 'click'"), ["user_id", "event_type"])


@query("""WITH v AS (SELECT o_custkey, o_orderpriority AS source, CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE year(o_orderdate)::VARCHAR END AS y FROM orders)
SELECT o_custkey, coalesce(min(CASE WHEN source = '1-URGENT' AND y <> 'n/a' THEN y END), min(CASE WHEN y <> 'n/a' THEN y END)) AS year FROM v GROUP BY 1""")
def shown_year(t):
    value = F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.year("o_orderdate").cast("string"))
    return U.shown_year(t.orders.select("o_custkey", F.col("o_orderpriority").alias("source"), value.alias("value")), "o_custkey", "1-URGENT")


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'F') AS n FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1""")
def left_after_moving(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    return U.left_after(o, o.where("o_orderstatus = 'F'"), "o_custkey", "o_orderkey", o.where("o_custkey % 3 = 0"))


@query("""SELECT l_orderkey, bool_and(l_quantity > 5 OR l_returnflag = 'R') AS settled FROM lineitem GROUP BY 1""")
def settled_items(t):
    units = t.lineitem.select("l_orderkey", F.when(F.col("l_quantity") > 5, F.col("l_partkey")).alias("print"), F.when(F.col("l_returnflag") == "R", "returned").alias("reason"))
    return U.settled(units, "l_orderkey", "print", "reason")


@query("""SELECT lang, count(*) FILTER (l.doc_id IS NULL)::BIGINT AS pending, count(l.doc_id)::BIGINT AS decided FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY 1""")
def breakdown_axis(t):
    docs = t.documents.select("doc_id", "lang")
    return U.breakdown(docs.join(t.labels.select("doc_id"), "doc_id", "left_anti"), docs.join(t.labels.select("doc_id"), "doc_id", "left_semi"), "lang")
