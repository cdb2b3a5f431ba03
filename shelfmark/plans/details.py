"""Queries on details of items, undo, merges and reports."""

from pyspark.sql import functions as F

from ..operators import details as D
from ..operators import upkeep as U
from .registry import query


@query("""WITH u AS (SELECT l_orderkey AS key, l_linenumber AS n, CASE WHEN l_quantity > 3 THEN l_partkey END AS print, l_returnflag = 'R' AS said FROM lineitem),
s AS (SELECT key FROM u GROUP BY 1 HAVING bool_and(print IS NOT NULL OR said)),
f AS (SELECT key, print FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n, print NULLS FIRST) AS r FROM u) WHERE r = 1 AND key IN (FROM s)),
c AS (SELECT key, p_type AS verdict FROM f JOIN part ON p_partkey = print WHERE p_size < 10)
SELECT o_orderkey AS key, coalesce(c.verdict, CASE o_orderstatus WHEN 'F' THEN 'F' END) AS verdict, CASE WHEN c.verdict IS NOT NULL THEN 'content' ELSE 'path' END AS anchor
FROM orders LEFT JOIN c ON c.key = o_orderkey WHERE c.verdict IS NOT NULL OR o_orderstatus = 'F'""")
def first_verdict(t):
    units = t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("ordinal"), F.when(F.col("l_quantity") > 3, F.col("l_partkey")).alias("print"), F.when(F.col("l_returnflag") == "R", "returned").alias("reason"))
    by_content = t.part.where("p_size < 10").select(F.col("p_partkey").alias("print"), F.col("p_type").alias("verdict"))
    by_path = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("verdict"))
    return D.first_verdict(t.orders.select(F.col("o_orderkey").alias("key")), units, by_content, by_path)


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', CASE WHEN l_returnflag = 'R' THEN 'part of it' END, CASE WHEN l_tax > 0.06 THEN 'unread' END) AS doubts, l_quantity > 10 AS exact FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, doubts, exact AND doubts = '' AS accepted, CASE WHEN exact AND doubts = '' THEN 'high' ELSE 'medium' END AS confidence FROM h""")
def candidate_confidence(t):
    out = D.candidates(t.lineitem, F.col("l_quantity") > 10, {"part of it": F.col("l_returnflag") == "R", "unread": F.col("l_tax") > 0.06})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "doubts", "accepted", "confidence")


@query("""WITH f AS (SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem WHERE l_quantity > 25) WHERE r = 1)
SELECT l_orderkey, l_partkey, CASE WHEN p_size < 25 THEN md5(p_name) ELSE md5(p_brand) END AS print FROM f JOIN part ON p_partkey = l_partkey WHERE p_size < 40""")
def accepted_prints(t):
    prints = t.part.where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), F.md5("p_name").alias("print"))
    inside = t.part.where("p_size < 40").select(F.col("p_partkey").alias("l_partkey"), F.md5("p_brand").alias("print"))
    return D.accepted_print(t.lineitem.withColumn("accepted", F.col("l_quantity") > 25), prints, inside, "l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT l_orderkey, l_partkey AS print FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem WHERE l_quantity > 10) WHERE r = 1""")
def content_prints(t):
    units = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 10, F.col("l_partkey")).alias("v"))
    return D.content_prints(units, "l_orderkey", "l_linenumber", "v")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0 OR (o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0)""")
def undo_restores(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    batch = rows.where("o_orderkey % 7 = 0")
    before = rows.where("o_orderkey % 2 = 0 or o_orderkey % 7 <> 0")
    stash = D.stashed(before, batch, "o_orderkey", 5)
    after = before.join(batch.select("o_orderkey"), "o_orderkey", "left_anti").unionByName(batch.withColumn("o_orderstatus", F.lit("X")))
    return D.restored(after, stash, rows.where("o_orderkey % 3 <> 0"), "o_orderkey", 5)


@query("""SELECT event_id, user_id, user_id % 10 AS batch FROM events UNION ALL SELECT event_id, user_id, 100 FROM events WHERE user_id % 10 = 3""")
def redo_batch(t):
    log = t.events.select("event_id", "user_id", (F.col("user_id") % 10).alias("batch"))
    return D.redone(log, log.where("batch in (3, 4)"), 3, 100)


@query("""SELECT c_custkey, 'customer' AS kind, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1
UNION ALL SELECT o_custkey, 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""")
def merge_impact(t):
    moving = t.customer.where("c_mktsegment = 'BUILDING'")
    return D.merge_impact({"customer": t.customer, "orders": t.orders.select(F.col("o_custkey").alias("c_custkey"))}, "c_custkey", moving)


@query("""SELECT DISTINCT CASE WHEN p_brand IN ('Brand#2', 'Brand#3') THEN 'Brand#1' ELSE p_brand END AS p_brand, p_name FROM part""")
def merged_into(t):
    return D.merged_into(t.part.select("p_brand", "p_name"), "p_brand", t.part.where("p_brand in ('Brand#2', 'Brand#3')"), "Brand#1")


@query("""SELECT p_brand, p_name FROM part UNION ALL SELECT 'Brand#1', min(p_name) FROM part WHERE p_brand IN ('Brand#2', 'Brand#3')
AND lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_brand = 'Brand#1') GROUP BY lower(p_name)""")
def kept_aliases(t):
    return D.kept_aliases(t.part, t.part.where("p_brand in ('Brand#2', 'Brand#3')"), "p_brand", "p_name", "Brand#1")


@query("""SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_partkey % 40 = 7) DESC, p_retailprice NULLS LAST, p_partkey) AS r FROM part) WHERE r = 1""")
def preferred_variant(t):
    return D.preferred(t.part, t.part.where("p_partkey % 40 = 7"), "p_brand", "p_partkey", [F.col("p_retailprice")])


@query("""WITH m AS (SELECT p_partkey AS item, p_partkey // 4 AS folder, p_type AS stem, 'f' || p_partkey AS name FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 12 = 1),
f AS (SELECT p_partkey // 4 AS folder, lower(p_type) AS stem, 'f' || p_partkey AS name FROM part WHERE NOT (p_partkey % 4 = 0 OR p_partkey % 12 = 1)), h AS (SELECT folder, count(*) AS n FROM m GROUP BY 1)
SELECT item, f.name, CASE WHEN lower(m.stem) = f.stem THEN 'stem' ELSE 'folder' END AS why FROM m JOIN f USING (folder) JOIN h USING (folder) WHERE n = 1 OR lower(m.stem) = f.stem""")
def matched_media(t):
    folder, name = F.floor(F.col("p_partkey") / 4).alias("folder"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name")
    mains = t.part.where("p_partkey % 4 = 0 or p_partkey % 12 = 1").select(F.col("p_partkey").alias("item"), folder, F.col("p_type").alias("stem"), name)
    return D.matched_media(mains, t.part.select(folder, F.lower("p_type").alias("stem"), name))


@query("""WITH i AS (SELECT p_partkey, p_name FROM part WHERE p_size > 25)
SELECT l_orderkey, l_linenumber, l_partkey, l_partkey::VARCHAR AS name, CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM i) THEN l_returnflag END AS role, false AS "inner" FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, p_name, l_returnflag, true FROM lineitem JOIN i ON p_partkey = l_partkey""")
def file_lines(t):
    inside = t.part.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("path"))
    return D.file_lines(t.lineitem.withColumn("role", F.col("l_returnflag")), inside, "l_orderkey", "l_partkey", "l_linenumber")


@query("""SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY f, l_suppkey) - 1)::INT AS place, l_suppkey FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS f FROM lineitem GROUP BY ALL)""")
def merged_media(t):
    return D.merged_media(t.lineitem, "l_orderkey", ["l_linenumber"], "l_suppkey")


@query("""WITH k AS (SELECT o_custkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus END AS k FROM orders)
SELECT o_custkey, concat_ws(',', string_agg(DISTINCT k, ',' ORDER BY k), max(CASE WHEN k IS NULL THEN 'unknown' END)) AS kinds FROM k GROUP BY 1""")
def kinds_of_groups(t):
    return D.kinds_of(t.orders.select("o_custkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("k")), "o_custkey", "k")


@query("""WITH r AS (SELECT nullif(l_returnflag, 'N') AS flag, l_linestatus, l_linenumber, l_orderkey, l_quantity FROM lineitem),
k AS (SELECT flag, l_linestatus, l_linenumber, min(l_orderkey) AS l_orderkey FROM r WHERE l_orderkey % 2 = 0 AND l_linenumber <> 3 GROUP BY ALL)
SELECT s.flag, s.l_linestatus, s.l_linenumber, k.l_orderkey FROM (SELECT DISTINCT flag, l_linestatus, l_linenumber FROM r WHERE l_quantity > 40) s
LEFT JOIN k ON s.flag IS NOT DISTINCT FROM k.flag AND s.l_linestatus IS NOT DISTINCT FROM k.l_linestatus AND s.l_linenumber IS NOT DISTINCT FROM k.l_linenumber""")
def like_release(t):
    rows = t.lineitem.select(F.nullif("l_returnflag", F.lit("N")).alias("flag"), "l_linestatus", "l_linenumber", "l_orderkey", "l_quantity")
    said = rows.where("l_quantity > 40").select("flag", "l_linestatus", "l_linenumber").distinct()
    return D.like(rows.where("l_orderkey % 2 = 0 and l_linenumber <> 3"), said, ["flag", "l_linestatus", "l_linenumber"], "l_orderkey")


@query("""SELECT o_orderkey AS item, min(l_returnflag) AS role FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_partkey % 5 = o_orderkey % 5 WHERE l_returnflag <> 'N' GROUP BY 1""")
def main_of_other_role(t):
    items = t.orders.select(F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 5).alias("member"))
    members = t.lineitem.select(F.col("l_orderkey").alias("item"), (F.col("l_partkey") % 5).alias("member"), F.when(F.col("l_returnflag") == "N", "main").otherwise(F.col("l_returnflag")).alias("role"))
    return D.main_of_other_role(items, members, "item", "member")


@query("""SELECT item, name, min(anchor) AS anchor FROM (SELECT doc_id AS item, lang AS name, 'path' AS anchor FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT d.doc_id, c.lang, 'content' FROM documents c JOIN documents d ON md5(c.text) = md5(d.text) WHERE c.doc_id % 3 = 0) GROUP BY ALL""")
def standing_collections(t):
    d = t.documents.select(F.col("doc_id").alias("item"), F.md5("text").alias("print"), F.col("lang").alias("name"))
    return D.standing(d.where("item % 2 = 0"), d.where("item % 3 = 0"), d)


@query("""SELECT p_partkey AS path, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN p_size + 100 ELSE p_size END AS stamp,
CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN p_size END AS was FROM part""")
def taken_back(t):
    s = t.part.select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 3 == 0, "changed").otherwise("gone").alias("kind"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("expected"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") + 100).alias("found"))
    return D.taken_back(t.part.select(F.col("p_partkey").alias("path"), F.col("p_size").alias("stamp")), s)


@query("""WITH e AS (SELECT unnest(list_filter([CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END, CASE WHEN o_totalprice > 200000 THEN 'big' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END], lambda x: x IS NOT NULL)) AS kind, o_orderkey, o_totalprice FROM orders)
SELECT kind, n, place, o_orderkey FROM (SELECT kind, o_orderkey, count(*) OVER (PARTITION BY kind) AS n, row_number() OVER (PARTITION BY kind ORDER BY -o_totalprice, o_orderkey)::INT AS place FROM e) WHERE place <= 5""")
def finding_rows(t):
    kinds = {"urgent": F.col("o_orderpriority") == "1-URGENT", "big": F.col("o_totalprice") > 200000, "open": F.col("o_orderstatus") == "O"}
    return D.findings(t.orders, kinds, [-F.col("o_totalprice"), F.col("o_orderkey")], 5, ["o_orderkey"])


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS good, count(*) FILTER (value > 50) / count(*) AS rate FROM events GROUP BY 1""")
def sample_stats(t):
    return D.rates(t.events.select("event_type", F.when(F.col("value") > 50, "read").alias("outcome")), "event_type", "outcome", "read")


@query("""SELECT p_size % 3 AS scope, count(DISTINCT p_brand) AS folders, count(*) AS files, sum(p_partkey)::BIGINT AS bytes FROM part GROUP BY 1""")
def scope_totals(t):
    return D.scope_totals(t.part.select((F.col("p_size") % 3).alias("scope"), F.col("p_brand").alias("folder"), "p_partkey"), "scope", "p_partkey")


@query("""SELECT 0 AS place, 'label' AS stage, NULL::VARCHAR AS waiting_on UNION ALL SELECT 1, 'ship', 'label'""")
def next_stages(t):
    rows = U.stages([("label", U.not_run(t.documents.select("doc_id"), t.labels, "doc_id")), ("ship", t.orders.where("o_orderstatus = 'P'")), ("close", t.orders.where("o_orderkey < 0"))])
    return D.next_stage(rows.withColumn("before", F.when(F.col("stage") == "ship", "label").when(F.col("stage") == "close", "ship")))


@query("""WITH m AS (SELECT p_partkey AS key, p_brand AS work, p_type AS kind, p_size AS size, CASE WHEN p_partkey % 3 = 0 THEN 'print' || p_partkey END AS print FROM part WHERE p_partkey % 10 <> 7),
v AS (SELECT 'print' || p_partkey AS anchor, 'said ' || p_size AS kind FROM part WHERE p_partkey % 6 = 0)
SELECT a.p_partkey AS key, CASE WHEN m.key IS NULL THEN 'unknown' WHEN work = 'Brand#5' THEN 'held' ELSE 'moved' END AS state, CASE WHEN work <> 'Brand#5' THEN coalesce(print, m.key::VARCHAR) END AS anchor,
CASE WHEN work <> 'Brand#5' THEN coalesce(v.kind, m.kind) END AS kind, CASE WHEN work <> 'Brand#5' THEN work END AS from_work, CASE WHEN work <> 'Brand#5' THEN v.anchor IS NOT NULL END AS replaces
FROM part a LEFT JOIN m ON m.key = a.p_partkey LEFT JOIN v ON v.anchor = m.print WHERE a.p_size < 30""")
def merge_plan(t):
    key = F.col("p_partkey").cast("string")
    print_ = F.concat(F.lit("print"), key)
    some = t.part.where("p_partkey % 10 <> 7")
    variants = some.select(key.alias("key"), F.col("p_brand").alias("work"))
    identified = some.select(key.alias("key"), F.col("p_type").alias("kind"))
    verdicts = t.part.where("p_partkey % 6 = 0").select(print_.alias("anchor"), F.lit("release").alias("decision"), F.concat(F.lit("said "), F.col("p_size").cast("string")).alias("kind"))
    prints = some.where("p_partkey % 3 = 0").select(key.alias("key"), print_.alias("print"))
    plan = D.merge_plan(variants, identified, verdicts, prints, t.part.where("p_size < 30").select(key.alias("key")), "Brand#5", ["kind"])
    return plan.select(F.col("key").cast("long").alias("key"), "state", "anchor", "kind", "from_work", "replaces")
