"""Places, neighbours, first matches and plans of what to fetch."""

from pyspark.sql import functions as F

from ..operators import browse as B
from ..operators import converge as C
from ..operators import order as O
from ..operators import registry as R
from .registry import query


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events""")
def numbered_events(t):
    return O.numbered(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id", "place")


@query("""SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,2)) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::DECIMAL(28,2) AS so_far FROM orders""")
def running_total(t):
    rows = t.orders.select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return O.running(rows, [], [F.asc("o_orderdate"), F.asc("o_orderkey")], "price", "so_far").select("o_orderkey", F.col("so_far").cast("decimal(28,2)").alias("so_far"))


@query("""WITH s AS (SELECT DISTINCT 'dir' || (c_nationkey % 3) AS folder, c_name AS name FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY name) - 1 AS seat FROM s),
w AS (SELECT *, greatest(seat - 3, 0) AS low FROM r)
SELECT w.folder, w.name, r.name AS neighbour, r.seat FROM w JOIN r ON w.folder = r.folder AND r.seat BETWEEN low AND low + 6 - CASE WHEN w.seat >= low + 6 THEN 1 ELSE 0 END AND r.seat <> w.seat""")
def neighbours(t):
    rows = t.customer.select(F.concat(F.lit("dir"), (F.col("c_nationkey") % 3).cast("string")).alias("folder"), F.col("c_name").alias("name"))
    return O.around(rows, "folder", "name", 6)


_MAPPINGS = """m AS (SELECT n_regionkey % 2 = 0 AS even, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE n_name END AS platform, n_nationkey AS place, 'note ' || n_nationkey AS note,
CASE WHEN n_nationkey % 3 = 0 THEN 'C' END AS convention, CASE n_nationkey % 4 WHEN 0 THEN 'Large ' || chr(97 + n_nationkey % 26) || '*' WHEN 1 THEN '*ri@g' WHEN 2 THEN 'red @*t ' || n_nationkey % 10 ELSE 'small *' || n_nationkey % 10 || '#' END AS pattern FROM nation)"""
_LIKE = "regexp_full_match(lower(n.name), replace(replace(replace(lower(m.pattern), '#', '[0-9]'), '@', '[a-z]'), '*', '.*'))"
_FIRST = f"""n AS (SELECT DISTINCT p_size % 2 = 0 AS even, p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_size END AS name FROM part), {_MAPPINGS},
f AS (SELECT n.even, n.name, min_by(struct_pack(p := m.platform, c := m.convention, note := m.note), m.place) AS x FROM n LEFT JOIN m ON n.even = m.even AND {_LIKE} GROUP BY 1, 2),
hit AS (SELECT n.even, n.name, count(m.place) > 0 AS hit FROM n LEFT JOIN m ON n.even = m.even AND {_LIKE} GROUP BY 1, 2),
told AS (SELECT CASE WHEN even THEN 'a' ELSE 'b' END AS source, name, CASE WHEN NOT hit THEN 'unmapped' WHEN x.p IS NULL THEN 'excluded' ELSE 'mapped' END AS state, x FROM f JOIN hit USING (even, name))"""


def _names(t):
    source = lambda c: F.when(c % 2 == 0, "a").otherwise("b")
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"))))
    k = F.col("n_nationkey")
    digit = (k % 10).cast("string")
    pattern = F.when(k % 4 == 0, F.concat(F.lit("Large "), F.char(97 + k % 26), F.lit("*"))).when(k % 4 == 1, "*ri@g").when(k % 4 == 2, F.concat(F.lit("red @*t "), digit)).otherwise(F.concat(F.lit("small *"), digit, F.lit("#")))
    mappings = t.nation.select(source(F.col("n_regionkey")).alias("source"), k.alias("place"), pattern.alias("pattern"), F.when(k % 5 != 4, F.col("n_name")).alias("platform"), F.when(k % 3 == 0, "C").alias("convention"), F.concat(F.lit("note "), k.cast("string")).alias("note"))
    return t.part.select("p_partkey", source(F.col("p_size")).alias("source"), name.alias("name")), mappings


@query(f"""WITH {_FIRST} SELECT source, name, state, CASE WHEN state = 'mapped' THEN x.p END AS platform, CASE WHEN state = 'mapped' THEN x.c END AS convention, CASE WHEN state = 'excluded' THEN x.note END AS note FROM told""")
def registry_lookup(t):
    return R.first_match(*_names(t))


@query(f"""WITH {_FIRST}, a AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS source, p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_size END AS name, CASE WHEN p_partkey % 7 > 0 THEN 'v' || p_partkey % 4 END AS fingerprint, 'u' || p_partkey % 13 AS url FROM part),
k AS (SELECT DISTINCT source, name, fingerprint FROM a WHERE p_partkey % 2 = 0 AND fingerprint IS NOT NULL)
SELECT p_partkey, action, CASE WHEN state = 'mapped' THEN x.p END AS platform, CASE WHEN state = 'mapped' THEN coalesce(x.c, 'as is') END AS convention FROM (
SELECT a.p_partkey, state, x, CASE WHEN a.url = 'u5' THEN 'refused' WHEN state = 'mapped' AND k.name IS NOT NULL THEN 'up to date' WHEN state = 'mapped' THEN 'fetch' WHEN state = 'excluded' THEN 'excluded' ELSE 'unmapped' END AS action
FROM a JOIN told USING (source, name) LEFT JOIN k ON k.source = a.source AND k.name = a.name AND k.fingerprint = a.fingerprint)""")
def fetch_plan(t):
    names, mappings = _names(t)
    k = F.col("p_partkey")
    offers = names.select("source", "name", F.concat(F.lit("u"), (k % 13).cast("string"), F.lit("/"), k.cast("string")).alias("url"), F.when(k % 7 > 0, F.concat(F.lit("v"), (k % 4).cast("string"))).alias("fingerprint"))
    known = names.where(k % 2 == 0).select("source", "name", F.when(k % 7 > 0, F.concat(F.lit("v"), (k % 4).cast("string"))).alias("fingerprint"))
    sources = t.region.select(F.when(F.col("r_regionkey") % 2 == 0, "a").otherwise("b").alias("source"), F.lit(False).alias("bundle"), F.lit("as is").alias("convention"))
    plan = R.fetch_plan(offers, known, sources, mappings, refused=F.col("url").startswith("u5/"))
    return plan.select(F.split("url", "/")[1].cast("long").alias("p_partkey"), "action", "platform", "convention")


@query("""SELECT p_brand AS g0, row_number() OVER w - 1 AS place, p_partkey AS key, count(*) OVER (PARTITION BY p_brand) AS n
FROM (SELECT *, CASE WHEN p_size > 45 THEN 0 WHEN ends_with(p_name, 'ring') THEN 1 ELSE 2 END AS p FROM part) WINDOW w AS (PARTITION BY p_brand ORDER BY p, p_partkey)""")
def entry_members(t):
    rank = C.preference([F.col("p_size") > 45, F.col("p_name").endswith("ring")])
    return C.members(t.part, [F.col("p_brand")], rank, "p_partkey")


@query("""WITH c AS (SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40),
o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders),
x AS (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY pos) FILTER (pos <= 5) AS first, count(*) AS n FROM o GROUP BY 1),
l AS (SELECT o_custkey, count(*) AS n, sum(l_quantity::INT) FILTER (pos <= 5) AS q FROM (SELECT o_custkey, l_quantity, row_number() OVER (PARTITION BY o_custkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity) AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1)
SELECT c_custkey, c_name, coalesce(first, '') AS orders, coalesce(x.n, 0) AS n_orders, coalesce(l.n, 0) AS n_lines, coalesce(q, 0)::BIGINT AS quantity FROM c LEFT JOIN x ON x.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey""")
def work_details(t):
    """A page of customers with their first orders and lines, and how many of each there are."""
    page = B.page(t.customer.select("c_custkey", "c_name", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 0, 40).drop("c_acctbal")
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey")
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    out = B.details(page, "c_custkey", {"orders": (orders, ["o_orderdate", "o_orderkey"]), "lines": (lines, ["l_shipdate", "l_orderkey", "l_linenumber"])}, most=5)
    keys = F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",")
    quantity = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["l_quantity"].cast("int"))
    return out.select("c_custkey", "c_name", keys.alias("orders"), "n_orders", "n_lines", quantity.alias("quantity"))
