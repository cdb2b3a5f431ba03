"""Queries on what devices should hold, on containers, serials and reference totals."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import desired as W
from .registry import query


@query("""WITH f AS (SELECT p_partkey, p_brand, p_size, ['zip', '7z', 'rar', 'iso', 'cue', ''][p_partkey % 6 + 1] AS ext, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 4 END AS n,
p_size::BIGINT * 200000000 AS b, p_size::BIGINT * 100000000 AS big, ['g.iso', 'g.cue', ''][p_partkey % 3 + 1] AS inn, 'd' || p_size || '/f' || p_partkey AS stem FROM part),
e AS (SELECT *, CASE WHEN p_brand = 'Brand#1' THEN ['zip'] WHEN p_brand = 'Brand#2' THEN ['iso'] WHEN p_brand = 'Brand#3' THEN ['iso', 'cue'] WHEN p_brand <> 'Brand#4' THEN ['zip', '7z'] END AS accepts,
CASE p_brand WHEN 'Brand#1' THEN 'rezip' WHEN 'Brand#2' THEN 'unpack' END AS recipe FROM f),
w AS (SELECT *, list_contains(accepts, ext) AS takes, CASE WHEN recipe IS NULL THEN 'no recipe' WHEN n IS NULL AND ext IN ('zip', '7z', 'rar') THEN 'contents unknown' WHEN n IS NULL THEN 'not a container'
WHEN ext = 'rar' THEN 'can''t be unpacked' WHEN n = 0 THEN 'nothing inside' WHEN recipe = 'rezip' AND (b >= 4294967295 OR big >= 4294967295) THEN 'too big'
WHEN recipe = 'unpack' AND n > 1 THEN 'several entries' WHEN recipe = 'unpack' AND inn = '' THEN 'no name' WHEN recipe = 'unpack' AND inn <> 'g.iso' THEN 'inside not wanted' END AS why FROM e),
d AS (SELECT *, CASE WHEN accepts IS NULL THEN 'unclaimed' WHEN takes THEN 'as is' WHEN why IS NOT NULL THEN 'unsupported' ELSE 'convert' END AS decision FROM w)
SELECT p_partkey, decision, CASE WHEN decision = 'unsupported' THEN why END AS reason,
CASE decision WHEN 'unsupported' THEN NULL WHEN 'convert' THEN CASE recipe WHEN 'rezip' THEN stem || '.zip' ELSE 'd' || p_size || '/' || inn END ELSE stem || '.' || ext END AS target,
CASE WHEN decision = 'convert' THEN b / (CASE recipe WHEN 'rezip' THEN 25.0::DOUBLE ELSE 80.0::DOUBLE END * 1048576) END AS secs FROM d""")
def capability_decision(t):
    k, brand = F.col("p_partkey"), F.col("p_brand")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("zip", "7z", "rar", "iso", "cue", "")]), (k % 6 + 1).cast("int"))
    inner = F.element_at(F.array(*[F.lit(x) for x in ("x/g.iso", "x/g.cue", "x/")]), (k % 3 + 1).cast("int"))
    files = t.part.select(
        k, brand.alias("platform"), F.concat(F.lit("lib/d"), F.col("p_size").cast("string"), F.lit("/f"), k.cast("string"), F.lit("."), ext).alias("path"), F.when(k % 5 != 0, k % 4).alias("entries"),
        (F.col("p_size").cast("long") * 200000000).alias("inner_bytes"), (F.col("p_size").cast("long") * 100000000).alias("largest"), inner.alias("inner_name"),
    )
    takes = F.when(brand == "Brand#1", F.array(F.lit("zip"))).when(brand == "Brand#2", F.array(F.lit("iso"))).when(brand == "Brand#3", F.array(F.lit("iso"), F.lit("cue")))
    recipe = F.when(brand == "Brand#1", "rezip").when(brand == "Brand#2", "unpack")
    matrix = t.part.where(brand.isin([f"Brand#{n}" for n in range(1, 5)])).select(F.upper(brand).alias("platform"), takes.alias("accepts"), recipe.alias("recipe"))
    out = W.decided(files, matrix, (["zip", "7z"], None))
    how = F.when(F.col("decision") == "convert", F.when(F.endswith("target", F.lit(".zip")), "rezip").otherwise("unpack"))
    return out.select("p_partkey", "decision", "reason", "target", W.seconds(how, F.col("inner_bytes")).alias("secs"))


@query("""WITH s AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (FROM s)""")
def gathered_members(t):
    chosen = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return W.gathered(chosen, t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) ELSE p_brand END AS a, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS b FROM part),
q AS (SELECT *, a || '/' || b || '/f' || p_partkey AS path FROM p),
one AS (SELECT lower(a) AS f, arg_min(a, path) AS a FROM q GROUP BY 1), two AS (SELECT lower(a || '/' || b) AS f, arg_min(b, path) AS b FROM q GROUP BY 1), there AS (SELECT lower(p_brand) AS f, upper(p_brand) AS a FROM part WHERE p_size < 3 GROUP BY ALL)
SELECT p_partkey, coalesce(there.a, one.a) || '/' || two.b || '/f' || p_partkey AS aligned FROM q JOIN one ON one.f = lower(q.a) JOIN two ON two.f = lower(q.a || '/' || q.b) LEFT JOIN there ON there.f = lower(q.a)""")
def aligned_paths(t):
    k = F.col("p_partkey")
    a, b = F.when(k % 3 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")), F.when(k % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type"))
    paths = t.part.select(k, F.concat_ws("/", a, b, F.concat(F.lit("f"), k.cast("string"))).alias("path"))
    return W.aligned(paths, t.part.where("p_size < 3").select(F.upper("p_brand").alias("path"))).select("p_partkey", "aligned")


@query("""WITH k AS (SELECT l_orderkey AS key, CASE WHEN l_returnflag = 'R' THEN 'patch' WHEN l_returnflag = 'A' THEN 'extra' WHEN l_tax > 0.04 THEN 'whole' END AS kind FROM lineitem WHERE l_linenumber <= 2),
g AS (SELECT key, count(kind) AS n, bool_and(coalesce(kind = 'patch', false)) AS p, bool_and(coalesce(kind = 'extra', false)) AS x FROM k GROUP BY 1)
SELECT o_orderkey AS key, CASE WHEN n > 0 THEN CASE WHEN p THEN 'patch' WHEN x THEN 'extra' ELSE 'runs' END WHEN o_orderpriority = '1-URGENT' THEN 'patch' ELSE 'runs' END AS standalone
FROM orders LEFT JOIN g ON key = o_orderkey""")
def standalone_kinds(t):
    kind = F.when(F.col("l_returnflag") == "R", "patch").when(F.col("l_returnflag") == "A", "extra").when(F.col("l_tax") > 0.04, "whole")
    kinds = t.lineitem.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("key"), kind.alias("kind"))
    return W.standalone(t.orders.select(F.col("o_orderkey").alias("key"), "o_orderpriority"), kinds, F.col("o_orderpriority") == "1-URGENT")


@query("""WITH b AS (SELECT l_orderkey AS item, p_brand AS source, p_size AS game, l_linenumber AS ordinal, p_partkey % 2 = 1 AND l_quantity > 10 AS good FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey % 2 = 0 OR p_brand IN ('Brand#1', 'Brand#2')),
r AS (SELECT *, row_number() OVER (PARTITION BY item, source, game ORDER BY ordinal, good DESC) AS r FROM b)
SELECT item, source, game, ordinal, good AS accepted, CASE WHEN good THEN 'high' ELSE 'medium' END AS confidence FROM r WHERE r = 1""")
def serial_candidates(t):
    serial = lambda c: F.concat(F.lit("ABC"), F.col(c).cast("string"))
    only = F.when(F.col("l_suppkey") % 2 == 1, F.array(F.lit("Brand#1"), F.lit("Brand#2")))
    found = t.lineitem.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("ordinal"), serial("l_partkey").alias("serial"), only.alias("platforms"), (F.col("l_quantity") > 10).alias("sure"))
    shown = F.concat(F.lit("abc-"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 1, "").otherwise("x"))
    hits = t.part.select(serial("p_partkey").alias("serial"), F.col("p_brand").alias("platform"), F.col("p_brand").alias("source"), F.col("p_size").alias("game"), shown.alias("shown"))
    return W.serial_candidates(found, hits)


@query("""SELECT l_returnflag AS kind, count(*) AS containers, count(*) FILTER (l_linenumber IN (1, 4)) AS opened, count(*) FILTER (l_linenumber = 2) AS failed, count(*) FILTER (l_linenumber NOT IN (1, 2, 4)) AS unread,
count(*) FILTER (l_linestatus = 'O') AS solid, coalesce(sum(CASE WHEN l_linenumber = 1 THEN l_suppkey END), 0)::BIGINT AS inner_files, coalesce(sum(CASE WHEN l_linenumber = 1 THEN l_partkey END), 0)::BIGINT AS inner_bytes,
count(*) FILTER (l_quantity > 45) AS whole, count(*) FILTER (l_linenumber IN (1, 4)) / nullif(count(*) FILTER (l_linenumber IN (1, 2, 4)), 0) AS rate FROM lineitem GROUP BY 1""")
def container_summary(t):
    n = F.col("l_linenumber")
    state = F.when(n.isin(1, 4), "opened").when(n == 2, "failed").otherwise("unread")
    one = lambda c: F.when(n == 1, F.col(c))
    rows = t.lineitem.select(F.col("l_returnflag").alias("kind"), state.alias("state"), (F.col("l_linestatus") == "O").alias("solid"), one("l_suppkey").alias("inner_files"), one("l_partkey").alias("inner_bytes"), F.when(F.col("l_quantity") > 45, 1).alias("without_crc"))
    return W.container_summary(rows)


@query("""SELECT 'platform' AS level, p_brand AS name, count(*) AS dats, sum(p_size)::BIGINT AS games FROM part GROUP BY p_brand
UNION ALL SELECT 'source', (p_partkey % 7)::VARCHAR, count(*), sum(p_size)::BIGINT FROM part GROUP BY p_partkey % 7 UNION ALL SELECT 'all', NULL, count(*), sum(p_size)::BIGINT FROM part""")
def reference_totals(t):
    return W.reference_totals(t.part.select(F.col("p_brand").alias("platform"), (F.col("p_partkey") % 7).alias("source"), F.col("p_size").alias("games")), ["platform", "source"], ["games"])


@query("""SELECT lang AS name, doc_id AS item, md5(text) AS print FROM documents WHERE doc_id % 3 <> 0 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0)""")
def unresolved_memberships(t):
    d = t.documents.select(F.col("lang").alias("name"), F.col("doc_id").alias("item"), F.md5("text").alias("print"))
    return W.unresolved(d, d.where("item % 3 = 0"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN 'a b' END AS translators, replace(lower(p_type), ' ', '') || 'x1' AS platform,
CASE WHEN p_partkey % 2 = 0 THEN 'xdelta' END AS patch, p_partkey % 3 = 0 AS serial, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' END AS family, ['0', '0.1', '0.7', '1'][p_size % 4 + 1] AS rating FROM part""")
def name_readings(t):
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    tag = F.when(k % 4 == 0, F.concat(F.lit(" [b][tr zh-Hans "), F.col("p_brand"), F.lit("]"))).when(k % 4 == 1, F.lit(" (x)[tr chi  a   b][tr zh c]")).when(k % 4 == 2, F.lit(" [tr zh][tr zh late]")).otherwise(F.lit(" [tr ru who]"))
    code = F.when(k % 3 == 0, F.lit("pcsG00042")).when(k % 3 == 1, F.lit("PCSG0042")).otherwise(F.lit("PCS900042"))
    disc = F.concat(F.col("p_name"), F.when(k % 2 == 0, F.lit(" ")).otherwise(F.lit("")), F.lit("(DISC "), F.substring(s, -1, 1), F.lit(")"))
    rating = F.element_at(F.array(F.lit(-1.0), F.lit(0.05), F.lit(0.65), F.lit(1.5)), (F.col("p_size") % 4 + 1).cast("int"))
    return t.part.select(
        k, T.translation_group(F.concat(F.col("p_name"), tag)).alias("translators"), T.fold_platform(F.concat(F.upper("p_type"), F.lit(" X-_.1"))).alias("platform"),
        T.patch_extension(F.concat(F.lit("a/b."), F.when(k % 2 == 0, F.lit("XDelta")).otherwise(F.lit("zip")))).alias("patch"), T.matches_glob(code, "PCS@#####").alias("serial"),
        T.without_glob_suffix(disc, "(disc #)").alias("family"), T.format_rating(rating).alias("rating"),
    )
