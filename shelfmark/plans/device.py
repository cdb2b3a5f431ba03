"""From a selection to a device, evidence in layers, frontend files kept whole, pending work."""

from pyspark.sql import functions as F

from ..operators import device as D
from ..operators import evidence as E
from ..sources import kept as K
from ..streaming import pending as W
from .matches import LAYERS
from .registry import query

_FILES = """m AS (SELECT p_partkey, 'v' || p_partkey AS variant, 'lib/' || p_brand || '/' || nm || '.iso' AS key, p_brand || '/' || nm AS stem, p_size * 100000000::BIGINT AS len, p_type, p_brand, nm FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS nm FROM part)),
c AS (SELECT key, min(len) // 2 AS b FROM m WHERE p_type = 'PROMO' GROUP BY key),
f AS (SELECT p_partkey, variant, m.key AS source, p_brand, nm, stem || CASE WHEN c.key IS NULL THEN '.iso' ELSE '.chd' END AS path, CASE WHEN c.key IS NULL THEN len ELSE b END AS bytes, c.key IS NOT NULL AS converted FROM m LEFT JOIN c ON m.key = c.key),
g AS (SELECT lower(path) AS lp, min(path || chr(1) || source) AS first FROM f WHERE bytes <= 4000000000 GROUP BY 1),
s AS (SELECT f.*, CASE WHEN bytes > 4000000000 THEN 'too big' WHEN path || chr(1) || source <> first THEN 'collides' END AS reason FROM f LEFT JOIN g ON lower(path) = lp),
gone AS (SELECT DISTINCT path FROM s WHERE reason IS NULL AND p_partkey % 13 = 0),
l AS (SELECT s.*, CASE WHEN reason IS NOT NULL THEN 'rejected: ' || reason WHEN gone.path IS NOT NULL THEN 'gone' END AS left_off FROM s LEFT JOIN gone ON s.path = gone.path)"""


def _chain(t):
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    stem = F.concat("p_brand", F.lit("/"), name)
    rows = t.part.select(k, F.concat(F.lit("v"), k.cast("string")).alias("variant"), F.concat(F.lit("lib/"), stem, F.lit(".iso")).alias("key"), stem.alias("stem"), (F.col("p_size").cast("long") * 100_000_000).alias("len"), "p_type", "p_size")
    members = rows.select("variant", "key", F.lit(True).alias("is_file"), "len")
    decisions = rows.where("p_type = 'PROMO'").select("key", F.lit("convert").alias("decision"), F.concat("stem", F.lit(".chd")).alias("target"), F.expr("len div 2").alias("bytes"))
    return rows, D.screened(D.desired_files(members, decisions), 4_000_000_000)


@query(f"WITH {_FILES} SELECT variant, path, bytes::BIGINT AS bytes, converted, reason FROM s")
def desired_files(t):
    return _chain(t)[1].select("variant", "path", "bytes", "converted", "reason")


def _launching(t):
    rows, files = _chain(t)
    gone = files.where("reason is null").join(rows.where("p_partkey % 13 = 0").select("variant"), "variant", "left_semi").select("path")
    none = files.select("variant", "path").limit(0)
    return rows, D.launching(rows.select("variant", "key"), files, none, gone)


@query(f"WITH {_FILES} SELECT variant, CASE WHEN left_off IS NULL AND converted THEN path END AS launch, left_off FROM l")
def launching(t):
    return _launching(t)[1]


@query(f"""WITH {_FILES}, a AS (SELECT l.*, CASE p_size % 3 WHEN 0 THEN 'covers' WHEN 1 THEN 'videos' END AS folder, CASE p_size % 3 WHEN 0 THEN 'cover' WHEN 1 THEN 'video' ELSE 'other' END AS kind, 'h' || (l.p_partkey % 500) AS hash, CASE WHEN l.p_partkey % 17 > 0 THEN 'png' END AS ext FROM l JOIN part ON part.p_partkey = l.p_partkey WHERE left_off IS NULL),
p AS (SELECT *, CASE WHEN folder IS NULL THEN 'unknown kind' WHEN ext IS NULL THEN 'not in the pool' END AS why, 'media/' || p_brand || '/' || folder || '/' || nm || '.' || ext AS place FROM a)
SELECT variant, hash, CASE WHEN why IS NULL THEN place END AS path, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY why, place ORDER BY variant) = 1 THEN 'laid' ELSE 'crowded out' END) AS state FROM p""")
def media_laid(t):
    rows, on_card = _launching(t)
    kind = F.when(F.col("p_size") % 3 == 0, "cover").when(F.col("p_size") % 3 == 1, "video").otherwise("other")
    k = F.col("p_partkey")
    media = rows.select("variant", F.lit(0).alias("anchor"), k.alias("ordinal"), kind.alias("kind"), F.concat(F.lit("h"), (k % 500).cast("string")).alias("hash"), F.when(k % 17 > 0, "png").alias("ext"), F.lit(9).cast("long").alias("bytes"))
    return D.media_laid(media, on_card.join(rows.select("variant", "key"), "variant")).select("variant", "hash", "path", "state")


@query(f"""WITH {LAYERS} SELECT key, CASE r WHEN 0 THEN 'verdict' WHEN 1 THEN 'hash' WHEN 2 THEN 'name' ELSE 'unmatched' END AS layer, CASE WHEN r IS NOT NULL THEN entry END AS entry FROM c""")
def layered_evidence(t):
    """As ``layered_match_cascade``, but each layer reads for the orders that none before it resolved."""
    orders = t.orders.select(F.col("o_orderkey").alias("key"), "o_custkey", "o_orderpriority")
    building = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    layers = [
        ("verdict", lambda o: o.where("key % 11 = 0").select("key", F.concat(F.lit("v"), F.col("key").cast("string")).alias("entry"))),
        ("hash", lambda o: o.join(building, "o_custkey").select("key", F.col("c_name").alias("entry"))),
        ("name", lambda o: o.where("o_orderpriority = '1-URGENT'").select("key", F.col("o_orderpriority").alias("entry"))),
    ]
    return E.layered(orders, "key", layers)


@query("""WITH e AS (SELECT p_brand AS file, p_partkey AS k, p_partkey % 4 AS q, CASE WHEN p_partkey % 4 = 1 THEN upper(p_name) ELSE p_name END AS nm, p_size FROM part),
o AS (SELECT file, string_agg('<game><path>./p' || k || '</path><name>' || nm || '</name><x>' || p_size || '</x></game>' || chr(10), '' ORDER BY k) AS old, count(*) FILTER (q = 1) AS changed FROM e WHERE q <> 3 GROUP BY 1),
n AS (SELECT file, string_agg(chr(9) || '<game>' || chr(10) || chr(9) || chr(9) || '<path>./p' || k || '</path>' || chr(10) || chr(9) || chr(9) || '<name>' || nm || '</name>' || chr(10) || chr(9) || '</game>' || chr(10), '' ORDER BY k) AS new, count(*) AS added FROM e WHERE q = 3 GROUP BY 1)
SELECT file, md5('<!-- kept --><gameList>' || chr(10) || old || coalesce(new, '') || '</gameList>' || chr(10)) AS md5, changed, coalesce(added, 0)::INT AS added FROM o LEFT JOIN n USING (file)""")
def kept_lists(t):
    """Lists that others wrote, one a brand, with our names for some entries and some entries more."""
    k, line = F.col("p_partkey"), lambda x: F.concat(F.lit("./p"), x.cast("string"))
    entry = F.concat(F.lit("<game><path>"), line(k), F.lit("</path><name>"), "p_name", F.lit("</name><x>"), F.col("p_size").cast("string"), F.lit("</x></game>\n"))
    theirs = t.part.where(k % 4 != 3).groupBy(F.col("p_brand").alias("file")).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), entry.alias("e")))).alias("l"))
    files = theirs.select("file", F.concat(F.lit("<!-- kept --><gameList>\n"), F.array_join(F.transform("l", lambda x: x["e"]), ""), F.lit("</gameList>\n")).alias("text"))
    ours = t.part.where(k % 4 != 2).where("p_partkey % 4 <> 0 or p_partkey % 8 = 0").select(F.col("p_brand").alias("file"), line(k).alias("key"), F.lit("name").alias("field"), F.when(k % 4 == 1, F.upper("p_name")).otherwise(F.col("p_name")).alias("value"), k.cast("int").alias("ordinal"))
    return K.merged(files, ours, K.LIST).select("file", F.md5("text").alias("md5"), "changed", "added")


@query("""WITH s AS (SELECT event_type, max(event_id) // 2 AS mark FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT e.event_type, count(*) AS n, count(*) FILTER (mark IS NULL OR event_id > mark) AS waiting FROM events e LEFT JOIN s USING (event_type) GROUP BY 1""")
def pending_counts(t):
    settled = t.events.where("event_type <> 'error'").groupBy("event_type").agg(F.expr("max(event_id) div 2").alias("mark"))
    return W.counts(t.events, settled, "event_type", "event_id")
