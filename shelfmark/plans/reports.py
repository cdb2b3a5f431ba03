"""Health, shares, priorities, shaping, differences, ledgers, triage and entries."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import converge as C
from ..operators import health as H
from ..operators import ledger as L
from ..operators import priority as P
from ..operators import shape as S
from ..operators import sync as Y
from ..operators import triage as Q
from ..operators.order import numbered
from .registry import cents, query


@query("""SELECT n_chars::BIGINT AS size, lower(source) AS name, count(*) AS n, ((count(*) - 1) * n_chars)::BIGINT AS reclaimable FROM documents WHERE n_chars > 0 GROUP BY n_chars, lower(source) HAVING count(*) > 1""")
def duplicate_groups(t):
    return H.duplicates(t.documents, "n_chars", F.col("source"))


@query("""SELECT n_chars::BIGINT AS size, lower(lang) AS name, count(*) AS n, ((count(*) - 1) * n_chars)::BIGINT AS reclaimable FROM documents WHERE n_chars > 0 GROUP BY n_chars, lower(lang) HAVING count(*) > 1 ORDER BY reclaimable DESC, size, name LIMIT 15""")
def reclaimable_topn(t):
    return H.top(H.duplicates(t.documents, "n_chars", F.col("lang")), [F.desc("reclaimable"), F.asc("size"), F.asc("name")], 15)


@query("""SELECT source, lang, grouping(source, lang)::BIGINT AS level, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())""")
def health_grouping_sets(t):
    return H.grouped(t.documents, [["source", "lang"], ["source"], ["lang"], []], {"files": F.count("*"), "bytes": F.sum("n_chars")})


@query("""SELECT p_brand, l_partkey, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, l_partkey) AS rank
FROM (SELECT p_brand, l_partkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE rank <= 5""")
def top_n_per_platform(t):
    counted = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_partkey", "n")
    return H.top_per_group(counted, ["p_brand"], [F.desc("n"), F.asc("l_partkey")], 5)


@query("""SELECT o_orderpriority, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""")
def share_of_total(t):
    return H.with_share(t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")), "n")


@query("""SELECT lower(c_mktsegment) || (c_custkey % 500) AS folded, count(DISTINCT c_name) AS n, max(c_nationkey) AS bytes FROM customer GROUP BY 1 HAVING count(DISTINCT c_name) > 1""")
def collision_groups(t):
    folded = F.concat(F.lower("c_mktsegment"), (F.col("c_custkey") % 500).cast("string"))
    return H.collisions(t.customer, "c_name", folded, "c_nationkey")


@query("""SELECT "group", min(page_id) AS item FROM (SELECT page_id, regexp_extract(url, '^([^?#]*)/', 1) AS "group" FROM pages) GROUP BY 1 HAVING count(DISTINCT page_id) = 1""")
def exclusive_dirs(t):
    return H.exclusive_groups(t.pages, F.regexp_extract("url", "^([^?#]*)/", 1), "page_id").select("group", "item")


_RANK = "CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END"
_ORDER = ["purchase", "click", "view"]


def _values(t):
    return t.events.select("user_id", F.get_json_object("props", "$.k").alias("value"), F.col("event_type").alias("source"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") % 4).cast("string").alias("field"))


_EAV = 'v AS (SELECT user_id, json_extract_string(props, \'$.k\') AS value, event_type AS source, epoch_us(ts) AS "at", (event_id % 4)::VARCHAR AS field FROM events)'
_PICK = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY {_RANK.replace('event_type', 'source')}, \"at\" DESC, source, value) AS rn FROM v) WHERE rn = 1"


@query(f"WITH {_EAV} SELECT user_id, field, source, value, \"at\" FROM ({_PICK})")
def priority_pick(t):
    return P.pick(_values(t), ["user_id", "field"], P.source_rank(F.col("source"), _ORDER))


@query(f"WITH {_EAV}, w AS ({_PICK}) SELECT DISTINCT v.user_id, v.field, v.source, v.value FROM v JOIN w ON v.user_id = w.user_id AND v.field = w.field AND v.source = w.source")
def priority_pick_all(t):
    return P.pick_all(_values(t), ["user_id", "field"], P.source_rank(F.col("source"), _ORDER))


@query(f"WITH {_EAV}, w AS ({_PICK}) SELECT user_id, max(value) FILTER (field = '0') AS \"0\", max(value) FILTER (field = '1') AS \"1\", max(value) FILTER (field = '2') AS \"2\", max(value) FILTER (field = '3') AS \"3\" FROM w GROUP BY user_id")
def priority_merge(t):
    return P.merged(_values(t), "user_id", "field", ["0", "1", "2", "3"], P.source_rank(F.col("source"), _ORDER))


@query(f"WITH {_EAV}, o AS ({_PICK}), n AS ({_PICK.replace(_RANK.replace('event_type', 'source'), 'CASE source WHEN ' + chr(39) + 'error' + chr(39) + ' THEN 0 ELSE 1 END')}) SELECT o.user_id, o.field, o.value AS old_value, n.value AS new_value FROM o JOIN n ON o.user_id = n.user_id AND o.field = n.field WHERE o.value IS DISTINCT FROM n.value")
def priority_shift_diff(t):
    return P.shifts(_values(t), ["user_id", "field"], P.source_rank(F.col("source"), _ORDER), P.source_rank(F.col("source"), ["error"]))


@query("""SELECT source, text AS title, lang FROM (SELECT source, text, lang, row_number() OVER (PARTITION BY source ORDER BY coalesce(quality, 0) DESC, CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, -n_chars, text) AS rn
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE rn = 1""")
def display_title(t):
    both = t.documents.join(t.labels, "doc_id", "left").select("source", F.col("text").alias("title"), "lang", "n_chars", "quality")
    order = [-F.coalesce("quality", F.lit(0)), P.source_rank(F.col("lang"), ["de", "fr"]), -F.col("n_chars"), F.col("title")]
    return P.least_by(both, ["source"], order, ["title", "lang"])


@query("""SELECT lang, string_agg(source, '|' ORDER BY first) AS others FROM (SELECT lang, source, min(rn) AS first FROM (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) GROUP BY ALL HAVING min(rn) > 1) GROUP BY lang""")
def also_known_as(t):
    return P.others_in_order(t.documents, ["lang"], [-F.col("n_chars"), F.col("doc_id")], "source")


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[\\p{Hiragana}\\p{Katakana}]') THEN 'ja' WHEN regexp_matches(text, '\\p{Hangul}') THEN 'ko' WHEN regexp_matches(text, '\\p{Han}') THEN 'zh' WHEN regexp_matches(text, '\\p{Cyrillic}') THEN 'ru' WHEN regexp_matches(text, '\\p{L}') THEN 'en' ELSE 'unknown' END AS script,
trim(regexp_replace(text, '\\s+', ' ', 'g')) AS title FROM documents""")
def language_detect(t):
    return t.documents.select("doc_id", T.language_of(F.col("text"), F.lit(None).cast("string")).alias("script"), T.tidy(F.col("text")).alias("title"))


_PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')"


def _paths(t):
    return t.pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "").alias("path"), F.length("html").cast("long").alias("size"))


@query(f"""WITH f AS (SELECT {_PATH} AS p, length(html)::BIGINT AS size FROM pages), g AS (SELECT regexp_replace(p, '/?[^/]*$', '') AS dir, regexp_extract(p, '([^/]*)$', 1) AS b, size FROM f),
s AS (SELECT dir, CASE WHEN regexp_matches(b, '^.+\\.[^.]*$') THEN regexp_replace(b, '\\.[^.]*$', '') ELSE b END AS stem, nullif(lower(regexp_extract(b, '^.+\\.([^.]+)$', 1)), '') AS ext, size FROM g)
SELECT dir, stem, count(*) AS files, sum(size)::BIGINT AS bytes, coalesce(string_agg(DISTINCT ext, ',' ORDER BY ext), '') AS exts FROM s GROUP BY dir, stem""")
def shape_same_stem(t):
    return S.same_stem(_paths(t), "path", "size")


@query("""WITH n AS (SELECT conv_id % 40 AS g, 'talk ' || (conv_id % 7) AS base, 'talk ' || (conv_id % 7) || CASE WHEN turn > 0 THEN ' (Disc ' || turn || ')' ELSE '' END AS name, turn FROM conversations WHERE turn < 20),
d AS (SELECT g, base AS family, count(*) AS n, bool_or(turn > 0) AS marked, string_agg(name, '|' ORDER BY turn) AS members FROM n GROUP BY g, base) SELECT g, family, n, members FROM d WHERE n >= 2 AND marked""")
def shape_disc_family(t):
    mark = F.when(F.col("turn") > 0, F.concat(F.lit(" (Disc "), F.col("turn").cast("string"), F.lit(")"))).otherwise("")
    named = t.conversations.where("turn < 20").select((F.col("conv_id") % 40).alias("g"), F.concat(F.lit("talk "), (F.col("conv_id") % 7).cast("string"), mark).alias("name"))
    return S.disc_families(named, ["g"], "name")


@query("""WITH f AS (SELECT 'd' || (p_size % 5) || '/' || replace(p_name, ' ', '_') AS base, p_partkey % 9 AS k FROM part WHERE p_partkey % 9 > 0)
SELECT regexp_extract(base, '^(.*)/', 1) AS dir, regexp_extract(base, '/(.*)$', 1) AS base, count(DISTINCT k) AS n, max(k) - min(k) + 1 = count(DISTINCT k) AS complete FROM f GROUP BY base""")
def shape_volumes(t):
    files = t.part.where("p_partkey % 9 > 0").select(F.concat(F.lit("d"), (F.col("p_size") % 5).cast("string"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".part0"), (F.col("p_partkey") % 9).cast("string"), F.lit(".rar")).alias("key"))
    return S.volumes(files, "key")


@query("""SELECT name, row_number() OVER (ORDER BY num, name)::INT AS place FROM (SELECT DISTINCT 'Customer ' || (c_custkey % 300) AS name, c_custkey % 300 AS num FROM customer)""")
def natural_sort(t):
    names = t.customer.select(F.concat(F.lit("Customer "), (F.col("c_custkey") % 300).cast("string")).alias("name")).distinct()
    placed = numbered(names, [], [T.natural_key(F.col("name")).asc(), F.asc("name")])
    return placed.withColumn("place", (F.col("place") + 1).cast("int"))


@query("""WITH l AS (SELECT 's' || (doc_id % 17) || '/f' || (doc_id % 211) || '.sav' AS key, 's' || (doc_id % 17) AS dir, doc_id % 211 AS stem FROM labels),
m AS (SELECT DISTINCT 's' || (doc_id % 19) AS dir, doc_id % 211 AS stem FROM documents WHERE n_chars > 2000)
SELECT l.key, e.elsewhere FROM l LEFT JOIN (SELECT stem, min(dir) AS elsewhere FROM m GROUP BY stem) e ON l.stem = e.stem WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.dir = l.dir AND m.stem = l.stem)""")
def stranded_companions(t):
    path = lambda n, ext: F.concat(F.lit("s"), (F.col("doc_id") % n).cast("string"), F.lit("/f"), (F.col("doc_id") % 211).cast("string"), F.lit(ext)).alias("key")
    return S.stranded(t.labels.select(path(17, ".sav")), t.documents.where("n_chars > 2000").select(path(19, ".bin")), "key")


@query("""WITH f AS (SELECT 'r/p' || (p_partkey % 4) || '/t' || (p_partkey % 30) || '/x' || (p_partkey % 3) || '/' || p_partkey AS key, p_partkey AS k FROM part),
a AS (SELECT DISTINCT 'r/p' || (k % 4) || '/t' || (k % 30) AS root FROM f WHERE k % 50 = 7)
SELECT key, 'r/p' || (k % 4) || '/t' || (k % 30) AS root FROM f WHERE 'r/p' || (k % 4) || '/t' || (k % 30) IN (SELECT root FROM a)""")
def shape_tree_roots(t):
    k = F.col("p_partkey")
    tree = F.concat(F.lit("r/p"), (k % 4).cast("string"), F.lit("/t"), (k % 30).cast("string"))
    files = t.part.select(F.concat(tree, F.lit("/x"), (k % 3).cast("string"), F.lit("/"), k.cast("string")).alias("key")).union(t.part.where("p_partkey % 50 = 7").select(F.concat(tree, F.lit("/anchor"))))
    return S.tree_roots(files, "key", F.col("key").endswith("/anchor")).where(~F.col("key").endswith("/anchor"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 40 = 0 THEN 'manual' WHEN p_type = 'PROMO' THEN 'tree' WHEN p_name LIKE '% ring' THEN 'stem' ELSE 'single' END AS rule,
CASE WHEN p_partkey % 40 = 0 THEN 'm' WHEN p_type = 'PROMO' THEN p_brand WHEN p_name LIKE '% ring' THEN p_name ELSE p_partkey::VARCHAR END AS item FROM part""")
def shape_cascade(t):
    part = t.part.withColumn("key", F.col("p_partkey").cast("string"))
    layers = [("manual", F.when(F.col("p_partkey") % 40 == 0, F.lit("m"))), ("tree", F.when(F.col("p_type") == "PROMO", F.col("p_brand"))), ("stem", F.when(F.col("p_name").endswith(" ring"), F.col("p_name")))]
    return S.assigned(part, "key", layers).select("p_partkey", "rule", "item")


@query("""WITH d AS (SELECT o_orderkey AS path, (o_orderkey % 5)::INT AS version FROM orders WHERE o_orderkey % 3 <> 0),
m AS (SELECT o_orderkey AS path, (o_orderkey % 4)::INT AS version, o_custkey AS size, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey END AS mtime FROM orders WHERE o_orderkey % 4 <> 1),
a AS (SELECT o_orderkey AS path, o_custkey + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS size, o_orderkey AS mtime FROM orders WHERE o_orderkey % 7 <> 2),
j AS (SELECT coalesce(d.path, m.path, a.path) AS path, d.path IS NOT NULL AS d, m.path IS NOT NULL AS m, a.path IS NOT NULL AS a, d.version = m.version AS sv, coalesce(m.size = a.size AND m.mtime = a.mtime, false) AS same
FROM d FULL JOIN m ON d.path = m.path FULL JOIN a ON coalesce(d.path, m.path) = a.path)
SELECT path, CASE WHEN d AND NOT m THEN CASE WHEN a THEN 'foreign' ELSE 'add' END WHEN d AND NOT a THEN 'gone' WHEN d THEN CASE WHEN NOT same THEN 'changed' WHEN sv THEN 'keep' ELSE 'update' END WHEN m AND NOT a THEN 'forget' WHEN m THEN CASE WHEN same THEN 'delete' ELSE 'changed' END END AS action FROM j WHERE d OR m""")
def three_way_diff(t):
    key = F.col("o_orderkey")
    rows = t.orders.select(key.alias("path"), "o_custkey")
    desired = rows.where("path % 3 <> 0").select("path", (F.col("path") % 5).alias("version"))
    manifest = rows.where("path % 4 <> 1").select("path", (F.col("path") % 4).alias("version"), F.col("o_custkey").alias("size"), F.when(F.col("path") % 13 != 0, F.col("path")).alias("mtime"))
    actual = rows.where("path % 7 <> 2").select("path", (F.col("o_custkey") + F.when(F.col("path") % 17 == 0, 1).otherwise(0)).alias("size"), F.col("path").alias("mtime"))
    return Y.three_way(desired, manifest, actual)


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_name, p_partkey % 10 <> 0 AS ok FROM part WHERE p_partkey % 8 <> 0),
o AS (SELECT * FROM part WHERE p_partkey % 9 <> 0)
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN n.p_partkey IS NULL THEN 'removed' WHEN NOT ok THEN 'unreadable' WHEN o.p_partkey IS NULL THEN 'added' WHEN o.p_size IS NOT DISTINCT FROM n.p_size AND o.p_name = n.p_name THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.p_partkey = n.p_partkey""")
def baseline_diff(t):
    new = t.part.where("p_partkey % 8 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 6 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"), "p_name", (F.col("p_partkey") % 10 != 0).alias("ok"))
    return Y.row_diff(t.part.where("p_partkey % 9 <> 0"), new, "p_partkey", ["p_size", "p_name"], "ok")


@query("""SELECT count(*) AS files, coalesce(sum(o_custkey), 0)::BIGINT AS bytes FROM orders WHERE o_orderkey % 5 <> 0""")
def strangers(t):
    actual = t.orders.select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("size"))
    return Y.strangers(actual.where("path % 5 = 0"), actual)


@query("""SELECT p_partkey, p_size, row_number() OVER w::INT AS place, sum(p_size) OVER w::BIGINT AS freed FROM (SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 30) WINDOW w AS (ORDER BY p_size DESC, p_partkey ROWS UNBOUNDED PRECEDING)""")
def capacity_running_sum(t):
    return Y.trim_suggestions(t.part, "p_partkey", "p_size", 30)


@query("""SELECT sum(n_chars)::BIGINT AS bytes, CASE WHEN sum(n_chars) > 100000 THEN sum(n_chars) - 100000 END::BIGINT AS over FROM documents""")
def over_capacity(t):
    return Y.over_capacity(t.documents, "n_chars", 100_000)


@query("""SELECT p_partkey, CASE WHEN p_retailprice > 1050 THEN 'too big' WHEN p_partkey % 5 = 0 THEN 'forbidden character' WHEN p_partkey % 7 = 0 THEN 'reserved name' WHEN p_partkey % 11 = 0 THEN 'trailing dot or blank' END AS why FROM part""")
def screen_paths(t):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.lit("d/a:b.bin")).when(k % 7 == 0, F.lit("d/Com1.txt")).when(k % 11 == 0, F.lit("d/x.")).otherwise(F.concat(F.lit("d/"), F.col("p_name")))
    return t.part.select("p_partkey", Y.screen(name, F.col("p_retailprice"), 1050).alias("why"))


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_wins_log(t):
    return L.latest(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM (SELECT * FROM events WHERE event_id // 100 NOT IN (SELECT DISTINCT event_id // 100 FROM events WHERE event_type = 'error' AND event_id % 100 < 10))) WHERE rn = 1 AND event_type <> 'signup'""")
def soft_delete_undo(t):
    log = t.events.withColumn("batch", F.floor(F.col("event_id") / 100)).withColumn("lifted", F.when(F.col("event_type") == "signup", F.col("event_id")))
    undo = log.where("event_type = 'error' and event_id % 100 < 10")
    return L.live(L.latest(L.undone(log, undo), ["user_id"], ["event_id"]), "lifted").select("user_id", "event_id", "value")


@query("""WITH b AS (SELECT DISTINCT user_id, event_id // 500 AS batch FROM events) SELECT s.user_id, min(l.batch) AS batch FROM b s JOIN b l ON s.user_id = l.user_id AND l.batch > s.batch WHERE s.batch = 2 GROUP BY s.user_id""")
def covering_batch(t):
    log = t.events.select("user_id", F.floor(F.col("event_id") / 500).alias("batch")).distinct()
    return L.covering_batch(log, "batch", "user_id", F.col("batch") == 2)


@query("""SELECT source, lang, count(*) AS n, CASE WHEN min(k) = max(k) THEN min(k) ELSE 'doc ' || CASE WHEN left(min(k), 5) = left(max(k), 5) THEN substring(min(k), 5, 1) || CASE WHEN left(min(k), 6) = left(max(k), 6) THEN substring(min(k), 6, 1) ELSE '' END ELSE '' END END AS common
FROM (SELECT source, lang, 'doc ' || lpad((n_chars % 1000)::VARCHAR, 3, '0') AS k FROM documents) GROUP BY ALL""")
def batch_shapes(t):
    items = t.documents.withColumn("k", F.concat(F.lit("doc "), F.lpad((F.col("n_chars") % 1000).cast("string"), 3, "0")))
    return Q.batches(items, ["source", "lang"], "k")


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL""")
def drill_axis(t):
    return Q.drill(t.orders, ["o_orderpriority"], "o_orderstatus")


@query("""SELECT source, n, place::INT AS place, covered::BIGINT AS covered, round(covered / total, 6) AS share FROM (SELECT source, n, row_number() OVER w AS place, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS covered, sum(n) OVER () AS total FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) WINDOW w AS (ORDER BY n DESC, source))""")
def coverage(t):
    return H.running_share(t.documents.groupBy("source").agg(F.count("*").alias("n")), "n", [F.desc("n"), F.asc("source")])


@query("""WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1),
s AS (SELECT p_brand, n, CASE WHEN n <= 2 THEN 1 ELSE coalesce(list_filter(range(greatest(1, floor(n * 0.6180339887499))::BIGINT, greatest(1, floor(n * 0.6180339887499))::BIGINT + 201), lambda x: x < n AND gcd(x, n) = 1)[1], 1) END AS stride FROM n),
w AS (SELECT p_brand, (7 + unnest(range(0, least(4, n))) * stride) % n AS i FROM s)
SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part) JOIN w USING (p_brand, i)""")
def stride_sample(t):
    return Q.spread_sample(t.part.select("p_brand", "p_partkey"), ["p_brand"], [F.asc("p_partkey")], 4, seed=7)


@query("""SELECT k AS key, count(*) AS n FROM (SELECT p_partkey, unnest(list_distinct([p_brand, p_type, p_name])) AS k FROM part) GROUP BY 1""")
def tally_keys(t):
    return Q.tally(t.part, F.array("p_brand", "p_type", "p_name"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F')""")
def orphan_sweep(t):
    return L.orphans(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), t.orders.where("o_orderstatus <> 'F'"), "l_orderkey", "o_orderkey")


@query("""SELECT 'r' || (p_partkey % 3) || '/' || p_name || '/' || p_partkey AS key FROM part WHERE p_partkey % 3 <> 1 OR p_partkey % 4 = 0""")
def generation_sweep(t):
    entries = t.part.select(F.concat(F.lit("r"), (F.col("p_partkey") % 3).cast("string"), F.lit("/"), F.col("p_name"), F.lit("/"), F.col("p_partkey").cast("string")).alias("key"), F.when(F.col("p_partkey") % 4 == 0, 7).otherwise(6).alias("seen"))
    return L.swept(entries, 7, "r1", True).select("key")


@query("""SELECT p_partkey, p_size * 2 AS p_size FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT p_partkey, p_size FROM part WHERE p_partkey % 10 <> 0""")
def replace_rows(t):
    return L.replaced(t.part.select("p_partkey", "p_size"), t.part.where("p_partkey % 10 = 0").select("p_partkey", (F.col("p_size") * 2).alias("p_size")), ["p_partkey"])


@query("""SELECT count(*) FILTER (p_partkey % 3 <> 0) AS added, count(*) FILTER (p_partkey % 3 = 0) AS replaced, (SELECT count(*) FROM part WHERE p_size > 40) AS bad FROM part WHERE p_size <= 40""")
def import_counts(t):
    return L.import_counts(t.part.where("p_partkey % 3 = 0"), t.part, "p_partkey", F.col("p_size") <= 40)


@query("""SELECT c_custkey AS key FROM customer WHERE c_acctbal > 5000 UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def union_distinct_keys(t):
    return L.union_keys(t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("key")), t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("""SELECT p_brand AS g0, p_type AS g1, first(p_partkey ORDER BY p, p_partkey)::VARCHAR AS first, count(*)::INT AS n, string_agg(p_partkey::VARCHAR, '|' ORDER BY p, p_partkey) AS members
FROM (SELECT *, CASE WHEN p_size > 45 THEN 0 WHEN ends_with(p_name, 'ring') THEN 1 ELSE 2 END AS p FROM part) GROUP BY p_brand, p_type""")
def converge_entries(t):
    rank = C.preference([F.col("p_size") > 45, F.col("p_name").endswith("ring")])
    return C.entries(t.part, [F.col("p_brand"), F.col("p_type")], rank, "p_partkey")


@query("""SELECT doc_id, md5(text) AS print FROM documents WHERE doc_id % 4 = 0 OR n_chars % 5 = 0""")
def incremental_fingerprint(t):
    wanted = t.documents.select("doc_id", F.md5("text").alias("print"))
    done = t.documents.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("n_chars") % 5 != 0, F.md5("text")).otherwise("old").alias("print"))
    return P.unchanged_inputs(wanted, done, ["doc_id"], "print")


@query("""SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages""")
def html_title_extract(t):
    return t.pages.select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


@query("""SELECT item, string_agg(name, chr(10) ORDER BY turn) AS lines FROM (SELECT conv_id AS item, 'part ' || turn AS name, turn FROM conversations) GROUP BY item HAVING count(*) > 1""")
def playlists(t):
    rows = t.conversations.select("conv_id", F.concat(F.lit("part "), F.col("turn").cast("string")).alias("name"))
    return Y.playlists(rows, "conv_id", "name", T.natural_key(F.col("name"))).withColumnRenamed("conv_id", "item")


@query("""SELECT n_name, count(DISTINCT o_orderkey) AS orders, sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1""")
def nation_revenue(t):
    # lines become one row an order before they meet orders: the joins shuffle and count orders only
    net = (cents("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("net")
    lines = t.lineitem.where("l_shipdate < timestamp '1999-01-01'").select("l_orderkey", net).groupBy("l_orderkey").agg(F.sum("net").alias("net"))
    joined = lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.sum("net").cast("double").alias("revenue"))
