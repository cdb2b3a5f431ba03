"""What file names say."""

from pyspark.sql import functions as F

from ..functions import naming as N
from .registry import query

RULES = N.NameRules(team_words=("team",), languages=("En", "Ja"), versions=("v#*",), sizes=("#*mb",), noise=("!",), title_noise=("small",), genres=("rpg",), platforms=("GB",), numbering=("."))


@query("""SELECT p_partkey, trim(replace(p_name, 'small ', '')) AS title, CASE WHEN p_partkey % 3 = 0 THEN 'x team' END AS team, CASE WHEN p_partkey % 5 = 0 THEN 'v' || p_size % 10 || '.0' END AS version,
CASE WHEN p_partkey % 2 = 0 THEN 'En' ELSE 'Ja' END AS language, CASE WHEN p_partkey % 7 = 0 THEN 1990 + p_size END::INT AS year, CASE WHEN p_partkey % 11 = 0 THEN p_brand END AS unknown, 3 + (p_partkey % 3 = 0)::INT + (p_partkey % 5 = 0)::INT + (p_partkey % 7 = 0)::INT + (p_partkey % 11 = 0)::INT + (p_partkey % 13 = 0)::INT + starts_with(p_name, 'small ')::INT AS n FROM part""")
def name_grammar(t):
    k = F.col("p_partkey")
    mark = lambda every, text: F.when(k % every == 0, F.concat(F.lit(" ["), text, F.lit("]"))).otherwise("")
    size = F.col("p_size").cast("string")
    name = F.concat(
        F.lit("07."), F.when(k % 13 == 0, "GB ").otherwise(""), "p_name", mark(3, F.lit("x team")), mark(5, F.concat(F.lit("v"), (F.col("p_size") % 10).cast("string"), F.lit(".0"))), mark(7, (F.col("p_size") + 1990).cast("string")),
        mark(11, F.col("p_brand")), F.when(k % 2 == 0, "(En)").otherwise("(Ja)"), F.lit("."), F.lit("zip"),
    )
    out = N.parsed(t.part.select(k, name.alias("name"), size.alias("p_size")), "name", RULES)
    return out.select("p_partkey", "title", "team", "version", F.get("languages", F.lit(0)).alias("language"), "year", F.get("unknown", F.lit(0)).alias("unknown"), F.size("taken").alias("n"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'container' WHEN 1 THEN 'bare file' WHEN 2 THEN 'media' WHEN 4 THEN 'container' ELSE 'unclassified' END AS category, CASE p_partkey % 6 WHEN 3 THEN 'document' WHEN 5 THEN 'system junk' END AS suspect, p_partkey % 6 = 4 AS later_part FROM part""")
def name_kinds(t):
    k = F.col("p_partkey") % 6
    ext = F.when(k == 0, ".ZIP").when(k == 1, ".gba").when(k == 2, ".png").when(k == 3, ".txt").when(k == 4, ".part2.rar").otherwise(".zip")
    key = F.concat(F.lit("lib/"), F.when(k == 5, "._").otherwise(""), F.col("p_name"), ext)
    return t.part.select("p_partkey", N.classified(key).alias("c")).select("p_partkey", "c.*")
