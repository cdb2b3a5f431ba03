"""Saved rules as text, what they take, and what a further one would add."""

from pyspark.sql import functions as F

from ..operators import rule_text as X
from ..operators.rules import Clause
from .registry import cents, query

FIELDS = {"品牌": X.Field("p_brand", "text"), "名": X.Field("p_name", "text"), "类型": X.Field("p_type", "text"), "体积": X.Field("p_size", "size"), "年份": X.Field("year", "year")}
RULES = {
    "brands": "品牌=brand#3,Brand#7 且 (名$RING 或 体积>=40B)",
    "neither": "都不(类型=ECONOMY,promo 或 体积<10)",
    "not both": "都不((名^small 且 体积<=20))",
    "years": "年份>=1995 或 年份!=1994",
}


@query("""SELECT p_partkey, unnest(list_filter([CASE WHEN p_brand IN ('Brand#3', 'Brand#7') AND (ends_with(p_name, 'ring') OR p_size >= 40) THEN 'brands' END, CASE WHEN NOT (p_type IN ('ECONOMY', 'PROMO') OR p_size < 10) THEN 'neither' END,
CASE WHEN NOT (starts_with(p_name, 'small') AND p_size <= 20) THEN 'not both' END, CASE WHEN coalesce(CASE WHEN p_size > 20 THEN 1970 + p_size END, 0) <> 1994 THEN 'years' END], lambda x: x IS NOT NULL)) AS rule FROM part""")
def rule_text_hits(t):
    return X.hits(t.part.withColumn("year", F.when(F.col("p_size") > 20, F.col("p_size") + 1970)), "p_partkey", RULES, FIELDS)


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '品牌=' || p_brand || ' 且 体积>=' || p_size WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE '都不(品牌=' || p_brand || ' 或 名~' || p_name || ')' END AS canonical,
CASE p_partkey % 4 WHEN 1 THEN 'mixed joiners' WHEN 2 THEN 'unknown label' END AS error FROM part""")
def rule_text_checked(t):
    k = F.col("p_partkey") % 4
    brand, size = F.concat(F.lit("品牌="), F.col("p_brand")), F.col("p_size").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("( "), brand, F.lit("  且 ((体积 >= "), size, F.lit(")))")))
        .when(k == 1, F.concat(brand, F.lit(" 且 体积<5 或 名~x")))
        .when(k == 2, F.concat(F.lit("颜色="), F.col("p_name")))
        .otherwise(F.concat(F.lit("都不 ("), brand, F.lit(" 或 名 ~ "), F.col("p_name"), F.lit(")")))
    )
    return X.checked(t.part.select("p_partkey", text.alias("rule")), "rule", FIELDS).select("p_partkey", "canonical", "error")


@query("""WITH f AS (SELECT *, p_brand = 'Brand#1' OR p_size < 5 AS had, p_retailprice::DECIMAL(18,2) AS m FROM part), c AS (SELECT unnest(['ring', 'large', 'none']) AS rule)
SELECT rule, count(*) FILTER (hit) AS hits, count(*) FILTER (hit AND NOT had) AS added, coalesce(sum(m) FILTER (hit AND NOT had), 0)::DECIMAL(28,2) AS added_total FROM (SELECT rule, had, m, CASE rule WHEN 'ring' THEN ends_with(p_name, 'ring') WHEN 'large' THEN p_size >= 30 ELSE false END AS hit FROM f, c) GROUP BY 1""")
def selection_gain(t):
    chosen = [X.parse("品牌=brand#1", FIELDS), X.parse("体积<5", FIELDS)]
    candidates = {"ring": Clause("p_name", "$", "Ring"), "large": X.parse("体积>=30", FIELDS), "none": Clause("p_brand", "=", "nothing")}
    return X.gains(t.part.withColumn("m", cents("p_retailprice")), chosen, candidates, "m").withColumn("added_total", F.col("added_total").cast("decimal(28,2)"))
