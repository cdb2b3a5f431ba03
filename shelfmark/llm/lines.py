"""Operator 4: line deduplication by spread over distinct sites.

A line's key is two 64-bit hashes of its text without outer blanks. A line on ``min_sites`` sites
occurs at least as often, so a plain count (combined before its shuffle) leaves few lines to look
at closely. For those, HyperLogLog sketches of the sites merge by aggregation; a line whose
estimate lies near the threshold gets an exact distinct count. A line on enough sites is
boilerplate: the document with the smallest id among those that hold it keeps it, all others lose it.

Only DataFrame functions are used. Joins carry the many occurrences of a common line on one side
and a single row for it on the other, so a hot line can be split; sketches combine before a shuffle.

Cases: a null text counts as empty; blank lines are kept and never counted; a null site counts for
no site; rows with a null doc_id lose a line unless no row with an id holds it; repeated rows are
treated alike; an empty table gives an empty result; other columns pass through unchanged, whatever their names (but
for the two counts, where these are asked for).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_row, written

MIN_SITES = 10
SKETCH_LOG = 12  # 4096 buckets: a relative standard error of 1.04 / 64
NEAR = 5 * 1.04 / 64  # five standard errors

_BLANKS = " \t\r"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, site, pos, h1, h2) of every line that isn't blank."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col("source").alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    line: Column = F.btrim("line", F.lit(_BLANKS))
    return rows.withColumn("line", line).where("line <> ''").select("doc_id", "text_hash", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, keeper): lines on at least ``min_sites`` distinct sites and the smallest doc_id that holds them."""
    lines = _lines(docs)
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper")).where(F.col("n") >= min_sites)
    often = written(often.select("h1", "h2", "keeper"), "lines")
    seen = lines.select("h1", "h2", "site").join(often.select("h1", "h2"), ["h1", "h2"])
    spread = seen.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_LOG))).alias("sites"))
    spread = written(spread, "spread")
    low, high = min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR) + 1
    clear = spread.where(F.col("sites") > high).select("h1", "h2")
    near = spread.where(F.col("sites").between(low, high)).select("h1", "h2")
    exact = seen.join(near, ["h1", "h2"]).where("site is not null").distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_sites).select("h1", "h2")
    return often.join(clear.union(exact), ["h1", "h2"])


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, counts: bool = True) -> DataFrame:
    """The documents with boilerplate lines taken out of ``text``; with ``counts``, n_lines and n_removed are added (replaced if there)."""
    hits = _lines(docs).join(boilerplate(docs, min_sites), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = hits.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    # a document's own columns lie in one, so that none of their names can clash with these
    rows = docs.select(whole_row(docs).alias("row"))
    own = lambda c: F.col("row").getField(c)
    text = F.coalesce(own("text"), F.lit(""))
    all_ = rows.join(gone, own("doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("text_hash")), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")))
    # the line list is made once, as an argument, and picked from by place
    clean = F.when(F.col("gone").isNull(), own("text")).otherwise(F.array_join(F.element_at(F.transform(F.array(lines), lambda x: F.transform(kept, lambda i: F.get(x, i))), 1), "\n"))
    new = {"n_lines": F.size(lines), "n_removed": F.coalesce(F.size("gone"), F.lit(0))} if counts else {}
    return all_.select(*[(clean if c == "text" else own(c)).alias(c) for c in docs.columns if c not in new], *[v.alias(c) for c, v in new.items()])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = without_boilerplate(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return clean.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.length(text).cast("long").alias("clean_chars"), F.md5(text.cast("binary")).alias("clean_md5"))


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, i AS pos, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
bad AS (
  SELECT line, min(doc_id) AS keeper FROM lines WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT lines.*, bad.line IS NOT NULL AND doc_id <> keeper AS gone FROM lines LEFT JOIN bad USING (line)),
clean AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(text) AS clean_chars, md5(text) AS clean_md5 FROM clean
"""
