"""Operator 10: near-duplicate embeddings by navigable small-world graphs, one a shard.

Equal vectors of a label are one class first, so a very common vector is one row. Classes of a
label are dealt to shards of at most ``SHARD_ROWS``; every shard has a graph and is asked for every
class of its label, in blocks of ``QUERY_ROWS``, so a task holds a bounded number of vectors. Each
task audits a sample of its queries that have neighbours in the shard against brute force and doubles
the beam until the mean recall of a query passes. A pair that a graph proposes is a link only if its cosine in
double precision reaches the threshold. Tasks return a link count for each class and a spanning
forest of their links; components are united over all shards.

Cases: a vector that is null, zero, or holds a null or non-finite component links with nothing, nor
does one with a null label or null vec_id, or (between each other) vectors of different lengths;
repeated rows are vectors like any other and link with one another; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .components import components

COSINE = 0.93
SHARD_ROWS, QUERY_ROWS, LEAST_SHARDS = 16_384, 65_536, 2
EF, AUDIT_ROWS, AUDIT_RECALL = 32, 64, 0.995
_SLACK = 1e-5  # navigation is in single precision


def _task(cosine: float):
    def run(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .components import forest
        from .hnsw import Graph, audited

        rows = pd.concat(list(parts))  # at most SHARD_ROWS members and QUERY_ROWS queries
        rows = rows.sort_values("rep", kind="stable")
        full = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        full /= np.linalg.norm(full, axis=1, keepdims=True)
        member = rows["member"].to_numpy()
        rep, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
        x, y, x_rep, y_rep, weight = full[member], full[~member], rep[member], rep[~member], copies[member]
        if not len(x) or not len(y):
            return
        small = x.astype(np.float32)
        a, b, _ = audited(Graph(small), small, y.astype(np.float32), cosine - _SLACK, EF, AUDIT_ROWS, AUDIT_RECALL, np.isin(y_rep, x_rep))
        keep = np.zeros(len(a), bool)
        for k in range(0, len(a), 1 << 15):
            i, j = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
            keep[k : k + (1 << 15)] = (np.einsum("ij,ij->i", y[i], x[j]) >= cosine) & (y_rep[i] != x_rep[j])
        a, b = a[keep], b[keep]
        n = np.bincount(a, weights=weight[b], minlength=len(y)).astype(np.int64)
        yield pd.DataFrame({"u": y_rep[n > 0], "v": y_rep[n > 0], "n": n[n > 0]})
        if len(a):
            u, v = forest(y_rep[a], x_rep[b])
            yield pd.DataFrame({"u": u, "v": v, "n": np.zeros(len(u), np.int64)})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each vector."""
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), e.cast("array<double>").alias("embedding"))
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(e, lambda v: v != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    rows = rows.withColumn("usable", usable).withColumn("k1", F.when(usable, F.xxhash64("label", "embedding"))).withColumn("k2", F.when(usable, F.xxhash64("embedding", F.lit(1), "label")))
    classes = rows.where("usable").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
    classes = written(classes.withColumn("dim", F.size("embedding")), "vectors")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    sizes = sizes.select("label", "dim", F.greatest(F.lit(LEAST_SHARDS), F.ceil(F.col("n") / shard_rows)).cast("int").alias("shards"), F.ceil(F.col("n") / query_rows).cast("int").alias("blocks"))
    dealt = classes.join(sizes, ["label", "dim"])
    h = F.xxhash64("rep")
    here = ["label", "dim", "rep", "copies", "embedding"]
    members = dealt.select(*here, F.pmod(h, "shards").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("member"))
    queries = dealt.select(*here, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("rep", F.lit(2)), "blocks").cast("int").alias("block"), F.lit(False).alias("member"))
    found = written(members.unionByName(queries).groupBy("label", "dim", "shard", "block").applyInPandas(_task(cosine), "u long, v long, n long"), "vector-links")
    counts = found.where("n > 0").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    united = components(found.select("u", "v").where("u <> v"))
    of_class = classes.select("k1", "k2", "rep", "copies").join(counts, "rep", "left").join(united.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("k1", "k2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(of_class, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(node, seen) AS (
  SELECT vec_id, vec_id FROM v
  UNION SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.seen),
low AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
deg AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(deg.n, 0) AS n_links, coalesce(low.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(low.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN low ON low.node = e.vec_id LEFT JOIN deg ON deg.u = e.vec_id
"""
