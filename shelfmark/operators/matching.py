"""Matching items to reference entries: hashes with a residual, serials, fuzzy names, bands, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alnum, bigrams, dice_of_grams, worth_querying
from ..storage import written


def hash_lookup(items: DataFrame, entries: DataFrame, key: str, size: str) -> DataFrame:
    """Equal hash and (the entry's size unknown or equal); ``confirmed`` says which.

    An equi join with a residual, so Spark can shuffle or broadcast either side.
    """
    e = entries.withColumnRenamed(size, "_entry_size")  # a column of this name may be in neither side
    out = items.join(e, key).where(F.col("_entry_size").isNull() | (F.col("_entry_size") == F.col(size)))
    return out.withColumn("confirmed", F.col("_entry_size").isNotNull()).drop("_entry_size")


def cascade(items: DataFrame, key: str, layers: list[tuple[str, DataFrame]]) -> DataFrame:
    """Best layer of each item, earlier layers first.

    Layers hold (key, entry). Their hits are united with the layer's rank and the least kept: one
    shuffle by key in all, in place of an anti join a layer.
    """
    hits = None
    for rank, (name, found) in enumerate(layers):
        one = found.select(F.col(key), F.lit(rank).alias("_rank"), F.lit(name).alias("layer"), F.col("entry"))
        hits = one if hits is None else hits.union(one)
    best = hits.groupBy(key).agg(F.min(F.struct("_rank", "entry", "layer")).alias("_best"))
    return items.select(key).join(best, key, "left").select(key, F.coalesce("_best.layer", F.lit("unmatched")).alias("layer"), F.col("_best.entry").alias("entry"))


LONG_KEY = 64


def _short(key: Column) -> Column:
    """A key as joins carry it: a long one, such as a whole text, by its SHA-256 after a sign that no key holds."""
    return F.when(F.length(key) <= LONG_KEY, key).otherwise(F.concat(F.lit("#"), F.sha2(key, 256)))


def _rarest(keys: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """(key, same, gram, nth): each key's rarest bigrams, as many as leave too few others for a Dice of ``least``.

    Two keys of that Dice share at least ``least`` / (2 - ``least``) of either's bigrams, so in any
    one order of all bigrams they share one of these. Repeats of a bigram are numbered.
    """
    grams = keys.select("key", "same", F.explode(bigrams(F.col("text"))).alias("gram")).groupBy("key", "same", "gram").agg(F.count("*").alias("times"))
    lists = grams.join(counts, "gram").groupBy("key", "same").agg(F.sort_array(F.collect_list(F.struct("n", "gram", "times"))).alias("g"), F.sum("times").cast("int").alias("size"))  # as many as a name has bigrams
    needed = F.col("size") - F.ceil(F.col("size") * (least / (2 - least)) - 1e-9).cast("int") + 1
    each = F.flatten(F.transform("g", lambda x: F.transform(F.sequence(F.lit(1).cast("long"), x["times"]), lambda i: F.struct(x["gram"].alias("gram"), i.alias("nth")))))
    return lists.select("key", "same", F.explode(F.slice(each, F.lit(1), needed)).alias("g")).select("key", "same", "g.gram", "g.nth")


def _keyed(rows: DataFrame, side: str) -> DataFrame:
    """(id, key, same, pure, size, text): keys and their ASCII letters and digits, both short, and the whole key; written, as it is read several times."""
    key = F.col(f"{side}_key")
    return written(rows.select(F.col(f"{side}_id").alias("id"), _short(key).alias("key"), _short(alnum(key)).alias("same"), (alnum(key) == key).alias("pure"), (F.length(key) - 1).alias("size"), key.alias("text")), "keys")


def similar_keys(queries: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(query_key, name_key, score), both short, of distinct keys whose ASCII letters and digits are the same and whose Dice reaches ``least``.

    Equal keys meet as they are. Others need two keys with the same ASCII letters and digits, so only
    keys that have such company are looked into. Keys that hold more than ASCII letters and digits are mixed. Two mixed keys meet where one of
    their rarest bigrams and their ASCII letters are equal; a pure key meets the mixed ones whose ASCII
    letters it is; two pure keys must be equal. Each is an equi join, and no pair is missed.
    """
    company = queries.select("key", "same").union(names.select("key", "same")).distinct().groupBy("same").agg(F.count("*").alias("n")).where("n > 1").select("same")
    sides = []
    for rows in (queries, names):
        some = written(rows.join(company, "same", "left_semi").groupBy("key", "same").agg(F.first("pure").alias("pure"), F.first("size").alias("size"), F.first("text").alias("text")), "keys-in-company")
        sides.append((some.where("not pure"), some.where("pure")))
    (q_mixed, q_pure), (n_mixed, n_pure) = sides
    counts = q_mixed.union(n_mixed).select(F.explode(bigrams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    named = lambda rows, side: rows.withColumnsRenamed({c: f"{side}_{c}" for c in ("key", "size", "text")}).drop("pure")
    ratio = least / (2 - least)
    lengths = (F.col("query_size") >= F.col("name_size") * ratio - 1e-9) & (F.col("name_size") >= F.col("query_size") * ratio - 1e-9)
    differ = F.col("query_key") != F.col("name_key")
    met = named(_rarest(q_mixed, counts, least), "query").join(named(_rarest(n_mixed, counts, least), "name"), ["same", "gram", "nth"]).where(differ).select("query_key", "name_key")
    for q, n in ((q_mixed, n_pure), (q_pure, n_mixed)):
        met = met.union(named(q, "query").join(named(n, "name"), "same").where(differ).select("query_key", "name_key"))
    both = met.distinct().join(named(q_mixed.union(q_pure), "query").drop("same"), "query_key").join(named(n_mixed.union(n_pure), "name").drop("same"), "name_key").where(lengths)
    near = both.select("query_key", "name_key", dice_of_grams(bigrams(F.col("query_text")), bigrams(F.col("name_text"))).alias("score")).where(F.col("score") >= least)
    equal = queries.select(F.col("key").alias("query_key")).distinct().join(names.select(F.col("key").alias("name_key")).distinct(), F.col("query_key") == F.col("name_key"))
    return near.union(equal.withColumn("score", F.lit(1.0)))


def fuzzy_lookup(queries: DataFrame, names: DataFrame, least: float = 0.85, top: int = 3, condition: Column | None = None, gated: bool = True) -> DataFrame:
    """(query_id, name_id, score, rank): up to ``top`` name ids by Dice of character bigrams.

    ``queries`` has (query_id, query_key), ``names`` (name_id, name_key), keys as ``name_key`` makes
    them; an id may have several keys, of which the best counts. Letters and digits of ASCII must be
    the same in both keys. Keys that say too little find nothing: queries need two Han or kana
    characters or four ASCII letters, names two characters; without ``gated`` any key but an empty one is enough.

    Work is done for distinct keys: copies of a name neither meet nor are scored again, and long keys
    move by their digest. For each name key its ``top`` smallest ids are enough, as they stand before all others that have it;
    only with a ``condition`` on ids all of them are looked at.

    Cases: null and empty keys and null ids find nothing; repeated ids and keys count once; ties are in
    the order of name_id; other columns are ignored.
    """
    worth = worth_querying(F.col("query_key")) if gated else F.col("query_key") != ""
    q = _keyed(queries.where(worth & F.col("query_id").isNotNull()), "query")
    n = _keyed(names.where((F.length("name_key") >= (2 if gated else 1)) & F.col("name_id").isNotNull()), "name")
    near = similar_keys(q, n, least)
    q, n = (rows.select(F.col("id").alias(f"{side}_id"), F.col("key").alias(f"{side}_key")).distinct() for rows, side in ((q, "query"), (n, "name")))
    if condition is None:
        n = n.withColumn("_nth", F.row_number().over(Window.partitionBy("name_key").orderBy("name_id"))).where(F.col("_nth") <= top).drop("_nth")
        subject = "query_key"
        scored = near.join(n, "name_key")
    else:
        subject = "query_id"
        scored = near.join(n, "name_key").join(q, "query_key").where(condition)
    best = scored.groupBy(subject, "name_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(subject).orderBy(F.desc("score"), "name_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return (ranked if condition is not None else q.join(ranked, "query_key")).select("query_id", "name_id", "score", "rank")


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, slack: int) -> DataFrame:
    """Rows with |a - b| <= slack (integers): an equi join on bands of width ``slack``.

    Each right row is put into its band and the two beside it, so no pair is missed or doubled
    and the join shuffles by band.
    """
    width = max(1, slack)
    band = lambda c: F.floor(F.col(c) / width)
    l_ = left.withColumn("_band", band(a))
    r_ = right.withColumn("_band", F.explode(F.array(band(b) - 1, band(b), band(b) + 1)))
    return l_.join(r_, "_band").where(F.abs(F.col(a) - F.col(b)) <= slack).drop("_band")


def same_key_pairs(df: DataFrame, key: str, item: str, most: int = 8, least: int = 2) -> DataFrame:
    """(key, a, b): unordered pairs of distinct items in buckets of ``least`` to ``most`` items.

    Larger buckets are no evidence by definition, so they make no pairs; a bucket's size bounds its pairs.
    """
    one = df.select(F.col(key).alias("key"), F.col(item).alias("item")).where("key is not null and item is not null").distinct()
    sizes = one.groupBy("key").count().where(F.col("count").between(least, most)).select("key")
    kept = one.join(sizes, "key")
    a, b = kept.select("key", F.col("item").alias("a")), kept.select("key", F.col("item").alias("b"))
    return a.join(b, "key").where("a < b")


def without_dismissed(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Pairs that nobody dismissed, whichever way round."""
    both = dismissed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(both, ["a", "b"], "left_anti")


def tri_state(a: Column, b: Column, agree: Column) -> Column:
    """agree, conflict, or unknown where a side is missing."""
    return F.when(a.isNull() | b.isNull(), "unknown").when(agree, "agree").otherwise("conflict")


def tally(states: DataFrame, state: str, all_states: list[str]) -> DataFrame:
    """(state, n) for a fixed list of states, with zeros."""
    spark = states.sparkSession
    counted = states.groupBy(F.col(state).alias("state")).agg(F.count("*").alias("n"))
    fixed = spark.createDataFrame([(s,) for s in all_states], "state string")
    return F.broadcast(fixed).join(counted, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))  # a fixed list
