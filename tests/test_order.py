import random

from pyspark.sql import functions as F

from shelfmark.operators import health, order, registry, triage, upkeep
from shelfmark.storage import written


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().toString()


def groups(spark, n=3000, seed=4):
    rng = random.Random(seed)
    data = [(rng.choice(["hot", "hot", "hot", "b", None, f"g{k % 40}"]), rng.randrange(50), k, rng.choice([None, 1, 2, 5])) for k in range(n)]
    return data, spark.createDataFrame(data, "g string, x int, id int, v long").repartition(7)


def brute(data, sums=False):
    out, by = [], {}
    for g, x, i, v in sorted(data, key=lambda r: (str(r[0]), -r[1], r[2])):
        at, total = by.get(g, (0, 0))
        by[g] = at + 1, total + (v or 0)
        out.append((i, total + (v or 0)) if sums else (i, at))
    return sorted(out, key=str)


def test_places_and_sums(spark):
    data, df = groups(spark)
    by = [F.desc("x"), F.asc("id")]
    got = order.numbered(df, ["g"], by)
    assert rows(got.select("id", "place")) == brute(data)
    assert "SinglePartition" not in plan(got)
    assert rows(order.running(df, ["g"], by, "v").select("id", "sum")) == brute(data, True)
    one = [("x", *r[1:]) for r in data]
    assert rows(order.numbered(df, [], by).select("id", "place")) == brute(one)
    assert rows(order.running(df, [], by, "v", "s", "p").select("id", "s")) == brute(one, True)
    assert order.numbered(df.limit(0), ["g"], by).count() == 0 == order.running(df.limit(0), [], by, "v").count()


def test_clashing_columns_pass_through(spark):
    df = spark.createDataFrame([(k, 10 - k, "a") for k in range(5)], "place int, sum int, n string")
    assert rows(order.numbered(df, ["n"], [F.asc("sum")], "at").select("place", "at")) == [(k, 4 - k) for k in range(5)]


def test_a_group_of_all_rows_spreads(spark):
    """One folder of very many names: no task holds over twice the median, and no plan brings it into one."""
    n = 200_000
    names = spark.range(n).select(F.lit("folder").alias("folder"), F.format_string("name %07d", F.pmod(F.col("id") * 7919, F.lit(n))).alias("name"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        dealt = order._dealt(names, ["folder"], [F.asc("name")])
        sizes = sorted(r["count"] for r in dealt.groupBy("_part").count().collect())
        assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
        got = order.around(names, "folder", "name", 4)
        assert "SinglePartition" not in plan(got) and "Window" not in plan(got)
        some = written(got, "around")
        assert some.count() == 4 * n - 3
        by = {r.name: r.of for r in some.where("name in ('name 0000000', 'name 0000001', 'name 0100000', 'name 0199999')").groupBy("name").agg(F.sort_array(F.collect_list("neighbour")).alias("of")).collect()}
        at = lambda *k: [f"name {x:07d}" for x in k]
        assert by == {"name 0000000": at(1, 2, 3, 4), "name 0000001": at(0, 2, 3, 4), "name 0100000": at(99998, 99999, 100001, 100002), "name 0199999": at(199997, 199998)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_neighbours_in_order(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", "c", None]), rng.choice([f"n{k}", None]) if rng.random() < 0.1 else f"n{k % 90}") for k in range(300)] + [("alone", "x")]
    df = spark.createDataFrame(data, "folder string, name string")
    for k in (1, 2, 5, 40):
        want = []
        for f in {f for f, _ in data if f}:
            names = sorted({n for g, n in data if g == f and n})
            for at, n in enumerate(names):
                first = max(0, at - k // 2)
                want += [(f, n, x, s) for s, x in [(s, x) for s, x in enumerate(names) if s >= first and s != at][:k]]
        assert rows(order.around(df, "folder", "name", k)) == sorted(want, key=str)
        of = df.where("name = 'n7'")
        assert rows(order.around(df, "folder", "name", k, of)) == sorted((w for w in want if w[1] == "n7"), key=str)


def test_rankings_that_had_one_task(spark):
    df = spark.createDataFrame([(k, (k * 37) % 101) for k in range(1, 200)], "id int, n long")
    covered = health.running_share(df, "n", [F.desc("n"), F.asc("id")])
    assert plan(covered).count("SinglePartition") <= 2 * plan(covered).count("HashAggregate(keys=[], functions=[partial_sum")  # the total's only: a row from each task
    data = sorted(((r.n, -r.id) for r in df.collect()), reverse=True)
    total = sum(n for n, _ in data)
    want, so_far = [], 0
    for place, (n, i) in enumerate(data, 1):
        so_far += n
        want.append((-i, n, so_far, place, round(so_far / total, 6)))
    assert rows(covered.select("id", "n", "covered", "place", "share")) == sorted(want, key=str)
    kept = upkeep.within_budget(df, [F.asc("n"), F.asc("id")], "n", 500)
    assert "SinglePartition" not in plan(kept) and kept.agg(F.max("spent")).first()[0] <= 500
    sample = triage.spread_sample(df.withColumn("g", F.lit("one")), ["g"], [F.asc("id")], 10)
    assert "SinglePartition" not in plan(sample) and sample.count() == 10


# first match of patterns ---------------------------------------------------------------------------


def glob(pattern, text):
    def at(p, t):
        if not p:
            return not t
        if p[0] == "*":
            return any(at(p[1:], t[k:]) for k in range(len(t) + 1))
        if not t:
            return False
        ok = t[0].isascii() and t[0].isdigit() if p[0] == "#" else t[0].isascii() and t[0].isalpha() if p[0] == "@" else p[0] == t[0]
        return ok and at(p[1:], t[1:])

    return at(pattern.lower(), text.lower())


def test_first_match_against_all_patterns(spark):
    rng = random.Random(9)
    piece = lambda: rng.choice(["Sony", "so", "N", "n.t", "(x)", "PS#", "@", "*", "1", "2 ", "a+b", "[c]", "é"])
    maps = [(rng.choice("st"), k, "".join(piece() for _ in range(rng.randrange(1, 4))), rng.choice([None, "P", "Q"]), rng.choice([None, "c"]), f"why {k}") for k in range(60)]
    maps = [m for m in maps if m[2].count("*") <= 4] + [("s", 99, "", "P", None, "empty"), ("s", 98, None, "P", None, "null"), (None, 97, "*", "P", None, "no source")]
    names = [(rng.choice("stu"), "".join(rng.choice(["sony", "SO", "n", "N.T", "(x)", "ps7", "k", "1", "2 ", "A+B", "[c]", "É"]) for _ in range(rng.randrange(0, 5)))) for _ in range(400)] + [(None, "so"), ("s", None)]
    m = spark.createDataFrame(maps, "source string, place int, pattern string, platform string, convention string, note string")
    n = spark.createDataFrame(names, "source string, name string")
    want = []
    for s, name in {x for x in names if None not in x}:
        hit = min((r for r in maps if r[0] == s and r[2] and glob(r[2], name)), key=lambda r: r[1], default=None)
        want.append((s, name, "unmapped" if hit is None else "excluded" if hit[3] is None else "mapped", hit[3] if hit and hit[3] else None, hit[4] if hit and hit[3] else None, hit[5] if hit and not hit[3] else None))
    got = registry.first_match(n, m)
    assert rows(got) == sorted(want, key=str) and len({w[2] for w in want}) == 3
    assert "CartesianProduct" not in plan(got) and "NestedLoop" not in plan(got)
    assert registry.first_match(n, m.limit(0)).where("state <> 'unmapped'").count() == 0
    assert rows(registry.unknown_platforms(m, spark.createDataFrame([("P",)], "platform string"))) == [("Q",)]


def test_fetch_plan(spark):
    maps = spark.createDataFrame([("s", 1, "Nin* (old)", None, None, "no longer made"), ("s", 2, "nin*", "GB", "own", ""), ("s", 3, "sony", "PS", None, "")], "source string, place int, pattern string, platform string, convention string, note string")
    offers = [("s", "Nintendo", "http://a/1", "f1"), ("s", "Nin GB", "http://a/2", "f2"), ("s", "Nin (old)", "http://a/3", "f3"), ("s", "Sony", "http://bad/4", "f4"), ("s", "SONY", "http://a/5", None), ("s", "other", "http://a/6", "f6"), ("z", "bundle.zip", "http://a/7", "f7"), ("z", None, "http://a/8", None), ("u", "Nintendo", "http://a/9", "f9")]
    available = spark.createDataFrame(offers, "source string, name string, url string, fingerprint string")
    known = spark.createDataFrame([("s", "Nintendo", "f1"), ("s", "Nin GB", "old"), ("s", "SONY", None), ("s", "Nin (old)", "f3"), ("z", "bundle.zip", "f7"), ("z", "bundle.zip", "f7")], "source string, name string, fingerprint string")
    sources = spark.createDataFrame([("s", False, "as is"), ("z", True, "none")], "source string, bundle boolean, convention string")
    bad = F.col("url").startswith("http://bad/")
    act = lambda **k: {(r.source, r.name): (r.action, r.platform, r.convention, r.note) for r in registry.fetch_plan(available, known, sources, maps, bad, **k).collect()}
    assert act() == {
        ("s", "Nintendo"): ("up to date", "GB", "own", None), ("s", "Nin GB"): ("fetch", "GB", "own", None), ("s", "Nin (old)"): ("excluded", None, None, "no longer made"), ("s", "Sony"): ("refused", "PS", "as is", None),
        ("s", "SONY"): ("fetch", "PS", "as is", None), ("s", "other"): ("unmapped", None, None, None), ("z", "bundle.zip"): ("up to date", None, None, None), ("z", None): ("fetch", None, None, None), ("u", "Nintendo"): ("unmapped", None, None, None),
    }
    full = act(full=True)
    assert full["s", "Nintendo"][0] == full["z", "bundle.zip"][0] == "fetch"


def test_neighbours_across_blocks(spark, monkeypatch):
    """Blocks of few seats, none of them a folder's whole; no join by seat, for which every name would move once a neighbour."""
    import re

    monkeypatch.setattr(order, "BLOCK_SEATS", 4, raising=False)
    names = {"a": [f"n{k:03}" for k in range(50)], "b": ["x"], "c": ["p", "q", "r"]}
    df = spark.createDataFrame([(f, n) for f, some in names.items() for n in some], "folder string, name string")
    for k in (1, 4, 6):
        got = order.around(df, "folder", "name", k)
        assert not re.search(r"Join.*seat", got._jdf.queryExecution().executedPlan().toString())
        want = set()
        for f, some in names.items():
            for at, n in enumerate(some):
                first = max(0, at - k // 2)
                seats = [i for i in range(first, len(some)) if i != at][:k]
                want |= {(f, n, some[i], i) for i in seats}
        assert {tuple(r) for r in got.collect()} == want
