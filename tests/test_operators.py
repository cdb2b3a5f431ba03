"""Operators on small tables of hard cases: missing values, ties, repeats, empty tables."""

import itertools
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import browse, converge, health, ledger, matching, priority, shape, sync, triage
from shelfmark.operators.rules import All, AnyOf, Clause, NoneOf, compile_rule, filter_by, rule_hits, select_rows, thin_clauses


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    return [r[0] for r in df.select(make(F.col("c"))).collect()]


# rules against a plain evaluator -----------------------------------------------------------------

FACTS = [(1, "Alpha", 1990, ["x", "Y"]), (2, None, None, []), (3, "ÀLPHA", 2001, None), (4, "alp%", 1989, ["z"]), (5, "", 1990, ["x", None])]


def holds(rule, fact):
    if isinstance(rule, Clause):
        value = fact[rule.column]
        low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s) if isinstance(s, str) else s
        op = "=" if rule.op == "!=" else rule.op
        tests = {"=": lambda a, b: a == b, "~": lambda a, b: b in a, "^": lambda a, b: a.startswith(b), "$": lambda a, b: a.endswith(b), "<=": lambda a, b: a <= b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b}
        have = value if isinstance(value, list) else [value]
        hit = any(v is not None and tests[op](low(v), low(w)) for v in have for w in rule.values) if value is not None else False
        return not hit if rule.op == "!=" else hit
    parts = [holds(x, fact) for x in rule]
    return all(parts) if isinstance(rule, All) else any(parts) if isinstance(rule, AnyOf) else not any(parts)


clause = st.one_of(
    st.builds(lambda o, v: Clause("name", o, v), st.sampled_from(["=", "!=", "~", "^", "$"]), st.sampled_from(["alpha", "ALP", "a", "%", "Àlpha", ""])),
    st.builds(lambda o, v: Clause("year", o, v), st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), st.sampled_from([1989, 1990, 2001])),
    st.builds(lambda o, v: Clause("tags", o, *v), st.sampled_from(["=", "!="]), st.lists(st.sampled_from(["x", "y", "q"]), min_size=1, max_size=2)),
)
rule = st.recursive(clause, lambda r: st.builds(lambda k, xs: k(*xs), st.sampled_from([All, AnyOf, NoneOf]), st.lists(r, max_size=3)), max_leaves=6)


def test_rules_equal_a_plain_evaluator(spark):
    df = spark.createDataFrame(FACTS, "id int, name string, year int, tags array<string>")
    columns, multi = {c: F.col(c) for c in df.columns}, {"tags"}
    seen = []

    @given(rule)
    @settings(max_examples=60, deadline=None)
    def collect(r):
        seen.append(r)

    collect()
    got = df.select(*[compile_rule(r, columns, multi).alias(f"r{k}") for k, r in enumerate(seen)]).collect()
    for fact, row in zip(FACTS, got, strict=True):
        named = dict(zip(["id", "name", "year", "tags"], fact, strict=True))
        assert [row[f"r{k}"] for k in range(len(seen))] == [holds(r, named) for r in seen]


def test_rule_tools(spark):
    df = spark.createDataFrame(FACTS, "id int, name string, year int, tags array<string>")
    assert rows(filter_by(df, NoneOf(Clause("year", ">=", 1990))).select("id")) == [(2,), (4,)]
    told = spark.createDataFrame([(1, False), (2, True), (99, True)], "key int, included boolean")
    assert rows(select_rows(df, "id", [Clause("year", "=", 1990)], told).select("id")) == [(2,), (5,)]
    assert rows(select_rows(df, "id", [], told).select("id")) == [(2,)]
    assert rows(rule_hits(df, {"a": Clause("year", "=", 1990), "b": Clause("name", "^", "a")}, "year")) == [("a", 2, 1, 3980), ("b", 2, 1, 3979)]
    assert rows(thin_clauses(df, All(Clause("year", "=", 1), Clause("tags", "=", "x")), {"tags"})) == [("tags", 2), ("year", 1)]
    for bad in (("x", "??", 1), ("x", "=",), ("x", "<", 1, 2)):
        with pytest.raises(ValueError):
            Clause(*bad)


# text --------------------------------------------------------------------------------------------


def test_paths(spark):
    keys = ["r/p/d/a.tar.GZ", "r/p", "x", "", "r/.hidden", "r/BIOS/f.bin", "r/p/bios", None]
    df = spark.createDataFrame([(k,) for k in keys], "c string")
    got = df.select(T.root_of(F.col("c")), T.rest_of(F.col("c")), T.base_name(F.col("c")), T.dir_of(F.col("c")), T.stem(F.col("c")), T.extension(F.col("c")), T.platform_dir(F.col("c")), T.in_directory(F.col("c"), "bios"), T.ancestors(F.col("c"))).collect()
    assert tuple(got[0]) == ("r", "p/d/a.tar.GZ", "a.tar.GZ", "r/p/d", "a.tar", "gz", "r/p", False, ["r", "r/p", "r/p/d"])
    assert tuple(got[2]) == ("x", "", "x", "", "x", None, None, False, [])
    assert (got[4][4], got[4][5]) == (".hidden", None) and got[5][7] is True and got[6][7] is False and got[7][0] is None


def test_titles_and_readings(spark):
    assert column(spark, ["ＡＢ－ｃ 1", "é", "é", "日本 x", None], T.name_key) == ["abc1", "é", "é", "日本x", None]
    assert column(spark, ["é", "abc", None], T.nfc) == [unicodedata.normalize("NFC", "é"), "abc", None]
    assert column(spark, ["À B", None], T.ascii_lower) == ["À b", None]
    names = ["f10", "f9", "f09a", "f1", "F2", "f", "f100"]
    assert [n for _, n in sorted(zip(column(spark, names, T.natural_key), names, strict=True))] == ["F2", "f", "f1", "f9", "f09a", "f10", "f100"]
    assert column(spark, ["1994", "199X", "94", None], T.read_year) == [1994, None, None, None]
    assert column(spark, ["0.5", "80%", "7", "-1", "x", "1"], T.read_rating) == [0.5, 0.8, None, None, None, 1.0]
    assert column(spark, ["64MiB", "2 GB", "10", "1.5K", "MiB", "3 XB"], T.read_size) == [64 << 20, 2_000_000_000, 10, 1500, None, None]
    assert column(spark, ["1-4", "2", "4-1", "a"], T.read_players) == [(1, 4), (2, 2), None, None]
    assert column(spark, ["1994", "1994-05", "19940517T000000", "1994-13", "94"], T.read_partial_date) == [(1994, None, None), (1994, 5, None), (1994, 5, 17), None, None]
    assert column(spark, ["SLUS-00001", "12-34", "a1", "ab 12"], T.serial_key) == ["SLUS00001", None, None, "AB12"]
    assert column(spark, ["Name (1991)(Maker)[a]", "Name (19xx)(-)", "Name [1991]"], T.tag_year) == [1991, None, None]
    assert column(spark, ["Name (1991)(Maker)[a]", "Name (1991)"], T.tag_publisher) == ["Maker", None]
    assert column(spark, ["N (Japan, USA) (Rev 1)", "N (Rev 1)"], lambda c: T.region(c, ["Japan", "USA"])) == ["Japan, USA", None]
    assert column(spark, ["Game (Disc 1)", "Game [cd2]", "Game", "Discworld"], T.disc_family) == ["Game", "Game", "Game", "Discworld"]
    assert column(spark, ["𝄞a", "é"], T.utf16_units) == [3, 1]


@given(st.lists(st.tuples(st.text("abAB ", max_size=8), st.text("abAB ", max_size=8)), min_size=1, max_size=25))
@settings(max_examples=15, deadline=None)
def test_dice(spark, pairs):
    def grams(s):
        return [s] if len(s) == 1 else [s[k : k + 2] for k in range(len(s) - 1)]

    def brute(a, b):
        x, y = grams(a), grams(b)
        both = sum(min(x.count(g), y.count(g)) for g in set(x))
        return 1.0 if a == b else 2 * both / (len(x) + len(y)) if x or y else 0.0

    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(T.dice(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([brute(a, b) for a, b in pairs])


# joins -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("slack", [0, 1, 7])
def test_band_join(spark, slack):
    rng = random.Random(slack)
    a, b = [rng.randrange(-60, 60) for _ in range(80)] + [None], [rng.randrange(-60, 60) for _ in range(80)] + [None]
    left, right = spark.createDataFrame(list(enumerate(a)), "i int, x int"), spark.createDataFrame(list(enumerate(b)), "j int, y int")
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x is not None and y is not None and abs(x - y) <= slack)
    assert sorted((r.i, r.j) for r in matching.band_join(left, right, "x", "y", slack).collect()) == want


def brute_fuzzy(queries, names, top, least=0.85):
    grams = lambda s: [s[k : k + 2] for k in range(len(s) - 1)] or [s]
    plain = lambda s: "".join(c for c in s if c.isascii() and c.isalnum())
    score = lambda a, b: 1.0 if a == b else 2 * sum(min(grams(a).count(g), grams(b).count(g)) for g in set(grams(a))) / (len(grams(a)) + len(grams(b)))
    worth = lambda k: sum("\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" for c in k) >= 2 or sum(c.isascii() and c.isalpha() for c in k) >= 4
    want = []
    for i, q in sorted({(i, q) for i, q in queries if i is not None and q and worth(q)}):
        best = {}
        for j, n in names:
            if j is not None and n and len(n) > 1 and plain(q) == plain(n) and (x := score(q, n)) >= least:
                best[j] = max(x, best.get(j, 0))
        want += [(i, j, x, k + 1) for k, (j, x) in enumerate(sorted(best.items(), key=lambda e: (-e[1], e[0]))[:top])]
    return sorted(want, key=str)


def test_fuzzy_lookup_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abc日本語") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    keys = list(dict.fromkeys(base + [k[:-1] for k in base if len(k) > 6] + ["", "aa", "aaaa", "1", "日"]))
    queries = [(f"q{k % 50}", x) for k, x in enumerate(keys)] + [(None, keys[1]), ("q1", None)]
    names = [(f"n{k % 70}", x) for k, x in enumerate(keys)] + [(f"n{k % 9}", x) for k, x in enumerate(keys[:30])] + [(None, keys[1])]
    q, n = spark.createDataFrame(queries, "query_id string, query_key string"), spark.createDataFrame(names, "name_id string, name_key string")
    for top in (1, 3, 100):
        assert rows(matching.fuzzy_lookup(q, n, top=top)) == brute_fuzzy(queries, names, top)
    some = matching.fuzzy_lookup(q, n, top=100, condition=F.col("name_id") != "n3")
    assert {tuple(r)[:3] for r in some.collect()} == {x[:3] for x in brute_fuzzy(queries, names, 100) if x[1] != "n3"}
    assert matching.fuzzy_lookup(q.limit(0), n).count() == 0 == matching.fuzzy_lookup(q, n.limit(0)).count()


def test_fuzzy_lookup_of_pure_and_mixed_keys(spark):
    """A key of ASCII letters finds mixed ones and the other way round; an id with several names has one place."""
    queries = [("a", "abcdefghijklmnop"), ("b", "abcdefghijklmnopé"), ("c", "nintendogamesx")]
    names = [("m", "abcdefghijklmnopé"), ("p", "abcdefghijklmnop"), ("z", "abcdefghijklmnopqr"), ("n1", "nintendogamesx"), ("n1", "nintendogamesxé"), ("n2", "nintendogamesxé")]
    q, n = spark.createDataFrame(queries, "query_id string, query_key string"), spark.createDataFrame(names, "name_id string, name_key string")
    got = rows(matching.fuzzy_lookup(q, n, top=2))
    assert got == brute_fuzzy(queries, names, 2)
    assert [(r[0], r[1]) for r in got] == [("a", "m"), ("a", "p"), ("b", "m"), ("b", "p"), ("c", "n1"), ("c", "n2")]


def test_fuzzy_lookup_of_very_common_grams(spark):
    """Many names that share nearly all their bigrams, and very many copies of one: every pair that reaches the score is found."""
    rng, letters = random.Random(2), "日本語文äëï"
    keys = sorted({"".join(rng.choice(letters[:3]) for _ in range(rng.randrange(2, 14))) + rng.choice(["", "1", "x", "ä"]) for _ in range(150)})
    names = [(k, k) for k in keys] + [(f"copy{k}", keys[7]) for k in range(500)]
    q, n = spark.createDataFrame([(k, k) for k in keys], "query_id string, query_key string"), spark.createDataFrame(names, "name_id string, name_key string")
    got = matching.fuzzy_lookup(q, n, top=1000)
    want = brute_fuzzy([(k, k) for k in keys], names, 1000)
    assert {tuple(r)[:2] for r in got.collect()} == {w[:2] for w in want} and len(want) > len(keys)


def test_values_of_unknown_time_and_order(spark):
    v = spark.createDataFrame([("k", "a", "old", None), ("k", "a", "new", 5), ("k", "b", "other", 9), ("m", "a", "only", None)], "k string, source string, value string, at long")
    rank = priority.source_rank(F.col("source"), ["a", "b"])
    assert rows(priority.pick(v, ["k"], rank).select("k", "value")) == [("k", "new"), ("m", "only")]
    assert rows(priority.shifts(v, ["k"], rank, priority.source_rank(F.col("source"), ["b"]))) == [("k", "new", "other")]
    assert rows(priority.least_by(v, ["k"], [F.col("at")], ["value"])) == [("k", "new"), ("m", "only")]
    assert rows(priority.others_in_order(v, ["k"], [F.col("at")], "value")) == [("k", "other|old")]


def test_marks_and_filters(spark):
    names = {"Dark (1999)(SNK)(en-ja)[tr zh]": "fan", "G [tr zh-Hans group]": "fan", "G [T+ChiNew_J]": "fan", "G [tr ru x]": None, "G [fantastic]": None, "G (En,Zh-Hans)": "official", "G (Zhu Zhu Pets)": None, "G (China)": None, "G [tr zh](Ja,Zh)": "fan", "G (zh)": "official", "G": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.m for r in df.select("n", T.mark_of(F.col("n")).alias("m")).collect()} == names
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    few = filter_by(part, All(Clause("p_size", "<=", 5), AnyOf(Clause("p_brand", "=", "brand#1"), Clause("p_size", "=", 3))))
    plan = few._jdf.queryExecution().toString()
    assert "LessThanOrEqual(p_size,5)" in plan
    assert sorted(r.p_partkey for r in few.collect()) == sorted(r.p_partkey for r in part.where("p_size <= 5 and (lower(p_brand) = 'brand#1' or p_size = 3)").collect())


def test_lookups_and_pairs(spark):
    items = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "b", 5), (4, None, 5)], "id int, h string, size int")
    entries = spark.createDataFrame([("a", 5, "e1"), ("a", None, "e2"), ("a", 6, "e3"), (None, 5, "e4")], "h string, size int, entry string")
    assert rows(matching.hash_lookup(items, entries, "h", "size").select("id", "entry", "confirmed")) == sorted([(1, "e1", True), (1, "e2", False), (2, "e2", False)], key=str)
    layers = [("one", spark.createDataFrame([(3, "x")], "id int, entry string")), ("two", spark.createDataFrame([(3, "a"), (1, "z"), (1, "y")], "id int, entry string"))]
    assert rows(matching.cascade(items, "id", layers)) == sorted([(1, "two", "y"), (2, "unmatched", None), (3, "one", "x"), (4, "unmatched", None)], key=str)
    df = spark.createDataFrame([("k", 1), ("k", 2), ("k", 2), ("s", 3), (None, 4), (None, 5), *[("big", n) for n in range(9)]], "key string, item int")
    pairs = matching.same_key_pairs(df, "key", "item")
    assert rows(pairs) == [("k", 1, 2)]
    assert len(rows(matching.same_key_pairs(df, "key", "item", most=9))) == 37
    assert rows(matching.without_dismissed(pairs, spark.createDataFrame([(2, 1)], "a int, b int"))) == []


# values, shapes, differences, ledgers --------------------------------------------------------------


def test_priorities(spark):
    values = spark.createDataFrame([("s", "a", "1", 5), ("s", "b", "2", 9), ("s", "b", "3", 9), ("s", None, "4", 99), ("t", "c", None, 1)], "subject string, source string, value string, at long")
    rank = priority.source_rank(F.col("source"), ["b", "a"])
    assert rows(priority.pick(values, ["subject"], rank)) == [("s", "b", "2", 9), ("t", "c", None, 1)]
    assert rows(priority.pick_all(values, ["subject"], rank)) == sorted([("s", "b", "2"), ("s", "b", "3"), ("t", "c", None)], key=str)
    assert rows(priority.shifts(values, ["subject"], rank, priority.source_rank(F.col("source"), ["a"]))) == [("s", "2", "1")]
    assert rows(priority.pick(values.limit(0), ["subject"], rank)) == []


def test_shapes(spark):
    files = spark.createDataFrame([("r/a.part01.rar",), ("r/a.part3.rar",), ("r/b.r00",), ("r/b.r01",), ("r/c.bin",), ("t/g/anchor",), ("t/g/x/y",), ("t/z",)], "key string").withColumn("size", F.lit(2))
    assert rows(shape.volumes(files, "key")) == sorted([("r", "a", 2, False), ("r", "b", 2, True)], key=str)
    assert rows(shape.tree_roots(files, "key", F.col("key").endswith("anchor"))) == [("t/g/anchor", "t/g"), ("t/g/x/y", "t/g")]
    discs = spark.createDataFrame([("p", "G (Disc 10)"), ("p", "G (Disc 2)"), ("p", "H"), ("q", "G")], "p string, n string")
    assert rows(shape.disc_families(discs, ["p"], "n")) == [("p", "G", 2, "G (Disc 2)|G (Disc 10)")]
    assert rows(shape.same_stem(files.limit(0), "key", "size")) == []


def test_three_way_every_combination(spark):
    d, m, a, want = [], [], [], {}
    for k, (has_d, has_m, has_a, newer, touched, unknown) in enumerate(itertools.product([0, 1], repeat=6)):
        if has_d:
            d.append((k, 2 if newer else 1))
        if has_m:
            m.append((k, 1, 10, None if unknown else 5))
        if has_a:
            a.append((k, 11 if touched else 10, 5))
        same = not touched and not unknown
        if has_d:
            want[k] = ("foreign" if has_a else "add") if not has_m else "gone" if not has_a else "changed" if not same else "update" if newer else "keep"
        elif has_m:
            want[k] = "forget" if not has_a else "delete" if same else "changed"
    got = sync.three_way(spark.createDataFrame(d, "path int, version int"), spark.createDataFrame(m, "path int, version int, size int, mtime int"), spark.createDataFrame(a, "path int, size int, mtime int"))
    assert dict(rows(got)) == want


def test_differences(spark):
    old = spark.createDataFrame([(1, 5, None), (2, 5, "x"), (3, None, "x")], "k int, a int, b string")
    new = spark.createDataFrame([(1, 5, None, True), (2, None, "x", True), (4, 1, "y", True), (3, 1, "x", False)], "k int, a int, b string, ok boolean")
    assert rows(sync.row_diff(old, new, "k", ["a", "b"], "ok")) == [(1, "unchanged"), (2, "changed"), (3, "unreadable"), (4, "added")]
    assert rows(sync.row_diff(old, new.limit(0), "k", ["a"])) == [(1, "removed"), (2, "removed"), (3, "removed")]
    names = ["ok.bin", "a<b", "con.txt", "LPT1", "end.", "x" * 256, "𝄞" * 128]
    got = column(spark, ["d/" + n for n in names], lambda c: sync.screen(c, F.lit(1), 5))
    assert got == [None, "forbidden character", "reserved name", "reserved name", "trailing dot or blank", "name too long", "name too long"]


def test_ledgers(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, "y"), ("b", 1, 1, "z"), (None, 1, 1, "n")], "k string, batch int, at int, v string")
    assert rows(ledger.latest(log, ["k"], ["at"]).select("k", "v")) == sorted([("a", "y"), ("b", "z"), (None, "n")], key=str)
    assert rows(ledger.latest(ledger.undone(log, spark.createDataFrame([(2,)], "batch int")), ["k"], ["at"]).select("k", "v")) == sorted([("a", "x"), ("b", "z"), (None, "n")], key=str)
    entries = spark.createDataFrame([("r/a", 1), ("r/b", 2), ("rr/c", 1)], "key string, seen int")
    assert rows(ledger.swept(entries, 2, "r", True).select("key")) == [("r/b",), ("rr/c",)]
    assert rows(ledger.swept(entries, 2, "r", False).select("key")) == [("r/a",), ("r/b",), ("rr/c",)]
    assert ledger.next_scan(entries).first()[0] == 3 and ledger.next_scan(entries.limit(0)).first()[0] == 1
    path = str(tmp_path / "log")
    ledger.compact(log.where("k is not null"), ["k"], ["at"], path, "k")
    ledger.compact(spark.createDataFrame([("b", 9, 9, "new")], log.schema), ["k"], ["at"], path, "k")
    assert rows(spark.read.parquet(path).select("k", "v")) == [("a", "y"), ("b", "new")]


def test_queues_and_entries(spark):
    items = spark.createDataFrame([("s", "abc 1"), ("s", "abc 2"), ("t", "x"), ("t", "y"), ("u", "same"), ("u", "same")], "g string, e string")
    assert rows(triage.batches(items, ["g"], "e")) == [("s", 2, "abc "), ("t", 2, ""), ("u", 2, "same")]
    many = spark.range(10).select(F.lit("g").alias("g"), "id")
    drawn = lambda n, seed: [r.id for r in triage.spread_sample(many, ["g"], [F.asc("id")], n, seed).orderBy("id").collect()]
    assert drawn(4, 0) == [0, 1, 4, 7] and drawn(4, 1) == [1, 2, 5, 8] and drawn(4, 10) == drawn(4, 0)  # a stride of 7
    assert drawn(40, 3) == list(range(10))
    e = converge.entries(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, k int"), [F.col("g")], converge.preference([F.col("k") == 2]), "k")
    assert rows(e) == [("a", "2", 2, "2|1"), ("b", "3", 1, "3")]


def test_browse_and_health(spark):
    df = spark.createDataFrame([(1, "b, a,a"), (2, ""), (3, None)], "id int, l string")
    assert rows(browse.list_facet(df, "f", F.col("l"))) == [("f", "a", 1), ("f", "b", 1)]
    hits = browse.search(spark.createDataFrame([(1, "Best of"), (2, "The best"), (3, "none"), (4, None)], "key int, text string"), "BEST", spark.createDataFrame([(3, "the Best"), (2, "best")], "key int, text string"), spark.createDataFrame([(4, "is best")], "key int, text string"))
    assert rows(hits) == [(1, 0), (2, 1), (3, 3), (4, 4)]
    files = spark.createDataFrame([(5, "A"), (5, "a"), (0, "z"), (0, "z"), (None, "q"), (5, "b")], "size long, name string")
    assert rows(health.duplicates(files, "size", F.col("name"))) == [(5, "a", 2, 5)]
    top = health.top_per_group(spark.createDataFrame([("g", 1), ("g", 3), ("g", 2)], "g string, v int"), ["g"], [F.desc("v")], 2)
    assert rows(top) == [("g", 2, 2), ("g", 3, 1)]


def test_streams(spark, tmp_path):
    """The same functions on a stream, a file a batch."""
    from shelfmark.streaming import windows

    source = tmp_path / "in"
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:20:00"), (1, "2024-01-01 05:00:00")], "u int, t string").select("u", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("u int, ts timestamp").parquet(str(source))
    out = windows.windowed(stream, "ts", "1 hour", None, "10 minutes", ["u"], {"n": F.count("*")})
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.u, r.n) for r in spark.table("w").collect()) == [(1, 1), (1, 2), (2, 1)]
    q = windows.append_log(windows.first_seen(stream, "ts", "10 minutes", ["u"]), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert sorted(r.u for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
