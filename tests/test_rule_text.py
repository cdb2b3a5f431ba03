import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.operators import rule_text as X
from shelfmark.operators.rules import All, AnyOf, Clause, NoneOf, filter_by

A, B, C = Clause("platform", "=", "GB"), Clause("work", "^", "x"), Clause("year", ">=", 1990)


def test_trees():
    a, b, c = "平台=GB", "作品^x", "年份>=1990"
    for text, want in {
        a: A,
        f" ( {a} ) ": A,
        f"{a} 且 {b}": All(A, B),
        f"{a}\t或\n{b}": AnyOf(A, B),
        f"{a} 且 ({b} 或 {c})": All(A, AnyOf(B, C)),
        f"(({a} 且 {b}))": All(A, B),
        f"都不({a})": NoneOf(A),
        f"都不 ({a} 或 {b})": NoneOf(A, B),
        f"都不(({a} 或 {b}))": NoneOf(A, B),
        f"都不({a} 且 {b})": NoneOf(All(A, B)),
        f"都不(都不({a}))": NoneOf(NoneOf(A)),
        f"{a} 或 都不(({a} 且 (({b})))) 或 {c}": AnyOf(A, NoneOf(All(A, B)), C),
        f"{a} 且  且 {b}": All(A, B),
    }.items():
        assert X.parse(text) == want, text
        assert X.parse(X.render(X.parse(text))) == want


def test_values():
    one = lambda t: X.parse(t).values
    assert one("平台= GB , ,GBA ") == ("GB", "GBA")
    assert one("作品~一将功成万骨枯且或 (J") == ("一将功成万骨枯且或 (J",)
    assert X.parse("(作品~魂斗罗 (J) 且 平台=GB)") == All(Clause("work", "~", "魂斗罗 (J)"), A)
    assert X.parse("作品~笑) 且 平台=GB") == All(Clause("work", "~", "笑)"), A)
    assert one("体积<=64MiB") == (64 << 20,) and one("体积<1.5 gb") == (1_500_000_000,) and one("体积=7") == (7,)
    assert one("评分>=80%") == (0.8,) and one("评分>0.85") == (0.85,) and one("年份!=1996") == (1996,)
    assert X.render(X.parse("体积 <=  64MiB")) == "体积<=64MiB"
    assert X.parse("作品=a<=b") == Clause("work", "=", "a<=b") and X.parse("作品!=a") == Clause("work", "!=", "a")


@pytest.mark.parametrize(("text", "kind", "at"), [("", "empty", 0), ("()", "empty", 0), ("平台=GB 且 (  )", "empty", 8), ("颜色=红", "unknown label", 0), ("平台=GB 且 颜色=红", "unknown label", 8), ("平台", "no operator", 0), ("平台>GB", "operator doesn't suit", 2), ("年份~19", "operator doesn't suit", 2), ("平台= ,", "no value", 3), ("年份=1990,2000", "several values", 3), ("年份>=199", "not a number", 4), ("评分>2", "not a number", 3), ("体积<5G", "not a number", 3), ("平台=a 且 作品=b 或 作品=c", "mixed joiners", 12), ("(平台=a", "parentheses", 0), ("都不平台=a", "nothing to deny", 0), ("(平台=a) 作品=b", "no joiner", 7), ("(作品~x(日 且 平台=GB)", "parentheses", 0)])
def test_errors(text, kind, at):
    with pytest.raises(X.RuleError) as e:
        X.parse(text)
    assert (e.value.kind, e.value.at) == (kind, at)


def test_built_clauses_read_back_anywhere():
    for bad in ("RPG 且 平台=GB", "RPG 且", "a 或 b", "x (J", "x)", "a) (b"):
        with pytest.raises(X.RuleError):
            X.built("作品", "~", bad)
    for good in ("且 RPG", "且", "生存或毁灭", "Pocket (Japan)", "a,b"):
        c = X.built("作品", "~", good)
        for tree in (c, All(c, A), AnyOf(A, c), NoneOf(c), All(AnyOf(c, A), NoneOf(All(A, c)))):
            assert X.parse(X.render(tree)) == tree


_clause = st.sampled_from([A, B, C, Clause("work", "~", "魂斗罗 (J)"), Clause("languages", "!=", "En", "Zh"), Clause("rating", "<", 0.5), Clause("work", "=", "或")])


def _groups(inner):
    some = st.lists(inner, min_size=2, max_size=3)
    none = st.one_of(some.map(lambda x: NoneOf(*x)), inner.filter(lambda x: not isinstance(x, AnyOf)).map(NoneOf))
    return st.one_of(some.map(lambda x: All(*x)), some.map(lambda x: AnyOf(*x)), none)


@settings(max_examples=300, deadline=None)
@given(st.recursive(_clause, _groups, max_leaves=8))
def test_render_then_parse_is_the_same_tree(tree):
    text = X.render(tree)
    assert X.parse(text) == tree
    assert X.render(X.parse(text)) == text and X.parse(f" ( {text} ) ") == tree and X.same(tree, X.parse(text))


def test_renaming_a_collection():
    rule = X.parse("合集=甲,甲乙 且 作品~甲 且 都不(合集!=甲)")
    assert X.render(X.renamed(rule, "collections", "甲", "丙")) == "合集=丙,甲乙 且 作品~甲 且 都不(合集!=丙)"
    assert X.renamed(rule, "collections", "乙", "丙") == rule
    assert X.any_of([A]) == A and X.any_of([A, B]) == AnyOf(A, B)


FACTS = [(1, "GB", ["En", "Zh"], 1989, 0.9, 10), (2, "gba", ["Ja"], 1995, None, 70 << 20), (3, None, [], None, 0.2, None), (4, "SFC", None, 1995, 0.5, 64 << 20)]
TEXTS = {"one": "平台=gb,GBA", "not": "平台!=GB", "lang": "语言=zh 或 语言=Ja", "deny": "都不(年份>=1990)", "mix": "体积>=64MiB 且 (评分>=50% 或 都不(语言=En))", "none": "平台=X"}


def test_hits_and_gains(spark):
    facts = spark.createDataFrame(FACTS, "id int, platform string, languages array<string>, year int, rating double, size long")
    got = {}
    for r in X.hits(facts, "id", TEXTS, multi={"languages"}).collect():
        got.setdefault(r.rule, set()).add(r.id)
    assert got == {"one": {1, 2}, "not": {2, 3, 4}, "lang": {1, 2}, "deny": {1, 3}, "mix": {2, 4}}
    plan = X.hits(facts, "id", TEXTS, multi={"languages"})._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert X.hits(facts, "id", {}).count() == 0
    columns = {c: F.col(c) for c in facts.columns}
    trees = {k: X.parse(v) for k, v in TEXTS.items()}
    each = {k: {r.id for r in filter_by(facts, v, columns, {"languages"}).collect()} for k, v in trees.items()}
    had = each["one"]
    gain = {r.rule: (r.hits, r.added, r.added_total) for r in X.gains(facts, [trees["one"]], trees, "size", columns, {"languages"}).collect()}
    size = {r[0]: r[5] or 0 for r in FACTS}
    assert gain == {k: (len(v), len(v - had), sum(size[i] for i in v - had)) for k, v in each.items()}
    assert X.gains(facts, [], {}, "size").count() == 0


def test_checked_rows(spark):
    df = spark.createDataFrame([(1, " ( 平台=GB ) "), (2, "x"), (3, None), (4, "平台=GB 且 年份>1990")], "id int, rule string")
    assert sorted(tuple(r) for r in X.checked(df).drop("rule").collect()) == [(1, "平台=GB", None, None, 1), (2, None, "no operator", 0, None), (3, None, "empty", 0, None), (4, "平台=GB 且 年份>1990", None, None, 2)]
    assert X.checked(df.limit(0)).count() == 0
