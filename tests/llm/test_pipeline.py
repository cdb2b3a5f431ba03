import corpus_pipeline as C
import pytest
from test_decontaminate import brute as brute_leaks
from test_lines import brute as brute_lines
from test_sentencepieces import LIB
from test_simhash import brute as brute_groups

from shelfmark.llm import lines, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for k, (_, f) in enumerate(C.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_each_stage_does_its_whole_job(spark, sf, stages):
    assert all(set(s.columns) == set(stages[0].columns) for s in stages[1:5])
    a, b, c, d, e, f = (by_id(s) for s in stages)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in quality.scores(stages[0], quality.train(stages[0], labels)).collect()}
    assert set(b) == {i for i in a if scores[i]} and all(b[i] == a[i] for i in b)
    bad = {r.doc_id for r in labels.collect() if not r.quality}
    assert len(bad & set(b)) <= 0.3 * len(bad) and len(b) >= 0.8 * len(a)
    want = {i: t for i, t, _, _ in brute_lines([(i, r.text, r.source) for i, r in b.items()], lines.MIN_SITES)}
    assert {i: r.text for i, r in c.items()} == want
    groups = brute_groups([(i, r.text) for i, r in c.items()])
    assert set(d) == {i for i, _, low in groups if i == low} and all(d[i] == c[i] for i in d)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {x[0] for x in brute_leaks([(i, r.text) for i, r in d.items()], items)}
    assert set(e) == set(d) - leaked and all(e[i] == d[i] for i in e)
    assert {i: list(r.ids) for i, r in f.items()} == {i: LIB.encode(r.text or "") for i, r in e.items()} and all(r.round_trip for r in f.values())


def test_run(spark, sf, stages):
    assert {r.doc_id: list(r.ids) for r in C.run(spark, sf).collect()} == {r.doc_id: list(r.ids) for r in stages[-1].collect()}


def test_cases(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "x" * 50_000, None, None, 1), (2, "x" * 50_000, None, None, 1), (None, "plain words", "en", "s", 3), (2, "other words", "en", "s", 1), (None, "plain words", "en", "t", 3)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("_id_", C.F.lit(1))
    want = {"line dedup": 7, "SimHash near-dedup": 4, "benchmark decontamination": 7}  # two texts without words are a group
    for some in (docs, docs.limit(0)):
        for name, f in C.STAGES[:4]:
            out = f(spark, some, sf)
            assert set(out.columns) == set(docs.columns)
            n = out.count()
            assert some is not docs or name not in want or n == want[name], (name, n)
        C.STAGES[4][1](spark, some, sf).collect()
    left = C.near_dedup(spark, docs, sf).collect()
    assert sorted((r.doc_id for r in left), key=str) == [1, 2, 2, None]


def test_one_bad_row_takes_no_other_with_it(spark, sf):
    """Rows of one id, or without one, are decided by their own texts."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(None, item, "en", "s", 1), (None, "clean words", "en", "s", 1), (7, item, "en", "s", 1), (7, "clean words too", "en", "s", 1)]
    assert sorted(r.text for r in C.decontaminated(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()) == ["clean words", "clean words too"]


def test_columns_of_any_name_pass_through(spark, sf, tmp_path):
    """All stages but the last return every column of docs as it was, whatever it is called."""
    names = ["n_lines", "n_removed", "_id", "_hash", "_gone", "k1", "fp", "row", "doc", "score"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    docs = docs.select("*", *[(docs.doc_id * (k + 2)).alias(n) for k, n in enumerate(names)])
    for k, (_, f) in enumerate(C.STAGES[:4]):
        f(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars", *names}
        got = docs.collect()
        assert got and all(r[n] == r.doc_id * (j + 2) for r in got for j, n in enumerate(names))
