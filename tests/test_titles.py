from shelfmark.operators import matching
from shelfmark.plans import matches  # noqa: F401
from shelfmark.plans.registry import QUERIES


def test_fuzzy_titles_take_pages_and_whole_documents(spark, tmp_path):
    """English texts, short titles and letters far behind in long texts count."""
    long = "some words of a long text " * 20
    texts = [(1, "en", long + "fin"), (2, None, long + "finé"), (3, "de", long + "other"), (4, "en", "Ab"), (5, "fr", None), (6, "fr", "é")]
    spark.createDataFrame(texts, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "<title>ab</title>"), (2, "<title></title>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r)[:2] for r in QUERIES["fuzzy_titles"](spark, str(tmp_path)).collect())
    assert got == [("d1", "d1"), ("d1", "d2"), ("d2", "d1"), ("d2", "d2"), ("d3", "d3"), ("d4", "d4"), ("d4", "p1"), ("d6", "d6"), ("p1", "d4"), ("p1", "p1")]


def test_fuzzy_lookup_of_long_keys(spark):
    """Long keys that differ in few letters have the Dice of all their bigrams, repeats included."""
    a = "日本語文章" * 300
    b = a[:700] + "語" + a[701:]
    q = spark.createDataFrame([("a", a), ("b", b)], "query_id string, query_key string")
    n = spark.createDataFrame([("n", b), ("m", a[:400])], "name_id string, name_key string")
    got = {r.query_id: r.score for r in matching.fuzzy_lookup(q, n).collect()}
    assert got["b"] == 1.0 and abs(got["a"] - 2 * 1497 / 2998) < 1e-12 and len(got) == 2
