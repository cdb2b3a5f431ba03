import hashlib

import duckdb

from shelfmark.llm import lines as L


def brute(rows, min_sites):
    sites, keeper = {}, {}
    for i, text, site in rows:
        for x in (text or "").split("\n"):
            x = x.strip(" \t\r")
            if x:
                sites.setdefault(x, set()).add(site)
                if i is not None:
                    keeper[x] = min(i, keeper.get(x, i))
    bad = {x for x, s in sites.items() if len(s - {None}) >= min_sites}
    out = []
    for i, text, _ in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if not (x.strip(" \t\r") in bad and keeper.get(x.strip(" \t\r")) != i)]
        out.append((i, text if len(kept) == len(all_) else "\n".join(kept), len(all_), len(all_) - len(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in df.collect()), key=str)


def test_cases(spark):
    common = "Accept all cookies"
    rows = [(i, f"own line {i}\n {common}\t\r\n\nend {i}", f"s{i}") for i in range(6)]
    rows += [(7, None, "s7"), (8, "", "s8"), (None, common, "s9"), (9, common + "\n" + common, None), (3, common + "\nother", "s3"), (3, common + "\nother", "s3"), (10, "x\n" * 20_000 + common, "s1"), (11, "two sites", "s1"), (12, "two sites", "s2"), (13, "two sites", "s2"), (-1, "a", "s0"), (14, "last\n" + common + "\n", "s2")]
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, source string, h1 string, n_lines int")
    for sites in (2, 3, 6, 7, 8):
        got = L.without_boilerplate(docs, sites)
        assert result(got) == brute(rows, sites), sites
        assert set(got.columns) == {*docs.columns, "n_removed"}
    assert L.without_boilerplate(docs.limit(0)).count() == 0


def test_names_that_clash(spark):
    names = ["h1", "h2", "pos", "keeper", "gone", "_id", "_hash", "_gone", "text_hash", "row", "site", "line", "n_lines", "n_removed", "a.b"]
    docs = spark.createDataFrame([(i, f"common\nown {i}", f"s{i}", *range(len(names))) for i in range(5)], f"doc_id long, text string, source string, {', '.join(f'`{n}` long' for n in names)}")
    got = L.without_boilerplate(docs, 3, counts=False)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"own {i}" if i else "common\nown 0", f"s{i}", *range(len(names))) for i in range(5)]
    assert {(r.n_lines, r.n_removed) for r in L.without_boilerplate(docs, 3).collect()} == {(2, 0), (2, 1)}


def test_many_sites_near_the_threshold(spark):
    rows = [(100 * k + i, f"line {k}", f"s{i % k}") for k in range(30, 60) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert result(L.without_boilerplate(docs, 45)) == brute(rows, 45)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert result(L.without_boilerplate(docs)) == brute(rows, L.MIN_SITES)
    got = sorted(tuple(r) for r in L.op4_line_dedup(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(con.execute("select doc_id, n_lines, n_removed, clean_chars, clean_md5 from (" + L.ORACLE_SQL + ")").fetchall())
    assert hashlib.md5(b"").hexdigest() != got[0][4] and any(r[2] for r in got)
