from shelfmark.operators import browse


def test_details_are_cut_to_the_page(spark):
    subjects = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n"), (4, "none")], "id int, name string")
    files = spark.createDataFrame([(1, k, f"f{k}") for k in range(300)] + [(2, 5, "x"), (2, 3, None), (None, 1, "no"), (9, 1, "other")], "id int, at int, n_files string")
    titles = spark.createDataFrame([(4, "t")], "id int, title string")
    out = browse.details(subjects, "id", {"files": (files, ["at"]), "titles": (titles, ["title"])}, most=3).collect()
    got = sorted(((r.id, [tuple(f) for f in r.files], r.n_files, [t.title for t in r.titles], r.n_titles) for r in out), key=str)
    two = (2, [(3, None), (5, "x")], 2, [], 0)
    assert got == sorted([(1, [(0, "f0"), (1, "f1"), (2, "f2")], 300, [], 0), two, two, (None, [], 0, [], 0), (4, [], 0, ["t"], 1)], key=str)
    assert browse.details(subjects.limit(0), "id", {"files": (files, ["at"])}).count() == 0
