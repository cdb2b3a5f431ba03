from shelfmark.sources import kept as K

LIST = """<?xml version="1.0"?>\r
<!-- mine; <game><path>./no.zip</path></game> -->\r
<gameList>\r
\t<game id="7">\r
\t\t<path>./a &amp; b.zip</path>\r
\t\t<name>Old</name>\r
\t\t<unknown x="1">kept <![CDATA[<b>]]></unknown>\r
\t</game>\r
  <folder><path>./f</path></folder>
  <game><path>./c.zip</path><name>Same &lt;1&gt;</name><rating/></game>

</gameList>
<!-- end -->"""

LINES = """# a comment
collection: GB
extension: zip

game: One
file: a.zip
x-own: kept
description: first
  second
  .
  third

# between
game: Two
files:
  b.zip
  c.zip
rating: 80%"""


def frame(spark, *files):
    return spark.createDataFrame(files, "file string, text string")


def own(spark, *rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "file string, key string, field string, value string, ordinal int")


def texts(df):
    return {r.file: r.text for r in df.collect()}


def test_segments_are_the_whole_text(spark):
    files = frame(spark, ("l", LIST), ("e", ""), ("odd", "<game>never ends"))
    assert {(r.file, r.identical, r.line) for r in K.round_trips(files, K.LIST).collect()} == {("l", True, None), ("e", True, None), ("odd", True, None)}
    assert [r.key for r in K.segments(files, K.LIST).where("key is not null").orderBy("ordinal").collect()] == ["./a & b.zip", "./c.zip"]
    files = frame(spark, ("k", LINES), ("crlf", LINES.replace("\n", "\r\n")))
    assert all(r.identical for r in K.round_trips(files, K.LINES).collect())
    got = sorted((r.file, r.key) for r in K.segments(files, K.LINES).where("key is not null").collect())
    assert got == [("crlf", "a.zip"), ("crlf", "b.zip"), ("k", "a.zip"), ("k", "b.zip")]


def test_own_values_go_into_a_list(spark):
    files = frame(spark, ("l", LIST), ("same", LIST), ("new", None))
    mine = own(spark, ("l", "./a & b.zip", "name", "New & <better>"), ("l", "./a & b.zip", "genre", "RPG"), ("l", "./c.zip", "name", "Same <1>"), ("l", "./c.zip", "rating", "0.5"), ("l", "./d.zip", "name", "D"), ("same", "./c.zip", "name", "Same <1>"), ("new", "./x.zip", "name", "X"), ("l", None, "name", "no key"))
    out = K.merged(files, mine, K.LIST)
    got = texts(out)
    want = LIST.replace("<name>Old</name>", "<name>New &amp; &lt;better&gt;</name>").replace("</unknown>\r\n", "</unknown>\r\n\t\t<genre>RPG</genre>\r\n").replace("<rating/>", "<rating>0.5</rating>")
    want = want.replace("</gameList>", "\t<game>\n\t\t<path>./d.zip</path>\n\t\t<name>D</name>\n\t</game>\n</gameList>")
    assert got["l"] == want
    assert got["same"] == LIST
    assert got["new"] == "<?xml version=\"1.0\"?>\n<gameList>\n\t<game>\n\t\t<path>./x.zip</path>\n\t\t<name>X</name>\n\t</game>\n</gameList>\n"
    assert {(r.file, r.changed, r.added) for r in out.collect()} == {("l", 2, 1), ("same", 0, 0), ("new", 0, 1)}
    again = K.merged(out.select("file", "text"), mine, K.LIST)
    assert texts(again) == got  # a second time changes nothing
    gone = K.merged(files.where("file = 'l'"), own(spark, ("l", "./a & b.zip", "unknown", None)), K.LIST)
    assert texts(gone)["l"] == LIST.replace("\r\n\t\t<unknown x=\"1\">kept <![CDATA[<b>]]></unknown>", "")


def test_own_values_go_into_lines(spark):
    crlf = LINES.replace("\n", "\r\n")
    mine = [("a.zip", "description", "first\nsecond\n\nthird"), ("a.zip", "developer", "Dev"), ("b.zip", "rating", "90%"), ("d.zip", "game", "Four"), ("d.zip", "summary", "a\n\nb")]
    files = frame(spark, ("k", LINES), ("crlf", crlf), ("new", ""))
    out = K.merged(files, own(spark, *[("k", *m) for m in mine], *[("crlf", *m) for m in mine[:3]], ("new", "n.zip", "rating", "1")), K.LINES)
    got = texts(out)
    change = lambda t, end: t.replace(f"third{end}", f"third{end}developer: Dev{end}" if False else f"third{end}").replace("rating: 80%", f"rating: 90%{end}")
    assert "# between" in got["k"] and "x-own: kept" in got["k"] and "developer: Dev\n" in got["k"]
    assert got["k"].endswith("rating: 90%\n\ngame: Four\nfile: d.zip\nsummary: a\n  .\n  b\n")
    assert got["k"].replace("developer: Dev\n", "").startswith(change(LINES, "\n"))
    assert got["crlf"].replace("developer: Dev\r\n", "") == change(crlf, "\r\n")
    assert got["new"] == "game: n.zip\nfile: n.zip\nrating: 1\n"
    again = K.merged(out.select("file", "text"), own(spark, *[("k", *m) for m in mine]), K.LINES)
    assert texts(again)["k"] == got["k"]


def test_losses_and_states(spark):
    mine = own(spark, ("l", "a", "name", "ok"), ("l", "a", "name", "bell\x07"), ("l", "a", "x-own", "v"), ("l", "a", "name", None))
    assert sorted((r.field, r.why) for r in K.losses(mine, K.LIST).collect()) == [("name", "characters"), ("x-own", "no such field")]
    assert [(r.value, r.why) for r in K.losses(own(spark, ("k", "a", "summary", "a\n.\nb"), ("k", "a", "summary", "a.b\nc")), K.LINES).collect()] == [("a\n.\nb", "characters")]
    targets = frame(spark, ("n", None), ("a", "x"), ("c", "changed"), ("u", "theirs"))
    shots = spark.createDataFrame([("a", 1, "old"), ("a", 2, "x"), ("c", 1, "was")], "file string, at int, text string")
    assert {(r.file, r.state, r.write) for r in K.export_states(targets, shots).collect()} == {("n", "new", True), ("a", "aligned", True), ("c", "changed", False), ("u", "unknown", False)}
    assert all(r.write for r in K.export_states(targets, shots, force=True).collect())
    assert K.merged(targets.limit(0), mine.limit(0), K.LIST).count() == 0
