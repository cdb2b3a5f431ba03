import pytest
from pyspark.sql import functions as F

from shelfmark.functions import naming as N

RULES = N.name_rules("""
"版本" = 1
"汉化组词" = ["汉化", "字幕组"]
"汉化组名" = ["星组", "PSPchina"]
"语言地区" = ["简", "JP", "日文", "美版", "En"]
"版本模式" = ["v#*", "第#版"]
"容量模式" = ["#*Mb"]
"记号噪音" = ["!", "完美"]
"正题噪音词" = ["汉化版", "汉化", "简体中文版", "中文"]
"分类词" = ["智力", "AVG", "休闲益智"]
"平台前缀" = ["GBC", "FC", "NGC", "GBA"]
"编号分隔" = [".", "-", " ", "、"]
""")

NAMES = {
    "超级机器人大战R[星组](v1.2+)(简)(JP)(68.92Mb).zip": ("超级机器人大战R", "星组", "v1.2+", ["简", "JP"], None, []),
    "我的暑假[简体汉化版][某某某汉化组]": ("我的暑假", "简体汉化版", None, [], None, []),
    "71.智力：仙界異聞録.zip": ("仙界異聞録", None, None, [], None, []),
    "1741 - 梦想灯笼 [简] [PSPchina].7z": ("梦想灯笼", "PSPchina", None, ["简"], None, []),
    "1942.nes": ("1942", None, None, [], None, []),
    "2048.zip": ("2048", None, None, [], None, []),
    "GBC海贼王.cia.zip": ("海贼王", None, None, [], None, []),
    "FC唐老鸭大冒险2汉化.zip": ("唐老鸭大冒险2", None, None, [], None, []),
    "GBA.zip": ("GBA", None, None, [], None, []),
    "【真·三国无双】": ("真·三国无双", None, None, [], None, []),
    "[NGC][0510]太空堡垒[AVG](1990)(!)[what].iso": ("太空堡垒", None, None, [], 1990, ["what"]),
    "PROJECT X ZONE 0004008c00073900": ("PROJECT X ZONE", None, None, [], None, []),
    "恶魔城-美版-休闲益智_v97.gba": ("恶魔城", None, None, ["美版"], None, []),
    "口袋妖怪(日": ("口袋妖怪(日", None, None, [], None, []),
    "龙.骑.士 Dragon Quest.7z.001": ("龙骑士 Dragon Quest", None, None, [], None, []),
    "v1.8B（2023.2.1）": ("v1.8B", None, None, [], None, ["2023.2.1"]),
    "3.2": ("3.2", None, None, [], None, []),
    "a[b": ("a[b", None, None, [], None, []),
    "": ("", None, None, [], None, []),
}


def test_names(spark):
    df = spark.createDataFrame([(n, 1) for n in NAMES] + [(None, 2)], "name string, _keep int")
    got = {r.name: r for r in N.parsed(df, "name", RULES).collect()}
    for n, want in NAMES.items():
        r = got[n]
        assert (r.title, r.team, r.version, r.languages, r.year, r.unknown) == want, (n, r)
    assert got[None].title is None and got[None]._keep == 2
    r = got["恶魔城-美版-休闲益智_v97.gba"]
    assert [tuple(t) for t in r.taken] == [(".gba", "extension"), ("v97", "version"), ("休闲益智", "genre"), ("美版", "language")]
    r = got["龙.骑.士 Dragon Quest.7z.001"]
    assert (r.chinese, r.latin) == ("龙骑士", "Dragon Quest") and [t.what for t in r.taken] == [".001", ".7z"]
    r = got["71.智力：仙界異聞録.zip"]
    assert [tuple(t) for t in r.taken] == [(".zip", "extension"), ("71.", "number"), ("智力", "genre")] and r.chinese == "仙界異聞録" and r.latin is None
    plan = N.parsed(df, "name", RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert N.parsed(df, "name", N.NameRules()).where("name = 'a[b'").first().title == "a[b"


def test_rule_files():
    more = N.name_rules('"版本" = 1\n"语言地区" = ["Fr"]', RULES)
    assert more.languages == ("Fr", *RULES.languages) and more.team_words == RULES.team_words
    assert N.name_rules('"版本" = 1\n"继承内置" = false', RULES) == N.NameRules()
    with pytest.raises(ValueError, match="version 2"):
        N.name_rules('"版本" = 2')


def test_classified(spark):
    want = {
        "lib/a/GAME.ZIP": ("container", None, False), "x.chd": ("compressed image", None, False), "x.GBA": ("bare file", None, False), "x.md": ("bare file", None, False), "cover.png": ("media", None, False), "gamelist.xml": ("media", None, False),
        "read.txt": ("unclassified", "document", False), "emu.exe": ("unclassified", "program", False), "a.iso.part": ("unclassified", "partial download", False), "lib/.DS_Store": ("unclassified", "system junk", False), "._a.zip": ("unclassified", "system junk", False),
        "x.7z.001": ("container", None, False), "x.7z.002": ("container", None, True), "x.z01": ("container", None, True), "x.part1.rar": ("container", None, False), "x.part02.rar": ("container", None, True), "x.unknownext": ("unclassified", None, False), "noext": ("unclassified", None, False),
    }
    df = spark.createDataFrame([(k,) for k in want] + [(None,)], "key string")
    got = {r.key: r.c for r in df.select("key", N.classified(F.col("key")).alias("c")).collect()}
    assert got.pop(None) is None
    assert {k: tuple(v) for k, v in got.items()} == want
